"""Byte-level BPE encoding and decoding by prefix dynamic programming.

The text is split by the vocabulary's pattern; each match is encoded on its own.
Within a match every byte prefix has exactly one valid last token: the token
that ends the encoding of that prefix.  A token t that ends at byte e is that
last token when the prefix before t has last token p and the merges would leave
the pair (p, t) alone, so one pass over the tokens that end at each byte (an
Aho-Corasick automaton) fills the table, and following it back from the end
gives the ids.  The table is what makes changes cheap and exact:

* ``PrefixTable.append`` continues after the last byte;
* ``PrefixTable.replace`` redoes the bytes after a change until the last tokens
  agree with the old ones for as many bytes as the longest token has; from
  there on everything agrees;
* ``update`` does the same for stored encodings of whole texts: matches before
  a change and after the point where the matches fall into step again keep
  their ids.

Distinct matches are encoded once per Python worker while the table of them has
room; others are encoded where they occur.

Defined results: null text counts as empty (no ids, nothing decoded); a text is
never cut, however long; repeated rows give repeated results; null doc_ids are
kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tokenizer_path

RANKS = "byte_bpe_50k.tiktoken"
#: Distinct matches (of at most LONGEST characters) and token pairs that a worker keeps.
ROOM, LONGEST, PAIR_ROOM = 500_000, 32, 1_000_000
#: Characters behind a match that can decide where the match ends ("'re" and "'ll" look two ahead).
LOOK_AHEAD = 3
_NO_TOKEN = -1
_SPACE_ASCII = "\t-\r "


class Vocabulary:
    """Tokens by rank, the split of each token, and which pairs of tokens hold."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.length = [len(t) for t in self.bytes_of]
        self.longest = max(self.length)
        self._joined: dict[int, int] = {}   # pair key -> rank of the token that the pair merges into
        self._parts: list = [None] * self.size
        self._pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.made = [False] * self.size     # the merges build the token out of its bytes
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self.automaton.add_word(token.decode("latin-1"), rank)
            if len(token) == 1:
                self.made[rank] = True
                continue
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if (a is not None and b is not None and a < rank and b < rank and self.made[a] and self.made[b]
                        and self._stands(a, b)):
                    self._joined[a * self.size + b] = rank
                    self._parts[rank] = (a, b)
                    self.made[rank] = True
                    break
        self.automaton.make_automaton()
        self._pairs.clear()

    def _stands(self, left: int, right: int) -> bool:
        """Whether the merges keep ``left`` and ``right`` apart.

        Both tokens are taken apart again, latest merge first; between two steps
        the parts that touch would have been merged if their joint rank comes
        before the merge that is undone next.  At equal ranks the merge further
        left goes first."""
        until = self.size  # merges of lower rank have been done while these two parts touched
        while True:
            joint = self._joined.get(left * self.size + right)
            if joint is not None and joint < until:
                return False
            of_left, of_right = self._parts[left], self._parts[right]
            if of_left is None and of_right is None:
                return True
            if of_right is None or (of_left is not None and left > right):
                until, left = left, of_left[1]
            else:
                until, right = right + 1, of_right[0]

    def holds(self, left: int, right: int) -> bool:
        key = left * self.size + right
        known = self._pairs.get(key)
        if known is None:
            known = self._stands(left, right)
            if len(self._pairs) < PAIR_ROOM:
                self._pairs[key] = known
        return known

    def fill(self, data: bytes, last: list[int], start: int) -> None:
        """Last tokens of the prefixes of ``data`` that end behind ``start``;
        ``last`` holds those up to ``start`` and is extended."""
        at = max(0, start - self.longest + 1)
        shift, length, made, pairs, size = at + 1, self.length, self.made, self._pairs, self.size
        last.extend([_NO_TOKEN] * (len(data) - start))
        for end, token in self.automaton.iter(data[at:].decode("latin-1")):
            end += shift
            if end <= start or last[end] >= 0:
                continue
            begin = end - length[token]
            if begin == 0:
                if made[token]:
                    last[end] = token
                continue
            before = last[begin]
            known = pairs.get(before * size + token)
            if known or (known is None and before >= 0 and made[token] and self.holds(before, token)):
                last[end] = token

    def encode(self, data: bytes) -> list[int]:
        """Ids of one match."""
        whole = self.ranks.get(data)
        if whole is not None:  # a match that is a token needs no merges
            return [whole]
        last = [_NO_TOKEN]
        self.fill(data, last, 0)
        return self.walk(last)

    def walk(self, last: list[int]) -> list[int]:
        ids, at = [], len(last) - 1
        while at > 0:
            ids.append(last[at])
            at -= self.length[last[at]]
        ids.reverse()
        return ids


class PrefixTable:
    """The last token of each byte prefix of one match."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [_NO_TOKEN]
        self.append(data)

    def append(self, more: bytes) -> None:
        start, self.data = len(self.data), self.data + more
        self.vocabulary.fill(self.data, self.last, start)

    def replace(self, start: int, drop: int, new: bytes) -> int:
        """Puts ``new`` in place of ``drop`` bytes at ``start``; returns how many
        prefixes were computed anew."""
        old, stop = self.last, start + drop
        data = self.data[:start] + new + self.data[stop:]
        last, done, shift = old[:start + 1], start, len(new) - drop
        step = self.vocabulary.longest
        # whole windows of the longest token's length behind the change must agree
        target = min(len(data), start + len(new) + step)
        while True:
            self.vocabulary.fill(data[:target], last, done)
            computed, done = target - start, target
            if target == len(data):
                break
            behind = last[target - step + 1:]
            if target - step >= start + len(new) and behind == old[target - step + 1 - shift:target + 1 - shift]:
                last.extend(old[target + 1 - shift:])
                break
            target = min(len(data), target + step)
        self.data, self.last = data, last
        return computed

    def ids(self) -> list[int]:
        return [self.vocabulary.ranks[self.data]] if self.data in self.vocabulary.ranks else self.vocabulary.walk(self.last)


def _as_ranges(points: list[int]) -> str:
    out, begin = [], None
    for k, p in enumerate(points):
        begin = p if begin is None else begin
        if k + 1 == len(points) or points[k + 1] != p + 1:
            out.append(f"\\U{begin:08x}-\\U{p:08x}")
            begin = None
    return "".join(out)


class Splitter:
    """The matches of the pattern, as the encoding library finds them.

    The library's letters and numbers are those of its own Unicode version; they
    are read off the library, and texts that hold a character on which the
    ``regex`` package differs are split with spelled-out classes."""

    def __init__(self, pattern: str):
        import public_tokenizers
        import regex
        import tiktoken
        self.pattern = regex.compile(pattern)
        singles = {bytes([b]): b for b in range(256)}
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        sets, odd = {}, set()
        for name in (r"\p{L}", r"\p{N}", r"\s"):
            own = bytes(tiktoken.Encoding("class", pat_str=name, mergeable_ranks=singles, special_tokens={}).encode_ordinary(every)).decode()
            sets[name] = own
            odd |= set(own).symmetric_difference(regex.findall(name, every))
        self.odd = regex.compile(f"[{_as_ranges(sorted(map(ord, odd)))}]") if odd else None
        self.odd_from = min(odd, default="\U0010ffff")
        self.spelled = self.pattern
        if odd:
            ranges = {name: _as_ranges(sorted(map(ord, own))) for name, own in sets.items()}
            inside = "".join(ranges[n] for n in (r"\s", r"\p{L}", r"\p{N}"))
            spelled = (pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{inside}]").replace(r"\p{L}", f"[{ranges[chr(92) + 'p{L}']}]")
                       .replace(r"\p{N}", f"[{ranges[chr(92) + 'p{N}']}]").replace(r"\S", f"[^{ranges[chr(92) + 's']}]")
                       .replace(r"\s", f"[{ranges[chr(92) + 's']}]"))
            self.spelled = regex.compile(spelled)
        # the same pattern on plain ASCII texts (alternatives that begin differently may change places)
        plain = (f" ?[A-Za-z]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^{_SPACE_ASCII}A-Za-z0-9]+"
                 f"|[{_SPACE_ASCII}]+(?![^{_SPACE_ASCII}])|[{_SPACE_ASCII}]+")
        self.plain = re.compile(plain) if pattern == public_tokenizers.PATTERN else None

    def _of(self, text: str):
        if self.plain is not None and text.isascii():
            return self.plain
        if self.odd is not None and max(text) >= self.odd_from and self.odd.search(text):
            return self.spelled
        return self.pattern

    def split(self, text: str) -> list[str]:
        return self._of(text).findall(text) if text else []

    def matches(self, text: str, start: int = 0):
        """(start, end) of the matches from ``start`` on."""
        return (m.span() for m in self._of(text).finditer(text, start)) if text else iter(())


class Encoder:
    """Splits, encodes and decodes; keeps the ids of distinct matches."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.vocabulary, self.splitter = Vocabulary(ranks), Splitter(pattern)
        self.kept = _Kept(self._encoded)

    def _encoded(self, match: str) -> bytes:
        ids = self.vocabulary.encode(match.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian 32-bit numbers."""
        return b"".join(map(self.kept.__getitem__, self.splitter.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, _ints(ids)))

    def state(self, text: str) -> tuple[bytes, list[int], list[int]]:
        """(ids, first character of each match, number of ids before each match)."""
        ids, starts, firsts, n = [], [], [], 0
        for a, b in self.splitter.matches(text):
            one = self.kept[text[a:b]]
            starts.append(a)
            firsts.append(n)
            ids.append(one)
            n += len(one) // 4
        return b"".join(ids), starts, firsts

    def change(self, text: str, state: tuple[bytes, list[int], list[int]], at: int, drop: int, new: str):
        """(new text, new state) with ``new`` in place of ``drop`` characters at
        ``at``; only matches around the change are split and encoded again."""
        ids, starts, firsts = state
        result, shift = text[:at] + new + text[at + drop:], len(new) - drop
        # matches that end LOOK_AHEAD before the change stay
        keep = max(0, bisect.bisect_right(starts, at - LOOK_AHEAD) - 1)
        out_starts, out_firsts = starts[:keep], firsts[:keep]
        n = firsts[keep] if keep < len(firsts) else len(ids) // 4
        parts = [ids[:4 * n]]
        for a, b in self.splitter.matches(result, starts[keep] if keep < len(starts) else 0):
            if a >= at + len(new):  # from a match that began here before, all is as before
                k = bisect.bisect_left(starts, a - shift)
                if k < len(starts) and starts[k] == a - shift:
                    parts.append(ids[4 * firsts[k]:])
                    out_firsts += [f - firsts[k] + n for f in firsts[k:]]
                    out_starts += [s + shift for s in starts[k:]]
                    break
            one = self.kept[result[a:b]]
            out_starts.append(a)
            out_firsts.append(n)
            parts.append(one)
            n += len(one) // 4
        return result, (b"".join(parts), out_starts, out_firsts)


class _Kept(dict):
    """Match → value, computed when first asked for and kept while there is room."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, match: str):
        value = self.compute(match)
        if len(self) < ROOM and len(match) <= LONGEST:
            self[match] = value
        return value


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(ranks: str = RANKS, pattern: str | None = None) -> Encoder:
    """The worker's encoder for a rank file and pattern."""
    import public_tokenizers
    key = (tokenizer_path(ranks), pattern or public_tokenizers.PATTERN)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


_STATE = [pa.field("ids", pa.list_(pa.int32())), pa.field("match_starts", pa.list_(pa.int32())),
          pa.field("match_ids", pa.list_(pa.int32()))]
_STATE_DDL = "ids array<int>, match_starts array<int>, match_ids array<int>"


def _ints(raw: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


def encode_decode(docs: DataFrame, ranks: str = RANKS, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit
    numbers), decoded_sha256 (the bytes the ids stand for)."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        coder, sha = encoder(ranks, pattern), hashlib.sha256
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for text in batch.column("text"):
                ids = coder.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                of_ids.append(sha(ids).hexdigest())
                of_text.append(sha(coder.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, ranks: str = RANKS, pattern: str | None = None) -> DataFrame:
    """doc_id, text, ids, and the state ``update`` needs: ``match_starts`` (first
    character of each match) and ``match_ids`` (ids before each match)."""
    small_batches(docs.sparkSession)
    schema = pa.schema([pa.field("doc_id", pa.int64()), pa.field("text", pa.string()), *_STATE])

    def run(batches):
        coder = encoder(ranks, pattern)
        for batch in batches:
            states = [coder.state(t.as_py() or "") for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), batch.column("text").cast(pa.string()),
                                   pa.array([_ints(s[0]) for s in states], _STATE[0].type),
                                   *[pa.array([s[k] for s in states], _STATE[k].type) for k in (1, 2)]], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, text string, {_STATE_DDL}")


def update(encoded: DataFrame, changes: DataFrame, ranks: str = RANKS, pattern: str | None = None) -> DataFrame:
    """``encoded`` (of :func:`encode`) after ``changes`` (doc_id, at, drop, new):
    ``new`` replaces ``drop`` characters at ``at`` (counted from 0; an append has
    the text's length).  At most one change for each doc_id; rows without one
    stay as they are, a null ``new`` only drops."""
    schema = pa.schema([pa.field("doc_id", pa.int64()), pa.field("text", pa.string()), *_STATE])

    def run(batches):
        import numpy as np
        coder = encoder(ranks, pattern)
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                if r["at"] is not None:
                    state = (np.asarray(r["ids"], "<u4").tobytes(), r["match_starts"], r["match_ids"])
                    r["text"], (ids, r["match_starts"], r["match_ids"]) = coder.change(r["text"] or "", state, r["at"], r["drop"] or 0, r["new"] or "")
                    r["ids"] = _ints(ids)
            yield pa.RecordBatch.from_pylist([{f.name: r[f.name] for f in schema} for r in rows], schema=schema)

    small_batches(encoded.sparkSession)
    change = changes.select("doc_id", F.col("at").cast("int"), F.col("drop").cast("int"), F.col("new").cast("string"))
    return encoded.select("doc_id", "text", "ids", "match_starts", "match_ids").join(change, "doc_id", "left").mapInArrow(
        run, f"doc_id long, text string, {_STATE_DDL}")


def decode(encoded: DataFrame, ranks: str = RANKS, pattern: str | None = None) -> DataFrame:
    """doc_id and ``data`` (binary): the bytes that ``ids`` stand for."""
    schema = pa.schema([("doc_id", pa.int64()), ("data", pa.binary())])

    def run(batches):
        of = encoder(ranks, pattern).vocabulary.bytes_of.__getitem__
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array([b"".join(map(of, ids or [])) for ids in batch.column("ids").to_pylist()],
                                                                    pa.binary())], schema=schema)

    small_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")
