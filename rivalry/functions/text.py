"""Token-level text helpers: regex tokens, truncation, tag extraction, ids."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from rivalry.functions.lists import strip_ws

# Word-or-punctuation tokens, Unicode aware (same class syntax in Java and RE2).
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c, pattern: str = TOKEN_PATTERN) -> Column:
    """Regex tokenizer (the default, JVM-side); a NULL text is treated as ''."""
    return F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(pattern), 0)


def token_count(c, pattern: str = TOKEN_PATTERN) -> Column:
    """Number of tokens."""
    return F.size(tokens(c, pattern))


def token_count_with(tokenize: Callable[[str], list]) -> Callable:
    """T9 with a user tokenizer (e.g. a subword model): an Arrow-batched pandas
    UDF calling ``tokenize(text)``; NULL text counts as ''.  The tokenizer is
    created once per Python worker when ``tokenize`` closes over it."""
    @F.pandas_udf("int")
    def _count(s: pd.Series) -> pd.Series:
        return s.fillna("").map(lambda t: len(tokenize(t))).astype("int32")
    return lambda c: _count(_c(c))


def truncate_tokens(c, max_len: int, pattern: str = TOKEN_PATTERN, sep: str = " ") -> Column:
    """First ``max_len`` tokens decoded back to text (joined by ``sep``)."""
    return F.array_join(F.slice(tokens(c, pattern), 1, max_len), sep)


def spread_truncate(token_arrays: list, max_len: int) -> Column:
    """Each field limited to ``max_len // n`` tokens, then concatenated."""
    per = max_len // len(token_arrays)
    return F.concat(*[F.slice(_c(t), 1, per) for t in token_arrays])


def extract_tag_blocks(c, tag: str) -> Column:
    """All ``<tag>…</tag>`` bodies (multiline, non-greedy), each stripped."""
    pat = f"(?s)<{tag}>(.*?)</{tag}>"
    return F.transform(F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(pat), 1), strip_ws)


def strip_special(c, marker: str) -> Column:
    """Text before the first ``marker``."""
    return F.substring_index(_c(c), marker, 1)


def md5_seed(c, modulo: int = 1001) -> Column:
    """A repeatable pseudo-random int in ``[0, modulo)`` from md5 of the key."""
    h = F.conv(F.substr(F.md5(_c(c).cast("string")), F.lit(1), F.lit(8)), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(modulo)).cast("int")


def md5_uuid(c) -> Column:
    """A repeatable UUID-shaped id (8-4-4-4-12 hex) from md5 of the key."""
    h = F.md5(_c(c).cast("string"))
    return F.concat_ws("-", *[F.substr(h, F.lit(s), F.lit(n)) for s, n in
                              ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def hash_coin(key, seed: int = 42) -> Column:
    """Deterministic fair coin: first md5 hex digit of ``seed:key`` is odd."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), _c(key).cast("string")))
    return F.instr(F.lit("13579bdf"), F.substr(h, F.lit(1), F.lit(1))) > 0
