"""Language identification with a blended-spectrum string kernel.

A text is lower-cased and written in 32 symbols: a to z, five classes of other
letters (code point modulo 5), and one symbol for every run of non-letters.  Its
feature set holds the 1-, 2- and 3-grams that are present; the kernel of two
texts is the number of n-grams present in both over the root of the product of
their set sizes.

``train`` takes a labelled sample of the rows that are not held out: about
``per_lang`` documents of every language (with very many languages fewer, about
``SAMPLE`` in all but never under ``LEAST`` of one), drawn by hash, and of each
document one segment of ``SEGMENT`` characters, drawn by hash from all its
segments that hold a letter.  About ``landmarks`` of them (4 a language up to
``MOST_LANDMARKS``) span the Nyström feature space, in which kernel ridge
regression is solved for each language against the rest.  ``predict`` goes over whole texts in segments of
``SEGMENT`` symbols: a batch of presence rows times the landmark matrix gives
the kernel block, and times the weights the scores; a document's score is the
mean over its segments, weighted by their symbols.

Only text and lang of documents whose crc32(doc_id as text) modulo 5 is not 0
are learned from; predictions see the text alone.

Defined results: null text, or text without a letter, is ``und`` with score 0;
ties go to the alphabetically first language; when nothing could be learned all
documents are ``und``; repeated rows repeat their result; a null doc_id is not
held out and not learned from; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, kept, let, small_batches

PER_LANG, LANDMARKS, RIDGE, SEGMENT = 500, 128, 1e-3, 4096
SAMPLE, LEAST, MOST_LANDMARKS = 128_000, 32, 1024
SHARPNESS = 4.0
UND = "und"
#: Rows without one are ``und``.
LETTER = r"\p{L}"

_SIZE = 32 ** 3 + 32 ** 2 + 32


def _symbol_table() -> np.ndarray:
    t = np.zeros(1 << 16, np.uint8)
    for cp in range(1 << 16):
        if chr(cp).isalpha():
            t[cp] = cp - 96 if 97 <= cp <= 122 else 27 + cp % 5
    return t


_TABLE: list[np.ndarray] = []


def symbols(text: str) -> np.ndarray:
    """Symbols of a text, runs of non-letters as one 0."""
    if not _TABLE:
        _TABLE.append(_symbol_table())
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _TABLE[0][np.minimum(cp, (1 << 16) - 1)]
    if cp.size and cp.max() >= 1 << 16:
        for k in np.flatnonzero(cp >= 1 << 16):
            s[k] = 27 + cp[k] % 5 if chr(cp[k]).isalpha() else 0
    keep = s > 0
    keep[1:] |= s[:-1] > 0
    return s[keep]


def presence(segments: list[np.ndarray]) -> np.ndarray:
    """One row of 0/1 per segment: which 1-, 2- and 3-grams it holds."""
    out = np.zeros((len(segments), _SIZE), np.uint8)
    flat = out.reshape(-1)
    for k, s in enumerate(segments):
        x = s.astype(np.int32) + 0
        base = k * _SIZE
        flat[x + (base + 32 ** 3 + 32 ** 2)] = 1
        if len(x) > 1:
            two = x[:-1] * 32 + x[1:]
            flat[two + (base + 32 ** 3)] = 1
            if len(x) > 2:
                flat[two[:-1] * 32 + x[2:] + base] = 1
    return out


@dataclass
class KernelModel:
    langs: list[str]
    columns: np.ndarray   # n-grams that some landmark holds
    landmarks: np.ndarray  # (columns, landmarks), scaled by the landmarks' set sizes
    weights: np.ndarray   # (landmarks, langs)

    def kernel(self, segments: list[np.ndarray]) -> np.ndarray:
        b = presence(segments)
        size = np.maximum(b.sum(axis=1, dtype=np.int32), 1)
        return (b[:, self.columns].astype(np.float32) @ self.landmarks) / np.sqrt(size)[:, None].astype(np.float32)

    def scores(self, segments: list[np.ndarray]) -> np.ndarray:
        return self.kernel(segments) @ self.weights


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, per_lang: int = PER_LANG) -> list:
    """About ``per_lang`` rows (doc_id, lang, one segment of the text) of every language."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    rows = rows.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    counts = cut_lineage(rows.groupBy("lang").count(), "languages")
    each = min(per_lang, max(LEAST, SAMPLE // max(1, counts.count())))
    rate = counts.select("lang", (F.lit(each * 1.0) / F.col("count")).alias("rate"))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(1 << 30)
    picked = rows.join(rate, "lang").where(draw < F.col("rate"))
    # parts of equal length, none over SEGMENT characters, from the whole text
    parts = F.ceil(F.length("text") / SEGMENT).cast("int")
    size = F.ceil(F.length("text") / parts).cast("int")
    lettered = F.filter(F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.substring(F.col("text"), i * size + 1, size)),
                        lambda x: x.rlike(LETTER))
    one = let(lettered, lambda p: F.get(p, F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.size(p)).cast("int")))
    return sorted(picked.select("doc_id", "lang", one.alias("text")).collect(),
                  key=lambda r: (r["lang"], r["doc_id"], r["text"]))


def train(docs: DataFrame, per_lang: int = PER_LANG, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel | None:
    seen = [(r["lang"], symbols(r["text"])[:SEGMENT]) for r in training_sample(docs, per_lang)]
    seen = [(lang, s) for lang, s in seen if s.any()]
    if not seen:
        return None
    langs = sorted({lang for lang, _ in seen})
    by_lang = {lang: [k for k, (x, _) in enumerate(seen) if x == lang] for lang in langs}
    share = max(4, landmarks // len(langs))
    chosen = [rows[i] for rows in by_lang.values() for i in np.unique(np.linspace(0, len(rows) - 1, share).astype(int))]
    most = max(landmarks, MOST_LANDMARKS)
    if len(chosen) > most:
        chosen = [chosen[i] for i in np.unique(np.linspace(0, len(chosen) - 1, most).astype(int))]
    marks = presence([seen[k][1] for k in chosen])
    columns = np.flatnonzero(marks.any(axis=0))
    scaled = (marks[:, columns].T / np.sqrt(np.maximum(marks.sum(axis=1, dtype=np.int64), 1))).astype(np.float32)
    model = KernelModel(langs, columns, scaled, np.zeros((len(chosen), len(langs)), np.float32))
    k = np.concatenate([model.kernel([s for _, s in seen[a:a + 64]]) for a in range(0, len(seen), 64)]).astype(np.float64)
    inner = k[chosen]
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    good = value > 1e-8 * value.max()
    to_features = vector[:, good] / np.sqrt(value[good])
    phi = k @ to_features
    y = np.where(np.array([lang for lang, _ in seen])[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    w = np.linalg.solve(phi.T @ phi + ridge * len(seen) * np.eye(phi.shape[1]), phi.T @ y)
    model.weights = (to_features @ w).astype(np.float32)
    return model


def predict(docs: DataFrame, model: KernelModel | None, batch_segments: int = 64) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to ``docs`` (columns of these names are replaced)."""
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", lang_pred string, score double"

    def run(batches):
        kept("language")
        for batch in batches:
            segments, owner = [], []
            for k, text in enumerate(batch.column(names.index("text")).to_pylist()):
                s = symbols(text) if text and model else np.empty(0, np.uint8)
                if s.any():
                    segments += [s[a:a + SEGMENT] for a in range(0, len(s), SEGMENT)]
                    owner += [k] * (-(-len(s) // SEGMENT))
            pred, score = [UND] * batch.num_rows, [0.0] * batch.num_rows
            if segments:
                f = np.concatenate([model.scores(segments[a:a + batch_segments]) for a in range(0, len(segments), batch_segments)])
                weight = np.fromiter(map(len, segments), np.float64, len(segments))
                total = np.zeros((batch.num_rows, len(model.langs)))
                np.add.at(total, owner, f * weight[:, None])
                mass = np.bincount(owner, weight, batch.num_rows)
                for k in np.flatnonzero(mass):
                    mean = total[k] / mass[k]
                    e = np.exp(SHARPNESS * (mean - mean.max()))
                    best = int(mean.argmax())
                    pred[k], score[k] = model.langs[best], float(e[best] / e.sum())
            yield pa.record_batch([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                  names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def language_digest(docs: DataFrame, model: KernelModel | None) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return predict(rows, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
