"""Quality rules by distribution divergence.

Each document has two histograms: characters by class (upper case, digits,
punctuation, symbols, blanks, the rest) and words (the language's most common
words, one bin each, and all other words).  Both are compared with its language's
reference, the same histogram summed over all other documents of that language
(the document's own counts are taken off), by Jensen-Shannon distance (square
root of the divergence in bits: 0 equal, 1 disjoint).  A document is rejected
when a distance exceeds its limit.  Short texts scatter, so a limit grows by its
``slack / sqrt(words)``, and below ``min_words`` words no verdict is given beyond
the base rules.

Common words are words of at most ``common_letters`` letters; ``n_common`` are
kept per language (by count, then alphabetically).  The references hold one
short row per language, for every language in which at least two documents have
a word (one without common words has a word histogram of one bin); all other
documents are compared with the reference of all documents together.  Where no
other document has a word there is no reference: the distances are null and the
base rules decide.

Everything is built-in functions.  Repeated three-word windows are found by
their 64-bit hashes within one text.

Defined results: null text counts as empty (0 words, base_failed); repeated
rows repeat their result; null lang uses the common reference; texts are never
cut, however long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANK, cut_lineage, let

BLANK_CHARS = " \t\n\x0b\f\r"
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "punct": "[.,;:!?'\"()-]", "symbol": "[#*$%&|<>]", "blank": r"[\x20\x09-\x0D]"}
N_COMMON, COMMON_LETTERS = 24, 6
CHAR_LIMIT, CHAR_SLACK, WORD_LIMIT, WORD_SLACK, MIN_WORDS = 0.12, 1.2, 0.10, 2.6, 80


def with_words(docs: DataFrame) -> DataFrame:
    """doc_id, lang, t (text), words."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), t.alias("t"))
    trimmed = F.btrim("t", F.lit(BLANK_CHARS))
    return df.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK)))


FEW = 64  # repeated windows that are looked up one by one


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice."""
    def covered(starts):
        return let(starts, lambda p: F.aggregate(
            F.transform(p, lambda a, k: F.coalesce(F.least(F.get(p, k + 1) - a, F.lit(3)), F.lit(3))), F.lit(0), lambda acc, x: acc + x))

    def by_lookup(hashes, again):
        at = F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(again, h), i)), lambda i: i.isNotNull())
        return covered(at)

    def by_sorting(hashes):
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s):
            same = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
                            | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
            return covered(F.sort_array(F.transform(same, lambda x: x["i"])))

        return let(pairs, starts)

    def counted(hashes):
        again = let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda h, i: F.coalesce(h == F.get(s, i + 1), F.lit(False)))))
        # the same positions either way; looking up costs windows x repeated windows, sorting windows x log(windows)
        return let(again, lambda d: F.when(F.size(d) == 0, 0).when(F.size(d) <= FEW, by_lookup(hashes, d)).otherwise(by_sorting(hashes)))

    def windows(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return F.when(F.size(words) > 3, let(words, lambda w: let(windows(w), counted))).otherwise(0)


def base_counts(df: DataFrame, *more) -> DataFrame:
    t, words = F.col("t"), F.col("words")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    cols = {f"_{k}": F.regexp_count(t, F.lit(v)) for k, v in CLASSES.items()}
    df = df.select("doc_id", "lang", "words", F.size(words).cast("long").alias("n_words"),
                   F.length(t).cast("long").alias("_chars"), dup_lines.cast("long").alias("n_dup_lines"),
                   _repeat_words(words).cast("long").alias("n_repeat_words"), *more, *[c.cast("long").alias(k) for k, c in cols.items()])
    return df.withColumns({"word_chars": F.col("_chars") - F.col("_blank"), "n_symbols": F.col("_symbol"),
                           "_rest": F.col("_chars") - sum((F.col(f"_{k}") for k in CLASSES), F.lit(0))})


def common_words(docs: DataFrame, n_common: int = N_COMMON, common_letters: int = COMMON_LETTERS) -> DataFrame:
    """(lang, best): the most common words with their counts, array<struct<r, w, k>>,
    for each language and, with a null lang, for all documents together."""
    words = (with_words(docs).select("lang", F.explode("words").alias("w"))
             .where((F.length("w") <= common_letters) & F.col("w").rlike(r"^\p{L}+$")))
    words = cut_lineage(words.groupBy("lang", "w").agg(F.count("*").alias("k")), "word-counts")
    # the first words of each language by Spark's grouped top-k (a window limit is applied before the shuffle)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("k"), "w"))
    whole = words.groupBy("w").agg(F.sum("k").alias("k")).select(F.lit(None).cast("string").alias("lang"), "w", "k")
    both = words.where("lang IS NOT NULL").unionByName(whole)
    best = (both.withColumn("r", rank).where(F.col("r") <= n_common).groupBy("lang")
            .agg(F.sort_array(F.collect_list(F.struct("r", "w", "k"))).alias("best")).withColumnRenamed("lang", "_l"))
    # a language needs another document to be compared with
    langs = (docs.where(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]") & F.col("lang").isNotNull())
             .groupBy(F.col("lang").cast("string").alias("lang")).count().where("count > 1").select("lang"))
    langs = langs.unionByName(docs.sparkSession.range(1).select(F.lit(None).cast("string").alias("lang")))
    none = F.array().cast("array<struct<r:int,w:string,k:bigint>>")
    best = langs.join(best, F.col("lang").eqNullSafe(F.col("_l")), "left").select("lang", F.coalesce("best", none).alias("best"))
    return cut_lineage(best, "common-words")


def histograms(docs: DataFrame, common: DataFrame) -> DataFrame:
    """The base counts and both histograms of every document, in one pass over
    the texts: class counts ``_upper`` ..., ``_hits`` (occurrences of each common
    word of ``_ref``, the language compared with; null: all documents)."""
    df = with_words(docs)
    known = common.where("lang IS NOT NULL").select(F.col("lang").alias("_ref"), F.col("best").alias("_own"))
    whole = common.where("lang IS NULL").select(F.col("best").alias("_all"))
    # one short row per language, without a bound: broadcast only when it measures small
    df = df.join(known, F.col("lang") == F.col("_ref"), "left").join(F.broadcast(whole), F.lit(True), "left")
    names = F.transform(F.coalesce("_own", "_all", F.array().cast("array<struct<r:int,w:string,k:bigint>>")), lambda x: x["w"])
    df = df.withColumn("_names", names)
    hits = let(F.filter("words", lambda w: F.array_contains(F.col("_names"), w)), lambda hit: F.transform(
        "_names", lambda c: F.size(hit) - F.size(F.array_remove(hit, c))))
    return base_counts(df, "_ref", hits.alias("_hits")).drop("words")


def references(table: DataFrame, common: DataFrame) -> DataFrame:
    """lang (null: all documents), words, chars, and the counts of common words
    and of character classes over all documents of a language."""
    columns = ["_chars", "n_words", *[f"_{k}" for k in CLASSES]]
    own = table.where("lang IS NOT NULL").groupBy("lang").agg(*[F.sum(c).alias(c) for c in columns])
    whole = table.agg(*[F.sum(c).alias(c) for c in columns]).select(F.lit(None).cast("string").alias("lang"), *columns)
    full = common.withColumnRenamed("lang", "_l").join(own.unionByName(whole), F.col("_l").eqNullSafe(F.col("lang")))
    return cut_lineage(full.select("lang", F.col("n_words").alias("words"), F.col("_chars").alias("chars"),
                                   F.transform("best", lambda x: x["k"]).alias("common"), F.array(*[F.col(f"_{k}") for k in CLASSES]).alias("classes")), "references")


def _with_rest(shares: Column) -> Column:
    return F.concat(shares, F.array(F.lit(1.0) - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms, each an array of shares whose
    last bin (what is left to 1) is added here."""
    def part(a, m):
        return F.when((a > 0) & (m > 0), a * F.log2(a / m)).otherwise(0.0)

    def one(a, b):
        return (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2

    return let(_with_rest(p), lambda x: let(_with_rest(q), lambda y: F.sqrt(F.greatest(
        F.aggregate(F.zip_with(x, y, one), F.lit(0.0), lambda a, v: a + v), F.lit(0.0)))))


def quality(docs: DataFrame, char_limit: float = CHAR_LIMIT, char_slack: float = CHAR_SLACK,
            word_limit: float = WORD_LIMIT, word_slack: float = WORD_SLACK, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, kept, char_js, word_js."""
    common = common_words(docs)
    df = cut_lineage(histograms(docs, common), "histograms")
    refs = references(df, common)
    whole_ref = F.struct("words", "chars", "common", "classes")
    known = refs.where("lang IS NOT NULL").select(F.col("lang").alias("_lang"), whole_ref.alias("_own"))
    whole = refs.where("lang IS NULL").select(whole_ref.alias("_all"))
    df = df.join(known, F.col("_ref") == F.col("_lang"), "left").join(F.broadcast(whole), F.lit(True), "left")
    df = df.withColumn("_r", F.coalesce("_own", "_all"))

    def distance(mine: Column, n: Column, all_: Column, total: Column) -> Column:
        """Of a document's bins among its n to the bins of all others."""
        rest = F.greatest(total - n, F.lit(1))
        return F.when(total > n, js_distance(F.transform(mine, lambda x: x / F.greatest(n, F.lit(1))), F.zip_with(all_, mine, lambda a, x: (a - x) / rest)))

    classes = F.array(*[F.col(f"_{k}") for k in CLASSES])
    df = df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                   F.when(F.col("_r.words") > F.col("n_words"), F.round(distance(classes, F.col("_chars"), F.col("_r.classes"), F.col("_r.chars")), 6)).alias("char_js"),
                   F.round(distance(F.col("_hits"), F.col("n_words"), F.col("_r.common"), F.col("_r.words")), 6).alias("word_js"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scatter = F.lit(1.0) / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    fits = (F.col("n_words") < min_words) | ((F.col("char_js") <= char_limit + char_slack * scatter)
                                             & (F.col("word_js") <= word_limit + word_slack * scatter))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                     base.alias("base_failed"), (~base & F.coalesce(fits, F.lit(True))).alias("kept"), "char_js", "word_js")
