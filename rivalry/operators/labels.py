"""Labels, projections and row-level reshaping of battle tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivalry.functions import probs
from rivalry.functions.text import hash_coin

FLAGS = ("winner_model_a", "winner_model_b", "winner_tie")


def label_from_flags(df: DataFrame, out: str = "label") -> DataFrame:
    """``argmax(winner_a, winner_b, winner_tie)``, first maximum wins."""
    return df.withColumn(out, probs.argmax(*FLAGS))


def label_from_cases(df: DataFrame, out: str = "label") -> DataFrame:
    """A-win → 0, else b-win → 1, else 2."""
    a, b = F.col(FLAGS[0]), F.col(FLAGS[1])
    return df.withColumn(out, F.when(a == 1, 0).when(b == 1, 1).otherwise(2).cast("int"))


def fold_default(df: DataFrame, value: int = -1) -> DataFrame:
    """Constant fold sentinel."""
    return df.withColumn("fold", F.lit(value).cast("int"))


def cast_id(df: DataFrame, col: str = "id") -> DataFrame:
    """P5: id → string (join keys across corpora)."""
    return df.withColumn(col, F.col(col).cast("string"))


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns of ``a`` that also exist in ``b``, in ``a``'s order."""
    bs = set(b.columns)
    return [c for c in a.columns if c in bs]


def project_common_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keep the intersection of two schemas."""
    return a.select(*common_columns(a, b))


def drop_columns(df: DataFrame, cols) -> DataFrame:
    """P7."""
    return df.drop(*cols)


def rename_target(df: DataFrame, old: str = "target", new: str = "labels") -> DataFrame:
    """P8."""
    return df.withColumnRenamed(old, new)


def swap_sides(df: DataFrame, cond, pairs=(("response_a", "response_b"),), label: str = "label") -> DataFrame:
    """Swap paired columns and the 0/1 label where ``cond`` holds (tie stays 2)."""
    out = df
    for x, y in pairs:
        out = out.withColumns({x: F.when(cond, F.col(y)).otherwise(F.col(x)),
                               y: F.when(cond, F.col(x)).otherwise(F.col(y))})
    lab = F.col(label)
    return out.withColumn(label, F.when(cond & (lab < 2), 1 - lab).otherwise(lab).cast("int"))


def swap_augment(df: DataFrame, seed: int = 42, key: str = "id", apply: bool = True,
                 pairs=(("response_a", "response_b"),)) -> DataFrame:
    """Swap A/B content and label on a deterministic per-row coin.

    The coin is ``md5(seed:key)`` so reruns and retried tasks agree; the
    ``swapped`` flag records the draw.  ``apply=False`` (e.g. for validation
    rows) keeps every row as is.
    """
    coin = hash_coin(F.col(key), seed) if apply else F.lit(False)
    return swap_sides(df.withColumn("swapped", coin), F.col("swapped"), pairs)


def swap_union(df: DataFrame, pairs=(("response_a", "response_b"),)) -> DataFrame:
    """P10: both orientations of every row."""
    orig = df.withColumn("swapped", F.lit(False))
    sw = swap_sides(df.withColumn("swapped", F.lit(True)), F.lit(True), pairs)
    return orig.unionByName(sw)


def chosen_rejected(df: DataFrame, target: str = "label", prompt: str = "prompt",
                    a: str = "response_a", b: str = "response_b", sep: str = "\n\n") -> DataFrame:
    """P11 + F2: non-tie rows → (prompt, chosen, rejected) preference pairs."""
    t = F.col(target)
    win = F.when(t == 0, F.col(a)).otherwise(F.col(b))
    lose = F.when(t == 0, F.col(b)).otherwise(F.col(a))
    return (df.filter(t != 2)
            .withColumn("chosen", F.concat(F.col(prompt), F.lit(sep), win))
            .withColumn("rejected", F.concat(F.col(prompt), F.lit(sep), lose)))


def drop_ties(df: DataFrame, target: str = "label") -> DataFrame:
    """F2."""
    return df.filter(F.col(target) != 2)


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """A5: count and share per class.  The total comes from a window over the
    per-class aggregate (a handful of rows), not over the input."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("ratio", F.col("n") / F.sum("n").over(Window.partitionBy()))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``1/freq`` normalised to sum 1."""
    dist = class_distribution(df, label).withColumn("inv", 1.0 / F.col("ratio"))
    return dist.select(label, (F.col("inv") / F.sum("inv").over(Window.partitionBy())).alias("weight"))
