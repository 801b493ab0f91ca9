"""List-valued string cells (three dialects) and whitespace helpers.

A battle cell holds a serialised list of turns, e.g. ``["hi","bye"]``.  The
three dialects are kept as three named functions — there is no silent default.
All are JVM expressions (``from_json`` + higher-order functions).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIST_SCHEMA = "array<string>"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_list(c) -> Column:
    """JSON list of strings; NULL elements kept; unparsable → NULL."""
    return F.from_json(_c(c), LIST_SCHEMA)


def parse_list_strict(c) -> Column:
    """Literal-eval dialect: any NULL element turns the whole cell into ``[]``.

    Unparsable text gives NULL, which ``quarantine_unparsed`` routes aside.
    """
    a = parse_list(c)
    return F.when(F.exists(a, lambda x: x.isNull()), F.array().cast(LIST_SCHEMA)).otherwise(a)


def parse_list_join(c, sep: str = " ") -> Column:
    """Eval-with-null-as-empty dialect: elements joined by one space, NULL → ''."""
    a = parse_list(c)
    return F.array_join(F.transform(a, lambda x: F.coalesce(x, F.lit(""))), sep)


def parse_list_textual(c, sep: str = " ") -> Column:
    """Textual dialect: strip ``[``/``]`` characters, split on ``","``, strip ``"``.

    No unescaping happens; a JSON ``null`` stays as text.
    """
    s = F.btrim(_c(c), F.lit("[]"))
    parts = F.split(s, '","')
    return F.array_join(F.transform(parts, lambda x: F.btrim(x, F.lit('"'))), sep)


def strip_ws(c) -> Column:
    """Python ``str.strip()``: removes leading/trailing whitespace incl. newlines."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def quarantine_unparsed(df: DataFrame, *cells: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows: bad ones hold a non-null cell that is not a list of
    strings, and get ``bad_cells``, the names of those cells.  Good rows keep
    their columns."""
    failed = [F.when(F.col(c).isNotNull() & parse_list(c).isNull(), F.lit(c)) for c in cells]
    bad = F.array_compact(F.array(*failed))
    return df.where(F.size(bad) == 0), df.withColumn("bad_cells", bad).where(F.size("bad_cells") > 0)


def word_count(c) -> Column:
    """Python ``len(s.split())``: whitespace-separated words, '' → 0."""
    return F.size(F.filter(F.split(_c(c), r"\s+"), lambda x: x != ""))
