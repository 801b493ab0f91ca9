"""Small DuckDB SQL builders shared by the oracles (no Spark here)."""

from __future__ import annotations


def kfold_sql(src: str, k: int, order_expr: str, label: str = "label", id_col: str = "id",
              cols: str = "*") -> str:
    """Stratified k-fold in plain SQL (allocation formula written out for each fold)."""
    cums, terms = [], []
    for i in range(k):
        terms.append(f"((off + n - 1 - {i} + {k}) // {k} - (off - 1 - {i} + {k}) // {k})")
        cums.append(" + ".join(terms))
    fold = " + ".join(f"CASE WHEN ({c}) <= r THEN 1 ELSE 0 END" for c in cums)
    return f"""(SELECT {cols}, CAST({fold} AS INTEGER) AS fold FROM (
      SELECT s.*, row_number() OVER (PARTITION BY s.{label} ORDER BY {order_expr}) - 1 AS r, c.n, c.off
      FROM {src} s JOIN (
        SELECT {label}, n, coalesce(sum(n) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
        FROM (SELECT {label}, count(*) AS n, min({id_col}) AS first FROM {src} GROUP BY {label}) cls
      ) c ON s.{label} = c.{label}) ranked)"""


def softmax_sql(zs: list[str], t: str | None = None) -> list[str]:
    zz = [f"({z}) / ({t})" if t else f"({z})" for z in zs]
    m = f"greatest({', '.join(zz)})"
    es = [f"exp({z} - {m})" for z in zz]
    tot = " + ".join(es)
    return [f"({e}) / ({tot})" for e in es]


def log_loss_sql(label: str, ps: list[str], eps: str = "2.220446049250313e-16") -> str:
    cl = [f"least(greatest({p}, {eps}), 1 - {eps})" for p in ps]
    pick = "CASE " + " ".join(f"WHEN {label} = {i} THEN {c}" for i, c in enumerate(cl)) + " END"
    return f"-ln(({pick}) / ({' + '.join(cl)}))"


def ce_sql(label: str, zs: list[str]) -> str:
    m = f"greatest({', '.join(zs)})"
    lse = f"(ln({' + '.join(f'exp({z} - {m})' for z in zs)}) + {m})"
    pick = "CASE " + " ".join(f"WHEN {label} = {i} THEN {z}" for i, z in enumerate(zs)) + " END"
    return f"({lse} - ({pick}))"


def shuffle_key_sql(id_col: str = "id", seed: int = 42) -> str:
    return f"md5('{seed}:' || CAST({id_col} AS VARCHAR))"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def dot_sql(a: str, b: str) -> str:
    return (f"list_reduce(list_transform(list_zip({a}, {b}), lambda t: CAST(t[1] AS DOUBLE) * CAST(t[2] AS DOUBLE)), "
            f"lambda x, y: x + y, CAST(0 AS DOUBLE))")


def lit(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def fill_sql(parts: list[tuple[str, str]], **values: str) -> str:
    """``str.format`` in SQL: ``||`` of literals and expressions."""
    return "(" + " || ".join(lit(v) if k == "lit" else f"({values[v]})" for k, v in parts) + ")"


TOKEN_RE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '{TOKEN_RE}')"


def words_sql(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"


def join_mode_sql(x: str) -> str:
    return f"array_to_string(list_transform(from_json({x}, '[\"VARCHAR\"]'), lambda e: coalesce(e, '')), ' ')"


def textual_mode_sql(x: str) -> str:
    return f"array_to_string(list_transform(string_split(trim({x}, '[]'), '\",\"'), lambda e: trim(e, '\"')), ' ')"
