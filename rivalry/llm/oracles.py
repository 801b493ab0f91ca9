"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from .quality import CHAR_LIMIT, CHAR_SLACK, CLASSES, COMMON_LETTERS, MIN_WORDS, N_COMMON, WORD_LIMIT, WORD_SLACK
from .ranked_search import K, TERM
from .vectors import MIN_COSINE

_CLASS_SQL = {k: v.replace("'", "''") for k, v in CLASSES.items()}


def _js(p: str, q: str) -> str:
    """One bin's share of the divergence."""
    m = f"(({p}) + ({q})) / 2"
    return " + ".join(f"(CASE WHEN ({x}) > 0 THEN ({x}) * log2(({x}) / ({m})) ELSE 0 END) / 2" for x in (p, q))


_COUNTS = ", ".join(f"length(t) - length(regexp_replace(t, '{r}', '', 'g')) AS c_{k}" for k, r in _CLASS_SQL.items())
_SUMS = ", ".join(f"sum(c_{k}) AS c_{k}" for k in _CLASS_SQL)
_SHARES = [(f"d.c_{k} / greatest(d.chars, 1)", f"(r.c_{k} - d.c_{k}) / greatest(r.chars - d.chars, 1)") for k in _CLASS_SQL]
_REST = tuple("1 - (" + " + ".join(s[i] for s in _SHARES) + ")" for i in (0, 1))
_CHAR_JS = "sqrt(greatest(" + " + ".join(_js(p, q) for p, q in [*_SHARES, _REST]) + ", 0))"

QUALITY = rf"""WITH d0 AS (SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS t FROM documents),
pairs AS (SELECT lang AS rl FROM d0 WHERE lang IS NOT NULL AND regexp_matches(t, '[^\x20\x09-\x0D]') GROUP BY lang HAVING count(*) > 1),
d AS (SELECT k, doc_id, lang, (SELECT rl FROM pairs WHERE rl = lang) AS rl, t, length(t) AS chars, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, {_COUNTS} FROM d0),
tri AS (SELECT k, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM d, range(len(w) - 2) r(i)),
again AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM tri) WHERE n > 1),
inside AS (SELECT k, count(DISTINCT i + j) AS n FROM again, range(3) o(j) GROUP BY k),
words AS (SELECT lang, unnest(w) AS w FROM d),
counted AS (SELECT lang, w, count(*) AS n FROM words WHERE length(w) <= {COMMON_LETTERS} AND regexp_full_match(w, '\p{{L}}+') GROUP BY 1, 2),
pooled AS (SELECT lang, w, n FROM counted WHERE lang IS NOT NULL UNION ALL SELECT NULL, w, sum(n) FROM counted GROUP BY w),
common AS (SELECT lang, w, n FROM pooled QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) <= {N_COMMON}),
sums AS (SELECT lang, sum(chars) AS chars, sum(len(w)) AS words, {_SUMS} FROM d GROUP BY lang),
ref AS (SELECT * FROM sums WHERE lang IS NOT NULL UNION ALL
  SELECT NULL, sum(chars), sum(words), {_SUMS} FROM sums),
hits AS (SELECT k, c.w, count(*) AS n FROM (SELECT k, rl, unnest(w) AS w FROM d) x
  JOIN common c ON c.w = x.w AND c.lang IS NOT DISTINCT FROM x.rl GROUP BY 1, 2),
bins AS (SELECT d.k, coalesce(h.n, 0) / greatest(len(d.w), 1) AS p, (c.n - coalesce(h.n, 0)) / greatest(r.words - len(d.w), 1) AS q
  FROM d JOIN ref r ON r.lang IS NOT DISTINCT FROM d.rl JOIN common c ON c.lang IS NOT DISTINCT FROM d.rl
  LEFT JOIN hits h ON h.k = d.k AND h.w = c.w),
word_js AS (SELECT k, sqrt(greatest(sum({_js('p', 'q')}) + any_value(0) + {_js('1 - sum(p)', '1 - sum(q)')}, 0)) AS js FROM bins GROUP BY k),
s AS (SELECT d.doc_id, len(d.w) AS n_words, d.chars - d.c_blank AS word_chars, d.c_symbol AS n_symbols,
    len(d.lines) - len(list_distinct(d.lines)) AS n_dup_lines, coalesce(i.n, 0) AS n_repeat_words,
    CASE WHEN r.words > len(d.w) THEN round({_CHAR_JS}, 6) END AS char_js, CASE WHEN r.words > len(d.w) THEN round(coalesce(j.js, 0), 6) END AS word_js
  FROM d JOIN ref r ON r.lang IS NOT DISTINCT FROM d.rl LEFT JOIN inside i ON i.k = d.k LEFT JOIN word_js j ON j.k = d.k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(n_words < {MIN_WORDS} OR (
    char_js <= {CHAR_LIMIT} + {CHAR_SLACK} * (1 / sqrt(greatest(n_words, 1)))
    AND word_js <= {WORD_LIMIT} + {WORD_SLACK} * (1 / sqrt(greatest(n_words, 1)))), true) AS kept, char_js, word_js FROM s"""

VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND list_aggregate(list_transform(e, lambda x: x * x), 'sum') > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND list_cosine_similarity(a.e, b.e) >= {MIN_COSINE}),
reach(id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, c.root AS component_id, v.vec_id = c.root AS kept
FROM v JOIN (SELECT id, min(root) AS root FROM reach GROUP BY id) c ON c.id = v.vec_id"""

# CRC-32 of the decimal id, bit by bit, lowest bit first
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''),
  lambda x: list_transform(range(8), lambda b: (ord(x) >> b) & 1)))), lambda r, b: xor(r >> 1, 3988292384 * (xor(r, b) & 1))), 4294967295)"""



def _rendered(turns: str) -> str:
    """A list of structs: a turn's rendered text and whether it is trained."""
    return (f"list_transform({turns}, lambda q: struct_pack(s := '<|im_start|>' || q.role || '\n' || q.text || '<|im_end|>\n', "
            "u := CAST(q.role = 'assistant' AS INTEGER)))")


def _joined(turns: str) -> str:
    return f"array_to_string(list_transform({turns}, lambda q: q.s), '')"


def _masked(turns: str) -> str:
    before = f"coalesce(list_sum(list_transform({turns}[1:i], lambda q: length(q.s))), 0)"
    return (f"array_to_string(list_transform(range(len({turns})), lambda i: {before} || ':' || length({turns}[i + 1].s) || ':' || {turns}[i + 1].u), ',')")


PREFERENCE = f"""WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id AS c, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role, text) AS t FROM turns GROUP BY 1),
h AS (SELECT c, t, CAST({_CRC} % 6 AS INTEGER) AS h FROM c),
p AS (SELECT h.c AS pair_id, h.t AS x, list_concat(h.t[1:h], coalesce(b.t[h + 1:], [])) AS y FROM h LEFT JOIN c b ON b.c = h.c + 1),
k AS (SELECT pair_id, x, y, coalesce(list_min(list_filter(range(least(len(x), len(y))), lambda i: x[i + 1] <> y[i + 1])), least(len(x), len(y))) AS n FROM p),
r AS (SELECT pair_id, n, {_rendered('x[1:n]')} AS p, {_rendered('x[n + 1:]')} AS c, {_rendered('y[n + 1:]')} AS r FROM k)
SELECT pair_id, CAST(n AS INTEGER) AS n_prompt_turns, {_joined('p')} AS prompt, {_joined('c')} AS chosen, {_masked('c')} AS chosen_mask,
  {_joined('r')} AS rejected, {_masked('r')} AS rejected_mask FROM r"""

_SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SEARCH = rf"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_SMALL}, '{TERM}') AS ts FROM documents),
s AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d),
tf AS (SELECT k, doc_id, len(ts) AS n, t, count(*) AS tf FROM (SELECT k, doc_id, ts, unnest(ts) AS t FROM d) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), s),
i AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all({_SMALL}, '{TERM}')) AS ts FROM benchmark),
g AS (SELECT q, item_id, k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM (SELECT q, item_id, unnest(ts) AS t FROM i) JOIN tf USING (t) JOIN w USING (t), s GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank FROM g WHERE score > 0) WHERE rank <= {K}"""

TRIE = f"""WITH o AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT c, l, CAST({_CRC} % 6 AS INTEGER) AS h FROM o),
s AS (SELECT h.c, list_concat(coalesce(b.l[1:h], []), h.l[h + 1:]) AS l FROM h LEFT JOIN o b ON b.c = h.c - h.c % 100),
p AS (SELECT c, l, unnest(range(len(l) + 1)) AS d FROM s),
n AS (SELECT l[1:d] AS k, d, min(c) AS c, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = len(l)), '') AS e FROM p GROUP BY 1, 2),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n - 1) * length(n.k[d].t) ELSE 0 END AS saved FROM n LEFT JOIN kids USING (k)),
a AS (SELECT k[1:u] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT k, n_children, saved, unnest(range(d + 1)) AS u FROM v) GROUP BY 1)
SELECT v.c AS conv_id, v.d AS depth, q.c AS parent_conv_id, v.n AS n_convs, v.n_children, a.n_leaves, a.saved_tokens, sha256(v.e) AS ends_sha256
FROM v JOIN a ON a.k = v.k LEFT JOIN n q ON v.d > 0 AND q.k = v.k[1:v.d - 1]"""

ORACLES = {"op2_quality_divergence": QUALITY, "op6_metric_range_join": VECTORS, "op7_preference_format": PREFERENCE,
           "op11_nra_search": SEARCH, "op12_conversation_trie": TRIE}
