"""DuckDB twins of ``fixtures`` for the SQL oracles.

``with_fixtures(body, "bb", "pb")`` prefixes ``body`` with the CTEs it needs
(dependencies resolved).  Tables ``orders``, ``conversations`` … are views
registered by the checker.
"""

from __future__ import annotations


def _logit(m: int, a: int, cls: int, mod: int) -> str:
    return (f"((o_orderkey * {m} + {a}) % 1000) / CAST(500 AS DOUBLE) - 1 + "
            f"CASE WHEN label = {cls} AND o_orderkey % {mod} <> 0 THEN 1.5 ELSE 0.0 END")


def _strict(x: str) -> str:
    return (f"CASE WHEN list_count(from_json({x}, '[\"VARCHAR\"]')) < len(from_json({x}, '[\"VARCHAR\"]')) "
            f"THEN []::VARCHAR[] ELSE from_json({x}, '[\"VARCHAR\"]') END")


def zip_render(p: str, a: str, b: str, block: str) -> str:
    """Concatenate ``block`` (using p_i, a_i, b_i, i) over the zipped turns."""
    n = f"least(len({p}), len({a}), len({b}))"
    blk = block.replace("p_i", f"{p}[i+1]").replace("a_i", f"{a}[i+1]").replace("b_i", f"{b}[i+1]")
    return f"array_to_string(list_transform(range({n}), lambda i: {blk}), '')"


FIXTURES: dict[str, tuple[str, tuple[str, ...]]] = {
    "bb0": ("""SELECT o_orderkey, o_custkey,
        CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS INTEGER) AS label
      FROM orders""", ()),
    "bb": (f"""SELECT o_orderkey AS id,
        'm' || CAST(o_custkey % 20 AS VARCHAR) AS model_a,
        'm' || CAST((o_orderkey * 7 + o_custkey) % 23 % 20 AS VARCHAR) AS model_b,
        label,
        CAST(label = 0 AS INTEGER) AS winner_model_a,
        CAST(label = 1 AS INTEGER) AS winner_model_b,
        CAST(label = 2 AS INTEGER) AS winner_tie,
        {_logit(37, 0, 0, 3)} AS z0, {_logit(91, 13, 1, 3)} AS z1, {_logit(53, 7, 2, 3)} AS z2,
        {_logit(17, 0, 0, 4)} AS g0, {_logit(71, 3, 1, 4)} AS g1, {_logit(29, 11, 2, 4)} AS g2,
        (o_orderkey * 7919) % 4096 + 1 AS len
      FROM bb0""", ("bb0",)),
    "conv_lists": ("""SELECT conv_id,
        coalesce(list(text ORDER BY turn) FILTER (WHERE role = 'user'), []::VARCHAR[]) AS prompts,
        coalesce(list(text ORDER BY turn) FILTER (WHERE role = 'assistant'), []::VARCHAR[]) AS answers
      FROM conversations GROUP BY conv_id""", ()),
    "bt0": ("""SELECT a.conv_id AS id, a.prompts, a.answers,
        CASE WHEN a.conv_id % 11 = 0 THEN list_append(b.answers, NULL) ELSE b.answers END AS b_answers,
        (a.conv_id * 5 + a.conv_id // 3) % 3 AS lab
      FROM conv_lists a JOIN conv_lists b
        ON b.conv_id = CASE WHEN a.conv_id % 2 = 0 THEN a.conv_id + 1 ELSE a.conv_id - 1 END""",
            ("conv_lists",)),
    "bt": ("""SELECT id,
        'm' || CAST(id % 7 AS VARCHAR) AS model_a,
        'm' || CAST((id * 3 + id // 7 + 1) % 7 AS VARCHAR) AS model_b,
        CAST(to_json(prompts) AS VARCHAR) AS prompt,
        CAST(to_json(answers) AS VARCHAR) AS response_a,
        CAST(to_json(b_answers) AS VARCHAR) AS response_b,
        CAST(lab = 0 AS INTEGER) AS winner_model_a,
        CAST(lab = 1 AS INTEGER) AS winner_model_b,
        CAST(lab = 2 AS INTEGER) AS winner_tie
      FROM bt0""", ("bt0",)),
    "pb": (f"""SELECT id, model_a, model_b,
        CAST(list_position([winner_model_a, winner_model_b, winner_tie],
             list_max([winner_model_a, winner_model_b, winner_tie])) - 1 AS INTEGER) AS label,
        {_strict('prompt')} AS p, {_strict('response_a')} AS a, {_strict('response_b')} AS b
      FROM bt""", ("bt",)),
    "px": (f"""SELECT id, model_a, model_b,
        CAST(list_position([winner_model_a, winner_model_b, winner_tie],
             list_max([winner_model_a, winner_model_b, winner_tie])) - 1 AS INTEGER) AS label,
        {_strict('prompt')} AS p, {_strict('response_a')} AS a, {_strict('response_b')} AS b
      FROM bx""", ("bx",)),
    "ps": (f"""SELECT id, label,
        {_strict('prompt')} AS p, {_strict('response_a')} AS a, {_strict('response_b')} AS b
      FROM bs""", ("bs",)),
    "bx": ("""SELECT * REPLACE (id + 1000000 AS id) FROM bt WHERE id % 4 = 0
      UNION ALL
      SELECT * REPLACE (id + 1000000 AS id, 'new-' || model_a AS model_a) FROM bt WHERE id % 4 = 1""",
           ("bt",)),
    "bs": ("""SELECT prompt, response_a, response_b,
        CAST(CASE WHEN winner_model_a = 1 THEN 0 WHEN winner_model_b = 1 THEN 1 ELSE 2 END AS INTEGER) AS label,
        'syn-' || CAST(id AS VARCHAR) AS id
      FROM bt WHERE id % 3 = 0""", ("bt",)),
    "ctx": ("""SELECT CASE WHEN substr(md5(prompt), 1, 1) >= 'c' THEN prompt || ' #' ELSE prompt END AS prompt,
        'Sample: ' || prompt AS similar_prompt, 'Ideal answer ' || substr(h, 3, 6) AS similar_response,
        ('0x' || substr(h, 2, 2))::INTEGER / CAST(255 AS DOUBLE) AS similarity, row
      FROM (SELECT prompt, row, md5(prompt || ':' || CAST(row AS VARCHAR)) AS h FROM (
        SELECT p[i + 1] AS prompt, CAST(id AS BIGINT) * 1024 + i AS row FROM pb, range(len(p)) r(i)))""", ("pb",)),
    "rc": ("SELECT vec_id AS id, embedding FROM embeddings WHERE vec_id % 5 <> 0", ()),
    "rq": ("SELECT vec_id AS q_id, embedding FROM embeddings WHERE vec_id % 5 = 0", ()),
    "seq": ("""SELECT label AS seq_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos,
        vec_id, embedding, CAST(vec_id % 7 <> 0 AS INTEGER) AS mask FROM embeddings""", ()),
    "ml": ("""SELECT CAST(user_id % 4 AS INTEGER) AS fold, CAST(day(ts) % 3 AS INTEGER) AS epoch,
        event_id AS step, value AS loss, CAST(1e-4 AS DOUBLE) / (1 + day(ts) % 3) AS lr FROM events""", ()),
    "res": ("""SELECT 'request-' || CAST(id AS VARCHAR) AS custom_id, id, content,
        CAST(200 + id % 50 AS BIGINT) AS prompt_tokens, CAST(length(content) // 4 AS BIGINT) AS completion_tokens
      FROM (SELECT id, """ + zip_render(
        "p", "a", "b",
        "'<prompt>' || p_i || '</prompt>\n<response_a>' || a_i || '</response_a>\n' || "
        "CASE WHEN id % 10 = 0 AND i = 0 THEN '' ELSE '<response_b>' || b_i || '</response_b>\n' END")
        + " AS content FROM pb)", ("pb",)),
}


def _resolve(names, seen, order):
    for n in names:
        if n in seen:
            continue
        seen.add(n)
        _resolve(FIXTURES[n][1], seen, order)
        order.append(n)


def with_fixtures(body: str, *names: str) -> str:
    order: list[str] = []
    _resolve(names, set(), order)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({FIXTURES[n][0]})" for n in order)
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{body}"
