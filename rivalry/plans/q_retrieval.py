"""Registered queries: vectors, kNN joins, pooling, retrieval context."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivalry.functions import probs
from rivalry.functions.vectors import l2_normalize, round_vec, to_double, to_float
from rivalry.operators import ann, context, knn, metrics, pooling
from rivalry.plans import fixtures as fx
from rivalry.plans.oracle_fixtures import with_fixtures as W
from rivalry.plans.registry import register
from rivalry.plans.sqlgen import dot_sql, lit, strip_sql
from rivalry.functions import templates as T
from rivalry.session import cut_lineage, scratch_path, table


def _knn_sql(k: int, cols: str) -> str:
    return W(f"""SELECT {cols} FROM (SELECT q.q_id, c.id, {dot_sql('q.embedding', 'c.embedding')} AS sim,
  row_number() OVER (PARTITION BY q.q_id ORDER BY {dot_sql('q.embedding', 'c.embedding')} DESC, c.id) AS rank
  FROM rq q, rc c) WHERE rank <= {k}""", "rq", "rc")


def _knn(spark, sf, k):
    return knn.knn_join(fx.retrieval_queries(spark, sf), fx.retrieval_corpus(spark, sf), k=k)


@register("knn_top1_join", _knn_sql(1, "q_id, id, round(sim, 5) AS similarity"))
def q_knn_top1_join(spark, sf):
    return _knn(spark, sf, 1).select("q_id", "id", F.round("similarity", 5).alias("similarity"))


@register("topk_similar", _knn_sql(3, "q_id, rank, id, round(sim, 5) AS similarity"))
def q_topk_similar(spark, sf):
    return _knn(spark, sf, 3).select("q_id", F.col("rank").cast("long").alias("rank"), "id",
                                     F.round("similarity", 5).alias("similarity"))


@register("list_max", f"SELECT q_id, round(max(sim), 5) AS max_similarity FROM ({_knn_sql(3, 'q_id, sim')}) GROUP BY q_id")
def q_list_max(spark, sf):
    top = _knn(spark, sf, 3)
    lists = top.groupBy("q_id").agg(F.collect_list("similarity").alias("distances"))
    return lists.select("q_id", F.round(F.array_max("distances"), 5).alias("max_similarity"))


@register("similarity_threshold", f"SELECT q_id, sim > 0.75 AS use_context FROM ({_knn_sql(1, 'q_id, sim')})")
def q_similarity_threshold(spark, sf):
    return context.with_context_flag(_knn(spark, sf, 1)).select("q_id", "use_context")


@register("knn_approx_join")
def q_knn_approx_join(spark, sf):
    index = ann.build_index(fx.retrieval_corpus(spark, sf), scratch_path(spark, "ann-index"))
    out = ann.search(fx.retrieval_queries(spark, sf), index)
    return out.select("q_id", "id", F.round("similarity", 5).alias("similarity"), "n_candidates")


@register("l2_normalize", """SELECT vec_id, list_transform(e3, lambda x: round(x / greatest(sqrt(list_reduce(
    list_transform(e3, lambda y: y * y), lambda a, b: a + b, CAST(0 AS DOUBLE))), 1e-12), 5)) AS unit
  FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) AS e3 FROM embeddings)""")
def q_l2_normalize(spark, sf):
    e = table(spark, sf, "embeddings")
    e3 = F.transform("embedding", lambda x: x.cast("double") * 3)
    return e.select("vec_id", round_vec(l2_normalize(e3), 5).alias("unit"))


@register("vector_cast", """SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6)) AS vec,
  list_transform(embedding, lambda x: round(CAST(CAST(CAST(x AS DOUBLE) / 3 AS FLOAT) AS DOUBLE), 12)) AS narrow FROM embeddings""")
def q_vector_cast(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("_d", to_double("embedding"))
    third = F.transform("_d", lambda x: x / 3)  # no longer a float32 value: the narrowing cast rounds it
    return e.select("vec_id", round_vec("_d", 6).alias("vec"), round_vec(to_float(third), 12).alias("narrow"))


@register("select_class_tokens", """SELECT vec_id, round(CAST(embedding[6] AS DOUBLE), 6) AS A,
  round(CAST(embedding[18] AS DOUBLE), 6) AS B, round(CAST(embedding[43] AS DOUBLE), 6) AS tie FROM embeddings""")
def q_select_class_tokens(spark, sf):
    e = table(spark, sf, "embeddings")
    a, b, t = probs.select_by_index("embedding", [5, 17, 42])
    return e.select("vec_id", *[F.round(c.cast("double"), 6).alias(n) for c, n in zip((a, b, t), ("A", "B", "tie"))])


def _pool_sql(value: str, where: str = "") -> str:
    return W(f"""SELECT seq_id, list(round(v, 5) ORDER BY d) AS pooled FROM (
  SELECT seq_id, d, {value} AS v FROM seq, range(64) r(d) {where} GROUP BY seq_id, d) GROUP BY seq_id""", "seq")


@register("mean_pool", _pool_sql("sum(CAST(embedding[d + 1] AS DOUBLE) * mask) / greatest(sum(mask), 1e-9)"))
def q_mean_pool(spark, sf):
    p = pooling.mean_pool(fx.sequences(spark, sf))
    return p.select("seq_id", round_vec("pooled", 5).alias("pooled"))


_ATT_W = [1.0 / 8.0] * 64
_ATT_SCORE = dot_sql("embedding", "[" + ", ".join(["CAST(0.125 AS DOUBLE)"] * 64) + "]")


@register("attention_pool", W(f"""WITH s AS (SELECT seq_id, embedding, {_ATT_SCORE} AS sc FROM seq WHERE mask = 1),
a AS (SELECT seq_id, embedding, exp(sc - max(sc) OVER (PARTITION BY seq_id)) AS w FROM s)
SELECT seq_id, list(round(v, 5) ORDER BY d) AS pooled FROM (
  SELECT seq_id, d, sum(w * CAST(embedding[d + 1] AS DOUBLE)) / sum(w) AS v FROM a, range(64) r(d) GROUP BY seq_id, d)
GROUP BY seq_id""", "seq"))
def q_attention_pool(spark, sf):
    p = pooling.attention_pool(fx.sequences(spark, sf), _ATT_W)
    return p.select("seq_id", round_vec("pooled", 5).alias("pooled"))


@register("last_token_pool", W("SELECT seq_id, arg_max(vec_id, pos) AS vec_id FROM seq WHERE mask = 1 GROUP BY seq_id", "seq"))
def q_last_token_pool(spark, sf):
    return pooling.last_token_pool(fx.sequences(spark, sf)).select("seq_id", "vec_id")


@register("first_token_pool", W("SELECT seq_id, arg_min(vec_id, pos) AS vec_id FROM seq GROUP BY seq_id", "seq"))
def q_first_token_pool(spark, sf):
    return pooling.first_token_pool(fx.sequences(spark, sf)).select("seq_id", "vec_id")


@register("position_ids", W("""SELECT seq_id, pos, CASE WHEN mask = 0 THEN 1 ELSE
  CAST(sum(mask) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS BIGINT) END
  AS position_id
FROM seq""", "seq"))
def q_position_ids(spark, sf):
    return pooling.position_ids(fx.sequences(spark, sf)).select("seq_id", "pos", "position_id")


@register("vector_concat", W("SELECT id, len(embedding) AS dim FROM rc UNION ALL SELECT q_id, len(embedding) FROM rq",
                             "rc", "rq"))
def q_vector_concat(spark, sf):
    c = fx.retrieval_corpus(spark, sf)
    q = fx.retrieval_queries(spark, sf).withColumnRenamed("q_id", "id")
    return c.unionByName(q).select("id", F.size("embedding").cast("bigint").alias("dim"))


@register("id_bind_join", W("""SELECT bb.id, bb.label, round(exp(z0 - greatest(z0, z1, z2)) / (exp(z0 - greatest(z0, z1, z2))
  + exp(z1 - greatest(z0, z1, z2)) + exp(z2 - greatest(z0, z1, z2))), 6) AS A, len(e.embedding) AS emb_dim
FROM bb JOIN embeddings e ON e.vec_id = bb.id""", "bb"))
def q_id_bind_join(spark, sf):
    bb = metrics.with_probs(fx.battles_big(spark, sf))
    preds = bb.select("id", "A")
    labs = bb.select("id", "label")
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.size("embedding").cast("bigint").alias("emb_dim"))
    return preds.join(labs, "id").join(emb, "id").select("id", "label", F.round("A", 6).alias("A"), "emb_dim")


# ---------------------------------------------------------------- context

_LOOK_SQL = """ex AS (SELECT id, CAST(i AS INTEGER) AS pos, p[i + 1] AS prompt FROM pb, range(len(p)) r(i)),
lastctx AS (SELECT * FROM ctx QUALIFY row_number() OVER (PARTITION BY prompt ORDER BY row DESC) = 1),
look AS (SELECT ex.id, ex.pos, ex.prompt, c.prompt IS NOT NULL AS hit, c.similar_prompt, c.similar_response,
  c.similarity FROM ex LEFT JOIN lastctx c ON ex.prompt = c.prompt)"""


@register("context_lookup_join", W(f"""WITH {_LOOK_SQL}
SELECT id, pos, hit, similar_response, round(similarity, 6) AS similarity FROM look""", "pb", "ctx"))
def q_context_lookup_join(spark, sf):
    look = context.context_lookup(fx.parsed_battles(spark, sf), fx.prompt_context(spark, sf))
    return look.select("id", "pos", "hit", "similar_response", F.round("similarity", 6).alias("similarity"))


_CTX_BLOCK = ("'\n###Instruction:: ' || p[i+1] || ' \n###Response A: ' || a[i+1] || ' \n###Response B: ' || b[i+1] || "
              "CASE WHEN coalesce(c[i+1].similarity > 0.75, false) THEN '\n<Sample Response><prompt>' || "
              "c[i+1].similar_prompt || '</prompt>\n<response>' || c[i+1].similar_response || "
              "'</response></Sample Response>' ELSE '' END")
_N = "least(len(p), len(a), len(b))"


@register("inject_context", W(f"""WITH {_LOOK_SQL},
per AS (SELECT id, list(struct_pack(hit := hit, similarity := similarity, similar_prompt := similar_prompt,
  similar_response := similar_response) ORDER BY pos) AS c FROM look GROUP BY id),
d AS (SELECT pb.id, p, a, b, coalesce(per.c, []) AS c FROM pb LEFT JOIN per ON pb.id = per.id)
SELECT id, '<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\n' || {strip_sql(lit(T.CONTEXT_HEADER) + " || array_to_string(list_transform(range(" + _N + "), lambda i: " + _CTX_BLOCK + "), '')")}
  || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n[RESULT]:<|eot_id|>' AS text,
  len(list_filter(c[1:{_N}], lambda x: NOT x.hit)) AS n_missing,
  len(list_filter(c[1:{_N}], lambda x: coalesce(x.similarity > 0.75, false))) AS n_added
FROM d""", "pb", "ctx"))
def q_inject_context(spark, sf):
    return context.inject_context(fx.parsed_battles(spark, sf), fx.prompt_context(spark, sf))


# ---------------------------------------------------------------- E2 end to end

def retrieval_augmentation(battles, conversations, threshold: float = context.THRESHOLD, dim: int = 64, embedder=None):
    """Q/A corpus from the conversations (A18) and the distinct prompt turns
    of the battles are embedded with the same embedder (ML2), learned from the
    corpus prompts when none is given, so that both lie in one space; exact kNN
    (J6) gives each prompt its nearest corpus prompt, which becomes the
    retrieval table of the context injection (J4 + F4 + T15).  The battles, the
    corpus and the prompts are read several times: each is written once."""
    from rivalry.operators import ml, text_features
    from rivalry.operators.turns import qa_pairs
    battles = cut_lineage(battles.select("id", "p", "a", "b"), "e2-battles")
    qa = cut_lineage(qa_pairs(conversations).select(F.xxhash64("conv_id", "k").alias("id"), "prompt", "response"), "e2-corpus")
    embedder = embedder or text_features.fit_embedder(qa, "prompt", dim)
    corpus = ml.batch_embed(qa, "prompt", embedder=embedder)
    prompts = cut_lineage(battles.select(F.explode("p").alias("prompt")).distinct().withColumn("q_id", F.xxhash64("prompt")), "e2-prompts")
    queries = ml.batch_embed(prompts, "prompt", embedder=embedder)
    top = knn.knn_join(queries.select("q_id", "embedding"), corpus.select("id", "embedding"), k=1)
    ctx = (top.join(prompts, "q_id").join(qa.select("id", F.col("prompt").alias("similar_prompt"),
                                                    F.col("response").alias("similar_response")), "id")
           .select("prompt", "similar_prompt", "similar_response", "similarity"))
    return context.inject_context(battles, ctx, threshold)


@register("retrieval_augmentation")
def q_retrieval_augmentation(spark, sf):
    return retrieval_augmentation(fx.parsed_battles(spark, sf), table(spark, sf, "conversations"))
