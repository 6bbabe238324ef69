"""Queries of ranking, question rules and context assembly over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import questions as Q
from granary.functions import text as X
from granary.operators import retrieval as K
from granary.operators.relations import first_per_hash, top_k
from granary.operators.similar_vectors import usable_vectors
from granary.queries.text_functions import sql_chunk_type
from granary.sources.tables import table

EVERY = 20
#: Characters of an excerpt in a prompt. Fixed value.
EXCERPT = 4_000


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


def k1_dense_top_k(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return K.dense_top_k(v.filter(F.col("id") % EVERY == 0), v, 10).select("query_id", "id", "rank", F.round("cosine", 6).alias("cosine"))


_DENSE = f"""
v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS l FROM v),
s AS (SELECT q.id AS query_id, x.id, round(list_dot_product(q.e, x.e) / (q.l * x.l), 9) AS cosine FROM n q JOIN n x ON q.id <> x.id WHERE q.id % {EVERY} = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM s)"""
K1_SQL = f"WITH {_DENSE} SELECT query_id, id, rank, round(cosine, 6) AS cosine FROM t WHERE rank <= 10"


def k1_filtered_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The filter stands below the search: only vectors of label 3 are searched."""
    keep = table(spark, d, "embeddings", "vec_id", "embedding", "label").filter("label = 3").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    v = _vectors(spark, d)
    return K.dense_top_k(v.filter(F.col("id") % EVERY == 0), keep, 5).select("query_id", "id", "rank", F.round("cosine", 6).alias("cosine"))


K1F_SQL = f"""WITH {_DENSE}, f AS (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, s.id) AS r FROM s JOIN embeddings e ON e.vec_id = s.id WHERE e.label = 3)
SELECT query_id, id, r AS rank, round(cosine, 6) AS cosine FROM f WHERE r <= 5"""


def k2_diverse_top_k(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    top = K.dense_top_k(v.filter(F.col("id") % EVERY == 0), v, 40)
    return K.marginal_relevance(top.join(v, "id").select("query_id", "id", "rank", F.col("cosine").alias("relevance"), "vec"), 10)


def k3_reranked(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "run_results", "question_id", "question").filter("question_id IS NOT NULL AND question IS NOT NULL").groupBy("question_id").agg(F.min("question").alias("question"))
    q = q.select("question_id", Q.question_type(F.col("question")).alias("t")).select("question_id", F.col("t.type").alias("kind"))
    e = table(spark, d, "expanded_evidence", "ev_id", "question_id", "chunk_text", "cross_encoder_score").filter("chunk_text IS NOT NULL AND cross_encoder_score IS NOT NULL").filter(~F.isnan("cross_encoder_score"))
    e = e.join(q, "question_id")
    score = K.blended_score(F.col("cross_encoder_score"), Q.type_score(F.col("kind"), X.chunk_type(F.col("chunk_text")), F.col("chunk_text")))
    e = e.select("question_id", "ev_id", F.round(score, 6).alias("score"))
    return top_k(e, "question_id", [F.desc("score"), F.asc("ev_id")], 20)


_KIND = "CASE " + " ".join(
    "WHEN {c} > 0 AND {c} = {m} THEN '{t}'".format(c=f"c_{t}", m="greatest(" + ", ".join(f"c_{x}" for x in Q.TYPES) + ")", t=t) for t in Q.TYPES
) + " ELSE 'GENERAL' END"
_COUNTS = ", ".join("(" + " + ".join(f"len(regexp_extract_all(q, '{p}'))" for p in ps) + f") AS c_{t}" for t, ps in Q.TYPES.items())
_PLACE = "CASE " + " ".join(f"WHEN kind = '{t}' THEN CASE " + " ".join(f"WHEN ct = '{c}' THEN {len(cs) - i} / {len(cs)}" for i, c in enumerate(cs)) + " ELSE 0.5 END" for t, cs in Q.PREFERRED.items()) + " END"
K3_SQL = rf"""
WITH q AS (SELECT question_id, lower(min(question)) AS q FROM run_results WHERE question_id IS NOT NULL AND question IS NOT NULL GROUP BY 1),
c AS (SELECT question_id, {_COUNTS} FROM q), k AS (SELECT question_id, {_KIND} AS kind FROM c),
e AS (SELECT ev_id, question_id, kind, lower(chunk_text) AS x, cross_encoder_score AS s, {sql_chunk_type('chunk_text')} AS ct FROM expanded_evidence JOIN k USING (question_id)
    WHERE chunk_text IS NOT NULL AND cross_encoder_score IS NOT NULL AND NOT isnan(cross_encoder_score)),
b AS (SELECT question_id, ev_id, round(0.85 / (1 + exp(-s)) + 0.15 * ({_PLACE}
    + CASE WHEN kind IN ('HYPERPARAMETERS', 'RESULTS', 'TRAINING') THEN least(len(regexp_extract_all(x, '[0-9]+\.?[0-9]*')) * 0.1, 0.8) ELSE 0 END
    + CASE WHEN kind = 'HYPERPARAMETERS' THEN least(len(regexp_extract_all(x, '[a-zA-Z_][a-zA-Z0-9_]*\s*[=:]\s*[-+]?[0-9]*\.?[0-9]+')) * 0.2, 1.0) ELSE 0 END), 6) AS score FROM e)
SELECT question_id, ev_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, ev_id) AS rank FROM b QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, ev_id) <= 20"""


def _bm25(spark: SparkSession, d: str, k: int) -> DataFrame:
    q = table(spark, d, "benchmark_items", "item_id", "question").filter(F.col("item_id") % EVERY == 0).select(F.col("item_id").alias("query_id"), F.array_distinct(X.blank_tokens(F.col("question"))).alias("terms"))
    docs = table(spark, d, "documents", "doc_id", "text").filter("text IS NOT NULL").select("doc_id", X.blank_tokens(F.col("text")).alias("terms"))
    return K.bm25(q, docs, k)


def k4_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, 10)


_BM25 = rf"""
q AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(string_split_regex(lower(question), '[\s\x0b]+'), lambda w: w <> ''))) AS term FROM benchmark_items WHERE item_id % {EVERY} = 0),
dt AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[\s\x0b]+'), lambda w: w <> '') AS terms FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM dt),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM dt) GROUP BY 1, 2, 3),
idf AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), st),
adj AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf) ELSE idf END AS idf FROM idf),
sc AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN adj USING (term) JOIN q USING (term), st GROUP BY 1, 2),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc)"""
K4_SQL = f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 10"


def k5_fused(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "benchmark_items", "item_id", "question").filter(F.col("item_id") % EVERY == 0).select(F.col("item_id").alias("query_id"), F.explode(X.long_words(F.col("question"))).alias("term"))
    w = table(spark, d, "documents", "doc_id", "text").filter("text IS NOT NULL").select("doc_id", F.explode(X.long_words(F.col("text"))).alias("term"))
    overlap = w.join(q, "term").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("score"))
    overlap = top_k(overlap, "query_id", [F.desc("score"), F.asc("doc_id")], 30)
    return K.reciprocal_rank_fusion([_bm25(spark, d, 30), overlap], 10)


K5_SQL = rf"""
WITH {_BM25},
lq AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 4))) AS term FROM benchmark_items WHERE item_id % {EVERY} = 0),
ld AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 4))) AS term FROM documents WHERE text IS NOT NULL),
ov AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, doc_id) AS rank FROM ld JOIN lq USING (term) GROUP BY 1, 2),
u AS (SELECT query_id, doc_id, rank FROM bm WHERE rank <= 30 UNION ALL SELECT query_id, doc_id, rank FROM ov WHERE rank <= 30),
f AS (SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 9) AS score FROM u GROUP BY 1, 2)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10"""


def k8_reference_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Tables and figures that a question's chunks mention, with the first three chunks of the same question that are of such a type and hold the mention."""
    c = table(spark, d, "retrieved_chunks", "rc_id", "question_id", "chunk_text").filter("question_id IS NOT NULL AND chunk_text IS NOT NULL")
    mentions = F.array_distinct(F.regexp_extract_all(F.lower("chunk_text"), F.lit(r"\b(?:table|figure)\s*[0-9]+\b"), F.lit(0)))
    # a chunk that holds a mention makes one itself, so both sides meet by the mention
    held = c.select("question_id", "rc_id", F.explode(mentions).alias("reference"), "chunk_text")
    held = held.filter(X.chunk_type(F.col("chunk_text")).isin("TABLE", "MIXED", "EQUATION")).select("question_id", "reference", "rc_id")
    return top_k(held, ["question_id", "reference"], [F.asc("rc_id")], 3, "position")


K8_SQL = rf"""
WITH c AS (SELECT rc_id, question_id, lower(chunk_text) AS t, {sql_chunk_type('chunk_text')} AS type FROM retrieved_chunks WHERE question_id IS NOT NULL AND chunk_text IS NOT NULL),
m AS (SELECT DISTINCT question_id, rc_id, unnest(regexp_extract_all(t, '\b(?:table|figure)\s*[0-9]+\b')) AS reference FROM c WHERE type IN ('TABLE', 'MIXED', 'EQUATION'))
SELECT question_id, reference, row_number() OVER (PARTITION BY question_id, reference ORDER BY rc_id) AS position, rc_id FROM m QUALIFY row_number() OVER (PARTITION BY question_id, reference ORDER BY rc_id) <= 3"""


def k9_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Of each question the evidence of its best tier: verified, else of some confidence, else any."""
    e = table(spark, d, "expanded_evidence", "ev_id", "question_id", "verification_confidence").filter("question_id IS NOT NULL")
    c = F.col("verification_confidence")
    tiers = e.withColumn("tier", F.when(c >= 0.8, 1).when(c >= 0.4, 2).otherwise(3))
    return K.lowest_tier(tiers, "question_id", "tier").select("question_id", "ev_id", "tier")


K9_SQL = """
SELECT question_id, ev_id, tier FROM (SELECT question_id, ev_id, CASE WHEN verification_confidence >= 0.8 THEN 1 WHEN verification_confidence >= 0.4 THEN 2 ELSE 3 END AS tier FROM expanded_evidence WHERE question_id IS NOT NULL)
QUALIFY tier = min(tier) OVER (PARTITION BY question_id)"""


def k10_centroid_rank(spark: SparkSession, d: str) -> DataFrame:
    """Collections of vectors (by label) ranked for every twentieth vector by the cosine with their centroids."""
    e = table(spark, d, "embeddings", "vec_id", "label", "embedding")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    cent = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vec"))  # as long as the vectors
    return K.dense_top_k(_vectors(spark, d).filter(F.col("id") % EVERY == 0), cent.select(F.col("label").cast("long").alias("id"), "vec"), 3, skip_self=False).select("query_id", F.col("id").alias("label"), "rank")


K10_SQL = f"""
WITH p AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, unnest(range(1, 65)) AS r(i) GROUP BY 1, 2),
c AS (SELECT label, list(m ORDER BY i) AS e FROM p GROUP BY 1),
s AS (SELECT vec_id AS query_id, c.label, round(list_dot_product(CAST(v.embedding AS DOUBLE[]), c.e) / (sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) * sqrt(list_dot_product(c.e, c.e))), 9) AS x FROM embeddings v, c WHERE vec_id % {EVERY} = 0)
SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, label) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY x DESC, label) <= 3"""


def k11_cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Cached answers for every twentieth cached query: an equal query of the same repository, else the most similar one at 0.95 or more."""
    c = table(spark, d, "semantic_cache").withColumn("key", F.lower(F.trim("query_text")))
    asked = c.filter(F.col("cache_id") % EVERY == 0).select(F.col("cache_id").alias("asked_id"), "repo_id", "key")
    exact = asked.join(c.select("repo_id", "key", F.col("cache_id").alias("hit_id")), ["repo_id", "key"]).filter("hit_id <> asked_id").groupBy("asked_id").agg(F.min("hit_id").alias("hit_id"))
    v = usable_vectors(c, F.col("repo_id"), F.col("cache_id"), F.col("embedding"), F.lit(64))

    def unpack(batches):  # packed doubles to an array
        import numpy as np

        for b in batches:
            yield b.assign(vec=[np.frombuffer(x) for x in b["vec"]])

    v = v.mapInPandas(unpack, "grp string, id long, vec array<double>")
    near = K.dense_top_k(v.filter(F.col("id") % EVERY == 0), v, 1, within="grp").filter("cosine >= 0.95")
    near = near.select(F.col("query_id").alias("asked_id"), F.col("id").alias("near_id"))
    out = asked.select("asked_id").join(exact, "asked_id", "left").join(near, "asked_id", "left")
    return out.select("asked_id", F.coalesce("hit_id", "near_id", F.lit(-1)).alias("hit_id"), F.when(F.col("hit_id").isNotNull(), "exact").when(F.col("near_id").isNotNull(), "similar").otherwise("miss").alias("kind"))


K11_SQL = f"""
WITH r AS (SELECT cache_id AS id, repo_id, lower(trim(query_text)) AS key, embedding AS j FROM semantic_cache),
a AS (SELECT id, repo_id, CASE WHEN json_valid(j) AND json_type(j) = 'ARRAY' AND json_array_length(j) = 64 THEN CAST(j AS JSON) END AS j FROM r WHERE repo_id IS NOT NULL),
u AS (SELECT id, repo_id, CAST(j AS DOUBLE[]) AS v FROM a WHERE j IS NOT NULL AND len(list_filter(json_extract(j, '$[*]'), lambda x: json_type(x) NOT IN ('DOUBLE', 'BIGINT', 'UBIGINT'))) = 0),
n AS (SELECT *, sqrt(list_dot_product(v, v)) AS l FROM u WHERE len(list_filter(v, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
e AS (SELECT a.id AS asked_id, min(b.id) AS hit_id FROM r a JOIN r b ON a.repo_id = b.repo_id AND a.key = b.key AND a.id <> b.id WHERE a.id % {EVERY} = 0 GROUP BY 1),
s AS (SELECT a.id AS asked_id, b.id AS near_id, round(list_dot_product(a.v, b.v) / (a.l * b.l), 9) AS c FROM n a JOIN n b ON a.repo_id = b.repo_id AND a.id <> b.id WHERE a.id % {EVERY} = 0),
m AS (SELECT * FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY asked_id ORDER BY c DESC, near_id) = 1) WHERE c >= 0.95)
SELECT r.id AS asked_id, coalesce(hit_id, near_id, -1) AS hit_id, CASE WHEN hit_id IS NOT NULL THEN 'exact' WHEN near_id IS NOT NULL THEN 'similar' ELSE 'miss' END AS kind
FROM r LEFT JOIN e ON e.asked_id = r.id LEFT JOIN m ON m.asked_id = r.id WHERE r.id % {EVERY} = 0"""


def k12_prompt_keys(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "run_results", "question", "run_name").filter("question IS NOT NULL AND run_name IS NOT NULL").distinct()
    return r.select(F.sha2(F.concat_ws("::", "question", "run_name"), 256).alias("prompt_key"))


K12_SQL = "SELECT sha256(question || '::' || run_name) AS prompt_key FROM (SELECT DISTINCT question, run_name FROM run_results WHERE question IS NOT NULL AND run_name IS NOT NULL)"


def l1_routes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "run_results", "result_id", "question").filter("question IS NOT NULL").select("result_id", Q.route(F.col("question")).alias("r")).select("result_id", "r.*")


_SHARES = ", ".join("(" + " + ".join(rf"CAST(regexp_matches(q, '\b{p}\b') AS INTEGER)" for p in ps) + f") / {len(ps)} AS s_{a}" for a, ps in Q.ROUTES.items())
L1_SQL = f"""
WITH s AS (SELECT result_id, {_SHARES} FROM (SELECT result_id, lower(question) AS q FROM run_results WHERE question IS NOT NULL)),
b AS (SELECT result_id, greatest(s_code, s_data, s_reasoning) AS m, s_code + s_data + s_reasoning AS t, CASE greatest(s_code, s_data, s_reasoning) WHEN s_code THEN 'code' WHEN s_data THEN 'data' ELSE 'reasoning' END AS a FROM s),
c AS (SELECT result_id, a, CASE WHEN t > 0 THEN m / t ELSE 0.0 END AS c FROM b)
SELECT result_id, CASE WHEN a = 'code' AND c >= 0.75 THEN 'code' WHEN c < 0.6 THEN 'reasoning' ELSE a END AS agent, round(c, 6) AS confidence FROM c"""


def l8_corpus_mode(spark: SparkSession, d: str) -> DataFrame:
    """Whether a question is about several papers, by the words in it, and so searched in the whole corpus."""
    several = F.lower("question").rlike("|".join(Q.COMPARISONS))
    return table(spark, d, "run_results", "result_id", "question").filter("question IS NOT NULL").select("result_id", F.when(several, "corpus").otherwise("single").alias("mode"))


L8_SQL = "SELECT result_id, CASE WHEN regexp_matches(lower(question), 'compare|vs|versus|difference between|different|contrast|both|all|each|multiple|several') THEN 'corpus' ELSE 'single' END AS mode FROM run_results WHERE question IS NOT NULL"


def l2_question_types(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "run_results", "result_id", "question").filter("question IS NOT NULL").select("result_id", Q.question_type(F.col("question")).alias("t"))
    return t.select("result_id", "t.type", F.round("t.confidence", 6).alias("confidence"))


L2_SQL = f"""
WITH c AS (SELECT result_id, {_COUNTS} FROM (SELECT result_id, lower(question) AS q FROM run_results WHERE question IS NOT NULL))
SELECT result_id, {_KIND} AS type, round(CASE WHEN greatest({', '.join(f'c_{t}' for t in Q.TYPES)}) > 0 THEN least(greatest({', '.join(f'c_{t}' for t in Q.TYPES)}) / 3, 1.0) ELSE 0.5 END, 6) AS confidence FROM c"""


def l5_intents(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("question")
    sym = r"(?i){} [`'\"]?([\p{{L}}\p{{N}}_./:-]+)"
    hit = F.coalesce(*[F.when(q.rlike(sym.format(p)), F.struct(F.lit(k).alias("intent"), F.regexp_extract(q, sym.format(p), 1).alias("symbol"))) for k, p in Q.INTENTS.items()])
    return table(spark, d, "run_results", "result_id", "question").select("result_id", hit.alias("h")).filter("h IS NOT NULL").select("result_id", "h.intent", "h.symbol")


def _intent_sql(k: str, p: str) -> str:
    return rf"WHEN regexp_matches(question, '(?i){p} [`''\"]?[\p{{L}}\p{{N}}_./:-]+') THEN {{'intent': '{k}', 'symbol': regexp_extract(question, '(?i){p} [`''\"]?([\p{{L}}\p{{N}}_./:-]+)', 1)}}"


L5_SQL = "SELECT result_id, h.intent AS intent, h.symbol AS symbol FROM (SELECT result_id, CASE " + " ".join(
    _intent_sql(k, p) for k, p in Q.INTENTS.items()
) + " END AS h FROM run_results) WHERE h IS NOT NULL"


def m1_context(spark: SparkSession, d: str) -> DataFrame:
    """Context of each question: distinct chunks without low-value sections, scored by content, three a section, sections in reading order, at most 15."""
    c = table(spark, d, "retrieved_chunks").filter("question_id IS NOT NULL AND chunk_text IS NOT NULL")
    c = first_per_hash(c, "question_id", "chunk_hash", [F.desc_nulls_last("similarity"), F.asc("rc_id")])
    c = c.filter(~F.lower(F.coalesce("section", F.lit(""))).rlike(X.LOW_VALUE))
    kind = X.chunk_type(F.col("chunk_text"))
    weight = F.when(kind == "HYPERPARAMETERS", 3.0).when(kind == "TABLE", 2.5).when(kind == "EQUATION", 2.0).when(kind == "ALGORITHM", 1.5).when(kind == "MIXED", 1.0).otherwise(0.0)
    numbers = F.least(F.regexp_count("chunk_text", F.lit(X.NUMBER)) * 0.1, F.lit(1.0))
    pairs = F.least(F.regexp_count("chunk_text", F.lit(r"[a-zA-Z_][a-zA-Z0-9_]*\s*[=:]\s*[0-9.]+")) * 0.5, F.lit(1.5))
    c = c.select("question_id", "rc_id", F.coalesce("section", F.lit("Unknown")).alias("section"), F.coalesce("page", F.lit(9999)).alias("page"), F.round(weight + numbers + pairs, 4).alias("score"))
    c = c.withColumn("first_page", F.min("page").over(Window.partitionBy("question_id", "section")))
    c = c.withColumn("r", F.row_number().over(Window.partitionBy("question_id", "section").orderBy(F.desc("score"), "rc_id"))).filter("r <= 3")
    return top_k(c, "question_id", [F.asc("first_page"), F.asc("section"), F.asc("page"), F.asc("rc_id")], 15, "position").select("question_id", "position", "rc_id", "score")


M1_SQL = rf"""
WITH u AS (SELECT * FROM retrieved_chunks WHERE question_id IS NOT NULL AND chunk_text IS NOT NULL AND chunk_hash <> '' QUALIFY row_number() OVER (PARTITION BY question_id, chunk_hash ORDER BY similarity DESC NULLS LAST, rc_id) = 1),
t AS (SELECT question_id, rc_id, coalesce(section, 'Unknown') AS section, coalesce(page, 9999) AS page, chunk_text AS x, {sql_chunk_type('chunk_text')} AS k FROM u WHERE NOT regexp_matches(lower(coalesce(section, '')), '{X.LOW_VALUE}')),
s AS (SELECT question_id, rc_id, section, page, round(CASE k WHEN 'HYPERPARAMETERS' THEN 3.0 WHEN 'TABLE' THEN 2.5 WHEN 'EQUATION' THEN 2.0 WHEN 'ALGORITHM' THEN 1.5 WHEN 'MIXED' THEN 1.0 ELSE 0.0 END
    + least(len(regexp_extract_all(x, '[0-9]+\.?[0-9]*')) * 0.1, 1.0) + least(len(regexp_extract_all(x, '[a-zA-Z_][a-zA-Z0-9_]*\s*[=:]\s*[0-9.]+')) * 0.5, 1.5), 4) AS score FROM t),
f AS (SELECT *, min(page) OVER (PARTITION BY question_id, section) AS first_page, row_number() OVER (PARTITION BY question_id, section ORDER BY score DESC, rc_id) AS r FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY first_page, section, page, rc_id) AS position FROM f WHERE r <= 3)
SELECT question_id, position, rc_id, score FROM p WHERE position <= 15"""


def m2_context_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Numbered, cited excerpts of each question's five best chunks as one prompt block."""
    c = table(spark, d, "retrieved_chunks").filter("question_id IS NOT NULL AND chunk_text IS NOT NULL")
    c = top_k(c, "question_id", [F.desc_nulls_last("similarity"), F.asc("rc_id")], 5)
    head = F.concat(F.lit("[EXCERPT "), F.col("rank").cast("string"), F.lit("] "), X.citation(F.col("paper_title"), F.col("pdf_filename"), F.col("page")))
    text = F.trim("chunk_text")
    body = F.when(F.length(text) > EXCERPT, F.concat(F.substring(text, 1, EXCERPT), F.lit("\n...[truncated]"))).otherwise(text)
    blocks = c.select("question_id", F.struct("rank", F.concat(head, F.lit("\n"), body).alias("b")).alias("s")).groupBy("question_id").agg(F.array_sort(F.collect_list("s")).alias("bs"))  # five a question
    return blocks.select("question_id", F.array_join(F.transform("bs", lambda s: s["b"]), "\n\n").alias("context"))


M2_SQL = f"""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC NULLS LAST, rc_id) AS rank FROM retrieved_chunks WHERE question_id IS NOT NULL AND chunk_text IS NOT NULL),
b AS (SELECT question_id, rank, '[EXCERPT ' || CAST(rank AS VARCHAR) || '] ' || coalesce(nullif(paper_title, ''), nullif(pdf_filename, ''), 'Unknown Paper') || ', ' || CASE WHEN page IS NULL THEN 'Page unknown' ELSE 'Page ' || CAST(page AS VARCHAR) END
    || chr(10) || CASE WHEN length(trim(chunk_text)) > {EXCERPT} THEN substring(trim(chunk_text), 1, {EXCERPT}) || chr(10) || '...[truncated]' ELSE trim(chunk_text) END AS b FROM c WHERE rank <= 5)
SELECT question_id, string_agg(b, chr(10) || chr(10) ORDER BY rank) AS context FROM b GROUP BY 1"""

QUERIES = {
    "k1_dense_top_k": (k1_dense_top_k, K1_SQL),
    "k1_filtered_top_k": (k1_filtered_top_k, K1F_SQL),
    "k2_diverse_top_k": (k2_diverse_top_k, None),
    "k3_reranked": (k3_reranked, K3_SQL),
    "k4_bm25": (k4_bm25, K4_SQL),
    "k5_fused": (k5_fused, K5_SQL),
    "k8_reference_chunks": (k8_reference_chunks, K8_SQL),
    "k9_fallback": (k9_fallback, K9_SQL),
    "k10_centroid_rank": (k10_centroid_rank, K10_SQL),
    "k11_cache_lookup": (k11_cache_lookup, K11_SQL),
    "k12_prompt_keys": (k12_prompt_keys, K12_SQL),
    "l1_routes": (l1_routes, L1_SQL),
    "l2_question_types": (l2_question_types, L2_SQL),
    "l8_corpus_mode": (l8_corpus_mode, L8_SQL),
    "l5_intents": (l5_intents, L5_SQL),
    "m1_context": (m1_context, M1_SQL),
    "m2_context_blocks": (m2_context_blocks, M2_SQL),
}
