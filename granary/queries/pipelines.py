"""Queries of whole pipelines: cached questions against the vectors of chunks, with parts left out, and prompts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import questions as Q
from granary.functions import text as X
from granary.operators import retrieval as K
from granary.operators.pipeline import retrieve
from granary.operators.relations import top_k
from granary.operators.similar_vectors import usable_vectors
from granary.queries.retrieval import EVERY, EXCERPT
from granary.sources.tables import table

#: What is answered where nothing was found. Fixed value.
NOT_FOUND = "I cannot find this information in the uploaded documents."
#: Chunks and characters of each in a prompt of the code, data and reasoning handlers. Fixed values.
FEW, SHORT = 3, 1_000


def _unpacked(v: DataFrame) -> DataFrame:
    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(vec=[np.frombuffer(x) for x in b["vec"]])

    return v.mapInPandas(unpack, "grp string, id long, vec array<double>").select("id", "vec")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """(id, question, vec) of every twentieth cached question."""
    c = table(spark, d, "semantic_cache", "cache_id", "query_text", "embedding").filter(F.col("cache_id") % EVERY == 0)
    v = _unpacked(usable_vectors(c, F.lit(""), F.col("cache_id"), F.col("embedding"), F.lit(64)))
    return v.join(c.select(F.col("cache_id").alias("id"), F.coalesce("query_text", F.lit("")).alias("question")), "id")


def _chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, chunk_hash, vec) of the usable vectors of the model that questions have, too."""
    e = table(spark, d, "emb_cache", "emb_id", "chunk_hash", "model_name", "embedding_json").filter("model_name = 'minilm-64'")
    return _unpacked(usable_vectors(e, F.lit(""), F.col("emb_id"), F.col("embedding_json"), F.lit(64))).join(e.select(F.col("emb_id").alias("id"), "chunk_hash"), "id")


def q3_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest chunk vectors of every twentieth cached question."""
    return K.dense_top_k(_asked(spark, d), _chunk_vectors(spark, d), 5, skip_self=False).select("query_id", "id", "rank", F.round("cosine", 6).alias("cosine"))


_USABLE = """
u{t} AS (SELECT id, CAST(j AS DOUBLE[]) AS v FROM (SELECT {i} AS id, CASE WHEN json_valid({j}) AND json_type({j}) = 'ARRAY' AND json_array_length({j}) = 64 THEN CAST({j} AS JSON) END AS j FROM {f}) WHERE j IS NOT NULL AND len(list_filter(json_extract(j, '$[*]'), lambda x: json_type(x) NOT IN ('DOUBLE', 'BIGINT', 'UBIGINT'))) = 0),
n{t} AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS l FROM u{t} WHERE len(list_filter(v, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0)"""
_BOTH = _USABLE.format(t="q", i="cache_id", j="embedding", f="semantic_cache") + "," + _USABLE.format(t="x", i="emb_id", j="embedding_json", f="(SELECT * FROM emb_cache WHERE model_name = 'minilm-64')")
Q3_SQL = f"""WITH {_BOTH},
s AS (SELECT q.id AS query_id, x.id, round(list_dot_product(q.v, x.v) / (q.l * x.l), 9) AS cosine FROM nq q, nx x WHERE q.id % {EVERY} = 0)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank, round(cosine, 6) AS cosine FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) <= 5"""


def o12_completeness(spark: SparkSession, d: str) -> DataFrame:
    """How completely each label's vectors are met by the others: the mean over every twentieth vector of its highest cosine with another of its label, in percent."""
    e = table(spark, d, "embeddings", "vec_id", "label", "embedding").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vec"))
    asked = e.filter(F.col("id") % EVERY == 0)
    best = K.dense_top_k(asked, e, 1, within="label").join(asked.select(F.col("id").alias("query_id"), "label"), "query_id")
    mean = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * F.avg("cosine")))
    return best.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(mean, 4).alias("completeness"))


O12_SQL = f"""
WITH v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(e, e)) AS l FROM v),
s AS (SELECT q.id, q.label, max(round(list_dot_product(q.e, x.e) / (q.l * x.l), 9)) AS c FROM n q JOIN n x ON q.label = x.label AND q.id <> x.id WHERE q.id % {EVERY} = 0 GROUP BY 1, 2)
SELECT label, count(*) AS n, round(greatest(0.0, least(100.0, 100 * avg(c))), 4) AS completeness FROM s GROUP BY 1"""


def k6_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth cached question through the whole pipeline: 50 nearest, each text once, sections, 15 by marginal relevance, blended score."""
    chunks = table(spark, d, "retrieved_chunks", F.col("rc_id").alias("chunk_id"), "chunk_hash", "section", "chunk_text")
    return retrieve(_asked(spark, d), _chunk_vectors(spark, d), chunks)


VARIANTS = {"full": {}, "vectors only": {"diverse": None, "sections": False, "rerank": False}, "no diversity": {"diverse": None}, "no sections": {"sections": False}, "no rerank": {"rerank": False}}


def k14_ablations(spark: SparkSession, d: str) -> DataFrame:
    """The pipeline with parts left out: of each variant the questions answered and the share of its chunks that the whole pipeline gives, too."""
    chunks = table(spark, d, "retrieved_chunks", F.col("rc_id").alias("chunk_id"), "chunk_hash", "section", "chunk_text")
    asked, vectors = _asked(spark, d), _chunk_vectors(spark, d)
    every = None
    for name, parts in VARIANTS.items():
        one = retrieve(asked, vectors, chunks, **parts).select(F.lit(name).alias("variant"), "query_id", "chunk_id")
        every = one if every is None else every.unionByName(one)
    full = every.filter("variant = 'full'").select("query_id", "chunk_id", F.lit(1.0).alias("kept"))
    g = every.join(full, ["query_id", "chunk_id"], "left").groupBy("variant")
    return g.agg(F.count_distinct("query_id").alias("questions"), F.count(F.lit(1)).alias("chunks"), F.round(F.avg(F.coalesce("kept", F.lit(0.0))), 6).alias("in_full"))


def _best_chunks(spark: SparkSession, d: str, k: int) -> DataFrame:
    c = table(spark, d, "retrieved_chunks").filter("question_id IS NOT NULL AND length(trim(chunk_text)) > 0")
    return top_k(c, "question_id", [F.desc_nulls_last("similarity"), F.asc("rc_id")], k)


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "run_results", "question_id", "question").filter("question_id IS NOT NULL AND question IS NOT NULL").groupBy("question_id").agg(F.min("question").alias("question"))


def _joined(parts: DataFrame) -> DataFrame:
    blocks = parts.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "b"))).alias("bs"))  # a few a question
    return blocks.select("question_id", F.array_join(F.transform("bs", lambda s: s["b"]), "\n\n").alias("context"))


def m4_grounded_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The prompt of each question: the rule to keep to the excerpts, or to say the fixed sentence, five cited excerpts and the question; without excerpts that sentence alone."""
    text = F.trim("chunk_text")
    body = F.when(F.length(text) > EXCERPT, F.concat(F.substring(text, 1, EXCERPT), F.lit("\n...[truncated]"))).otherwise(text)
    head = F.concat(F.lit("[EXCERPT "), F.col("rank").cast("string"), F.lit("] "), X.citation(F.col("paper_title"), F.col("pdf_filename"), F.col("page")))
    context = _joined(_best_chunks(spark, d, 5).select("question_id", "rank", F.concat(head, F.lit("\n"), body).alias("b")))
    rule = F.lit(f"Answer from these excerpts only and cite them as [Excerpt N]. If they don't say it, answer: {NOT_FOUND}\n\n")
    prompt = F.coalesce(F.concat(rule, "context", F.lit("\n\nQuestion: "), "question"), F.lit(NOT_FOUND))
    return _questions(spark, d).join(context, "question_id", "left").select("question_id", prompt.alias("prompt"))


_CITED = "coalesce(nullif(paper_title, ''), nullif(pdf_filename, ''), 'Unknown Paper') || ', ' || CASE WHEN page IS NULL THEN 'Page unknown' ELSE 'Page ' || CAST(page AS VARCHAR) END"
_BEST = "c AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC NULLS LAST, rc_id) AS rank FROM retrieved_chunks WHERE question_id IS NOT NULL AND length(trim(chunk_text)) > 0), q AS (SELECT question_id, min(question) AS question FROM run_results WHERE question_id IS NOT NULL AND question IS NOT NULL GROUP BY 1)"
M4_SQL = f"""
WITH {_BEST}, b AS (SELECT question_id, string_agg('[EXCERPT ' || CAST(rank AS VARCHAR) || '] ' || {_CITED} || chr(10) || CASE WHEN length(trim(chunk_text)) > {EXCERPT} THEN substring(trim(chunk_text), 1, {EXCERPT}) || chr(10) || '...[truncated]' ELSE trim(chunk_text) END, chr(10) || chr(10) ORDER BY rank) AS context
    FROM c WHERE rank <= 5 GROUP BY 1)
SELECT question_id, coalesce('Answer from these excerpts only and cite them as [Excerpt N]. If they don''t say it, answer: {NOT_FOUND}' || chr(10) || chr(10) || context || chr(10) || chr(10) || 'Question: ' || question, '{NOT_FOUND}') AS prompt FROM q LEFT JOIN b USING (question_id)"""


def m5_handler_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The prompt of each question for the handler that it is routed to: three short chunks with their file and section, and the question."""
    text = F.col("chunk_text")
    body = F.when(F.length(text) > SHORT, F.concat(F.substring(text, 1, SHORT), F.lit("\n...[truncated]"))).otherwise(text)
    head = F.concat(F.lit("[File: "), F.coalesce("pdf_filename", F.lit("unknown")), F.lit(" | Section: "), F.coalesce("section", F.lit("None")), F.lit("]\n"))
    context = _joined(_best_chunks(spark, d, FEW).select("question_id", "rank", F.concat(head, body).alias("b")))
    q = _questions(spark, d).select("question_id", "question", Q.route(F.col("question"))["agent"].alias("agent")).join(context, "question_id", "left")
    prompt = F.concat(F.lit("Handler: "), "agent", F.lit("\nContext:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), "question")
    return q.select("question_id", "agent", F.md5(prompt).alias("prompt_digest"), F.length(prompt).alias("chars"))


def _m5_sql() -> str:
    from granary.queries.retrieval import L1_SQL

    routed = L1_SQL.replace("FROM run_results WHERE question IS NOT NULL", "FROM q").replace("result_id", "question_id").strip()
    return f"""
WITH {_BEST}, a AS ({routed}), b AS (SELECT question_id, string_agg('[File: ' || coalesce(pdf_filename, 'unknown') || ' | Section: ' || coalesce(section, 'None') || ']' || chr(10) || CASE WHEN length(chunk_text) > {SHORT} THEN substring(chunk_text, 1, {SHORT}) || chr(10) || '...[truncated]' ELSE chunk_text END, chr(10) || chr(10) ORDER BY rank) AS context
    FROM c WHERE rank <= {FEW} GROUP BY 1),
p AS (SELECT question_id, agent, 'Handler: ' || agent || chr(10) || 'Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || question AS p FROM q JOIN a USING (question_id) LEFT JOIN b USING (question_id))
SELECT question_id, agent, md5(p) AS prompt_digest, length(p) AS chars FROM p"""


QUERIES = {
    "k6_pipeline": (k6_pipeline, None),
    "k14_ablations": (k14_ablations, None),
    "m4_grounded_prompts": (m4_grounded_prompts, M4_SQL),
    "m5_handler_prompts": (m5_handler_prompts, _m5_sql()),
    "o12_completeness": (o12_completeness, O12_SQL),
    "q3_candidates": (q3_candidates, Q3_SQL),
}
