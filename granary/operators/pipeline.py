"""A retrieval pipeline of the ranking operators, with parts that may be left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import questions as Q
from granary.functions import text as X
from granary.operators import retrieval as K
from granary.operators.relations import first_per_hash, keep_unless_empty, top_k


def retrieve(queries: DataFrame, vectors: DataFrame, chunks: DataFrame, k: int = 10, wide: int = 50, diverse: int | None = 15, sections: bool = True, rerank: bool = True) -> DataFrame:
    """(query_id, rank, chunk_id, score): the ``k`` best chunks of every query.

    ``queries`` is (id, question, vec), ``vectors`` (id, chunk_hash, vec) and ``chunks`` (chunk_id, chunk_hash, section, chunk_text). The ``wide`` nearest vectors become chunks by their hash, each
    text once; sections of little value go unless nothing else is left (``sections``); ``diverse`` chunks are picked by marginal relevance, unless it is None; and cosine and
    what suits the type of question are blended into the final score (``rerank``). Queries without a chunk give no row, vectors without one are passed over.
    """
    near = K.dense_top_k(queries.select("id", "vec"), vectors.select("id", "vec"), wide, skip_self=False)
    first = chunks.filter("chunk_hash IS NOT NULL AND chunk_text IS NOT NULL").groupBy("chunk_hash").agg(F.min(F.struct("chunk_id", "section", "chunk_text")).alias("c")).select("chunk_hash", "c.*")
    found = near.join(vectors.select("id", "chunk_hash", "vec"), "id").join(first, "chunk_hash")
    found = first_per_hash(found, "query_id", "chunk_hash", [F.desc("cosine"), F.asc("id")])
    if sections:
        found = keep_unless_empty(found, "query_id", ~F.lower(F.coalesce("section", F.lit(""))).rlike(X.LOW_VALUE))
    if diverse is not None:
        # marginal relevance starts from the order by cosine
        placed = top_k(found, "query_id", [F.desc("cosine"), F.asc("id")], wide, "place")
        picked = K.marginal_relevance(placed.select("query_id", "id", F.col("place").alias("rank"), F.col("cosine").alias("relevance"), "vec"), diverse)
        found = found.join(picked.select("query_id", "id"), ["query_id", "id"])
    score = F.col("cosine")
    if rerank:
        kinds = queries.select(F.col("id").alias("query_id"), Q.question_type(F.col("question")).alias("t")).select("query_id", F.col("t.type").alias("kind"))
        found = found.join(kinds, "query_id")
        score = K.blended_score(F.col("cosine"), Q.type_score(F.col("kind"), X.chunk_type(F.col("chunk_text")), F.col("chunk_text")))
    found = found.select("query_id", "chunk_id", F.round(score, 6).alias("score"))
    return top_k(found, "query_id", [F.desc("score"), F.asc("chunk_id")], k).select("query_id", "rank", "chunk_id", "score")
