"""Ranking operators: exact dense search in blocks, BM25, rank fusion, diversity, reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2_048


def _packed(df: DataFrame, side: str, within: str | None = None) -> DataFrame:
    """Rows (id, vec array) packed into blocks: one row holds up to BLOCK ids and their unit vectors, of one value of ``within``."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[int] = []
        vecs: list[np.ndarray] = []
        group: str | None = None

        def block() -> pd.DataFrame:
            m = np.array(vecs, dtype="float64")
            norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
            packed = {"grp": [group], f"{side}_ids": [np.array(ids, dtype="int64").tobytes()], f"{side}_vecs": [(m / np.where(norms > 0, norms, 1.0)).tobytes()]}
            return pd.DataFrame(packed)

        for b in batches:
            for g, i, v in zip(b["grp"], b["id"], b["vec"]):
                if ids and (len(ids) == BLOCK or g != group):
                    yield block()
                    ids, vecs = [], []
                group = g
                ids.append(i), vecs.append(np.asarray(v, dtype="float64"))
        if ids:
            yield block()

    rows = df.select((F.col(within).cast("string") if within else F.lit("")).alias("grp"), "id", "vec").filter("grp IS NOT NULL AND id IS NOT NULL AND vec IS NOT NULL")
    if within:
        rows = rows.sortWithinPartitions("grp")
    return rows.mapInPandas(pack, f"grp string, {side}_ids binary, {side}_vecs binary")


def dense_top_k(queries: DataFrame, rows: DataFrame, k: int, skip_self: bool = True, within: str | None = None) -> DataFrame:
    """(query_id, id, cosine, rank): the ``k`` rows of highest cosine for each query; ties go to the smaller id.

    Both sides are (id, vec array of one length) and are packed into blocks; every pair of a query block and a row block is
    one matrix product that keeps ``k`` a query, and the kept ones are merged by query. Nulls are left out; empty sides give no rows.
    With ``within``, a column of both sides, only rows that are equal in it are searched; its nulls find nothing.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for qi, qv, xi, xv in b[["q_ids", "q_vecs", "x_ids", "x_vecs"]].itertuples(index=False, name=None):
                q_ids, x_ids = np.frombuffer(qi, dtype="int64"), np.frombuffer(xi, dtype="int64")
                q, x = np.frombuffer(qv).reshape(len(q_ids), -1), np.frombuffer(xv).reshape(len(x_ids), -1)
                cos = np.round(q @ x.T, 9)
                if skip_self:
                    cos[q_ids[:, None] == x_ids[None, :]] = -9
                order = np.argsort(x_ids, kind="stable")
                top = order[np.argsort(-cos[:, order], axis=1, kind="stable")[:, : min(k, len(x_ids))]]
                best = np.take_along_axis(cos, top, axis=1)
                yield pd.DataFrame({"query_id": np.repeat(q_ids, top.shape[1]), "id": x_ids[top].ravel(), "cosine": best.ravel()})

    q, x = _packed(queries, "q", within), _packed(rows, "x", within)
    pairs = q.join(x, "grp") if within else q.drop("grp").crossJoin(x.drop("grp"))  # of blocks: a stated query set against all rows
    found = pairs.mapInPandas(search, "query_id long, id long, cosine double").filter("cosine > -9")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """(query_id, doc_id, score, rank): Okapi BM25 of documents for queries; ties go to the smaller id.

    ``queries`` is (query_id, terms array), ``docs`` (doc_id, terms array). A negative inverse document frequency becomes ``floor`` times the
    mean one. Only terms of queries leave the documents' tasks. Documents without terms count towards the mean length.
    """
    q = queries.select("query_id", F.explode("terms").alias("term"))
    asked = q.select("term").distinct()
    sized = docs.select("doc_id", "terms", F.size("terms").alias("dl"))
    stats = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = sized.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    tf = sized.select("doc_id", "dl", F.explode("terms").alias("term")).join(asked, "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = df.crossJoin(F.broadcast(stats)).withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # stats is one row
    mean = idf.agg(F.avg("idf").alias("mean_idf"))
    idf = idf.join(asked, "term", "left_semi").crossJoin(F.broadcast(mean))
    idf = idf.withColumn("idf", F.when(F.col("idf") < 0, floor * F.col("mean_idf")).otherwise(F.col("idf")))
    hits = tf.join(idf, "term").join(q, "term")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scores = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """(query_id, doc_id, score, rank): rankings of (query_id, doc_id, rank) fused by the sum of 1 / (constant + rank)."""
    every = rankings[0].select("query_id", "doc_id", "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select("query_id", "doc_id", "rank"))
    fused = every.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (constant + F.col("rank"))), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def marginal_relevance(candidates: DataFrame, k: int, balance: float = 0.5) -> DataFrame:
    """(query_id, id, position): greedy maximal marginal relevance among a query's candidates.

    ``candidates`` is (query_id, id, rank, relevance, vec array), already cut to few rows a query. A query with at most ``k``
    candidates keeps their order; ties go to the earlier rank.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank", kind="stable")
        if len(rows) > k:
            x = np.array([np.asarray(v, dtype="float64") for v in rows["vec"]])
            x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
            sim, rel = x @ x.T, rows["relevance"].to_numpy()
            picked = [int(np.argmax(rel))]
            while len(picked) < k:
                score = balance * rel - (1 - balance) * sim[:, picked].max(axis=1)
                score[picked] = -np.inf
                picked.append(int(np.argmax(score)))
            rows = rows.iloc[picked]
        return pd.DataFrame({"query_id": rows["query_id"].to_numpy(), "id": rows["id"].to_numpy(), "position": np.arange(1, len(rows) + 1)})

    return candidates.groupBy("query_id").applyInPandas(choose, "query_id long, id long, position long")


def blended_score(relevance: Column, type_score: Column, weight: float = 0.85) -> Column:
    """The sigmoid of a relevance score blended with a score of the chunk's type."""
    return weight / (1 + F.exp(-relevance)) + (1 - weight) * type_score


def lowest_tier(df: DataFrame, key: str, tier: str) -> DataFrame:
    """Of each key the rows of its lowest tier: a cascade of fallbacks in one pass."""
    return df.withColumn("__t", F.min(tier).over(Window.partitionBy(key))).filter(F.col(tier) == F.col("__t")).drop("__t")
