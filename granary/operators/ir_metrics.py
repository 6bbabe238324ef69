"""Retrieval metrics for all questions at once, from ranked results and relevant sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS = (1, 3, 5, 10)


def judged_ranking(results: DataFrame, relevant: DataFrame) -> DataFrame:
    """(question_id, rank, doc, hit, n_relevant): each result marked as relevant or not.

    ``results`` is (question_id, rank from 1, doc), ``relevant`` (question_id, doc). A question without relevant documents has n_relevant 0;
    questions without results don't occur.
    """
    gold = relevant.select("question_id", "doc").distinct()
    sizes = gold.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    hits = results.join(gold.withColumn("hit", F.lit(1)), ["question_id", "doc"], "left")
    return hits.join(sizes, "question_id", "left").select("question_id", "rank", "doc", F.coalesce("hit", F.lit(0)).alias("hit"), F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"))


def ranking_metrics(judged: DataFrame) -> DataFrame:
    """One row a question: recall, precision and nDCG at each cutoff, reciprocal rank and average precision.

    Every result that is relevant counts, repeated ones too, so recall can exceed 1; without relevant documents all metrics are 0.
    """
    w = Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = judged.withColumn("hits_so_far", F.sum("hit").over(w))
    n = F.first("n_relevant")
    safe = lambda x: F.when(n > 0, x / n).otherwise(0.0)
    aggs = []
    for k in CUTOFFS:
        within = F.col("rank") <= k
        hits = F.sum(F.when(within, F.col("hit")).otherwise(0))
        dcg = F.sum(F.when(within, F.col("hit") / F.log2(F.col("rank") + 1)).otherwise(0.0))
        ideal = sum((F.when(n >= i, F.lit(1.0) / F.log2(F.lit(i + 1.0))).otherwise(0.0) for i in range(1, k + 1)), F.lit(0.0))
        aggs += [F.round(safe(hits), 6).alias(f"recall_{k}"), F.round(hits / k, 6).alias(f"precision_{k}"), F.round(F.when(n > 0, dcg / ideal).otherwise(0.0), 6).alias(f"ndcg_{k}")]
    first = F.min(F.when(F.col("hit") == 1, F.col("rank")))
    aggs += [F.round(F.coalesce(1 / first, F.lit(0.0)), 6).alias("reciprocal_rank"), F.round(safe(F.sum(F.col("hit") * F.col("hits_so_far") / F.col("rank"))), 6).alias("average_precision")]
    return j.groupBy("question_id").agg(*aggs)


def distinct_recall(judged: DataFrame, k: int) -> DataFrame:
    """Recall at ``k`` over distinct documents, 1 where nothing is relevant."""
    hit = F.count_distinct(F.when((F.col("rank") <= k) & (F.col("hit") == 1), F.col("doc")))
    n = F.first("n_relevant")
    return judged.groupBy("question_id").agg(F.round(F.when(n > 0, hit / n).otherwise(1.0), 6).alias("recall"))
