"""Filters, joins and groupings that the retrieval and evaluation queries share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def equals_all(df: DataFrame, criteria: dict[str, object]) -> DataFrame:
    """Rows whose columns equal all criteria; a null never does, no criteria keep every row."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in criteria.items()], F.lit(True)))


def keep_unless_empty(df: DataFrame, key: str, keep: Column) -> DataFrame:
    """Per ``key`` the rows where ``keep`` holds, or all rows of keys where it holds for none. A null condition counts as false."""
    marked = df.withColumn("__keep", F.coalesce(keep, F.lit(False)).cast("int"))
    any_kept = F.max("__keep").over(Window.partitionBy(key))
    return marked.withColumn("__any", any_kept).filter((F.col("__keep") == 1) | (F.col("__any") == 0)).drop("__keep", "__any")


def last_per_key(df: DataFrame, key: str, order: list[Column], columns: list[str]) -> DataFrame:
    """The last row of each key under ``order``, by a maximum of structs, which is combined before the shuffle."""
    last = df.groupBy(key).agg(F.max(F.struct(*order, *[F.col(c) for c in columns])).alias("__s"))
    return last.select(key, *[F.col(f"__s.{c}").alias(c) for c in columns])


def first_per_hash(df: DataFrame, group: str, hash_col: str, order: list[Column]) -> DataFrame:
    """Order-preserving distinct: the first row of each hash in a group; rows with an empty or null hash are dropped."""
    w = Window.partitionBy(group, hash_col).orderBy(*order)
    return df.filter(F.col(hash_col).isNotNull() & (F.col(hash_col) != "")).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def top_k(df: DataFrame, group: str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The ``k`` first rows of each group with their rank; the row limit reaches below the shuffle as a group limit."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col(rank) <= k)


def compare_runs(current: DataFrame, baseline: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """(key, metric, baseline, current, diff) for every metric of keys in either run; a side that lacks the key is null."""
    a = current.select(key, *[F.col(m).alias(f"c_{m}") for m in metrics])
    b = baseline.select(key, *[F.col(m).alias(f"b_{m}") for m in metrics])
    both = a.join(b, key, "full")
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"b_{m}").alias("baseline"), F.col(f"c_{m}").alias("current")) for m in metrics])
    out = both.select(key, F.explode(pairs).alias("p")).select(key, "p.*")
    return out.withColumn("diff", F.col("current") - F.col("baseline"))
