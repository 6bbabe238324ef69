"""Joining rows with one row a key, where a key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.plans.lineage import materialize

#: A key of this many rows is hot if it also holds a thousandth of all rows, so there are at most a thousand hot keys.
HOT_ROWS = 50_000
HOT_SHARE = 1_000


def skew_join(rows: DataFrame, per_key: DataFrame, key: list[str], counted: DataFrame | None = None) -> DataFrame:
    """The inner join of ``rows`` with ``per_key``, which has one row a key.

    Adaptive execution splits a hot partition only between map outputs, only beyond 256 MB and not below an aggregate of the same stage,
    so hot keys are counted first (combined in every task before the shuffle). Their rows stay where they are and get the at most
    HOT_SHARE rows of hot keys by broadcast; all other rows are shuffled, and none of their keys is large. Keys are counted in ``counted``, a written table
    with the keys of ``rows``, or in ``rows`` itself, which should then be a written table.
    """
    counted = rows if counted is None else counted
    total = counted.count()
    if total < HOT_ROWS:
        return rows.join(per_key, key)
    hot = counted.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= max(HOT_ROWS, total // HOT_SHARE)).select(*key)
    hot = materialize(hot)
    if hot.isEmpty():
        return rows.join(per_key, key)
    few = F.broadcast(hot)  # at most HOT_SHARE keys
    warm = rows.join(few, key, "left_semi").join(F.broadcast(per_key.join(few, key, "left_semi")), key)
    return warm.unionByName(rows.join(few, key, "left_anti").join(per_key, key))
