"""Keeping derived tables up to date: differences, upserts, deletes, resumption, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def difference(old: DataFrame, new: DataFrame, key: list[str], digest: str) -> DataFrame:
    """(*key, status) of every key in either table: added, deleted, modified (another digest) or unchanged."""
    o = old.select(*key, F.col(digest).alias("__o"), F.lit(True).alias("__in_old"))
    n = new.select(*key, F.col(digest).alias("__n"), F.lit(True).alias("__in_new"))
    both = o.join(n, key, "full")
    status = F.when(F.col("__in_old").isNull(), "added").when(F.col("__in_new").isNull(), "deleted").when(~F.col("__o").eqNullSafe(F.col("__n")), "modified").otherwise("unchanged")
    return both.select(*key, status.alias("status"))


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: what upserts in this order leave behind. Rows with a null key are left out."""
    rows = df.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in key))
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def upsert(target: DataFrame, updates: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """``target`` after ``updates``, of which the first in ``order`` wins for each key; applying it again changes nothing."""
    new = latest(updates, key, order)
    return target.join(new.select(*key), key, "left_anti").unionByName(new.select(*target.columns))


def sessions(df: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, session_start, session_end, events): runs of events at most ``gap`` apart; the batch form of a session window."""
    g = df.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return g.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")
