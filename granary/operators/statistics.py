"""Statistics of evaluation runs: summaries, confidence intervals, tests, calibration."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.words import mix
from granary.plans.lineage import materialize
from granary.plans.skew import skew_join


def latency_summary(value: Column) -> list[Column]:
    """Mean, population deviation, extremes and interpolated percentiles, rounded to 4 digits."""
    r = lambda c, name: F.round(c, 4).alias(name)
    out = [F.count(value).alias("n"), r(F.avg(value), "mean"), r(F.stddev_pop(value), "std"), r(F.min(value), "min"), r(F.max(value), "max")]
    return out + [r(F.percentile(value, p / 100), f"p{p}") for p in (50, 75, 90, 95, 99)]


def running_total(rows: DataFrame, by: list[str], order: list[str], weight: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``weight`` over the earlier rows of their group in ``order``, which must have no ties.

    Rows are cut into ranges of the order, so no task holds a whole group; what the earlier ranges of a group hold is added from their totals.
    """
    parts = rows.repartitionByRange(*[F.col(c) for c in [*by, *order]]).withColumn("__weight", weight).withColumn("__part", F.spark_partition_id())
    parts = materialize(parts)
    totals = parts.groupBy(*by, "__part").agg(F.sum("__weight").alias("__total"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = totals.select(*by, "__part", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    own = F.sum("__weight").over(Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = parts.withColumn("__own", F.coalesce(own, F.lit(0))).join(totals, [*by, "__part"])
    return out.withColumn(name, F.col("__before") + F.col("__own")).drop("__part", "__weight", "__own", "__before")


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the average rank of ``value``, which is nowhere null, within ``by``; equal values share the mean of their ranks."""
    rows = materialize(df)
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    ranks = running_total(counts, by, [value], F.col("__n"), "__earlier")
    ranks = ranks.select(*by, value, (F.col("__earlier") + (F.col("__n") + 1) / 2).alias(name))
    return skew_join(rows, ranks, [*by, value])


#: The error function by a polynomial with an error under 1.5e-7. Fixed values.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_SCALE = 0.3275911


def two_sided_p(z: Column) -> Column:
    """The two-sided probability of a standard normal ``z``."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + ERF_SCALE * x)
    poly = sum((c * F.pow(t, F.lit(float(i + 1))) for i, c in enumerate(ERF)), F.lit(0.0))
    return F.least(F.lit(1.0), poly * F.exp(-x * x))


def rank_correlation(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pearson and Spearman correlation of two columns within ``by``; rows with a null in either are left out."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = average_ranks(average_ranks(rows, by, x, "__rx"), by, y, "__ry")
    return rows.groupBy(*by).agg(F.round(F.corr(x, y), 6).alias("pearson"), F.round(F.corr("__rx", "__ry"), 6).alias("spearman"))


def bootstrap_intervals(df: DataFrame, by: list[str], value: str, resamples: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(*by, n, mean, low, high): Poisson bootstrap intervals of the mean of each group.

    Every row draws a Poisson(1) count for each resample from a hash of its values, and only sums of counts and weighted
    values leave a task, so groups of any size need no more memory than the resamples. Null and NaN values are left out.
    """
    keys = df.select(*by).schema

    # the chances of at most 0, 1, 2, ... of a Poisson(1) count
    steps = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
    turns = np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list] = {}
        for b in batches:
            for key, own in b.groupby(by, dropna=False, sort=False):
                s = sums.setdefault(key if isinstance(key, tuple) else (key,), [0, 0.0, np.zeros(resamples), np.zeros(resamples)])
                v = own[value].to_numpy(dtype=float)
                seeds = own["__seed"].to_numpy().view(np.uint64)
                for start in range(0, len(v), 512):
                    draws = (mix(seeds[start : start + 512, None] ^ turns[None, :]) >> np.uint64(11)) / float(1 << 53)
                    w = np.searchsorted(steps, draws, side="right")
                    s[2] += w.sum(axis=0)
                    s[3] += v[start : start + 512] @ w
                s[0] += len(v)
                s[1] += float(v.sum())
        for key, (n, total, w, wx) in sums.items():
            yield pd.DataFrame([(*key, n, total, w.tolist(), wx.tolist())], columns=[*by, "n", "total", "w", "wx"])

    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, value, F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns]).alias("__seed"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)
    sums = rows.mapInPandas(partial, f"{fields}, n long, total double, w array<double>, wx array<double>")
    each = sums.select(*by, "n", "total", F.posexplode(F.arrays_zip("w", "wx")).alias("i", "s"))
    per = each.groupBy(*by, "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), (F.sum("s.wx") / F.nullif(F.sum("s.w"), F.lit(0.0))).alias("m"))
    tail = (1 - level) / 2
    return per.groupBy(*by).agg(F.max("n").alias("n"), (F.max("total") / F.max("n")).alias("mean"), F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"))


def signed_rank(pairs: DataFrame, by: list[str], difference: str) -> DataFrame:
    """(*by, n, w_plus, w_minus, z, p): the signed-rank statistic of paired differences; zeros are left out, z and its two-sided p are the normal approximation."""
    d = pairs.filter(F.col(difference).isNotNull() & (F.col(difference) != 0)).withColumn("__abs", F.abs(difference))
    d = average_ranks(d, by, "__abs", "__rank")
    plus = F.sum(F.when(F.col(difference) > 0, F.col("__rank")).otherwise(0.0))
    minus = F.sum(F.when(F.col(difference) < 0, F.col("__rank")).otherwise(0.0))
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), plus.alias("w_plus"), minus.alias("w_minus"))
    n = F.col("n")
    g = g.withColumn("z", F.round((F.least("w_plus", "w_minus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24), 6))
    return g.withColumn("p", F.round(two_sided_p(F.col("z")), 6))


def effect_size(df: DataFrame, by: list[str], side: Column, value: str) -> DataFrame:
    """(*by, n1, n2, d, size): Cohen's d of ``value`` between rows where ``side`` holds and the others, with the pooled deviation."""
    one = lambda c: F.when(side, F.col(c))
    two = lambda c: F.when(~side, F.col(c))
    g = df.groupBy(*by).agg(F.count(one(value)).alias("n1"), F.count(two(value)).alias("n2"), F.avg(one(value)).alias("m1"), F.avg(two(value)).alias("m2"), F.var_samp(one(value)).alias("v1"), F.var_samp(two(value)).alias("v2"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    d = F.round(F.when(pooled > 0, (F.col("m1") - F.col("m2")) / pooled).otherwise(0.0), 6)
    a = F.abs("d")
    return g.withColumn("d", d).withColumn("size", F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large")).select(*by, "n1", "n2", "d", "size")


def calibration_error(df: DataFrame, confidence: Column, correct: Column, bins: int = 5) -> DataFrame:
    """(bin, n, mean_confidence, accuracy, gap): reliability bins; the expected error is the sum of the gaps weighted by share."""
    b = df.select(F.least(F.lit(bins - 1), F.floor(confidence * bins).cast("int")).alias("bin"), confidence.alias("c"), correct.cast("double").alias("y")).filter("bin IS NOT NULL AND y IS NOT NULL")
    g = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 6).alias("mean_confidence"), F.round(F.avg("y"), 6).alias("accuracy"))
    return g.withColumn("gap", F.round(F.abs(F.col("accuracy") - F.col("mean_confidence")), 6))
