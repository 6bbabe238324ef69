"""Connected components of a graph given by its edges, in logarithmically many joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.plans.lineage import discard, materialize
from granary.plans.skew import skew_join


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component): every node of ``edges`` with the smallest node that it is connected with.

    Alternates large-star and small-star steps until the edges form stars around the
    smallest nodes. A node's neighbours are never gathered: both steps use a minimum by node and a join,
    whose hot keys AQE can split. Null ends and loops are ignored, repeated edges count once; no edges
    give no rows.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    digest = F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))  # of a set of edges, in any order
    before = e.agg(*digest).first()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours of a node go to the smallest of the node and its neighbours
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = skew_join(both.filter("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large)
        # small star: a node and its smaller neighbours go to the smallest of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = skew_join(large, least, ["u"])
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = materialize(small.filter("u <> v").distinct())
        after = now.agg(*digest).first()
        discard(e)
        discard(large)
        e = now
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
