"""A typed directed graph of files, classes and functions as two tables, and operators on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nodes_and_edges(units: DataFrame, order: str, needs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, language) and edges (src, dst, type) of code units (file_path, class_name, function_name, language) and what they depend on.

    A class uses its file, a function its file and class. ``needs`` is (``order``, target, type) with type imports, inherits or calls; the unit's function, else its class, else its file, is
    the source of such an edge. Attributes of the last unit in ``order`` win, and one edge, the last, is kept for each pair of ends. A target that no unit defines becomes a
    Module, Class or Function by the first edge that leads there.
    """
    fn = F.when(F.col("class_name").isNotNull(), F.concat_ws(".", "class_name", "function_name")).otherwise(F.col("function_name"))
    u = units.filter("file_path IS NOT NULL").select("file_path", "class_name", F.when(F.col("function_name").isNotNull(), fn).alias("fn"), "language", F.col(order).alias("o"))
    node = lambda c, t: u.filter(F.col(c).isNotNull()).select(F.col(c).alias("id"), F.lit(t).alias("type"), "language", "o")
    every = node("file_path", "File").unionByName(node("class_name", "Class")).unionByName(node("fn", "Function"))
    nodes = every.groupBy("id").agg(F.max(F.struct("o", "type", F.coalesce("language", F.lit("unknown")).alias("language"))).alias("s")).select("id", "s.type", "s.language")
    edge = lambda a, b: u.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit("Uses").alias("type"), "o", F.lit(0).alias("r"))
    links = edge("class_name", "file_path").unionByName(edge("fn", "file_path")).unionByName(edge("fn", "class_name"))
    if needs is not None:
        of = needs.select(F.col(order).alias("o"), F.col("target").alias("dst"), F.initcap("type").alias("type")).filter("dst <> ''")
        of = u.select("o", F.coalesce("fn", "class_name", "file_path").alias("src")).join(of, "o").select("src", "dst", "type", "o", F.lit(1).alias("r"))
        links = links.unionByName(of)
        kind = F.when(F.col("type") == "Imports", "Module").when(F.col("type") == "Inherits", "Class").otherwise("Function")
        stubs = of.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("o", "type")).alias("s")).select("id", F.col("s.type").alias("type"))
        stubs = stubs.join(nodes, "id", "left_anti").select("id", kind.alias("type"), F.lit("unknown").alias("language"))
        nodes = nodes.unionByName(stubs)
    edges = links.groupBy("src", "dst").agg(F.max(F.struct("o", "r", "type")).alias("s")).select("src", "dst", "s.type")
    return nodes, edges


def neighbours(edges: DataFrame, seeds: DataFrame, group: str) -> DataFrame:
    """(group, id): nodes one hop from a group's seeds (group, id) in either direction, without the seeds."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other")))
    out = seeds.join(both, "id").select(group, F.col("other").alias("id")).distinct()
    return out.join(seeds, [group, "id"], "left_anti")


def pruned(nodes: DataFrame, edges: DataFrame, drop: Column) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes where ``drop`` holds and without their edges."""
    gone = nodes.filter(drop).select("id")
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), kept


def first_callers(edges: DataFrame, k: int = 12, by_type: bool = False) -> DataFrame:
    """(dst, n, callers): the number of a node's sources and the first ``k`` of them by name; with ``by_type`` also (type), for each type of edge."""
    key = ["dst", "type"] if by_type else ["dst"]
    ranked = edges.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("src")))
    few = ranked.filter(F.col("r") <= k).groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("src")), ", ").alias("callers"))
    return ranked.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).join(few, key)
