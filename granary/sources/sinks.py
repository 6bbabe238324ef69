"""Sinks: partitioned tables rewritten only where they change, appended logs, exported graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.incremental import upsert
from granary.plans.lineage import discard, materialize


def overwrite_partitions(df: DataFrame, path: str, by: str) -> None:
    """Write ``df`` into the table at ``path``, replacing only the partitions of ``by`` that it holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upsert_partitions(spark: SparkSession, updates: DataFrame, path: str, by: str, key: list[str], order: list[Column]) -> None:
    """Upsert into the table at ``path`` partitioned by ``by``: the touched partitions are rewritten, the others stay.

    The new state is written aside first, as a table can't be overwritten while it is read.
    """
    touched = updates.select(by).distinct()
    old = spark.read.parquet(path).join(touched, by, "left_semi")
    fresh = materialize(upsert(old, updates.select(*old.columns), key, order))
    overwrite_partitions(fresh, path, by)
    discard(fresh)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)


def drop_partition_rows(spark: SparkSession, path: str, by: str, gone: DataFrame) -> None:
    """Delete the rows of the partitions in ``gone`` (by) from a table: their folders are removed."""
    jvm = spark.sparkContext._jvm
    for r in gone.select(by).distinct().toLocalIterator():
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={r[0]}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line): a graph as JSON lines, nodes {id, type, language} and links {source, target, type}."""
    n = nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), "id", "type", "language")).alias("line"))
    return n.unionByName(edges.select(F.to_json(F.struct(F.lit("link").alias("kind"), F.col("src").alias("source"), F.col("dst").alias("target"), "type")).alias("line")))
