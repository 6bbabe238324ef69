"""Event-time aggregations on streams, and running a stream over what a folder holds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.plans.lineage import shared_folder


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` as a file stream: a file, or a folder of files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{sf_dir}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def tumbling_counts(events: DataFrame, ts: str, keys: list[str], value: str, size: str, delay: str) -> DataFrame:
    """Count and sum of ``value`` in tumbling windows; a window comes out once the watermark, ``delay`` behind the latest event, passes it."""
    w = events.withWatermark(ts, delay).groupBy(F.window(ts, size).alias("w"), *keys)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def session_counts(events: DataFrame, ts: str, key: str, gap: str, delay: str) -> DataFrame:
    """Events by session: runs of a key's events with pauses under ``gap``."""
    w = events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key)
    return w.agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def run_to_table(stream: DataFrame, mode: str = "append", place: str | None = None) -> DataFrame:
    """Run a stream over all that is there, into a Parquet table, and return it.

    Table and checkpoint lie in the folder ``place``; run again with the same one, a stream goes on where its last run ended. Without one
    a new folder below the shared folder is taken, and everything is read.
    """
    spark = stream.sparkSession
    place = place or f"{shared_folder(spark)}/granary-stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{place}/table").option("checkpointLocation", f"{place}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/table")


def _states(spark: SparkSession, place: str) -> list[int]:
    """The numbers of the batches whose states were written whole below ``place``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(place).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(path(place))] if fs.exists(path(place)) else []
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(path(f"{place}/{n}/_SUCCESS")))


def latest_per_key(stream: DataFrame, key: str, order: str, columns: list[str], place: str | None = None) -> DataFrame:
    """The last row of every key of a stream, as micro-batches fold into a table: each batch merges its own last rows with the table's.

    The states lie beside the checkpoint in ``place``, one for each batch, so a run that is resumed there starts from the last one, and a batch that is
    run twice starts from the state before it. The states before the last two are deleted.
    """
    spark = stream.sparkSession
    place = place or f"{shared_folder(spark)}/granary-latest-{uuid.uuid4().hex}"
    fields = [key, order, *columns]
    best = lambda df: df.groupBy(key).agg(F.max(F.struct(order, *columns)).alias("s")).select(key, "s.*")

    def merge(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        rows = best(batch.select(*fields))
        before = [n for n in _states(session, f"{place}/states") if n < epoch]
        if before:
            rows = best(rows.unionByName(session.read.parquet(f"{place}/states/{before[-1]}")))
        rows.write.mode("overwrite").parquet(f"{place}/states/{epoch}")
        path = session.sparkContext._jvm.org.apache.hadoop.fs.Path
        for n in before[:-1]:
            path(f"{place}/states/{n}").getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(path(f"{place}/states/{n}"), True)

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    states = _states(spark, f"{place}/states")
    if not states:
        return spark.createDataFrame([], stream.select(*fields).schema)
    return spark.read.parquet(f"{place}/states/{states[-1]}").select(*fields)
