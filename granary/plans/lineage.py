"""Cutting lineage through the shared checkpoint folder.

Iterative operators write each round as a Parquet table below the folder that
``spark.checkpoint.dir`` names, so a lost executor costs the tasks it ran and
never an earlier round. Only where the setting is absent (a local test session)
is a temporary folder of this machine used.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Names of the folders that this process wrote; nothing else is ever deleted.
_written: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder for written rounds: the session's ``spark.checkpoint.dir``, else one made here."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="granary-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once and return it read back, without its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/granary-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.add(path.rsplit("/", 1)[1])
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table from :func:`materialize` that no later plan reads; other folders are left alone."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        name = f.rsplit("/", 1)[1]
        if name in _written:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            _written.discard(name)
