"""Sources: folders of text files, archives, JSON datasets and JSON lines."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Extensions of files that hold no text. Fixed values.
BINARY = "png jpg jpeg gif bmp ico pdf zip tar gz rar 7z exe dll so dylib bin pyc class jar woff woff2 ttf eot mp3 mp4 avi mov db sqlite".split()


def _is_text_path(path: Column) -> Column:
    """No hidden folder or file, no binary extension."""
    return ~path.rlike(r"(^|/)\.[^/]") & ~F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)).isin(BINARY)


def _decoded(df: DataFrame) -> DataFrame:
    """(file_path, content): contents that are valid UTF-8; others are left out."""
    rows = df.select("file_path", F.try_validate_utf8(F.col("content").cast("string")).alias("content"))
    return rows.filter("content IS NOT NULL")


def scan_folder(spark: SparkSession, root: str, allowed: DataFrame | None = None) -> DataFrame:
    """(file_path, content) of the text files below ``root``, paths relative to it; only those in ``allowed`` (file_path), if given."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.select(F.regexp_replace(F.expr("url_decode(replace(path, '+', '%2B'))"), r"^file:/*", "/").alias("p"), "content")
    files = files.filter(F.col("p").startswith(base)).select(F.substring("p", F.lit(len(base) + 1), F.length("p")).alias("file_path"), "content").filter(_is_text_path(F.col("file_path")))
    if allowed is not None:
        files = files.join(allowed.select("file_path"), "file_path", "left_semi")
    return _decoded(files)


def scan_archives(spark: SparkSession, pattern: str) -> DataFrame:
    """(archive, file_path, content) of the text files in zip and tar archives; a single top folder is dropped from the paths.

    An archive is one row and is unpacked in one task; a file that can't be opened as an archive gives no rows.
    """

    def members(blob: bytes) -> list[tuple[str, bytes]]:
        try:
            with zipfile.ZipFile(io.BytesIO(blob)) as z:
                return [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
        except zipfile.BadZipFile:
            pass
        try:
            with tarfile.open(fileobj=io.BytesIO(blob)) as t:
                return [(m.name, t.extractfile(m).read()) for m in t.getmembers() if m.isfile()]
        except tarfile.TarError:
            return []

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, blob in zip(b["path"], b["content"]):
                files = members(blob)
                tops = {n.split("/", 1)[0] for n, _ in files}
                cut = len(next(iter(tops))) + 1 if len(tops) == 1 and all("/" in n for n, _ in files) else 0
                rows += [(path.rsplit("/", 1)[-1], n[cut:], c) for n, c in files]
            yield pd.DataFrame(rows, columns=["archive", "file_path", "content"])

    files = spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(unpack, "archive string, file_path string, content binary")
    files = files.filter(_is_text_path(F.col("file_path")))
    rows = files.select("archive", "file_path", F.try_validate_utf8(F.col("content").cast("string")).alias("content"))
    return rows.filter("content IS NOT NULL")


def read_dataset(spark: SparkSession, path: str, items: T.StructType, version: str = "1.0") -> DataFrame:
    """The items of JSON datasets {schema_version, items[]}; another version is an error."""
    schema = T.StructType([T.StructField("schema_version", T.StringType()), T.StructField("items", T.ArrayType(items))])
    rows = spark.read.schema(schema).json(path, multiLine=True)
    wrong = F.raise_error(F.concat(F.lit("unsupported schema_version "), F.coalesce("schema_version", F.lit("none"))))
    rows = rows.withColumn("items", F.when(F.col("schema_version") == version, F.col("items")).otherwise(wrong.cast(T.ArrayType(items))))
    return rows.select(F.inline("items"))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines; a malformed line is an error, or is kept in ``_corrupt_record`` if not ``strict``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").json(path)
