"""Sources, sinks and streams on temporary folders."""

import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.sources import files, sinks
from granary.streaming import windows as W


def test_scan_folder(spark, tmp_path):
    (tmp_path / "src/.git").mkdir(parents=True)
    (tmp_path / "src/a b.py").write_text("x = 'é'", encoding="utf-8")
    (tmp_path / "src/pic.png").write_bytes(b"\x89PNG")
    (tmp_path / "src/bad.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "src/.git/config").write_text("hidden")
    (tmp_path / "top.md").write_text("# T")
    got = {(r.file_path, r.content) for r in files.scan_folder(spark, str(tmp_path)).collect()}
    assert got == {("src/a b.py", "x = 'é'"), ("top.md", "# T")}
    only = spark.createDataFrame([("top.md",)], "file_path string")
    assert files.scan_folder(spark, str(tmp_path), only).count() == 1


def test_scan_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("repo/x.py", "1")
        z.writestr("repo/y/z.txt", "2")
    (tmp_path / "f.txt").write_text("3")
    with tarfile.open(tmp_path / "b.tar", "w") as t:
        t.add(tmp_path / "f.txt", arcname="f.txt")
    (tmp_path / "c.zip").write_bytes(b"nothing")
    got = {tuple(r) for r in files.scan_archives(spark, f"{tmp_path}/*.[zt]*[pr]").collect()}
    assert got == {("a.zip", "x.py", "1"), ("a.zip", "y/z.txt", "2"), ("b.tar", "f.txt", "3")}


def test_datasets(spark, tmp_path):
    item = T.StructType([T.StructField("id", T.StringType()), T.StructField("question", T.StringType())])
    (tmp_path / "ok.json").write_text(json.dumps({"schema_version": "1.0", "items": [{"id": "1", "question": "q"}]}))
    (tmp_path / "old.json").write_text(json.dumps({"schema_version": "0.9", "items": []}))
    assert files.read_dataset(spark, f"{tmp_path}/ok.json", item).collect()[0].question == "q"
    with pytest.raises(Exception, match="schema_version"):
        files.read_dataset(spark, f"{tmp_path}/old.json", item).collect()
    (tmp_path / "l.jsonl").write_text('{"id": "1"}\n{broken\n')
    assert files.read_json_lines(spark, f"{tmp_path}/l.jsonl", item, strict=False).filter("_corrupt_record IS NOT NULL").cache().count() == 1
    with pytest.raises(Exception):  # noqa: B017
        files.read_json_lines(spark, f"{tmp_path}/l.jsonl", item).collect()


def test_partition_upsert(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = lambda xs: spark.createDataFrame(xs, "k string, v int, c string")
    sinks.overwrite_partitions(rows([("a", 1, "p"), ("b", 1, "p"), ("c", 1, "q")]), path, "c")
    sinks.upsert_partitions(spark, rows([("b", 2, "p"), ("d", 1, "p")]), path, "c", ["k"], [F.desc("v")])
    assert sorted(map(tuple, spark.read.parquet(path).select("k", "v", "c").collect())) == [("a", 1, "p"), ("b", 2, "p"), ("c", 1, "q"), ("d", 1, "p")]
    sinks.drop_partition_rows(spark, path, "c", rows([("x", 0, "q")]))
    assert spark.read.parquet(path).filter("c = 'q'").count() == 0
    sinks.append_log(rows([("a", 1, "p")]), f"{tmp_path}/log")
    sinks.append_log(rows([("b", 1, "p")]), f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 2


def test_stream_windows_agree_with_a_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00", "x" if i % 3 else "y", 1.0) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, t string, kind string, v double").withColumn("ts", F.col("t").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/events.parquet")
    s = W.table_stream(spark, str(tmp_path), "events")
    got = {(str(r.window_start), r.kind, r.n) for r in W.run_to_table(W.tumbling_counts(s, "ts", ["kind"], "v", "10 minutes", "5 minutes")).collect()}
    want = {(str(r.w.start), r.kind, r.n) for r in df.groupBy(F.window("ts", "10 minutes").alias("w"), "kind").agg(F.count("*").alias("n")).collect() if r.w.end <= df.agg(F.max("ts")).first()[0].replace(minute=54)}
    assert got == want
    one = W.latest_per_key(W.table_stream(spark, str(tmp_path), "events").select("kind", "ts", "id"), "kind", "ts", ["id"])
    assert {r.kind for r in one.collect()} == {"x", "y"}
    n = W.run_to_table(W.session_counts(W.table_stream(spark, str(tmp_path), "events"), "ts", "kind", "2 minutes", "1 minute"))
    assert n.columns == ["kind", "session_start", "session_end", "events"]
