"""The retrieval pipeline on a handful of chunks."""

from granary.operators.pipeline import retrieve


def tables(spark):
    queries = spark.createDataFrame([(1, "What value has the learning rate?", [1.0, 0.0, 0.0]), (2, "Why?", [0.0, 0.0, 1.0])], "id long, question string, vec array<double>")
    vectors = [(10, "a", [1.0, 0.1, 0.0]), (11, "b", [1.0, 0.1, 0.01]), (12, "c", [1.0, -0.2, 0.0]), (13, "r", [1.0, 0.0, 0.0]), (14, "a", [1.0, 0.1, 0.0]), (15, "gone", [1.0, 0.0, 0.1]), (16, None, [1.0, 0.0, 0.0])]
    chunks = [(100, "a", "Method", "plain words"), (101, "b", "Method", "learning_rate = 0.1\nbatch = 32"), (102, "c", None, "other words"), (103, "r", "References", "[1] Smith"), (104, "a", "Method", "plain words"), (105, "x", "Method", None)]
    return queries, spark.createDataFrame(vectors, "id long, chunk_hash string, vec array<double>"), spark.createDataFrame(chunks, "chunk_id long, chunk_hash string, section string, chunk_text string")


def ids(df, query=1):
    return [r.chunk_id for r in df.filter(f"query_id = {query}").orderBy("rank").collect()]


def test_parts_of_the_pipeline(spark):
    q, v, c = tables(spark)
    assert ids(retrieve(q, v, c, diverse=None, sections=False, rerank=False)) == [103, 100, 101, 102]
    assert ids(retrieve(q, v, c, diverse=None, rerank=False)) == [100, 101, 102]
    assert ids(retrieve(q, v, c, diverse=None)) == [101, 100, 102]  # settings suit the question
    assert set(ids(retrieve(q, v, c, diverse=2, rerank=False))) == {100, 102}  # 101 says what 100 does
    assert ids(retrieve(q, v, c, k=1, diverse=None)) == [101]


def test_nothing_to_find(spark):
    q, v, c = tables(spark)
    assert retrieve(q.limit(0), v, c).count() == 0 and retrieve(q, v.limit(0), c).count() == 0 and retrieve(q, v, c.limit(0)).count() == 0
    only = c.filter("section = 'References'")
    assert ids(retrieve(q, v, only)) == [103]  # sections of little value, where there is nothing else
