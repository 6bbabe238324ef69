"""Retrieval, metric, chunking, graph and upkeep operators against small references."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.operators import answer_metrics as A
from granary.operators import chunking as C
from granary.operators import code_lines as L
from granary.operators import graph as G
from granary.operators import incremental as N
from granary.operators import ir_metrics as M
from granary.operators import relations as R
from granary.operators import retrieval as K
from granary.operators import statistics as S
from granary.operators.chunking import pack, structural_blocks
from granary.streaming import windows as W


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([("q", 1, "x"), ("q", 2, "a"), ("q", 3, "y"), ("q", 4, "b")], "question_id string, rank int, doc string")
    gold = spark.createDataFrame([("q", "a"), ("q", "b")], "question_id string, doc string")
    m = M.ranking_metrics(M.judged_ranking(ranked, gold)).first()
    assert (m.recall_1, m.recall_3, m.recall_5, m.precision_3, m.reciprocal_rank, m.average_precision) == (0.0, 0.5, 1.0, 0.333333, 0.5, 0.5)
    assert abs(m.ndcg_5 - 0.650921) < 1e-6
    none = M.ranking_metrics(M.judged_ranking(ranked, gold.limit(0))).first()
    assert none.recall_5 == none.ndcg_5 == none.average_precision == 0


def test_answer_metrics(spark):
    df = spark.createDataFrame([("hello world", "hello"), ("the cat", "cat"), ("", ""), ("x", "")], "a string, e string")
    n = lambda c: A.normal_tokens(F.col(c))
    got = [r[0] for r in df.select(F.round(A.token_f1(n("a"), n("e")), 4)).collect()]
    assert got == [0.6667, 1.0, 1.0, 0.0]
    assert [r[0] for r in df.select(F.round(A.rouge_l(n("a"), n("e")), 4)).collect()] == [0.6667, 1.0, 0.0, 0.0]
    assert df.select(A.bleu(n("a"), n("e"))).collect()[3][0] == 0.0


def test_latency_and_effects(spark):
    v = spark.createDataFrame([(float(i),) for i in range(1, 6)], "v double")
    s = v.agg(*S.latency_summary(F.col("v"))).first()
    assert (s["mean"], s["p50"], s["p95"], s["min"], s["max"]) == (3.0, 3.0, 4.8, 1.0, 5.0)
    two = spark.createDataFrame([("g", True, x) for x in (1.0, 2.0, 3.0)] + [("g", False, x) for x in (2.0, 3.0, 4.0)], "g string, s boolean, v double")
    e = S.effect_size(two, ["g"], F.col("s"), "v").first()
    assert (e.d, e.size) == (-1.0, "large")


def test_bootstrap_agrees_with_the_exact_one(spark):
    rng = np.random.default_rng(5)
    values = rng.normal(10, 2, 400).tolist()
    df = spark.createDataFrame([("g", i, x) for i, x in enumerate(values)] + [("g", 999, math.nan)], "g string, i int, v double")
    b = S.bootstrap_intervals(df, ["g"], "v", resamples=400).first()
    low, high = exact_interval(values, 400)
    assert b.n == 400 and abs(b.low - low) < 0.08 and abs(b.high - high) < 0.08


def test_dense_search_and_diversity(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8))
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(300)], "id long, vec array<double>")
    got = {}
    for r in K.dense_top_k(df.filter("id < 5"), df, 7).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(5):
        cos = np.round(u[q] @ u.T, 9)
        cos[q] = -9
        want = sorted(range(300), key=lambda i: (-cos[i], i))[:7]
        assert [got[q][k] for k in range(1, 8)] == want
    c = K.dense_top_k(df.filter("id < 2"), df, 20).join(df, "id").select("query_id", "id", "rank", F.col("cosine").alias("relevance"), "vec")
    plain = {(r.query_id, r.id) for r in K.marginal_relevance(c, 5, balance=1.0).collect()}
    assert plain == {(r.query_id, r.id) for r in c.filter("rank <= 5").collect()}


def test_bm25_prefers_rare_terms(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "c"]), (3, ["a", "a"]), (4, [])], "doc_id long, terms array<string>")
    q = spark.createDataFrame([(7, ["b", "a", "zzz"])], "query_id long, terms array<string>")
    got = K.bm25(q, docs, 10).orderBy("rank").collect()
    assert got[0].doc_id == 1 and {r.doc_id for r in got} == {1, 2, 3}


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([(1, i, i + 1) for i in range(5)], "query_id long, doc_id long, rank long")
    b = spark.createDataFrame([(1, 4 - i, i + 1) for i in range(5)], "query_id long, doc_id long, rank long")
    assert K.reciprocal_rank_fusion([a, b], 5).collect() == K.reciprocal_rank_fusion([b, a], 5).collect()


def exact_interval(values, resamples, level=0.95, seed=42):
    """The bootstrap interval of a short list."""
    rng = random.Random(seed)
    means = sorted(sum(rng.choices(values, k=len(values))) / len(values) for _ in range(resamples))
    a = (1 - level) / 2
    return means[math.floor(a * resamples)], means[math.ceil((1 - a) * resamples) - 1]


def test_running_totals_and_ranks(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), rnd.randrange(40) / 8, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v double, i long").repartition(5)
    got = {r.i: r.n for r in S.running_total(df, ["g"], ["v", "i"], F.lit(2), "n").collect()}
    for g in "ab":
        own = sorted((v, i) for x, v, i in rows if x == g)
        assert all(got[i] == 2 * n for n, (_, i) in enumerate(own))
    ranks = {r.i: r.r for r in S.average_ranks(df, ["g"], "v", "r").collect()}
    for g, v, i in rows[:60]:
        own = sorted(x for h, x, _ in rows if h == g)
        assert ranks[i] == own.index(v) + (own.count(v) + 1) / 2
    assert S.running_total(df.limit(0), ["g"], ["v", "i"], F.lit(1), "n").count() == 0


def test_two_sided_p(spark):
    import statistics

    for z in (0.0, -0.5, 1.96, 3.3, -5.0):
        got = spark.range(1).select(S.two_sided_p(F.lit(z))).first()[0]
        assert abs(got - 2 * (1 - statistics.NormalDist().cdf(abs(z)))) < 1e-6


def test_streams_go_on_where_they_ended(spark, tmp_path):
    put = lambda rows: spark.createDataFrame(rows, "k string, v int, x string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema("k string, v int, x string").parquet(f"{tmp_path}/in")
    put([("a", 1, "p"), ("b", 5, "q")])
    assert sorted(map(tuple, W.latest_per_key(read(), "k", "v", ["x"], f"file://{tmp_path}/latest").collect())) == [("a", 1, "p"), ("b", 5, "q")]
    assert W.run_to_table(read(), place=f"file://{tmp_path}/table").count() == 2
    put([("a", 2, "r"), ("b", 4, "s"), ("c", 1, "t")])
    want = [("a", 2, "r"), ("b", 5, "q"), ("c", 1, "t")]
    for _ in range(2):  # once with new rows, once without
        assert sorted(map(tuple, W.latest_per_key(read(), "k", "v", ["x"], f"file://{tmp_path}/latest").collect())) == want
        assert W.run_to_table(read(), place=f"file://{tmp_path}/table").count() == 5


def test_only_written_rounds_are_deleted(spark, tmp_path):
    from granary.plans.lineage import discard, materialize

    spark.range(3).write.parquet(f"{tmp_path}/granary-mine/part")
    discard(spark.read.parquet(f"{tmp_path}/granary-mine/part"))
    assert spark.read.parquet(f"{tmp_path}/granary-mine/part").count() == 3
    round_ = materialize(spark.range(3).toDF("id"))
    discard(round_)
    with pytest.raises(Exception):
        round_.count()


def test_keep_unless_empty(spark):
    df = spark.createDataFrame([("q", 1, True), ("q", 2, False), ("r", 3, False), ("r", 4, None)], "q string, i int, k boolean")
    assert sorted(r.i for r in R.keep_unless_empty(df, "q", F.col("k")).collect()) == [1, 3, 4]


@pytest.mark.parametrize(("sizes", "budget", "overlap"), [([5, 5, 5, 5], 10, 5), ([50, 1, 1], 10, 3), ([3] * 40, 10, 4), ([], 5, 1), ([0, 0, 7], 7, 7)])
def test_pack(sizes, budget, overlap):
    w = pack(sizes, budget, overlap)
    assert all(e > s and (sum(sizes[s:e]) <= budget or e == s + 1) for s, e in w)
    assert [s for s, _ in w] == sorted({s for s, _ in w})
    assert {i for s, e in w for i in range(s, e)} == set(range(len(sizes)))
    assert all(sum(sizes[b[0] : a[1]]) <= overlap for a, b in zip(w, w[1:]) if b[0] < a[1])


def test_structural_blocks_and_types(spark):
    ls = ["| a | b |", "| c | d |", "text", "x = 1", "y = 2", "- item", "12. not a bullet"]
    assert structural_blocks(ls) == [(0, 2), (2, 3), (3, 5), (5, 6), (6, 7)]
    texts = ["| a |\n| b |", "gamma = 0.99\nlearning_rate: 0.1\nplain words here", "one\ntwo", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.chunk_type(F.col("t"))).collect()] == ["TABLE", "HYPERPARAMETERS", "TEXT", "TEXT", "TEXT"]


def test_line_facts(spark):
    python = "import os, sys as s\nfrom a.c import b, d as e\nclass A(B, metaclass=M):\n    def f(self):\n        return g(1) + if_(2)\n# h(3)\nasync def k():\n    os.x()\n"
    script = "import {a} from 'm/n';\nconst q = require('r');\nclass C extends D.E {\n}\nfunction fn(x) {\n  if (x) { y.z(x) }\n}\n"
    df = spark.createDataFrame([(1, python, "Python"), (2, script, "javascript"), (3, None, "python"), (4, "import os", None), (5, "", "python")], "id long, t string, lang string")
    got = {(r.key, r.line, r.fact, r.name, r.target) for r in L.line_facts(df, "id", "t", "lang").collect()}
    assert {x[1:] for x in got if x[0] == 1} == {
        (1, "import", "os", "os"), (1, "import", "sys", "sys"), (2, "import", "a.c.b", "a.c.b"), (2, "import", "a.c.d", "a.c.d"), (3, "class", "A", None), (3, "inherits", "A", "B"),
        (4, "function", "f", None), (5, "call", None, "g"), (5, "call", None, "if_"), (7, "function", "k", None), (8, "call", None, "os.x"),
    }
    assert {x[1:] for x in got if x[0] == 2} == {(1, "import", "m/n", "m/n"), (2, "import", "r", "r"), (2, "call", None, "require"), (3, "class", "C", None), (3, "inherits", "C", "D.E"), (5, "function", "fn", None), (6, "call", None, "y.z")}
    assert {x[0] for x in got} == {1, 2}


def test_dependencies_by_line_range(spark):
    facts = spark.createDataFrame([(1, 1, "import", "x", "x"), (1, 5, "call", None, "x"), (1, 6, "call", None, "y"), (1, 9, "inherits", "A", "y"), (2, 1, "call", None, "z")], "key long, line int, fact string, name string, target string")
    pieces = spark.createDataFrame([(1, 0, 1, 6), (1, 1, 6, 9), (3, 0, 1, 9)], "key long, piece int, first_line int, last_line int")
    assert {(r.key, r.piece, r.target, r.type) for r in L.dependencies(facts, pieces).collect()} == {(1, 0, "x", "imports"), (1, 0, "y", "calls"), (1, 1, "y", "inherits")}


def test_graph(spark):
    units = spark.createDataFrame([(1, "a.py", "A", "f", "python"), (2, "a.py", None, "g", None), (3, "b.js", None, "g", "javascript")], "o long, file_path string, class_name string, function_name string, language string")
    nodes, edges = G.nodes_and_edges(units, "o")
    assert {(r.src, r.dst) for r in edges.collect()} == {("A", "a.py"), ("A.f", "a.py"), ("A.f", "A"), ("g", "a.py"), ("g", "b.js")}
    seeds = spark.createDataFrame([(1, "g")], "q long, id string")
    assert {r.id for r in G.neighbours(edges, seeds, "q").collect()} == {"a.py", "b.js"}
    n, e = G.pruned(nodes, edges, F.col("id") == "a.py")
    assert n.count() == 4 and {(r.src, r.dst) for r in e.collect()} == {("A.f", "A"), ("g", "b.js")}
    needs = spark.createDataFrame([(1, "os.path", "imports"), (1, "A", "calls"), (3, "g", "calls"), (3, "A.f", "inherits"), (9, "nobody", "calls")], "o long, target string, type string")
    nodes, edges = G.nodes_and_edges(units, "o", needs)
    got = {(r.src, r.dst): r.type for r in edges.collect()}
    assert got == {("A", "a.py"): "Uses", ("A.f", "a.py"): "Uses", ("A.f", "A"): "Calls", ("g", "a.py"): "Uses", ("g", "b.js"): "Uses", ("A.f", "os.path"): "Imports", ("g", "g"): "Calls", ("g", "A.f"): "Inherits"}
    assert {(r.id, r.type) for r in nodes.collect()} == {("a.py", "File"), ("b.js", "File"), ("A", "Class"), ("A.f", "Function"), ("g", "Function"), ("os.path", "Module")}
    assert {(r.dst, r.type, r.callers) for r in G.first_callers(edges, by_type=True).filter("type = 'Calls'").collect()} == {("A", "Calls", "A.f"), ("g", "Calls", "g")}


def test_upkeep(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, v int, h string")
    u = spark.createDataFrame([("b", 2, "z"), ("c", 1, "w"), ("b", 3, "q"), (None, 1, "n")], "k string, v int, h string")
    once = N.upsert(t, u, ["k"], [F.desc("v")])
    assert sorted(map(tuple, once.collect())) == [("a", 1, "x"), ("b", 3, "q"), ("c", 1, "w")]
    assert sorted(map(tuple, N.upsert(once, u, ["k"], [F.desc("v")]).collect())) == sorted(map(tuple, once.collect()))
    assert {(r.k, r.status) for r in N.difference(t, once, ["k"], "h").collect()} == {("a", "unchanged"), ("b", "modified"), ("c", "added")}
    assert N.difference(t, t, ["k"], "h").filter("status <> 'unchanged'").count() == 0
