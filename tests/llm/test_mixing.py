"""Mixtures keep their totals and caps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm.mixing import cube_mix, flight, mix_report, sized_documents


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    tokens = rng.integers(10, 3000, 1500).astype(float)
    p = np.full(1500, 0.37)
    out = flight(p, tokens, np.random.default_rng(1), land=False)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out @ tokens - p @ tokens) < 1e-3 and abs(out.sum() - p.sum()) < 1e-6
    landed = flight(p, tokens, np.random.default_rng(1), land=True)
    assert set(landed) <= {0.0, 1.0}
    assert abs(landed @ tokens / (p @ tokens) - 1) < 0.002 and abs(landed.sum() - p.sum()) <= 3


def test_inclusion_follows_the_probabilities():
    tokens = np.array([5.0, 7, 9, 11, 4, 3, 8, 10, 6, 2] * 6)
    hits = sum(flight(np.full(60, 0.3), tokens, np.random.default_rng(s), land=True) for s in range(300))
    assert abs(hits.mean() / 300 - 0.3) < 0.02 and hits.min() > 40 and hits.max() < 150


def sized(spark, counts, seed=0):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for source, n in counts.items():
        for t in rng.integers(20, 400, n):
            rows.append((i, source, int(t)))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long")


@pytest.mark.parametrize("block", [2000, 60])
def test_shares_and_caps(spark, monkeypatch, block):
    import granary.llm.mixing as m

    monkeypatch.setattr(m, "BLOCK", block)
    docs = sized(spark, {"big": 900, "mid": 300, "tiny": 12, "other": 50}).unionByName(spark.createDataFrame([(9001, None, 5), (9002, "big", 0)], "doc_id long, source string, tokens long"))
    targets = spark.createDataFrame([(" Big ", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.1, 4), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    mix = cube_mix(docs, targets, total_tokens=120_000)
    rep = {r.source: r for r in mix_report(docs, targets, mix, 120_000).collect()}
    uses = {r.source: r.u for r in mix.groupBy("source").agg(F.max("uses").alias("u")).collect()}
    assert set(rep) == {"big", "mid", "tiny", "none"} and uses["big"] == 1 and uses["mid"] <= 2 and uses["tiny"] == 4
    assert mix.groupBy("doc_id").count().filter("count > 1").count() == 0
    for s in ("big", "mid"):
        assert abs(rep[s].used_tokens / rep[s].target_tokens - 1) < 0.01 and rep[s].shortfall_tokens == 0
    assert rep["tiny"].shortfall_tokens > 0 and rep["tiny"].used_tokens == 4 * rep["tiny"].available_tokens
    assert rep["none"].used_tokens == 0 and rep["none"].shortfall_tokens == 12_000
    assert abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-9
    assert sorted(map(tuple, cube_mix(docs, targets, 120_000).collect())) == sorted(map(tuple, mix.collect()))


def test_empty(spark):
    docs = sized(spark, {"a": 3})
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert cube_mix(docs.limit(0), targets).count() == 0
    assert cube_mix(docs, targets.limit(0)).count() == 0
    assert mix_report(docs.limit(0), targets, cube_mix(docs.limit(0), targets)).first().actual_share == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world", " A "), (2, None, "b"), (3, "", None), (4, "x " * 20000, "c")], "doc_id long, text string, source string")
    got = {r.doc_id: (r.source, r.tokens) for r in sized_documents(df, "doc_id", "text", "source").collect()}
    assert got[1] == ("a", 2) and got[2] == ("b", 0) and got[3] == (None, 0) and got[4][1] > 10000
