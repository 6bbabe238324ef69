"""Top N by bisection against plain sorting."""

import math
import random

import pytest
from pyspark.sql import Row

from granary.operators.top_n import top_n_per_group


def expected(rows, n):
    out = set()
    groups = {}
    for r in rows:
        if r["g"] is not None and r["s"] is not None and not math.isnan(r["s"]):
            groups.setdefault(r["g"], []).append(r)
    for g, rs in groups.items():
        rs.sort(key=lambda r: (-r["s"], r["t"] is None or math.isnan(r["t"]), -(r["t"] or 0) if r["t"] is not None and not math.isnan(r["t"]) else 0, r["i"]))
        out |= {(g, r["i"]) for r in rs[:n]}
    return out


ORDER = [("s", "desc"), ("t", "desc"), ("i", "asc")]


@pytest.mark.parametrize("n", [1, 5])
def test_matches_sorting(spark, n):
    rnd = random.Random(n)
    scores = [0.0, -0.0, 1.0, -1.0, 0.5, 1e300, -1e300, 5e-324, math.inf, -math.inf, math.nan, None]
    rows = [dict(g=rnd.choice(["hot", "hot", "hot", "a", "b", None]), s=rnd.choice(scores + [rnd.random(), round(rnd.random(), 1)]), t=rnd.choice([None, math.nan, 0.0, 0.5, -2.0]), i=i, __cut="x") for i in range(1500)]
    df = spark.createDataFrame([Row(**r) for r in rows], "g string, s double, t double, i long, __cut string")
    got = {(r.g, r.i) for r in top_n_per_group(df, "g", ORDER, n, ["g", "i"]).collect()}
    assert got == expected(rows, n)


def test_repeated_rows_give_exactly_n(spark):
    df = spark.createDataFrame([("a", 1.0, 7)] * 40 + [("b", 1.0, 1)] * 2, "g string, s double, i long")
    got = sorted(r.g for r in top_n_per_group(df, "g", [("s", "desc"), ("i", "asc")], 3).collect())
    assert got == ["a"] * 3 + ["b"] * 2


def test_hot_group_is_broadcast(spark, monkeypatch):
    import granary.operators.top_n as m

    monkeypatch.setattr(m, "HOT_ROWS", 100)
    rows = [("hot", float(i % 97), i) for i in range(2000)] + [("cold", float(i), i) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, s double, i long")
    got = {(r.g, r.i) for r in top_n_per_group(df, "g", [("s", "desc"), ("i", "asc")], 4, ["g", "i"]).collect()}
    best = lambda g: sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:4]
    assert got == {(g, r[2]) for g in ("hot", "cold") for r in best(g)}


def test_empty_and_refused_types(spark):
    empty = spark.createDataFrame([], "g string, s double, i long")
    assert top_n_per_group(empty, "g", [("s", "desc")], 3).count() == 0
    with pytest.raises(ValueError):
        top_n_per_group(spark.createDataFrame([("a", "b")], "g string, s string"), "g", [("s", "desc")], 1)
