"""Collision counting against brute force."""

import json

import numpy as np
from pyspark.sql import functions as F

from granary.operators.similar_vectors import parse_vector, similar_vectors, usable_vectors


def brute(vs, k):
    ids, x = np.array([i for i, _ in vs]), np.array([v for _, v in vs])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -9)
    return {int(ids[a]): [int(ids[b]) for b in sorted(range(len(ids)), key=lambda b: (-s[a, b], ids[b])) if b != a][:k] for a in range(len(ids))}


def frame(spark, vs, grp="t/m"):
    return usable_vectors(spark.createDataFrame([(i, json.dumps(list(v))) for i, v in vs], "id long, text string"), F.lit(grp), F.col("id"), F.col("text"), F.lit(len(vs[0][1])))


def found(df):
    out = {}
    for r in df.orderBy("id", "position").collect():
        out.setdefault(r.id, []).append(r.neighbour)
    return out


def clustered(n, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 20, dim))
    return [(int(i), (centres[i % len(centres)] + 0.35 * rng.standard_normal(dim)).tolist()) for i in rng.permutation(n)]


def test_one_cell_is_exact(spark):
    vs = clustered(300)
    assert found(similar_vectors(frame(spark, vs), 5)) == brute(vs, 5)


def test_many_cells_reach_the_recall(spark):
    vs = clustered(3000)
    got, want = found(similar_vectors(frame(spark, vs), 10, cell_rows=128)), brute(vs, 10)
    hits = sum(len(set(got[i]) & set(want[i])) for i in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all(len(got[i]) == 10 for i in want)


def test_copies_and_ties(spark):
    v = [1.0, 2.0, 3.0]
    vs = [(i, v) for i in range(40)] + [(100, [1.0, 2.0, 2.9]), (101, [-1.0, 0.0, 0.5])]
    assert found(similar_vectors(frame(spark, vs), 4)) == brute(vs, 4)


def test_unusable_texts():
    assert parse_vector("[1, 2.5, -3e0]", 3) is not None
    assert parse_vector(" [ 1 ,2,\n3 ] ", 3) is not None
    for bad in (None, "", "[]", "[1,2]", "[1,2,null]", "[1,2,NaN]", "[1,2,Infinity]", "[0,0,0.0]", '[1,2,"3"]', "[1,2,true]", "[1,2,1e999]", "{}", "[1,2,3", "null"):
        assert parse_vector(bad, 3) is None


def test_small_and_empty(spark):
    assert similar_vectors(frame(spark, [(1, [1.0, 0.0])]), 3).count() == 0
    assert found(similar_vectors(frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])]), 3)) == {1: [2], 2: [1]}
    none = usable_vectors(spark.createDataFrame([(1, "x")], "id long, text string"), F.lit("g"), F.col("id"), F.col("text"), F.lit(2))
    assert similar_vectors(none, 3).count() == 0


def test_rescaled_copies_tie_by_id(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal(24)
    vs = [(int(i), (v * rng.uniform(0.1, 9)).tolist()) for i in rng.permutation(150)] + [(1000 + i, rng.standard_normal(24).tolist()) for i in range(150)]
    assert found(similar_vectors(frame(spark, vs), 5)) == brute(vs, 5)
    assert frame(spark, vs[:150]).select("vec").distinct().count() < 40


def test_cosines_that_tie_after_rounding_go_to_the_smaller_id():
    from granary.operators.similar_vectors import cell_neighbours

    rng = np.random.default_rng(6)
    v = rng.standard_normal(24)
    x = v + 1e-7 * rng.standard_normal((200, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, near, c = cell_neighbours(x, x, np.arange(200), rng.standard_normal((32, 24)), 0.02, 5)
    assert (c == 1.0).all()
    for i in range(200):
        assert sorted(near[q == i]) == [j for j in range(6) if j != i][:5]
