"""Cache lookups are scoped by repository before anything is ranked."""

import json

import numpy as np
from pyspark.sql import functions as F

from granary.operators import retrieval as K
from granary.queries.retrieval import k11_cache_lookup


def test_nearer_rows_of_other_repositories_hide_no_hit(spark, tmp_path):
    rng = np.random.default_rng(0)
    v = rng.standard_normal(64)
    near = lambda e: json.dumps((v + e * rng.standard_normal(64)).tolist())
    rows = [(0, "a", "asked", near(0.0)), (1, "a", "far", json.dumps(rng.standard_normal(64).tolist())), (3, None, "none", near(0.0))]
    rows += [(100 + i, "b" if i % 2 else "c", f"other {i}", near(0.001)) for i in range(50)]
    rows += [(20, "a", "a little farther", near(0.1)), (7, "a", "farther still", near(0.15)), (40, "d", "alone", near(0.0))]
    spark.createDataFrame(rows, "cache_id long, repo_id string, query_text string, embedding string").write.parquet(str(tmp_path / "semantic_cache.parquet"))
    got = {r.asked_id: (r.hit_id, r.kind) for r in k11_cache_lookup(spark, str(tmp_path)).collect()}
    assert got[0] == (20, "similar") and got[20] == (0, "similar") and got[40] == (-1, "miss")
    assert got[100][1] == "similar" and got[100][0] % 2 == 0


def test_search_within_groups_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 16)
    rng = np.random.default_rng(2)
    x, g = rng.standard_normal((200, 6)), rng.integers(0, 5, 200)
    df = spark.createDataFrame([(i, f"g{g[i]}" if i % 11 else None, x[i].tolist()) for i in range(200)], "id long, grp string, vec array<double>")
    got = {}
    for r in K.dense_top_k(df.filter(F.col("id") % 7 == 0), df, 4, within="grp").collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 200, 7):
        cos = np.round(u @ u[q], 9)
        own = [i for i in range(200) if i != q and g[i] == g[q] and i % 11 and q % 11]
        assert [got.get(q, {})[k] for k in sorted(got.get(q, {}))] == sorted(own, key=lambda i: (-cos[i], i))[:4]
