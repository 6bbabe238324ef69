"""Near-duplicates against comparing all pairs."""

import random
import re

from granary.operators.components import connected_components
from granary.operators.near_duplicates import near_duplicate_groups, signatures, similar_pairs


def shingles(t, n):
    w = re.findall(r"[^\W_]+", t.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def corpus(seed=1, bases=25):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(bases):
        base = [rnd.choice(words) for _ in range(rnd.randint(25, 90))]
        for _ in range(rnd.randint(1, 8)):
            t = list(base)
            for _ in range(rnd.randint(0, 4)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            rows.append(" ".join(t))
    rnd.shuffle(rows)
    return list(enumerate(rows))


def truth(rows, threshold, n):
    s = [(i, shingles(t, n)) for i, t in rows if t and len(re.findall(r"[^\W_]+", t)) >= 20]
    return {(a, b) for a, x in s for b, y in s if a < b and len(x & y) / len(x | y) >= threshold}


def test_pairs_match_brute_force(spark):
    rows = corpus() + [(900, None), (901, ""), (902, "too short")] + [(910 + i, " ".join(f"q{j}" for j in range(30))) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {(r.id_a, r.id_b) for r in similar_pairs(df, "id", "text", 0.6, 3).collect()}
    want = truth(rows, 0.6, 3)
    assert len(want) > 50 and got == want


def test_large_components_use_the_prefix_join(spark, monkeypatch):
    import granary.operators.near_duplicates as m

    monkeypatch.setattr(m, "SMALL", 2)
    rows = corpus(seed=3, bases=6)
    df = spark.createDataFrame(rows, "id long, text string")
    assert {(r.id_a, r.id_b) for r in similar_pairs(df, "id", "text", 0.6, 3).collect()} == truth(rows, 0.6, 3)


def test_groups_and_hot_copies(spark):
    rows = [(i, "a b c d e f g h i j k l m n o p q r s t u v w x y z") for i in range(300)] + [(1000, "one two three")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = near_duplicate_groups(df, "id", "text").collect()
    assert len(got) == 300 and {(r.group_id, r.copies, r.links) for r in got} == {(0, 300, 0)}
    assert near_duplicate_groups(df.limit(0), "id", "text").count() == 0


def test_signature_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(0)
    common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (60, 20, 20))
    x, y = signatures([np.unique(np.concatenate([common, a])), np.unique(np.concatenate([common, b]))])
    assert abs((x == y).mean() - 0.6) < 0.2


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 30)] + [(50, 51), (51, 52), (52, 50), (60, 60), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 50: 50, 51: 50, 52: 50}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0

def template_heavy(texts=120, seed=5):
    """Texts that share most of their words with one template, and in pairs a little more."""
    rnd = random.Random(seed)
    template = [f"t{i}" for i in range(60)]
    rows = []
    for p in range(texts // 2):
        more = [f"p{p}x{i}" for i in range(6)]
        rows += [" ".join(template + more + [f"o{p}y{side}z{i}" for i in range(20)]) for side in range(2)]
    rnd.shuffle(rows)
    return list(enumerate(rows))


def sharing_a_bucket(rows, pairs, n):
    import numpy as np

    from granary.functions.words import WordHashes, ngrams, words
    from granary.operators.near_duplicates import band_keys

    known = WordHashes()
    keys = {i: set(band_keys(signatures([np.unique(ngrams(known.of(words(t)), n))]))[0].tolist()) for i, t in rows}
    return {(a, b) for a, b in pairs if keys[a] & keys[b]}


def test_leaves_of_a_template_bucket_are_compared(spark, monkeypatch):
    import granary.operators.near_duplicates as m

    rows = template_heavy()
    df = spark.createDataFrame(rows, "id long, text string")
    want = truth(rows, 0.6, 3)
    assert len(want) == 60
    for small in (64, 4):  # by all pairs, by the prefix join
        monkeypatch.setattr(m, "SMALL", small)
        got = {(r.id_a, r.id_b) for r in similar_pairs(df, "id", "text", 0.6, 3).collect()}
        assert sharing_a_bucket(rows, want, 3) <= got <= want
    groups = {}
    for r in near_duplicate_groups(df, "id", "text", 0.6, 3).collect():
        groups.setdefault(r.group_id, []).append(r.id)
    assert sharing_a_bucket(rows, want, 3) <= {tuple(sorted(g)) for g in groups.values()}


def test_hot_buckets_and_classes_in_blocks(spark, monkeypatch):
    import granary.operators.near_duplicates as m

    rows = template_heavy(80) + [(1000 + i, "one long text of which there are so many equal copies that they fill several blocks of rows and more than that") for i in range(40)]
    want = truth(rows, 0.6, 3)
    for name, value in (("HOT_ROWS", 8), ("HOT_SHARE", 1000), ("SAMPLED", 1), ("BLOCK", 16), ("FEW_IDS", 3)):
        monkeypatch.setattr(m, name, value)
    df = spark.createDataFrame(rows, "id long, text string")
    got = {(r.id_a, r.id_b) for r in similar_pairs(df, "id", "text", 0.6, 3).collect()}
    assert sharing_a_bucket(rows, want, 3) <= got <= want and len(want) >= 780


def test_groups_are_the_components_of_pairs(spark):
    rows = corpus(seed=8)
    df = spark.createDataFrame(rows, "id long, text string")
    edges = spark.createDataFrame(sorted(truth(rows, 0.6, 3)), "a long, b long")
    want = {r.node: r.component for r in connected_components(edges).collect()}
    assert {r.id: r.group_id for r in near_duplicate_groups(df, "id", "text", 0.6, 3).collect()} == want
