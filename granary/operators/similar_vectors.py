"""The k most similar vectors of every vector, by collision counting.

Index. Every vector is projected on single random directions. In each of ``tables``
trees the projections of one direction after another are sorted and cut at the
median, until a cell holds about ``cell_rows`` vectors; cuts come from a sample of at
most ``SAMPLE`` vectors a group (a fixed bound), but every vector is put into a cell of every tree. Groups of up to
``cell_rows`` vectors are one cell.

Search. A query opens a window around its own projection and visits every cell that
the window reaches. In a cell, the vectors stand in ``PROJECTIONS`` sorted
projection arrays, each cut into 256 runs of equal length; a query's window is a range of runs in each of them, and a vector whose runs
lie in the windows of at least two fifths of the arrays is verified by its exact
cosine. Queries whose k-th verified neighbour is farther than the window widen it
(virtual rehashing: the same arrays, longer windows) and count again. Runs are bytes, so counting the collisions of a vector costs less than its cosine.

A cell that is far larger than the others, as where vectors crowd or where the sample is too small for the group, is searched in a grid of blocks of ``BLOCK_ROWS``
vectors and ``BLOCK_ROWS`` queries, each a task of its own, with the same result.

Cosines are rounded before the best are chosen, so ties go to the smaller id in a cell, too.
Equal vectors are searched once; unit vectors are rounded, so copies of other length are equal. Of a vector's copies only the k + 1 smallest ids can be among
anyone's neighbours, as copies tie with each other and ties go to the smaller id.

Loss: a neighbour is missed only if it lies outside the cells that its query visits in every
tree, or collides too rarely. The tests hold recall at or above 0.9 against
brute force; where a group fits one cell every pair is within reach.
"""

from __future__ import annotations

import hashlib
import json
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.plans.lineage import materialize
from granary.plans.skew import skew_join

SAMPLE = 8192
PROJECTIONS = 16
#: Vectors that lie in a query's window on this share of the arrays are verified: one as far as the window is wide does on 0.68 of them.
COLLISIONS = 0.4
#: A query visits the cells within this share of the sample's nearest distance around its projection.
WINDOW = 0.6
#: A window is widened by this factor.
WIDER = 2.0
#: Beyond this share of verified pairs one matrix product is cheaper than single products.
DENSE = 0.04
#: Unit vectors are rounded to so many decimals, so that copies of other length or spelling become equal but for a few at a rounding edge.
UNIT_DIGITS = 13
#: A block of a cell holds about so many vectors or queries.
BLOCK_ROWS = 16384
#: Bytes of trees that are broadcast at once; more groups take more passes.
TREE_BYTES = 64 << 20
#: Ids of copies that are broadcast to leave them out (16 MB).
FEW_IDS = 1_000_000
_BLOCK = 64


def _refuse(token: str) -> float:
    raise ValueError(token)


def parse_vector(text: str | None, dim: int) -> np.ndarray | None:
    """The vector of unit length, if ``text`` is a JSON array of ``dim`` finite numbers, not all 0."""
    if text is None:
        return None
    try:
        values = json.loads(text, parse_constant=_refuse)
        if type(values) is not list or len(values) != dim or not {type(v) for v in values} <= {int, float}:
            return None
        v = np.array(values, dtype="float64")
    except (ValueError, OverflowError, RecursionError):
        return None
    if not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if top == 0:
        return None
    v = v / top
    return np.round(v / np.sqrt((v * v).sum()), UNIT_DIGITS) + 0.0


def usable_vectors(df: DataFrame, group: Column, vec_id: Column, text: Column, dim: Column) -> DataFrame:
    """(grp, id, vec): the vectors that can be used, of unit length, as packed doubles.

    Null, malformed, wrongly sized, non-finite and all-zero texts are left out, as are rows with a null
    group or dimension.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            vs = [parse_vector(t, int(d)) for t, d in zip(b["text"], b["dim"])]
            at = [v is not None for v in vs]
            yield pd.DataFrame({"grp": b["grp"][at], "id": b["id"][at], "vec": [v.tobytes() for v in vs if v is not None]})

    rows = df.select(group.alias("grp"), vec_id.alias("id"), text.alias("text"), dim.alias("dim"))
    return rows.filter("grp IS NOT NULL AND dim IS NOT NULL AND text IS NOT NULL").mapInPandas(parse, "grp string, id long, vec binary")


class Trees:
    """Cells of one group: ``depth`` cuts along single projections in each of ``tables`` trees."""

    def __init__(self, sample: np.ndarray, rows: int, cell_rows: int, tables: int, seed: int) -> None:
        self.depth = max(0, min(math.ceil(math.log2(max(1, rows) / cell_rows)), int(math.log2(max(1, len(sample)) / 8)) if len(sample) >= 8 else 0))
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.lines = rng.standard_normal((tables, self.depth, dim))
        self.counting = rng.standard_normal((PROJECTIONS, dim))
        self.cuts = [[np.zeros(2**d) for d in range(self.depth)] for _ in range(tables)]
        for t in range(tables):
            node = np.zeros(len(sample), dtype=np.int64)
            for d in range(self.depth):
                p = sample @ self.lines[t, d]
                for k in range(2**d):
                    own = p[node == k]
                    self.cuts[t][d][k] = np.median(own) if len(own) else 0.0
                node = 2 * node + (p > self.cuts[t][d][node])
        some = sample[:1024]
        dots = some @ sample.T
        dots[dots > 1 - 1e-9] = -1
        near = np.sqrt(np.maximum(0, 2 - 2 * dots.max(axis=1))) if len(sample) > 1 else np.array([0.5])
        self.radius = float(np.clip(np.median(near), 0.02, 1.0))

    def cells(self, x: np.ndarray, t: int, window: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, cell): every cell of tree ``t`` that the row's window reaches."""
        row, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        for d in range(self.depth):
            away = (x @ self.lines[t, d])[row] - self.cuts[t][d][node]
            right, left = away > -window, away <= window
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        return row, node


def _best(cos: np.ndarray, k: int) -> np.ndarray:
    """The columns of the ``k`` highest values of every row, k < their number; ties go to the first columns."""
    best = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(cos, best, axis=1).min(axis=1)
    cut = np.nonzero((least > -2) & ((cos >= least[:, None]).sum(axis=1) > k))[0]
    if len(cut):
        best[cut] = np.argsort(-cos[cut], axis=1, kind="stable")[:, :k]
    return best


def cell_neighbours(x: np.ndarray, q: np.ndarray, own: np.ndarray, lines: np.ndarray, radius: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row of x, rounded cosine) of the ``k`` best of ``x``, ties to the earlier row, for each of ``q`` by collision counting; ``own`` is each query's own row of x, -1 where it isn't there."""
    n, m = len(x), len(lines)
    k = min(k, n)
    px = x @ lines.T
    order = np.argsort(px, axis=0, kind="stable")
    sorted_px = np.take_along_axis(px, order, axis=0)
    run = np.empty((m, n), dtype=np.uint8)
    runs = (np.arange(n) * 256 // n).astype(np.uint8)
    for i in range(m):
        run[i, order[:, i]] = runs
    out_q, out_x, out_c = [], [], []
    for start in range(0, len(q), _BLOCK):
        todo = np.arange(start, min(start + _BLOCK, len(q)))
        window = radius
        while len(todo):
            last = window >= 2
            part = q[todo]
            if not last:
                pq = part @ lines.T
                hits = np.zeros((len(todo), n), dtype=np.uint8)
                away, inside = np.empty_like(hits), np.empty(hits.shape, dtype=bool)
                for i in range(m):
                    first = np.searchsorted(sorted_px[:, i], pq[:, i] - window, "left") * 256 // n
                    last_run = np.maximum(np.searchsorted(sorted_px[:, i], pq[:, i] + window, "right") - 1, 0) * 256 // n
                    first = np.minimum(first, last_run).astype(np.uint8)
                    np.subtract(run[i][None, :], first[:, None], out=away)  # below the first run it wraps round
                    np.less_equal(away, (last_run.astype(np.uint8) - first)[:, None], out=inside)
                    np.add(hits, inside.view(np.uint8), out=hits)
                found = hits >= COLLISIONS * m
                if found.mean() <= DENSE:
                    a, b = np.nonzero(found)
                    cos = np.full(found.shape, -2.0)
                    cos[a, b] = np.round(np.einsum("ij,ij->i", part[a], x[b]), 9)
                else:
                    cos = np.where(found, np.round(part @ x.T, 9), -2.0)
            else:
                cos = np.round(part @ x.T, 9)
            mine = own[todo]
            there = mine >= 0
            cos[np.nonzero(there)[0], mine[there]] = -2.0
            best = _best(cos, k) if k < n else np.broadcast_to(np.arange(n), (len(todo), n))
            top = np.take_along_axis(cos, best, axis=1)
            far = np.sqrt(np.maximum(0, 2 - 2 * top.min(axis=1)))
            done = (far <= window) | last
            a, b = np.nonzero(done[:, None] & (top > -2))
            out_q.append(todo[a]), out_x.append(best[a, b]), out_c.append(top[a, b])
            todo, window = todo[~done], window * WIDER
    return np.concatenate(out_q or [np.array([], int)]), np.concatenate(out_x or [np.array([], int)]), np.concatenate(out_c or [np.array([])])


def _trees(members: DataFrame, sizes: DataFrame, cell_rows: int, tables: int, seed: int) -> DataFrame:
    """(grp, bytes, data): the trees of every group of more than ``cell_rows`` vectors, from a sample of at most 2 x SAMPLE of them."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vkey")
        tree = Trees(np.array([np.frombuffer(v) for v in rows["vec"]][: 2 * SAMPLE]), int(rows["n"].iloc[0]), cell_rows, tables, seed)
        data = pickle.dumps(tree)
        return pd.DataFrame({"grp": [key[0]], "bytes": [len(data)], "data": [data]})

    big = sizes.filter(F.col("n") > cell_rows)
    share = F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("n"))
    some = members.join(big, "grp").filter(F.pmod(F.xxhash64("vkey"), F.lit(1_000_000)) < share * 1_000_000)
    return materialize(some.groupBy("grp").applyInPandas(build, "grp string, bytes long, data binary"))


def similar_vectors(vectors: DataFrame, k: int = 10, cell_rows: int = 4096, tables: int = 2, seed: int = 7) -> DataFrame:
    """(grp, id, neighbour, cosine, position): the ``k`` most similar others of every row of ``vectors``.

    ``vectors`` is (grp string, id long, vec packed unit doubles), as from :func:`usable_vectors`; ids are unique within
    a group, and all vectors of a group have one length. Cosines are rounded to 9 decimals, ties go to the smaller id.
    A group of one row gives none, one of up to k rows gives all others; an empty table
    gives an empty one. Other columns are not read.
    """
    members = materialize(vectors.select("grp", "id", F.md5("vec").alias("vkey"), "vec"))
    keys = members.select("grp", "vkey", "id")
    classes = materialize(keys.groupBy("grp", "vkey").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    first = F.row_number().over(Window.partitionBy("grp", "vkey").orderBy("id"))
    # a copy's place among the copies is needed for few of them: the k + 1 smallest ids of each vector
    copies = skew_join(keys, classes.filter("copies > 1").select("grp", "vkey", "rep"), ["grp", "vkey"], counted=keys)
    others = materialize(copies.filter("id <> rep").select("grp", "id"))
    copies = copies.withColumn("__r", first).filter(F.col("__r") <= k + 1).select("grp", "rep", "id")
    copies = copies.unionByName(classes.filter("copies = 1").select("grp", "rep", F.col("rep").alias("id")))
    few = others.count() <= FEW_IDS
    reps = members.join(F.broadcast(others) if few else others, ["grp", "id"], "left_anti").select("grp", F.col("id").alias("rep"), "vkey", "vec")

    sizes = materialize(classes.groupBy("grp").agg(F.count(F.lit(1)).alias("n")))
    trees = _trees(reps, sizes, cell_rows, tables, seed)
    passes = 1 + int((trees.agg(F.sum("bytes")).first()[0] or 0) // TREE_BYTES)
    turn = F.pmod(F.xxhash64("grp"), F.lit(passes))
    near = None
    for n in range(passes):  # one but for tens of thousands of large groups
        some = reps if passes == 1 else reps.filter(turn == n)
        found = _searched(some, trees if passes == 1 else trees.filter(turn == n), k, tables)
        near = found if near is None else near.unionByName(found)
    # a vector among another's best is a candidate of that other's side, too
    near = materialize(_merged(near, k))
    ways = F.array(F.struct("rep", "near"), F.struct(F.col("near").alias("rep"), F.col("rep").alias("near")))
    near = _merged(near.select("grp", "cosine", F.explode(ways).alias("w")).select("grp", "w.rep", "w.near", "cosine"), k)
    return _of_members(keys, classes.select("grp", "vkey", "rep"), copies, materialize(near), k)


def _merged(near: DataFrame, k: int) -> DataFrame:
    """(grp, rep, near, cosine): the ``k`` best of all found, in one shuffle by vector; a pair found twice counts once."""
    near = near.repartition("grp", "rep").groupBy("grp", "rep", "near").agg(F.max("cosine").alias("cosine"))
    best = Window.partitionBy("grp", "rep").orderBy(F.desc("cosine"), "near")
    return near.withColumn("__r", F.row_number().over(best)).filter(F.col("__r") <= k).drop("__r")


def _searched(reps: DataFrame, trees: DataFrame, k: int, tables: int) -> DataFrame:
    """(grp, rep, near, cosine): the ``k`` best of each cell that a vector visits. The trees are broadcast; groups without any are one cell."""
    spark = reps.sparkSession
    shared = spark.sparkContext.broadcast({r["grp"]: pickle.loads(r["data"]) for r in trees.select("grp", "data").toLocalIterator()})

    def visits(own: pd.DataFrame, g: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(tree, rows, cells, whether it is the row's own cell) of a batch of one group."""
        tree = shared.value.get(g)
        if tree is None or not tree.depth:
            yield 0, np.arange(len(own)), np.zeros(len(own), dtype=np.int64), np.ones(len(own), dtype=bool)
            return
        x = np.array([np.frombuffer(v) for v in own["vec"]])
        for t in range(tables):
            row, cell = tree.cells(x, t, WINDOW * tree.radius)
            home = np.zeros(len(x), dtype=np.int64)
            for d in range(tree.depth):
                home = 2 * home + (x @ tree.lines[t, d] > tree.cuts[t][d][home])
            yield t, row, cell, cell == home[row]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, own in b.groupby("grp"):
                for t, _, cell, at_home in visits(own, g):
                    c = pd.DataFrame({"cell": cell, "data": at_home.astype(int), "queries": 1}).groupby("cell", as_index=False).sum()
                    yield c.assign(grp=g, tree=t)[["grp", "tree", "cell", "data", "queries"]]

    counted = reps.select("grp", "vec").mapInPandas(count, "grp string, tree int, cell long, data long, queries long")
    counted = counted.groupBy("grp", "tree", "cell").agg(F.sum("data").alias("data"), F.sum("queries").alias("queries"))
    large = counted.filter(F.col("queries") > 2 * BLOCK_ROWS)  # at most one for every 2 x BLOCK_ROWS visits
    grid = {(r["grp"], r["tree"], r["cell"]): (-(-r["data"] // BLOCK_ROWS) or 1, -(-r["queries"] // BLOCK_ROWS)) for r in large.toLocalIterator()}
    blocks = spark.sparkContext.broadcast(grid)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, own in b.groupby("grp"):
                ids, vecs = own["rep"].to_numpy(), own["vec"].to_numpy()
                for t, row, cell, at_home in visits(own, g):
                    hot = np.array([(g, t, c) in blocks.value for c in cell.tolist()], dtype=bool) if blocks.value else np.zeros(len(cell), dtype=bool)
                    row_, cell_, home_ = row[~hot], cell[~hot], at_home[~hot]
                    yield pd.DataFrame({"grp": g, "tree": t, "cell": cell_, "block": 0, "data": home_, "asks": True, "rep": ids[row_], "vec": vecs[row_]})
                    for r, c, own_cell in zip(row[hot], cell[hot].tolist(), at_home[hot]):
                        d, q = blocks.value[g, t, c]
                        h = int.from_bytes(hashlib.md5(str(ids[r]).encode()).digest()[:8])
                        ask, lie = h % q, (h // q) % d if own_cell else -1
                        # as a query in every block of vectors, as a vector in every block of queries
                        at = [(x * q + ask, x == lie, True) for x in range(d)] + ([(lie * q + y, True, False) for y in range(q) if y != ask] if own_cell else [])
                        yield pd.DataFrame(at, columns=["block", "data", "asks"]).assign(grp=g, tree=t, cell=c, rep=ids[r], vec=vecs[r])[["grp", "tree", "cell", "block", "data", "asks", "rep", "vec"]]

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = shared.value.get(key[0])
        rows = rows.sort_values("rep")
        q = np.array([np.frombuffer(v) for v in rows["vec"]])
        is_data, asks, ids = rows["data"].to_numpy(), rows["asks"].to_numpy(), rows["rep"].to_numpy()
        x, x_ids = q[is_data], ids[is_data]
        if not len(x) or not asks.any():
            return pd.DataFrame({"grp": [], "rep": [], "near": [], "cosine": []})
        own = np.full(len(q), -1)
        own[is_data] = np.arange(len(x))
        if tree is None:  # a small group, one cell
            tree = Trees(x[:SAMPLE], len(x), len(x), 0, 7)
        a, b, c = cell_neighbours(x, q[asks], own[asks], tree.counting, tree.radius, k)
        return pd.DataFrame({"grp": key[0], "rep": ids[asks][a], "near": x_ids[b], "cosine": c})

    placed = reps.select("grp", "rep", "vec").mapInPandas(place, "grp string, tree int, cell long, block long, data boolean, asks boolean, rep long, vec binary")
    return placed.groupBy("grp", "tree", "cell", "block").applyInPandas(search, "grp string, rep long, near long, cosine double")


def _of_members(members: DataFrame, reps: DataFrame, copies: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """The neighbours of every row from those of distinct vectors: each stands for its k + 1 smallest ids."""
    others = near.join(copies.withColumnRenamed("rep", "near"), ["grp", "near"]).select("grp", "rep", F.col("id").alias("neighbour"), "cosine")
    listed = others.unionByName(copies.select("grp", "rep", F.col("id").alias("neighbour"), F.lit(1.0).alias("cosine")))
    best = Window.partitionBy("grp", "rep").orderBy(F.desc("cosine"), "neighbour")
    # of a vector's own copies and its neighbours k + 1 suffice, as a row leaves out itself alone
    listed = listed.withColumn("__r", F.row_number().over(best)).filter(F.col("__r") <= k + 1)
    per_rep = listed.groupBy("grp", "rep").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "neighbour"))).alias("listed"))
    per_vector = reps.select("grp", "vkey", "rep").join(per_rep, ["grp", "rep"])
    of = skew_join(members.select("grp", "id", "vkey"), per_vector, ["grp", "vkey"])
    mine = F.slice(F.filter("listed", lambda s: s["neighbour"] != F.col("id")), 1, k)
    out = of.select("grp", "id", F.posexplode(mine).alias("position", "n"))
    return out.select("grp", "id", F.col("n.neighbour").alias("neighbour"), (-F.col("n.c")).alias("cosine"), (F.col("position") + 1).alias("position"))
