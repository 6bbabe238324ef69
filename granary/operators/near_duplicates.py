"""Near-duplicate records by one-permutation hashing.

A text is its set of hashed word shingles. One hash of every shingle gives both a bin and a
value; the smallest value of each bin is the signature, and empty bins borrow from bins
drawn by a hash of bin and attempt (optimal densification). Bands of
``ROWS`` bins make buckets; every member of a bucket is joined with one member of it, its
centre: the first in an order of all texts by hash, so that texts which share many buckets mostly share one centre.
If all members reach the threshold with the centre, as copies of one text do, its s - 1
edges connect the bucket. Otherwise its other pairs are compared, too: all of them in buckets of up to ``SMALL``
classes, and by an exact prefix-filter join in larger ones (both give the same pairs; the size only chooses the plan). So a pair is missed only if
it shares no bucket at all and no component either.

Texts with equal shingle sets are one class from the start. Sizes are compared first, as sets of very different size can't be similar;
what is left is verified by the exact Jaccard similarity of the texts, which only now travel, and only those that stand in a pair.
:func:`similar_pairs` then completes the links inside each connected component of verified edges, where star edges may have
left out links between two leaves, by the same two ways.

What is written or shuffled for all texts is a digest and ``BANDS`` bucket keys a text. A bucket that a sample shows to hold a thousandth of all texts
gets a centre for every ``HOT_ROWS`` or so of its members and one above these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.words import WordHashes, mix, ngrams, words
from granary.operators.components import connected_components
from granary.plans.lineage import materialize
from granary.plans.skew import HOT_ROWS, HOT_SHARE, skew_join

ROWS = 3
BANDS = 28
BINS = ROWS * BANDS
SMALL = 64
#: One text in so many is looked at to find hot buckets; this only chooses the plan.
SAMPLED = 64
#: Rows of one class are expanded in blocks of about so many.
BLOCK = 4096
#: Up to so many ids are broadcast to pick the texts that stand in a pair (16 MB).
FEW_IDS = 2_000_000
_NONE = np.iinfo(np.uint64).max


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The densified one-permutation signatures of sets of 64-bit hashes, one row a set; no set may be empty."""
    h = mix(np.concatenate(sets))
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    own = np.full(len(sets) * BINS, _NONE, dtype=np.uint64)
    np.minimum.at(own, row * BINS + (h % np.uint64(BINS)).astype(np.int64), h >> np.uint64(8))
    own = own.reshape(-1, BINS)
    out, full, attempt = own.copy(), own != _NONE, 0
    todo = np.nonzero(~full.all(axis=1))[0]
    while len(todo):
        attempt += 1
        donor = (mix(np.arange(BINS, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(attempt)) % np.uint64(BINS)).astype(np.int64)
        some = out[todo]
        out[todo] = np.where((some == _NONE) & full[todo][:, donor], own[todo][:, donor], some)
        todo = todo[(out[todo] == _NONE).any(axis=1)]
    return out


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key a band, for every row of signatures."""
    rows = sigs.reshape(len(sigs), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sigs), BANDS))
    for i in range(ROWS):
        key = mix(key ^ rows[:, :, i]) + np.uint64(i + 1)
    return key.view(np.int64)


def _shingles(text: str | None, shingle: int, known: WordHashes) -> np.ndarray:
    return np.unique(ngrams(known.of(words(text)), shingle))


def text_keys(texts: DataFrame, shingle: int, min_words: int) -> DataFrame:
    """(id, k1, k2, n, bands) of each text (id, text) of at least ``min_words`` words: a digest of its shingle set, the size of the set and its buckets."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        known = WordHashes()
        for b in batches:
            for start in range(0, len(b), 2048):
                ids, keys, sets = [], [], []
                for i, t in zip(b["id"][start : start + 2048], b["text"][start : start + 2048]):
                    ws = words(t)
                    if len(ws) >= max(min_words, shingle):
                        s = np.unique(ngrams(known.of(ws), shingle))
                        ids.append(i), sets.append(s), keys.append(xxhash.xxh128_digest(s.tobytes()))
                if ids:
                    k = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2)
                    yield pd.DataFrame({"id": ids, "k1": k[:, 0], "k2": k[:, 1], "n": [len(s) for s in sets], "bands": list(band_keys(signatures(sets)))})

    return texts.mapInPandas(of, "id long, k1 long, k2 long, n int, bands array<bigint>")


class _Texts:
    """The texts of a table, their classes of equal shingle sets, and the threshold at which two are similar."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, threshold: float, shingle: int, min_words: int) -> None:
        rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
        self.texts = rows.filter("id IS NOT NULL AND text IS NOT NULL")
        self.threshold, self.shingle, self.min_words = threshold, shingle, min_words
        self.keys = materialize(text_keys(self.texts, shingle, min_words))
        by_set = self.keys.groupBy("k1", "k2")
        #: (id of the smallest member, k1, k2, n, copies) of each class
        self.classes = materialize(by_set.agg(F.min("id").alias("id"), F.min("n").alias("n"), F.count_distinct("id").alias("copies")))
        self.bands = by_set.agg(F.min("id").alias("id"), F.any_value("bands").alias("bands"))

    def members(self) -> DataFrame:
        """(id, rep, copies, block, blocks): every row with its class; classes are cut into blocks of about BLOCK rows."""
        rows = self.keys.select("id", "k1", "k2")
        per = self.classes.select("k1", "k2", F.col("id").alias("rep"), "copies", F.ceil(F.col("copies") / BLOCK).cast("int").alias("blocks"))
        rows = skew_join(rows, per, ["k1", "k2"]).select("id", "rep", "copies", "blocks").distinct()
        return rows.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))

    def of(self, ids: DataFrame) -> DataFrame:
        """(id, text) of the given ids, which are distinct; of repeated ids a text with the class's set."""
        ids = materialize(ids)
        few = ids.count() <= FEW_IDS
        return self.texts.join(F.broadcast(ids) if few else ids, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b, similarity) of the pairs whose exact Jaccard similarity reaches the threshold."""
        t, shingle = self.threshold, self.shingle
        size = lambda end: self.classes.select(F.col("id").alias(end), F.col("n").alias("n_" + end))
        pairs = pairs.join(size("a"), "a").join(size("b"), "b").filter(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * t - 1e-9)
        pairs = materialize(pairs.select("a", "b"))
        texts = self.of(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())

        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = WordHashes()
            sets: dict[int, np.ndarray] = {}
            for b in batches:
                out = []
                for i, j, x, y in b[["a", "b", "text_a", "text_b"]].itertuples(index=False, name=None):
                    if len(sets) > 4096:
                        sets.clear()
                    for k, text in ((i, x), (j, y)):
                        if k not in sets:
                            sets[k] = _shingles(text, shingle, known)
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    out.append((i, j, common / (len(sets[i]) + len(sets[j]) - common)))
                got = pd.DataFrame(out, columns=["a", "b", "similarity"])
                yield got[got["similarity"] >= t]

        one = skew_join(pairs, texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), ["a"])
        both = skew_join(one, texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), ["b"], counted=pairs)
        return both.select("a", "b", "text_a", "text_b").mapInPandas(compare, "a long, b long, similarity double")

    def stars(self) -> DataFrame:
        """(bucket, id, centre, top): the members of every bucket but its top, each with its centre; the top is the centre of centres, and the centre itself except in hot buckets."""
        rows = self.bands.select("id", F.explode("bands").alias("bucket"))
        total = self.classes.count()
        hot = None
        if total >= HOT_ROWS:
            some = self.keys.filter(F.pmod(F.xxhash64("k1"), F.lit(SAMPLED)) == 0).dropDuplicates(["k1", "k2"]).select(F.explode("bands").alias("bucket"))
            hot = some.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= max(HOT_ROWS, total // HOT_SHARE) / SAMPLED)
            hot = materialize(hot.select("bucket", F.lit(True).alias("hot")))
            hot = None if hot.isEmpty() else hot
        if hot is None:
            rows = rows.withColumns({"hot": F.lit(False), "salt": F.lit(0)})
        else:
            rows = rows.join(F.broadcast(hot), "bucket", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))  # BANDS x HOT_SHARE buckets, about
            rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(-(-total // HOT_ROWS)))).otherwise(0).cast("int"))
        order = F.xxhash64("id"), F.col("id")
        w = Window.partitionBy("bucket", "salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = materialize(rows.withColumn("centre", F.first("id").over(w)).filter("hot OR id <> centre").select("bucket", "id", "centre", "hot"))
        out = rows.filter("NOT hot").select("bucket", "id", "centre", F.col("centre").alias("top"))
        if hot is None:
            return out
        tops = rows.filter("hot AND id = centre").groupBy("bucket").agg(F.min_by("id", F.struct(*order)).alias("top"))
        warm = rows.filter("hot").join(F.broadcast(tops), "bucket").filter("id <> top")
        return materialize(out.unionByName(warm.select("bucket", "id", "centre", "top")))

    def edges(self) -> DataFrame:
        """(a, b, similarity): verified links that connect all pairs at the threshold which share a bucket.

        Centres are compared with their leaves first. Two leaves that are both near their centre are then connected; any other two leaves of the
        bucket are compared as well: all of them in buckets of up to ``SMALL`` sets, by the exact prefix-filter join in larger ones.
        """
        leaves = self.stars()
        pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
        above = leaves.filter("centre <> top").select(*pair("centre", "top"))
        stars = materialize(leaves.filter("id <> centre").select(*pair("id", "centre")).unionByName(above).distinct())
        edges = materialize(self.verified(stars))
        known = edges.select("a", "b", F.lit(True).alias("near"))
        near = leaves.select("bucket", "id", "centre", "top", *pair("id", "centre")).join(known, ["a", "b"], "left")
        near = near.select("bucket", "id", "centre", "top", ((F.col("id") == F.col("centre")) | F.col("near").isNotNull()).alias("near"), *pair("centre", "top"))
        near = near.join(known.withColumnRenamed("near", "up"), ["a", "b"], "left")
        near = materialize(near.select("bucket", "id", "top", (F.col("near") & ((F.col("centre") == F.col("top")) | F.col("up").isNotNull())).alias("near")))
        # one bucket of those with the same leaves will do
        digest = F.bit_xor(F.xxhash64("id")).alias("h1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("h2")
        left = near.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bool_and("near").alias("settled"), F.min("top").alias("top"), *digest)
        left = left.filter("n > 1 AND NOT settled").groupBy("n", "h1", "h2", "top").agg(F.min("bucket").alias("bucket"))
        members = near.select("bucket", "id", "near").join(left.select("bucket", "n"), "bucket")
        members = materialize(members.unionByName(left.select("bucket", F.col("top").alias("id"), F.lit(True).alias("near"), "n")))
        pairs = self.pairs_within(members).join(stars, ["a", "b"], "left_anti")
        return materialize(edges.unionByName(self.verified(pairs)))

    def pairs_within(self, members: DataFrame) -> DataFrame:
        """(a, b), distinct: the pairs that may be similar within groups of texts (bucket, id, near, n), but for those of two near ones."""
        small = members.filter(F.col("n") <= SMALL)
        a = small.select("bucket", F.col("id").alias("a"), F.col("near").alias("near_a"))
        b = small.select("bucket", F.col("id").alias("b"), F.col("near").alias("near_b"))
        pairs = a.join(b, "bucket").filter("a < b AND NOT (near_a AND near_b)").select("a", "b")
        large = members.filter(F.col("n") > SMALL).select("bucket", "id", "near")
        if not large.isEmpty():
            pairs = pairs.unionByName(self.prefix_pairs(large))
        return pairs.distinct()

    def prefix_pairs(self, large: DataFrame) -> DataFrame:
        """Candidate pairs inside large groups (bucket, id, near): two sets at the threshold share a shingle of their prefixes, rarest first.

        What follows the first shared shingle bounds what they can have in common.
        """
        t, shingle = self.threshold, self.shingle

        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = WordHashes()
            for b in batches:
                yield pd.DataFrame({"id": b["id"], "shingles": [_shingles(x, shingle, known).view(np.int64) for x in b["text"]]})

        sets = self.of(large.select("id").distinct()).mapInPandas(of, "id long, shingles array<bigint>")
        sets = large.join(sets, "id")
        each = sets.select("bucket", "id", "near", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
        freq = each.groupBy("bucket", "s").agg(F.count(F.lit(1)).alias("f"))
        ranked = each.join(freq, ["bucket", "s"]).withColumn("r", F.row_number().over(Window.partitionBy("bucket", "id").orderBy("f", "s")))
        prefix = ranked.filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * t - 1e-9) + 1).select("bucket", "s", "id", "near", "n", "r")
        other = prefix.select("bucket", "s", F.col("id").alias("b"), F.col("near").alias("near_b"), F.col("n").alias("m"), F.col("r").alias("q"))
        met = prefix.withColumnRenamed("id", "a").join(other, ["bucket", "s"]).filter("a < b AND NOT (near AND near_b)").filter(F.least("n", "m") >= F.greatest("n", "m") * t - 1e-9)
        met = met.groupBy("bucket", "a", "b", "n", "m").agg(F.min("r").alias("r"), F.min("q").alias("q"))
        common = 1 + F.least(F.col("n") - F.col("r"), F.col("m") - F.col("q"))
        return met.filter(common * (1 + t) >= (F.col("n") + F.col("m")) * t - 1e-6).select("a", "b").distinct()


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, shingle: int = 5, min_words: int = 20) -> DataFrame:
    """(id, group_id, copies, links): one row for every text that is nearly that of another.

    ``group_id`` is the smallest id of the texts connected by links of at least ``threshold``; ``copies`` counts the rows with
    the same shingle set (itself included) and ``links`` the verified edges of that set. Null texts, texts under ``min_words``
    words and texts without a near-duplicate give no row; repeated ids with one text count once; an empty table gives an empty one.
    """
    texts = _Texts(df, id_col, text_col, threshold, shingle, min_words)
    edges = texts.edges()
    ends = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id")))
    links = ends.groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    comp = connected_components(edges).select(F.col("node").alias("id"), "component")
    classes = texts.classes.select("id", "k1", "k2", "copies").join(comp, "id", "left").join(links, "id", "left").filter("component IS NOT NULL OR copies > 1")
    classes = classes.select("k1", "k2", F.coalesce("component", "id").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    rows = skew_join(texts.keys.select("id", "k1", "k2"), classes, ["k1", "k2"])
    return rows.select("id", "group_id", "copies", "links").distinct()


def similar_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, shingle: int = 5, min_words: int = 20) -> DataFrame:
    """(id_a, id_b, similarity): every pair of rows, id_a < id_b, at or above ``threshold``; equal texts count.

    Pairs of rows are expanded from links between classes of equal shingle sets only here, at the end, a class in blocks of about
    ``BLOCK`` rows. As n copies make n x n / 2 pairs, :func:`near_duplicate_groups` is the form to use unless pairs are asked for. Nulls, short texts and
    empty tables are treated as there.
    """
    texts = _Texts(df, id_col, text_col, threshold, shingle, min_words)
    edges = texts.edges()
    comp = materialize(connected_components(edges))
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    groups = comp.join(sizes, "component").select(F.col("component").alias("bucket"), F.col("node").alias("id"), F.lit(False).alias("near"), "n")
    pairs = texts.pairs_within(materialize(groups)).join(edges, ["a", "b"], "left_anti")
    links = edges.unionByName(texts.verified(pairs))
    rows = materialize(texts.members())
    each = lambda end, x: rows.select(F.col("rep").alias(end), F.col("block").alias("block_" + end), F.col("id").alias(x))
    blocks = rows.filter("id = rep").select("rep", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    per = lambda end: blocks.select(F.col("rep").alias(end), F.col("block").alias("block_" + end))
    met = links.join(per("a"), "a").join(per("b"), "b").join(each("a", "x"), ["a", "block_a"]).join(each("b", "y"), ["b", "block_b"])
    across = met.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")
    mine = rows.filter("copies > 1").select("rep", "block", "id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    yours = mine.select("rep", F.col("other").alias("block"), F.col("block").alias("other"), F.col("id").alias("y"))
    same = mine.join(yours, ["rep", "block", "other"]).filter("id < y").select(F.col("id").alias("id_a"), F.col("y").alias("id_b"), F.lit(1.0).alias("similarity"))
    return across.unionByName(same)
