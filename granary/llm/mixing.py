"""Mixing sources to target weights by the cube method.

A source whose target is m times its tokens uses every document floor(m) times and, of each
document, once more with probability m - floor(m). These inclusion probabilities move through the null space of the balancing
constraints (tokens and documents of the source) until they are 0 or 1: a flight takes three undecided
documents, whose constraints leave one direction, and moves along it, up or down at random in
proportion, until one of them is decided, so both totals stay as they were. Flights run in blocks of documents of one source; the
two that each block leaves undecided fly together in the next round. The last flight of a source spares a dozen
documents: of the ways to decide these few, the one nearest to both totals is taken.

A hot source has more blocks, not larger ones, and a block is all that a task holds. The driver sees one row a target.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.tokenizer import VOCABULARY, with_token_counts
from granary.plans.lineage import materialize

BLOCK = 2_000
#: So many documents of a source, drawn at random, and the two that the last flight leaves make up its landing problem.
LANDING = 10
#: More targets than this are refused, as one row for each is broadcast.
SOURCES = 100_000
PARTITIONS = 4_096
_EPS = 1e-9


def flight(p: np.ndarray, tokens: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Inclusion probabilities after the flight: at most two are left undecided, none if ``land``."""
    p = p.astype(float).copy()
    p[p < _EPS] = 0
    p[p > 1 - _EPS] = 1
    waiting = rng.permutation(np.nonzero((p > 0) & (p < 1))[0])
    waiting = waiting[np.argsort(tokens[waiting], kind="stable")].tolist()  # the largest fly first, so small ones are left to land
    scale = max(1.0, float(tokens.max(initial=1)))
    x = tokens / scale
    active: list[int] = []
    held = [waiting.pop(rng.integers(len(waiting))) for _ in range(min(LANDING, len(waiting)))] if land else []
    expected = float(p @ x), float(p.sum())
    while True:
        while len(active) < 3 and waiting:
            active.append(waiting.pop())
        if len(active) == 3:
            a, b, c = (x[i] for i in active)
            u = np.array([b - c, c - a, a - b])
            if np.abs(u).max() < 1e-15:  # of one size: any direction that keeps the count
                u = np.array([1.0, -1.0, 0.0])
        else:
            return _landed(p, x, [*active, *held], expected) if land else p
        at = p[active]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - at) / u, np.where(u < 0, -at / u, np.inf)).min()
            down = np.where(u > 0, at / u, np.where(u < 0, (at - 1) / u, np.inf)).min()
        at = at + up * u if rng.random() < down / (up + down) else at - down * u
        at[at < _EPS] = 0
        at[at > 1 - _EPS] = 1
        p[active] = at
        active = [i for i in active if 0 < p[i] < 1]


def _landed(p: np.ndarray, x: np.ndarray, left: list[int], expected: tuple[float, float]) -> np.ndarray:
    """Of all ways to decide the few that are left, the one whose totals come nearest to the expected ones."""
    if left:
        ways = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        p[left] = 0
        size = max(float(x[left].mean()), 1e-12)
        off = np.abs(p @ x + ways @ x[left] - expected[0]) / size + np.abs(p.sum() + ways.sum(axis=1) - expected[1])
        p[left] = ways[int(np.argmin(off))]
    return p


def _targets(targets: DataFrame) -> DataFrame:
    """One row a source, compared without case and padding; repeated targets add up. Null sources and shares are left out."""
    t = targets.select(F.lower(F.trim("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
    t = t.filter("source IS NOT NULL AND target_share > 0")
    return t.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"))


def sized_documents(docs: DataFrame, doc_id: str, text: str, source: str, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens): every document with its source, without case and padding, and its tokens."""
    keyed = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.lower(F.trim(F.col(f"`{source}`"))).alias("source"), F.col(f"`{text}`").alias("text"))
    # the keys travel with the count, so the texts are neither shuffled nor joined again
    return with_token_counts(keyed, ["doc_id", "source"], "text", path)


def mix_plan(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row a target: documents, available and target tokens, and the mean number of uses that reaches the target or the cap.

    ``total_tokens`` is the size of the mix; by default all tokens of the target sources.
    """
    has = sized.filter("tokens > 0").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("available"))
    plan = materialize(_targets(targets).join(has, "source", "left").fillna(0, ["documents", "available"]))
    total = total_tokens if total_tokens is not None else plan.agg(F.sum("available")).first()[0] or 0
    shares = plan.agg(F.sum("target_share")).first()[0] or 1.0
    plan = plan.withColumn("target_tokens", F.col("target_share") / shares * F.lit(float(total)))
    reached = F.least("target_tokens", F.col("available") * F.col("max_repeats"))
    return plan.withColumn("mean_uses", F.when(F.col("available") > 0, reached / F.col("available")).otherwise(0.0))


def cube_mix(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 11) -> DataFrame:
    """(doc_id, source, tokens, uses): the documents of the mix and how often each is used, at most max_repeats times.

    ``sized`` is (doc_id, source, tokens). Documents without tokens, with a null source or with a source without target are left out; a target without documents
    contributes nothing; more than SOURCES targets are an error; empty tables give an empty mix. The result depends on ``seed`` and the rows alone.
    """
    plan = mix_plan(sized, targets, total_tokens)
    few = plan.select("source", "mean_uses", "documents")
    if few.count() > SOURCES:
        raise ValueError(f"more than {SOURCES} target sources")
    rows = sized.filter("tokens > 0").join(F.broadcast(few), "source")
    whole = F.floor(F.col("mean_uses") + 1e-9)
    rows = rows.withColumn("base", whole.cast("int")).withColumn("p", F.greatest(F.col("mean_uses") - whole, F.lit(0.0)))
    state = materialize(rows.select("doc_id", "source", "tokens", "base", "p", F.col("documents").alias("left")))
    schema = state.select("doc_id", "source", "tokens", "base", "p").schema
    done: list[DataFrame] = []
    turn = 0
    blocks = lambda n: F.ceil(n / BLOCK)
    most, rows_left = state.agg(F.coalesce(F.max("left"), F.lit(0)), F.count(F.lit(1))).first()

    def flier(n: int):
        def fly(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
            b = b.sort_values("doc_id", kind="stable").reset_index(drop=True)
            rng = np.random.default_rng(xxhash.xxh64_intdigest(f"{seed}/{n}/{key[0]}/{key[1]}"))
            b["p"] = flight(b["p"].to_numpy(), b["tokens"].to_numpy(), rng, bool(b["left"].iloc[0] <= BLOCK))
            return b[schema.names]

        return fly

    while most:
        blocked = state.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed + turn)), F.greatest(blocks(F.col("left")), F.lit(1)).cast("long")))
        # blocks are small in bytes and dear in time: so many partitions as there are blocks, which adaptive execution leaves alone
        blocked = blocked.repartition(min(PARTITIONS, 1 + rows_left // BLOCK), "source", "block")
        flown = materialize(blocked.groupBy("source", "block").applyInPandas(flier(turn), schema))
        done.append(flown.filter("p = 0 OR p = 1"))
        undecided = flown.filter("p > 0 AND p < 1")
        counts = undecided.groupBy("source").agg(F.count(F.lit(1)).alias("left"))
        state = undecided.join(F.broadcast(counts), "source")  # one row a target
        most, rows_left = counts.agg(F.coalesce(F.max("left"), F.lit(0)), F.coalesce(F.sum("left"), F.lit(0))).first()
        turn += 1
    if not done:
        return state.select("doc_id", "source", "tokens", F.col("base").alias("uses")).limit(0)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "tokens", (F.col("base") + F.col("p")).cast("int").alias("uses")).filter("uses > 0")


def mix_report(sized: DataFrame, targets: DataFrame, mix: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row a target: what was asked, what there is, what was used, the share reached and what is missing.

    ``actual_share`` is of the tokens of the whole mix; ``shortfall_tokens`` is what the cap on repeats keeps from the target.
    """
    plan = mix_plan(sized, targets, total_tokens)
    used = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.count(F.lit(1)).alias("used_documents"), F.max("uses").alias("most_uses"))
    out = plan.join(used, "source", "left").fillna(0, ["used_tokens", "used_documents", "most_uses"])
    whole = mix.agg(F.sum(F.col("tokens") * F.col("uses")).alias("mix_tokens"))
    out = out.crossJoin(F.broadcast(whole))  # one row
    short = F.greatest(F.col("target_tokens") - F.col("available") * F.col("max_repeats"), F.lit(0.0))
    return out.select(
        "source", "target_share", "max_repeats", "documents", F.col("available").alias("available_tokens"), "target_tokens", "used_tokens", "used_documents", "most_uses",
        F.when(F.col("mix_tokens") > 0, F.col("used_tokens") / F.col("mix_tokens")).otherwise(0.0).alias("actual_share"), short.alias("shortfall_tokens"),
    )
