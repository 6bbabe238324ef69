"""The N best rows of every group by simultaneous bisection of cutoffs.

Every row gets an order-preserving code: the sort keys turned into 32-bit words,
most significant first, with a row number as the last word, so no two rows share
a code. All groups keep a bracket on the first word in which their undecided rows
differ. One pass halves every bracket six times at once: rows are counted above
the midpoints, the cutoff moves into one part in 64 of the bracket, rows above it are
kept, rows below it are decided, and only rows inside it go into the next pass.

A pass moves one pre-aggregated row per group and part, and joins undecided
rows with their cutoffs. Groups holding at least a thousandth of the rows (at most a
thousand of them) get their cutoffs by broadcast, so their rows stay where they
are; the others are joined by a shuffle, in which no group is large.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.plans.lineage import discard, materialize

#: Halvings of a bracket in one pass, and the parts they make.
HALVINGS = 6
PARTS = 2**HALVINGS
#: A group of this many rows is hot if it also holds a thousandth of all rows.
HOT_ROWS = 50_000
HOT_SHARE = 1_000
_LEAST = -(2**63)


@F.pandas_udf(T.LongType())
def float_code(x: pd.Series) -> pd.Series:
    """A long that orders like the double: the sign bit flips the others. NaN and null give null."""
    values = x.to_numpy(dtype="float64", na_value=np.nan) + 0.0
    bits = values.view("int64")
    code = np.where(bits < 0, bits ^ np.int64(0x7FFF_FFFF_FFFF_FFFF), bits)
    out = pd.Series(code, dtype="Int64")
    out[np.isnan(values)] = pd.NA
    return out


def _code(df: DataFrame, name: str, direction: str) -> Column:
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        code = float_code(c.cast("double"))
    elif isinstance(kind, (T.TimestampType,)):
        code = F.unix_micros(c)
    elif isinstance(kind, T.DateType):
        code = F.unix_date(c).cast("long")
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        code = c.cast("long")
    else:
        raise ValueError(f"cannot order by {name}: {kind.simpleString()}")
    return code if direction == "desc" else F.bitwise_not(code)


def top_n_per_group(df: DataFrame, group: str, order: list[tuple[str, str]], n: int, keep: list[str] | None = None) -> DataFrame:
    """The ``n`` first rows of each group under ``order``, with the columns ``keep``.

    ``order`` lists (column, ``desc`` or ``asc``), numbers, dates or timestamps.
    Rows with a null group or a null or NaN first key are left out; nulls and NaN in
    later keys come last. Rows equal in all keys are taken in the order of a row
    number, so exactly ``n`` rows of a larger group come out, repeated rows included.
    A group of fewer rows comes out whole; an empty table gives an empty one. Extra
    columns, whatever their names, are neither read nor returned.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    keep = list(dict.fromkeys(keep or [group, *(c for c, _ in order)]))
    names = [f"__k{i}" for i in range(2 * len(order) + 1)]
    coded = df.filter(F.col(f"`{group}`").isNotNull()).select(
        F.col(f"`{group}`").alias("__g"),
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"),
        *[_code(df, c, d).alias(f"__c{i}") for i, (c, d) in enumerate(order)],
    )
    coded = coded.filter(F.col("__c0").isNotNull())
    words: list[Column] = []
    for i in range(len(order)):
        c = F.coalesce(F.col(f"__c{i}"), F.lit(_LEAST))
        words += [F.shiftright(c, 32).alias(names[2 * i]), c.bitwiseAND(F.lit(0xFFFF_FFFF)).alias(names[2 * i + 1])]
    rows = materialize(coded.select("__g", "__row", *words, F.monotonically_increasing_id().alias(names[-1])))
    total = rows.count()

    counted = [F.count(F.lit(1)).alias("__n"), *(f(k).alias(f"{k}_{f.__name__}") for k in names for f in (F.min, F.max))]
    level = lambda pick: F.coalesce(*[F.when(F.col(f"{k}_min") < F.col(f"{k}_max"), pick(i, k)) for i, k in enumerate(names)])
    bracket = [
        "__g",
        "__n",
        "__need",
        level(lambda i, k: F.lit(i)).alias("__level"),
        level(lambda i, k: F.col(f"{k}_min")).alias("__lo"),
        level(lambda i, k: F.col(f"{k}_max")).alias("__hi"),
    ]
    cuts = materialize(rows.groupBy("__g").agg(*counted).withColumn("__need", F.least(F.lit(n).cast("long"), "__n")).select(*bracket).withColumn("__cut", F.lit(0)))
    # in the first pass every row is inside the bracket, as if the cutoff were part 0 of one part
    kept: list[DataFrame] = []
    active = rows.withColumn("__part", F.lit(0))
    while True:
        decided = _with_cuts(active, cuts, total)
        inside, whole = F.col("__part") == F.col("__cut"), F.col("__need") == F.col("__n")
        decided = decided.filter((F.col("__part") <= F.col("__cut"))).withColumn("__done", ~inside | whole)
        word = F.coalesce(*[F.when(F.col("__level") == i, F.col(k)) for i, k in enumerate(names)])
        part = F.least(F.floor((F.col("__hi") - word) * PARTS / (F.col("__hi") - F.col("__lo") + 1)), F.lit(PARTS - 1)).cast("int")
        now = materialize(decided.select("__g", "__row", *names, "__done", "__need", F.when(~F.col("__done"), part).alias("__part")))
        kept.append(now.filter("__done").select("__row.*"))
        active = now.filter("NOT __done")
        if active.isEmpty():
            break
        spread = active.groupBy("__g", "__part").agg(F.max("__need").alias("__need"), *counted)
        above = Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        spread = spread.withColumn("__cum", F.sum("__n").over(above))
        at = spread.filter((F.col("__cum") >= F.col("__need")) & (F.col("__cum") - F.col("__n") < F.col("__need")))
        last = cuts
        cuts = materialize(at.withColumn("__need", F.col("__need") - F.col("__cum") + F.col("__n")).select(*bracket, F.col("__part").alias("__cut")))
        discard(last)
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out


def _with_cuts(active: DataFrame, cuts: DataFrame, total: int) -> DataFrame:
    """``active`` with the cutoffs of its groups; those of hot groups, under HOT_SHARE of them, are broadcast."""
    least = max(HOT_ROWS, total // HOT_SHARE)
    rows = active.drop("__need")
    hot = cuts.filter(F.col("__n") >= least)
    if hot.isEmpty():
        return rows.join(cuts, "__g")
    there = rows.join(F.broadcast(hot), "__g", "left")
    fields = [c for c in cuts.columns if c != "__g"]
    cold = there.filter(F.col("__n").isNull()).drop(*fields).join(cuts.filter(F.col("__n") < least), "__g")
    return there.filter(F.col("__n").isNotNull()).unionByName(cold)
