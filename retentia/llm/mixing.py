"""Mixing sources to target weights (operator 8).

Each row gets a hash-random key.  The rows of a source stand in the order of their keys; cutting the key range
into equal buckets sorts them by range, and the sum of sizes before a row is the sum of the buckets before its own
plus a running sum inside it.  A source's target is cut at its exact budget: whole epochs of all its rows, then the
rows in order until the rest of the budget is used up, the row at the cut by the part that fits.

Targets: ``share`` of all sizes is dealt out by weight; no source gets more than ``max_epochs`` times its size, and
what it cannot take goes to the others by weight until none is above.  That is a water level: sources in order of
size over weight are full up to the level, the others hold their weight times the level.

Only DataFrame functions; nothing is collected.  Bucket sums are one row a source and bucket, and the sources
themselves one row each.

Defined cases: a null text has size 0, and a row of size 0 takes 0; a null source is a source of its own, after all
others; rows without a draw stand after all others of their source, in the order of size and ``key``; an empty table
gives an empty result; equal rows have equal keys and stand next to each other, so that
which of them comes first changes nothing; other columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentia.llm.common import fresh

#: The weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: Rows that a bucket of the key range is meant to hold, and the largest number of buckets of a source.
BUCKET_ROWS, MAX_BUCKETS = 2_000, 1 << 24
#: Key of the rows without a draw, above all others.
NO_DRAW = 1 << 60


def word_count(text: str | Column) -> Column:
    """Runs of anything but space, tab, line feed, vertical tab, form feed and carriage return; 0 for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = 1.5, max_epochs: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``_source``, ``_n``, ``_total`` of each source, with its ``_target``."""
    order = Window.orderBy(F.col("_source").asc_nulls_last())  # one row a source
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    every = Window.partitionBy()
    by_fill = Window.orderBy("_fill", F.col("_source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("_total") * F.lit(float(max_epochs))
    ranked = (sources.withColumn("_weight", weight)
              .withColumn("_fill", cap / F.col("_weight"))
              .withColumn("_rank", F.row_number().over(by_fill))
              .withColumn("_all", F.sum("_total").over(every) * F.lit(share))
              .withColumn("_w_left", F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
              .withColumn("_left", F.col("_all") - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
              # the level if all sources before this one are full and this one is not
              .withColumn("_level", F.col("_left") / F.col("_w_left"))
              .withColumn("_open", F.col("_fill") >= F.col("_level")))
    level = F.min(F.when(F.col("_open"), F.struct("_rank", "_level"))).over(every)["_level"]
    target = F.least(cap, F.col("_weight") * F.coalesce(level, F.lit(float("inf"))))
    return ranked.withColumn("_target", target).select("_source", "_n", "_total", "_target")


def mix(df: DataFrame, source: str = "source", key: list[str] | None = None, size: str = "size", share: float = 1.5,
        max_epochs: int = 2, weights: tuple[int, ...] = WEIGHTS, draw: Column | None = None) -> DataFrame:
    """``df`` with ``source_size``, ``target`` (both the source's) and ``taken``.

    ``draw`` gives the random order as a number from 0 up to 2^60, by default a hash of the columns ``key`` (all
    columns if none are named); rows that draw the same stand in the order of ``key`` and size, those that draw null
    after all others in the order of size and ``key``.
    """
    if draw is None:
        draw = F.shiftrightunsigned(F.xxhash64(*(key or df.columns)), 4)
    # the given columns travel as one, so that none of their names can clash
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(source).alias("_source"), F.coalesce(draw, F.lit(NO_DRAW)).alias("_key"),
                      F.col(size).alias("_size"), (F.struct(*key) if key else F.lit(0)).alias("_order"))
    sources = keyed.groupBy("_source").agg(F.count("*").alias("_n"), F.sum("_size").alias("_total"))
    plan = (targets(sources, share, max_epochs, weights)
            .withColumn("_buckets", F.least(F.lit(MAX_BUCKETS), F.ceil(F.col("_n") / BUCKET_ROWS)).cast("long")))
    dealt = (keyed.join(plan.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s"))
    # the key's 32 high bits, cut into as many equal ranges as the source has buckets
    high = F.shiftright(F.col("_key"), 28)
    drawn = F.shiftrightunsigned(high * F.col("_buckets"), 32)
    # rows without a draw: a bucket for each size, after all others
    dealt = dealt.withColumn("_bucket", F.when(F.col("_key") < NO_DRAW, drawn).otherwise(F.col("_buckets") + F.col("_size")))
    sums = dealt.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_sum"))
    over = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = (sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(over), F.lit(0)))
            .select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), "_offset"))
    inside = (Window.partitionBy("_source", "_bucket").orderBy("_key", "_order", "_size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (dealt.withColumn("_before", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
              .join(sums, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
              .withColumn("_before", F.col("_before") + F.col("_offset")))
    epochs = F.when(F.col("_total") > 0, F.floor(F.col("_target") / F.col("_total"))).otherwise(0).cast("long")
    budget = F.floor(F.col("_target")).cast("long") - epochs * F.col("_total")
    rest = F.greatest(F.lit(0), F.least(F.col("_size"), budget - F.col("_before")))
    added = {"source_size": F.col("_total"), "target": F.col("_target"), "taken": (epochs * F.col("_size") + rest).cast("long")}
    return placed.select("_row.*", *[c.alias(fresh(name, df.columns)) for name, c in added.items()])
