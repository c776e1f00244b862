"""Exact medians per group without bringing a group together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.sources.tables import materialize, small_side

# The sketch is off by at most n / ACCURACY ranks; the bracket is four times wider, and much wider
# in groups so small that single ranks matter.
ACCURACY = 10_000
MARGIN = 0.0004
SMALL_GROUP, SMALL_MARGIN = 50_000, 0.01

# So many values are ranked in one task; a longer range of values is narrowed first.
MAX_RANKED = 1_000_000
# A further round cuts a range at so many quantiles.
CUTS = 1000

# One line per group and column: a few dozen bytes each.
MAX_BROADCAST_GROUPS = 500_000


def group_medians(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """`group` and the exact median of every column (`median_<col>`), nulls ignored.

    A group may hold a third of all rows, so its values are never sorted as a whole. A quantile
    sketch, built per task and merged, brackets the middle ranks; values below the bracket are
    only counted, and the values inside it (below 0.1 % of a large group) are reduced to distinct
    values with counts before the ranking window sees them. Reads `df` twice.

    The counts tell whether the bracket held the middle ranks. Where it did not, or holds more than
    `MAX_RANKED` distinct values, further rounds narrow the range (`_values_at`).
    """
    pairs = F.array(
        *(
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v"))
            for c in cols
        )
    )
    keys = [group, "metric"]
    # A null group is no group, and a join on it would lose it anyway.
    values = (
        df.where(F.col(group).isNotNull())
        .select(group, F.inline_outer(pairs))
        .where(F.col("v").isNotNull())
    )

    marks = [0.5 - SMALL_MARGIN, 0.5 - MARGIN, 0.5 + MARGIN, 0.5 + SMALL_MARGIN]
    sketch = F.percentile_approx("v", marks, ACCURACY)
    sketches = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), sketch.alias("b"))
    wide, narrow = F.array(F.col("b")[0], F.col("b")[3]), F.array(F.col("b")[1], F.col("b")[2])
    sketches = sketches.withColumn("b", F.when(F.col("n") < SMALL_GROUP, wide).otherwise(narrow))
    sketches = small_side(sketches, "brackets", MAX_BROADCAST_GROUPS)
    located = values.join(sketches, keys).where(F.col("v") <= F.col("b")[1])
    below = F.col("v") < F.col("b")[0]
    counted = (
        located.select(*keys, "n", F.when(~below, F.col("v")).alias("v"))
        .groupBy(*keys, "n", "v")
        .agg(F.count(F.lit(1)).alias("times"))
    )

    counted = materialize(counted, "median-counts")
    low, high = F.expr("(n + 1) div 2"), F.expr("n div 2 + 1")
    is_below = F.col("v").isNull()
    state = counted.groupBy(*keys, "n").agg(
        F.coalesce(F.sum(F.when(is_below, F.col("times"))), F.lit(0)).alias("below"),
        F.sum("times").alias("upto"),
        F.count("v").alias("lines"),
    )
    held = (low > F.col("below")) & (high <= F.col("upto")) & (F.col("lines") <= MAX_RANKED)
    missed = state.where(~held).select(*keys, "n", F.explode(F.array_distinct(F.array(low, high))).alias("rank"))
    missed = materialize(missed, "median-missed")

    # Below the bracket there is one line per group, with a null value, and it ranks first.
    if not missed.isEmpty():
        counted = counted.join(missed.select(*keys).distinct(), keys, "left_anti")
    middle = _ranked(counted, keys).where((F.col("first") <= high) & (F.col("upto") >= low))
    middle = middle.select(*keys, "v")
    if not missed.isEmpty():
        middle = middle.unionByName(_values_at(values, keys, missed))
    # min and max are the two middle values.
    medians = middle.groupBy(*keys).agg(((F.min("v") + F.max("v")) / 2).alias("median"))
    return medians.groupBy(group).agg(
        *(F.max(F.when(F.col("metric") == c, F.col("median"))).alias(f"median_{c}") for c in cols)
    )


def _ranked(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first and the last rank of every counted value (`v`, `times`) of a key."""
    ordered = Window.partitionBy(*keys).orderBy(F.col("v").asc_nulls_first())
    upto_here = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("upto", F.sum("times").over(upto_here))
    return ranked.withColumn("first", F.col("upto") - F.col("times") + 1)


def _values_at(values: DataFrame, keys: Sequence[str], wanted: DataFrame) -> DataFrame:
    """The value at each `rank` of `wanted` (keys, n, rank): exact, whatever a sketch says.

    Every wanted rank has an open range of values that holds it, at first everything. A round puts
    two cuts around the rank, by a sketch of the range, and counts the values beside them. The counts say
    which part holds the rank, or that a cut is the answer. A cut is a value of the range, so a poor
    sketch costs rounds and never the result; a usual one leaves a few thousandths of the range.
    """
    none = F.lit(None).cast("double")
    open_range = wanted.withColumns({"at": F.col("rank"), "after": none, "before": none, "found": none})
    targets = materialize(open_range, "median-ranges")
    # Long ranges: each round reads the values of their groups twice.
    wide = F.col("found").isNull() & (F.col("n") > MAX_RANKED)
    while not targets.where(wide).isEmpty():
        narrowed = _narrowed(values, keys, targets.where(wide))
        targets = materialize(targets.where(~wide).unionByName(narrowed), "median-ranges")

    rest = small_side(targets.where(F.col("found").isNull()), "median-rest", MAX_BROADCAST_GROUPS)
    each = [*keys, "rank", "at"]
    counted = _inside(values, keys, rest).groupBy(*each, "v").agg(F.count(F.lit(1)).alias("times"))
    ranked = _ranked(counted, each).where(F.col("at").between(F.col("first"), F.col("upto")))
    answered = targets.where(F.col("found").isNotNull()).select(*keys, F.col("found").alias("v"))
    return ranked.select(*keys, "v").unionByName(answered)


def _inside(values: DataFrame, keys: Sequence[str], targets: DataFrame) -> DataFrame:
    """The values within the range of each target of their key."""
    above = F.col("after").isNull() | (F.col("v") > F.col("after"))
    below = F.col("before").isNull() | (F.col("v") < F.col("before"))
    return values.join(targets, list(keys)).where(above & below)


def _narrowed(values: DataFrame, keys: Sequence[str], targets: DataFrame) -> DataFrame:
    """The targets after one round: a shorter range, or the value found."""
    columns = targets.columns
    targets = small_side(targets, "median-wide", MAX_BROADCAST_GROUPS)
    sketch = F.percentile_approx("v", [i / CUTS for i in range(CUTS + 1)], ACCURACY)
    cuts = _inside(values, keys, targets).groupBy(*columns).agg(sketch.alias("cuts"))
    place = F.col("at") * CUTS / F.col("n")
    left = F.get("cuts", F.greatest(F.floor(place) - 1, F.lit(0)).cast("int"))
    right = F.get("cuts", F.least(F.ceil(place) + 1, F.lit(CUTS)).cast("int"))
    cut = cuts.select(*columns, left.alias("left"), right.alias("right"))
    cut = small_side(cut, "median-cuts", MAX_BROADCAST_GROUPS)

    counts = _inside(values, keys, cut).groupBy(*cut.columns).agg(
        F.count_if(F.col("v") < F.col("left")).alias("n1"),
        F.count_if(F.col("v") <= F.col("left")).alias("n2"),
        F.count_if(F.col("v") < F.col("right")).alias("n3"),
        F.count_if(F.col("v") <= F.col("right")).alias("n4"),
    )

    def part(after, before, n, skipped, found=F.lit(None).cast("double")):
        return F.struct(
            after.alias("after"), before.alias("before"), n.alias("n"),
            (F.col("at") - skipped).alias("at"), found.alias("found"),
        )

    at, after, before, n = (F.col(c) for c in ("at", "after", "before", "n"))
    lower, upper, n1, n2, n3, n4 = (F.col(c) for c in ("left", "right", "n1", "n2", "n3", "n4"))
    step = (
        F.when(at <= n1, part(after, lower, n1, F.lit(0)))
        .when(at <= n2, part(after, before, n, F.lit(0), lower))
        .when(at <= n3, part(lower, upper, n3 - n2, n2))
        .when(at <= n4, part(after, before, n, F.lit(0), upper))
        .otherwise(part(upper, before, n - n4, n4))
    )
    moved = counts.withColumn("step", step)
    return moved.select(*keys, "rank", *(f"step.{c}" for c in ("after", "before", "n", "at", "found"))).select(columns)
