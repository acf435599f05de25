"""Running sums and neighbours of an ordered table, by a distributed prefix scan.

The rows of each group are cut at quantiles of their order into parts of about
PART_ROWS rows. A part is sorted and summed by one task. What a part must know
of those before it, their sums and the row beside it, is one row a part: a small
table whose own running sums are joined back. So a group of any size uses all
tasks, and no task sorts more than a part. Rows of equal order are in one part.

Null and NaN order last or first as Spark orders them, in the outermost part. An
empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_ROWS, MAX_PARTS = 100_000, 10_000
#: Cuts of all groups together that are broadcast at most.
BROADCAST_CUTS = 1_000_000


def below(ascending: Column, value: Column, most: int = 1 << 16) -> Column:
    """How many elements of an ascending array, which has at most so many, are smaller than value: by binary search."""

    def halve(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["low"] + at["high"], 1)
        less = F.get(ascending, middle) < value
        return F.struct(F.when(less, middle + 1).otherwise(at["low"]).alias("low"), F.when(less, at["high"]).otherwise(middle).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(max(most, 1).bit_length()))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(ascending).alias("high")), halve)["low"]


def parts(df: DataFrame, by: list[str], value: str, rows: int | None = None) -> DataFrame:
    """df with _part: which part of its group, in the order of value, a row is in."""
    from featlens.sources.files import stored  # which imports this module

    rows = rows or PART_ROWS
    sizes = df.groupBy(*by).agg(F.count("*").alias("n"))
    seen = sizes.agg(F.max("n").alias("most"), F.count("*").alias("groups"), F.sum(F.ceil(F.col("n") / rows)).alias("parts")).first()
    many = min(math.ceil((seen.most or 0) / rows), MAX_PARTS)
    if many < 2:
        return df.withColumn("_part", F.lit(0))
    cuts = df.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx(value, [i / many for i in range(1, many)], max(10_000, 10 * many)).alias("_cuts"))
    # every so many of the cuts, so that small groups are not cut finer than large ones
    step = F.greatest(F.ceil(F.lit(float(many * rows)) / F.col("_n")).cast("int"), F.lit(1))
    cuts = cuts.select(*by, F.array_distinct(F.filter("_cuts", lambda _, i: (i + 1) % step == 0)).alias("_cuts"))
    # quantiles depend on the order in which tasks' rows arrive: whoever reads these parts twice must find the same ones
    cuts = stored(cuts, "cuts")
    cuts = F.broadcast(cuts) if seen.groups + min(seen.parts, seen.groups * many) <= BROADCAST_CUTS else cuts
    return df.join(cuts, by).withColumn("_part", below(F.col("_cuts"), F.col(value), many)).drop("_cuts")


def running(dealt: DataFrame, by: list[str], value: str, sums: dict[str, str]) -> DataFrame:
    """parts()'s rows with, for each column of sums, under the name given there, its sum over the group's rows up to and with this value."""
    inside = Window.partitionBy(*by, "_part").orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    local = dealt.select("*", *[F.sum(c).over(inside).alias(name) for c, name in sums.items()])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    each = dealt.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums)])
    carries = each.select(*by, "_part", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_t{i}") for i in range(len(sums))])
    joined = local.join(F.broadcast(carries), [*by, "_part"])
    return joined.withColumns({name: F.col(name) + F.col(f"_t{i}") for i, name in enumerate(sums.values())}).drop(*[f"_t{i}" for i in range(len(sums))])


def beside(dealt: DataFrame, by: list[str], value: str, columns: list[str]) -> DataFrame:
    """parts()'s rows, of which no two of a group have the same value, with _before and _after: value and columns of the rows next to them in the order; null at the group's ends."""
    own = F.struct(value, *columns)
    inside = Window.partitionBy(*by, "_part").orderBy(value)
    local = dealt.select("*", F.lag(own).over(inside).alias("_lag"), F.lead(own).over(inside).alias("_lead"))
    order = Window.partitionBy(*by).orderBy("_part")
    ends = dealt.groupBy(*by, "_part").agg(F.min(own).alias("first"), F.max(own).alias("last"))
    ends = ends.select(*by, "_part", F.lag("last").over(order).alias("_left"), F.lead("first").over(order).alias("_right"))
    joined = local.join(F.broadcast(ends), [*by, "_part"])
    return joined.withColumns({"_before": F.coalesce("_lag", "_left"), "_after": F.coalesce("_lead", "_right")}).drop("_lag", "_lead", "_left", "_right")
