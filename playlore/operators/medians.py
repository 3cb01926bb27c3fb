"""Exact medians of groups of any size: ranges are counted and narrowed until few values are left.

A median by aggregation holds all values of a group in one task.  Here a large group's values are
counted in ``CELLS`` ranges of equal width, the range that holds the middle becomes the next one to
be counted, from its least to its greatest value, and so on for all groups and columns at once.
When few enough values are left in a range, or all of them are equal, the middle is picked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playlore.functions.shared import checkpointed

#: Ranges that are counted at a time, and values that one task may hold.
CELLS, HELD = 1024, 100_000


def medians(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, columns..., n): the median of each column in each group; null where it has no value.

    ``n`` counts the rows of a group.  Nulls in a column don't count for it.
    """
    size = rows.groupBy(by).agg(F.count("*").alias("n"))
    values = rows.select(F.col(by).alias("g"), F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in columns])).alias("v")).select("g", "v.c", "v.x").filter("x IS NOT NULL")
    whole = values.groupBy("g", "c").agg(F.count("*").alias("count"), F.min("x").alias("low"), F.max("x").alias("high"))
    # The one or two places, from 0, whose values' mean is the median.
    asked = whole.select("g", "c", "count", "low", "high", F.explode(F.array_distinct(F.array(F.floor((F.col("count") - 1) / 2), F.floor(F.col("count") / 2)))).alias("place"))
    state, found = checkpointed(asked.withColumn("below", F.lit(0).cast("long"))), None
    while True:
        done = (F.col("count") <= HELD) | (F.col("low") == F.col("high"))
        picked = _picked(values, state.filter(done))
        found = picked if found is None else found.unionByName(picked)
        left = state.filter(~done)
        if left.isEmpty():
            break
        state = checkpointed(_narrowed(values, left))
    middle = found.groupBy("g", "c").agg(F.avg("x").alias("x"))
    wide = middle.groupBy("g").agg(*[F.max(F.when(F.col("c") == c, F.col("x"))).alias(c) for c in columns])
    return size.join(wide.withColumnRenamed("g", by), by, "left").select(by, *columns, "n")


def _inside(values: DataFrame, state: DataFrame) -> DataFrame:
    """The values in the ranges that are looked at, for each place that is asked for."""
    return values.join(state, ["g", "c"]).filter((F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high")))


def _narrowed(values: DataFrame, state: DataFrame) -> DataFrame:
    """The range within each range that holds the place."""
    cell = F.least(F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * CELLS), F.lit(CELLS - 1))
    by = ["g", "c", "place", "below"]
    counted = _inside(values, state).groupBy(*by, cell.alias("cell")).agg(F.count("*").alias("count"), F.min("x").alias("low"), F.max("x").alias("high"))
    before = F.coalesce(F.sum("count").over(Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = counted.withColumn("before", F.col("below") + before)
    held = told.filter((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("count")))
    return held.select("g", "c", "count", "low", "high", "place", F.col("before").alias("below"))


def _picked(values: DataFrame, state: DataFrame) -> DataFrame:
    """(g, c, x): the values at the places of ranges that hold few values, or one only."""
    same = state.filter("low = high").select("g", "c", F.col("low").alias("x"))
    few = _inside(values, state.filter("low < high")).groupBy("g", "c", "place", "below").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return same.unionByName(few.select("g", "c", F.get("xs", (F.col("place") - F.col("below")).cast("int")).alias("x")))
