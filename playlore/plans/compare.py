"""One spec over several listeners, side by side."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlore.schema import ZONE

from . import chart as C


def kind(spec: C.ChartSpec) -> str:
    """How listeners stand beside each other: numbers, recent, stacked, lines, or ranked."""
    if spec.answer in ("number", "first_played", "last_played", "top"):
        return "numbers"
    if spec.answer == "recent":
        return "recent"
    if spec.series != "none":
        return "stacked"
    return "lines" if spec.effective().dimension in C.ORDERED else "ranked"


def compare(plays: DataFrame, spec: C.ChartSpec, listeners: list[int], genres: DataFrame | None = None, as_of: dt.datetime | None = None, zone: str = ZONE) -> DataFrame:
    """The spec's answer for the named listeners; lines are put on the union of their labels.

    Gaps are 0 for sums and counts, null for rates, and the last value for running totals.
    """
    theirs = plays.filter(F.col("user_id").isin(*listeners))
    made = C.chart(theirs, spec, genres, as_of, zone)
    if kind(spec) != "lines":
        return made.withColumn("kind", F.lit(kind(spec)))
    fill = "carry" if spec.cumulative else "none" if spec.metric == "skip_rate" else "zero"
    return C.aligned(made.select("user_id", "label", "value"), fill).withColumn("kind", F.lit("lines"))
