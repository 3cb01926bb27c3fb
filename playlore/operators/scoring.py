"""Scoring of produced specs against expected ones, and comparison of two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def field_scores(produced: DataFrame, expected: DataFrame) -> DataFrame:
    """(case, field, ok): fields ``(case, field, value)`` against ``(case, field, kind, value, low, high, among)``.

    kind is exact, between, in or list; a list matches in any order.  A case that is expected to
    be rejected (``understood`` false) is scored by that alone: its other fields mean nothing.
    """
    refused = (F.col("field") == "understood") & (F.lower("value") == "false")
    rejected = expected.filter(refused).select("case").distinct()
    expected = expected.join(rejected, "case", "left_anti").unionByName(expected.filter(refused))
    p = produced.select("case", "field", F.col("value").alias("got"))
    joined = expected.join(p, ["case", "field"], "left")
    items = lambda c: F.array_sort(F.split(F.lower(c), r"\s*,\s*"))
    number = F.expr("try_cast(got AS double)")
    ok = (
        F.when(F.col("kind") == "between", number.between(F.col("low"), F.col("high")))
        .when(F.col("kind") == "in", F.array_contains("among", F.col("got")))
        .when(F.col("kind") == "list", items("got") == items("value"))
        .otherwise(F.col("got").eqNullSafe(F.col("value")))
    )
    return joined.select("case", "field", F.coalesce(ok, F.lit(False)).alias("ok"))


def summary(scores: DataFrame) -> DataFrame:
    by_case = scores.groupBy("case").agg(F.bool_and("ok").alias("exact"))
    fields = scores.agg(F.avg(F.col("ok").cast("double")).alias("field_accuracy"))
    return by_case.agg(F.count("*").alias("cases"), F.count_if("exact").alias("exact")).join(F.broadcast(fields))


def run_totals(runs: DataFrame) -> DataFrame:
    """Of all answers ``runs(case, error, latency_ms, input_tokens, output_tokens)``: errors, mean latency, tokens."""
    return runs.agg(
        F.count("*").alias("cases"),
        F.count("error").alias("errors"),
        F.coalesce(F.round(F.avg("latency_ms")), F.lit(0.0)).cast("long").alias("avg_latency_ms"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    )


def pass_rate(scores: DataFrame, by: str = "field") -> DataFrame:
    return scores.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(F.col("ok").cast("double")), 4).alias("rate"))


def pass_rate_by_tag(scores: DataFrame, tags: DataFrame) -> DataFrame:
    """``tags(case, tags array)``: share of exact cases of each tag."""
    exact = scores.groupBy("case").agg(F.bool_and("ok").alias("ok"))
    return pass_rate(exact.join(tags.select("case", F.explode("tags").alias("tag")), "case"), "tag")


def run_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(case, change) between two runs ``(case, ok)``: regression, fixed, gone, new."""
    joined = before.select("case", F.col("ok").alias("a")).join(after.select("case", F.col("ok").alias("b")), "case", "full")
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("a") & ~F.col("b"), "regression").when(~F.col("a") & F.col("b"), "fixed")
    return joined.select("case", change.alias("change")).filter("change IS NOT NULL")
