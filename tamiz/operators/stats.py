"""Run statistics and test results."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.operators.ordered import first_rows  # noqa: F401  (re-exported for reports)

_STATES = ("success", "fail", "partial")
NO_NAME = "(sin nombre)"


def _is(state: str):
    return F.lower("status") == state


def run_summary(hist: DataFrame) -> DataFrame:
    day = F.nullif(F.substring(F.col("timestamp").cast("string"), 1, 10), F.lit(""))
    out = hist.agg(F.count("*").alias("total"), *[F.count_if(_is(s)).alias(s) for s in _STATES],
                   F.coalesce(F.min(day), F.lit("")).alias("period_from"),
                   F.coalesce(F.max(day), F.lit("")).alias("period_to"))
    rate = F.when(F.col("total") > 0, F.round(F.col("success") * 100 / F.col("total"), 2)).otherwise(F.lit(0.0))
    return out.withColumn("success_pct", rate)


def by_solution(hist: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif(F.col("solution"), F.lit("")), F.lit(NO_NAME))
    return (hist.groupBy(name.alias("name")).agg(F.count("*").alias("total"), F.count_if(_is("success")).alias("success"))
            .orderBy(F.desc("total"), "name"))


def agent_usage(hist: DataFrame) -> DataFrame:
    return (hist.select(F.explode("agents").alias("name")).groupBy("name").agg(F.count("*").alias("count"))
            .orderBy(F.desc("count"), "name"))


def trend(hist: DataFrame, today: date, days: int = 7) -> DataFrame:
    """Runs per calendar day up to today; days without runs are zero."""
    first = today - timedelta(days=days - 1)
    calendar = hist.sparkSession.range(days).select(
        F.date_add(F.lit(first), F.col("id").cast("int")).cast("string").alias("date"))
    day = F.substring(F.col("timestamp").cast("string"), 1, 10)
    counts = hist.where((day >= str(first)) & (day <= str(today))).groupBy(day.alias("date")).agg(
        F.count("*").alias("total"), *[F.count_if(_is(s)).alias(s) for s in _STATES])
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total", *_STATES)]
    return calendar.join(counts, "date", "left").select("date", *zero).orderBy("date")


def history_list(hist: DataFrame, n: int | None = 10, solution: str | None = None, since: str | None = None) -> DataFrame:
    if solution is not None:
        hist = hist.where(F.col("solution") == solution)
    if since is not None:
        hist = hist.where(F.col("timestamp").cast("string") >= since)
    hist = hist.orderBy(F.desc("timestamp"), F.desc("id"))
    return hist if n is None else hist.limit(n)


def test_rollup(counters: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Totals over result files. Execution errors count as failures; skipped is the larger of the
    declared number and the gap between total and executed; nothing read gives NULL, never zero."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    declared = zero("notExecuted") + zero("inconclusive")
    skipped = F.greatest(declared, F.coalesce(F.col("total") - F.col("executed"), declared))
    return counters.groupBy(*keys).agg(
        F.sum(zero("total")).alias("total"), F.sum(zero("passed")).alias("passed"),
        F.sum(zero("failed") + zero("error") + zero("timeout") + zero("aborted")).alias("failed"),
        F.sum(skipped).alias("skipped"), F.nullif(F.count("*"), F.lit(0)).alias("files"))


def failures(results: DataFrame, shown: int | None = 600) -> DataFrame:
    """Failed tests with message and stack on one line each, ``shown`` characters at most, None for whole texts."""
    whole = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    flat = lambda c: whole(c) if shown is None else F.substring(whole(c), 1, shown)
    return results.where(F.col("outcome").isin("Failed", "Error", "Timeout", "Aborted")).select(
        "file", "testName", flat("message").alias("message"), flat("stack").alias("stack"))
