"""Run metrics: what sources gave, what policy and lifecycle took, how a run ended. Single aggregates, 0-filled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrook.functions.text import round2


def matches_by_source(entities: DataFrame, sources: DataFrame) -> DataFrame:
    """Each entity counts once for each of its sources; sources without any have 0."""
    n = entities.select(F.explode(F.array_distinct("source_ids")).alias("source_id")).groupBy("source_id").agg(F.count("*").alias("n"))
    return sources.join(n, "source_id", "left").select("source_id", F.coalesce("n", F.lit(0)).alias("matched"))


def effectiveness(fetched: DataFrame, rows: DataFrame) -> DataFrame:
    """fetched (source_id, fetched), rows (source_ids, status, disposition, likely_expired) -> yield and counts a source."""
    one = rows.withColumn("source_id", F.explode(F.array_distinct("source_ids")))
    counts = one.groupBy("source_id").agg(
        F.count("*").alias("matched"), F.count_if(F.expr("status = 'new' and disposition is null")).alias("new"), F.count_if(F.expr("status = 'seen' and disposition is null")).alias("seen"),
        *[F.count_if(F.coalesce(F.col("disposition") == d, F.lit(False))).alias(d) for d in ("applied", "dismissed", "expired")],
        F.count_if("likely_expired").alias("likely_expired"),
    )
    names = counts.columns[1:]
    out = fetched.join(counts, "source_id", "left").select("source_id", "fetched", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    return out.withColumn("yield", F.coalesce(round2(F.try_divide("matched", "fetched")), F.lit(0.0)))


def false_positive_proxy(rows: DataFrame) -> DataFrame:
    return rows.agg(round2(F.try_divide(F.count_if(F.col("disposition") == "dismissed"), F.count("*"))).alias("proxy"))


def count_by(rows: DataFrame, column: str) -> DataFrame:
    """Rows by value, nulls aside: these go behind the counting, as a filter on a derived column would work it out twice."""
    return rows.groupBy(column).agg(F.count(column).alias("n")).where("n > 0")


def quarantine_totals(rows: DataFrame) -> DataFrame:
    """By reason, by category, and all (both null), in one pass."""
    return rows.groupingSets([["reason"], ["category"], []], "reason", "category").agg(F.count("*").alias("n"))


def run_outcome(stats: DataFrame) -> DataFrame:
    """(source_id, status of success, failure or skipped) -> counts and the run's status."""
    out = stats.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("success", "failure", "skipped")], F.count("*").alias("sources"))
    status = (
        F.when((F.col("sources") > 0) & (F.col("skipped") == F.col("sources")), "all_cadence_skipped")
        .when((F.col("failure") > 0) & (F.col("success") == 0), "total_outage")
        .when(F.col("failure") > 0, "partial")
        .otherwise("success")
    )
    return out.select((F.col("sources") - F.col("skipped")).alias("attempted"), "skipped", F.col("success").alias("succeeded"), F.col("failure").alias("failed"), status.alias("status"))


def funnel(rows: DataFrame) -> DataFrame:
    """(metric, n) of all rows with reason, geo, disposition, status and likely_expired, from one aggregate."""
    on = "reason is null"
    live = on + " and disposition is null"
    names = {
        "policy_matched": on, "excluded": "reason is not null", "active": live, "suppressed": on + " and disposition is not null", "new": live + " and status = 'new'",
        "seen": live + " and status = 'seen'", "eligible": live + " and geo = 'eligible'", "verify": live + " and geo = 'verify'", "likely_expired": live + " and likely_expired",
    }
    one = rows.agg(*[F.count_if(F.expr(e)).alias(k) for k, e in names.items()])
    return one.unpivot([], list(names), "metric", "n")
