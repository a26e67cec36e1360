"""Run manifests, report tables and the refresh log: gold tables, one row a run, a source, a listing or a refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrook.operators.metrics import run_outcome

# Labels of reports (fixed values).
LEVELS = {"junior": "Junior", "mid": "Mid", "senior": "Senior", "staff_lead": "Staff/Lead"}
SCOPES = {"global": "Global remote", "emea": "EMEA/regional", "regional": "Regional/restricted"}
GEO = {"eligible": "Nigeria-eligible", "verify": "Verify geo"}
BOARDS = {
    "himalayas": "Himalayas", "jobicy": "Jobicy", "remotive": "Remotive", "arbeitnow": "Arbeitnow", "remoteok": "Remote OK",
    "wwr": "We Work Remotely", "hn-hiring": "Hacker News Who is Hiring", "linkedin": "LinkedIn",
}
ATTRIBUTION = "Public job board listing"


def label(value: Column, labels: dict[str, str], other: Column) -> Column:
    """The label of a value; other where it has none."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[value], other)


def level_label(level: Column) -> Column:
    return label(level, LEVELS, F.lit("Unknown"))


def scope_label(scope: Column) -> Column:
    return label(scope, SCOPES, F.lit("Remote (verify scope)"))


def geo_label(geo: Column) -> Column:
    return F.when(geo.isNull(), "Unknown").otherwise(label(geo, GEO, F.lit("Likely excluded")))


def manifest_sources(stats: DataFrame, catalog: DataFrame, errors: DataFrame, attribution: str | None = None) -> DataFrame:
    """A row for each source of a run, by the catalog's ordinal: stats (source_id, adapter, status, skip_reason,
    attempted_at, completed_at, fetched, normalized, quarantined, matched) with cadence and attribution of catalog (source_id, ordinal,
    min_poll_hours, attribution) and the failure of errors (source_id, message, http_status, attempts, retryable).

    A source that the catalog has no more gets cadence 0 and the default attribution, and stands last.
    """
    known = catalog.select("source_id", "ordinal", "min_poll_hours", F.coalesce("attribution", F.lit(attribution)).alias("attribution"))
    rows = stats.join(known, "source_id", "left").join(errors, "source_id", "left")
    took = (F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("attempted_at").cast("timestamp"))) / 1000
    return rows.select(
        "source_id", "ordinal", "adapter", "status", "skip_reason", F.coalesce("attribution", F.lit(ATTRIBUTION)).alias("attribution"), F.coalesce("min_poll_hours", F.lit(0)).alias("min_poll_hours"),
        "attempted_at", "completed_at", F.greatest(F.lit(0), F.coalesce(took.cast("long"), F.lit(0))).alias("duration_ms"), "fetched", "normalized", "quarantined", "matched",
        "message", "http_status", "attempts", "retryable",
    ).orderBy(F.asc_nulls_last("ordinal"), "source_id")


def manifest_run(stats: DataFrame, run_id: str, started_at: Column, completed_at: Column, config: Column) -> DataFrame:
    """The row of a run: its outcome by source, how long it took, and the hash of its configuration."""
    took = F.greatest(F.lit(0), (F.unix_micros(completed_at.cast("timestamp")) - F.unix_micros(started_at.cast("timestamp"))) / 1000).cast("long")
    return run_outcome(stats).select(F.lit(run_id).alias("run_id"), took.alias("duration_ms"), F.sha2(config, 256).alias("config_sha256"), "*")


def source_table(catalog: DataFrame, stats: DataFrame) -> DataFrame:
    """A row for each source of the catalog, whether it ran or not: board, status in words, attribution."""
    status = (
        F.when(F.col("status").isNull(), "not run").when(F.col("status") == "skipped", F.concat(F.lit("skipped ("), F.coalesce("skip_reason", F.lit("cadence")), F.lit(")")))
        .when(F.col("status") == "failure", "failure").otherwise("success")
    )
    rows = catalog.join(stats.select("source_id", "status", "skip_reason"), "source_id", "left")
    board = F.concat(label(F.col("adapter"), BOARDS, F.col("adapter")), F.lit(" ("), "adapter", F.lit(")"))
    return rows.select("source_id", board.alias("board"), status.alias("status"), F.coalesce("attribution", F.lit(ATTRIBUTION)).alias("attribution"))


def listing_table(ranked: DataFrame, seen: DataFrame) -> DataFrame:
    """Ranked listings as a report shows them; seen (dedupe_key) says which aren't new. Expired ones carry a sign."""
    known = seen.select("dedupe_key").distinct().withColumn("known", F.lit(True))
    two = lambda c: F.format_string("%.2f", c)
    return ranked.join(known, "dedupe_key", "left").select(
        "posting_id", geo_label(F.col("geo")).alias("tier"), "tier_rank", F.when(F.col("known"), "Seen").otherwise("New").alias("status"), "company", "title", level_label(F.col("level")).alias("level"),
        scope_label(F.col("remote_scope")).alias("scope"), two("total").alias("score"), F.concat(two("freshness"), F.when(F.col("likely_expired"), " ⚠").otherwise("")).alias("fresh"), two("geo_confidence").alias("geo_conf"),
    )


def refresh_log(repos: DataFrame) -> DataFrame:
    """(run_at, repo, ok, commits_added, commits_updated, pulls_added, pulls_updated) -> a log row for each run: run_at,
    status, repos touched (how many: their names stay in the table of deltas) and the summary of the deltas."""
    sums = {"commits+": "commits_added", "commits~": "commits_updated", "prs+": "pulls_added", "prs~": "pulls_updated"}
    ok, failed = F.count_if(F.col("ok")), F.count_if(~F.col("ok"))
    status = F.when((ok == 0) & (failed > 0), "failed").when(failed > 0, "partial").otherwise("success")
    parts = [F.concat(F.lit(k), F.coalesce(F.sum(c), F.lit(0))) for k, c in sums.items()]
    summary = F.concat_ws(" ", *parts, F.when(failed > 0, F.concat(F.lit("failed="), failed)))
    return repos.groupBy("run_at").agg(status.alias("status"), F.count("*").alias("repos"), summary.alias("summary"))
