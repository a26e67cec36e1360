"""Keyed state: ordered alias lookups, seen and lifecycle tables, poll cadence, version upgrades. Upserts give new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DISPOSITIONS = ("applied", "dismissed", "expired")


def dealt(rows: DataFrame) -> DataFrame:
    """rows for a join that deals both sides by key. Rows and states both grow, and a compressed file of a few MB holds a
    million keys: taken for small and broadcast, they would stand in the driver's memory as a whole."""
    return rows.hint("merge")


def alias_lookup(rows: DataFrame, state: DataFrame, id_column: str = "posting_id") -> DataFrame:
    """rows (id, aliases), state (key, ...) -> (id, pos, hit): of the aliases that the state has, the first one's row.

    Explodes to (id, key) and joins by key; the hit is a minimum by position, so it combines before the shuffle.
    """
    keys = rows.select(id_column, F.posexplode("aliases").alias("pos", "key"))
    found = keys.join(dealt(state), "key").withColumn("hit", F.struct(*state.columns))
    return found.groupBy(id_column).agg(F.min("pos").alias("pos"), F.min_by("hit", "pos").alias("hit"))


def split_seen(rows: DataFrame, seen: DataFrame, profile: str) -> DataFrame:
    """Adds status: `seen` if any alias is in the profile's seen state, else `new`; and first_seen_at."""
    hits = alias_lookup(rows, seen.where(F.col("profile") == profile).select("key", "first_seen_at"))
    out = rows.join(dealt(hits), "posting_id", "left")
    return out.withColumn("status", F.when(F.col("hit").isNull(), "new").otherwise("seen")).withColumn("first_seen_at", F.col("hit.first_seen_at")).drop("pos", "hit")


def disposition_of(rows: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Adds disposition: applied before dismissed before expired, whichever alias has it; null if none has."""
    rank = F.array_position(F.array(*map(F.lit, DISPOSITIONS)), F.col("disposition"))
    hits = rows.select("posting_id", F.explode("aliases").alias("key")).join(dealt(lifecycle), "key").groupBy("posting_id").agg(F.min(rank).cast("int").alias("rank"))
    return rows.join(dealt(hits), "posting_id", "left").withColumn("disposition", F.try_element_at(F.array(*map(F.lit, DISPOSITIONS)), F.col("rank"))).drop("rank")


def upsert_seen(state: DataFrame, rows: DataFrame, profile: str, observed: Column) -> DataFrame:
    """The next seen state: a known key keeps its first sight, the legacy key that a row's own key replaces goes, other
    profiles stay as they are. rows: dedupe_key, legacy_key, aliases, company, title, url."""
    own, rest = state.where(F.col("profile") == profile), state.where(F.col("profile") != profile)
    hits = alias_lookup(rows, own.select("key", "first_seen_at"))
    fresh = rows.join(dealt(hits), "posting_id", "left").groupBy(F.col("dedupe_key").alias("key")).agg(
        F.max_by("company", "posting_id").alias("company"), F.max_by("title", "posting_id").alias("title"), F.max_by("url", "posting_id").alias("url"),
        F.min("hit.first_seen_at").alias("known"), F.collect_set(F.when(F.col("legacy_key") != F.col("dedupe_key"), F.col("legacy_key"))).alias("old"),
    )
    gone = fresh.select(F.explode("old").alias("key")).distinct()
    kept = own.join(dealt(fresh.select("key")), "key", "left_anti").join(dealt(gone), "key", "left_anti")
    new = fresh.select(F.lit(profile).alias("profile"), "key", "company", "title", "url", F.coalesce("known", observed).alias("first_seen_at"), observed.alias("last_seen_at"))
    return rest.unionByName(kept).unionByName(new)


def transition(state: DataFrame, entries: DataFrame) -> DataFrame:
    """The next lifecycle state. entries: key, legacy_key, legacy_url_key, disposition, company, title, url, at, source_report.

    An entry leaves the other dispositions under any of its keys; repeated in its own, it keeps the earliest time and
    the first key. Idempotent.
    """
    names = entries.select("disposition", F.col("key").alias("own"), F.explode(F.array_distinct(F.array_compact(F.array("key", "legacy_key", "legacy_url_key")))).alias("key"))
    moved = names.select("key", F.col("disposition").alias("to")).groupBy("key").agg(F.collect_set("to").alias("to"))
    prior = state.join(dealt(names.groupBy("disposition", "key").agg(F.min("own").alias("own"))), ["disposition", "key"])
    known = prior.groupBy("disposition", "own").agg(F.min("at").alias("known_at"), F.min_by("key", F.struct("at", "key")).alias("known_key"))
    stay = state.join(dealt(moved), "key", "left").where("to is null").drop("to")
    last = entries.groupBy("disposition", F.col("key").alias("own")).agg(
        *[F.max_by(c, F.struct("at", c)).alias(c) for c in ("company", "title", "url", "source_report")], F.min("at").alias("at")
    )
    new = last.join(dealt(known), ["disposition", "own"], "left").select(
        "disposition", F.coalesce("known_key", "own").alias("key"), "company", "title", "url", F.coalesce("known_at", "at").alias("at"), "source_report"
    )
    return stay.select(*new.columns).unionByName(new)


def merge_applied(lines: DataFrame) -> DataFrame:
    """Ticked lines of all reports (path, line_no, key, company, title, url) -> one row a key: its first line in the order of
    reports and lines, and in how many reports it stands."""
    return lines.groupBy("key").agg(
        F.min(F.struct("path", "line_no", "company", "title", "url")).alias("first"), F.count_distinct("path").alias("reports")
    ).select("key", "first.*", "reports")


def upsert_poll(state: DataFrame, updates: DataFrame) -> DataFrame:
    """updates: profile, source_id, ordinal, at, ok, error. The last one of a source wins; success clears the error."""
    last = updates.groupBy("profile", "source_id").agg(F.max_by(F.struct("at", "ok", "error"), "ordinal").alias("u"))
    out = state.join(last, ["profile", "source_id"], "full")
    return out.select(
        "profile", "source_id",
        F.coalesce("u.at", "last_attempt_at").alias("last_attempt_at"),
        F.when(F.col("u.ok"), F.col("u.at")).otherwise(F.col("last_success_at")).alias("last_success_at"),
        F.when(~F.col("u.ok"), F.col("u.at")).otherwise(F.col("last_failure_at")).alias("last_failure_at"),
        F.when(F.col("u").isNull(), F.col("last_error")).when(F.col("u.ok"), F.lit(None)).otherwise(F.col("u.error")).alias("last_error"),
    )


def cadence(state: DataFrame, now: Column, min_hours: Column, force: bool = False) -> DataFrame:
    """Adds skip, next_eligible_at and hours_remaining (rounded up): the anchor is the latest of the three times."""
    out = state.withColumn("anchor", F.greatest("last_attempt_at", "last_success_at", "last_failure_at")).withColumn("h", min_hours)
    due = F.col("anchor") + F.make_interval(hours=F.col("h").cast("int"))
    left = (F.unix_micros(due.cast("timestamp")) - F.unix_micros(now)) / 3.6e9
    skip = F.lit(not force) & (F.col("h") > 0) & F.col("anchor").isNotNull() & (left > 0)
    return out.withColumns({"skip": skip, "next_eligible_at": F.when(skip, due), "hours_remaining": F.when(skip, F.ceil(left)).otherwise(0)}).drop("anchor", "h")


def upgrade(states: DataFrame, steps: dict[int, dict[str, Column]], current: int) -> DataFrame:
    """Rows with schema_version brought to the current version: each step adds or replaces columns of older rows.

    An unknown version is an error when its row is read.
    """
    known = F.col("schema_version").isin(*steps, current)
    out = states.withColumn("schema_version", F.when(known, F.col("schema_version")).otherwise(F.raise_error(F.lit("unknown state version")).cast("int")))
    for version, columns in sorted(steps.items()):
        old = F.col("schema_version") <= version
        out = out.withColumns({c: F.when(old, e).otherwise(F.col(c)) if c in out.columns else F.when(old, e) for c, e in columns.items()})
    return out.withColumn("schema_version", F.lit(current))


def partition_active(matched: DataFrame, seen: DataFrame, lifecycle: DataFrame, profile: str) -> DataFrame:
    """matched with disposition, status and active; suppressed rows still count as seen."""
    out = split_seen(disposition_of(matched, lifecycle), seen, profile)
    return out.withColumn("active", F.col("disposition").isNull())


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Exact dedupe: of equal keys the first in order. A window limit, so each task sends one row a key."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth")
