"""Entity resolution: listings that share a link signal, transitively, are one entity; and how its fields survive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrook.functions import text as X
from tallyrook.functions.urls import url_quality
from tallyrook.operators.components import connected_components
from tallyrook.operators.listings import legacy_key, level, provider_key, remote_scope, url_key
from tallyrook.operators.state import dealt


def link_signals(listings: DataFrame) -> DataFrame:
    """Listings with url_key and provider_key -> (posting_id, signal), each once."""
    signals = F.array_distinct(F.array_compact(F.array("provider_key", "url_key")))
    return listings.select("posting_id", F.explode(signals).alias("signal"))


def cautious_groups(listings: DataFrame) -> DataFrame:
    """(posting_id, signal) for firm-and-title groups of two sources or more that have every source exactly once.

    Groups without any name are left out: unrelated listings in other scripts would meet there. Counts combine before
    the shuffle, so a hot title is one row a task.
    """
    per_source = listings.where("legacy_key <> '::'").groupBy("legacy_key", "source_id").agg(F.count("*").alias("n"))
    sure = per_source.groupBy("legacy_key").agg(F.count("*").alias("sources"), F.max("n").alias("most")).where("sources >= 2 and most = 1")
    return listings.join(sure.select("legacy_key"), "legacy_key").select("posting_id", F.concat(F.lit("name::"), "legacy_key").alias("signal"))


def entities(listings: DataFrame) -> DataFrame:
    """Listings with identity -> (posting_id, entity_id): the least posting_id of each entity.

    A signal of n listings gives n edges to its least listing, not n * n pairs.
    """
    signals = link_signals(listings).union(cautious_groups(listings))
    least = signals.groupBy("signal").agg(F.min("posting_id").alias("dst"), F.max("posting_id").alias("last")).where("dst < last")
    edges = signals.join(least, "signal").select(F.col("posting_id").alias("src"), "dst")
    found = connected_components(edges)
    return listings.select("posting_id").join(found.withColumnRenamed("node", "posting_id"), "posting_id", "left").select(
        "posting_id", F.coalesce("component", "posting_id").alias("entity_id")
    )


def _richest(column: str):
    """The longest text that isn't empty, the least of equals."""
    value = X.trimmed(F.col(column))
    return F.coalesce(F.min(F.when(value != "", F.struct(-F.length(value), value)))["col2"], F.lit("")).alias(column)


def stable_key() -> Column:
    """What listings of one entity are ordered by before they merge: URL, where it was found, and the texts, as bytes."""
    found = F.concat_ws("|", "source_id", "adapter", F.coalesce("source_job_id", F.lit("")), "url")
    return F.concat_ws("|", F.coalesce("url_key", "url"), found, *[X.trimmed(F.col(c)) for c in ("company", "title", "description")])


TEXTS = ("company", "title", "location", "description")


def merged(listings: DataFrame, members: DataFrame, texts: tuple[str, ...] = TEXTS) -> DataFrame:
    """One row an entity: survivors of each field, and scope, level and identity made again from them.

    texts: which of TEXTS are wanted; identity needs company and title, scope and level come with all four.
    Of the records that it comes from only the first one is kept here; all of them, and all aliases, are keyed tables
    (operators.provenance), so an entity's row doesn't grow with its listings. An entity of one listing has nothing to
    choose from: its row is that listing's, and only listings that share an entity are dealt by it and compared.
    """
    shared = listings.select("posting_id").join(members, "posting_id").groupBy("entity_id").agg(F.count("*").alias("n")).where("n > 1").select("entity_id", F.lit(True).alias("shared"))
    rows = listings.join(members.join(dealt(shared), "entity_id", "left"), "posting_id")
    job = F.coalesce("source_job_id", F.lit("")).alias("source_job_id")
    alone = rows.where("shared is null").select(
        "entity_id", F.lit(1).cast("long").alias("members"), *[F.coalesce(X.trimmed(F.col(c)), F.lit("")).alias(c) for c in texts], F.when(F.col("url") != "", X.trimmed(F.col("url"))).alias("url"),
        "posted_at", F.struct("source_id", "adapter", job, "url").alias("first"), F.array_compact(F.array("source_id")).alias("source_ids"),
    )
    best = F.min(F.when(F.col("url") != "", url_quality(F.col("url"))))
    out = rows.where("shared").groupBy("entity_id").agg(
        F.count("*").alias("members"), *map(_richest, texts), best["url"].alias("url"),
        F.min("posted_at").alias("posted_at"), F.min(F.struct("source_id", "adapter", job, "url")).alias("first"), F.array_sort(F.collect_set("source_id")).alias("source_ids"),
    ).unionByName(alone)
    first = F.col("first")
    if set(texts) == set(TEXTS):
        out = out.withColumns({"remote_scope": remote_scope(), "level": level()})
    out = out.withColumns({"adapter": first["adapter"], "source_job_id": F.nullif(first["source_job_id"], F.lit(""))})
    dedupe = F.coalesce(url_key(F.col("url")), provider_key(F.col("adapter"), F.col("source_job_id")), legacy_key())
    return out.withColumns({"dedupe_key": dedupe, "legacy_key": legacy_key()}).drop("first")


def dedupe_summary(members: DataFrame) -> DataFrame:
    return members.agg(F.count("*").alias("n_input"), F.count_distinct("entity_id").alias("n_output")).withColumn("n_merged", F.col("n_input") - F.col("n_output"))
