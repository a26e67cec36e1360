"""Where an entity's listings come from, as keyed tables: a row a record or alias, not arrays in an entity's row.

A record is told apart by five fields (source, adapter, the provider's id, the address it was found at, and when). Records and
aliases are made distinct by all their columns, before and behind the shuffle, so an entity of any size spreads over the
tasks; what an entity's own row gets of them is an aggregate (first record, latest time, distinct attributions, of which
there are as many as sources configured).

Cases: a null id is the empty one; null or blank attributions don't count; an entity without any has null; repeated
records count once; a listing whose posting_id isn't a member has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrook.functions.text import trimmed

FIELDS = ("source_id", "adapter", "source_job_id", "original_url", "fetched_at")


def record() -> list[Column]:
    """The five fields of a listing's record."""
    return [F.col("source_id"), F.col("adapter"), F.coalesce("source_job_id", F.lit("")).alias("source_job_id"), F.col("url").alias("original_url"), F.col("fetched_at")]


def records(listings: DataFrame, members: DataFrame) -> DataFrame:
    """(entity_id, FIELDS), each record of an entity once."""
    return listings.join(members, "posting_id").select("entity_id", *record()).distinct()


def aliases(listings: DataFrame, members: DataFrame, merged: DataFrame) -> DataFrame:
    """(entity_id, alias), each once: the identity of the merged fields, and the provider's and URL's names of every record.

    merged: entities with dedupe_key and legacy_key, as made again from the merged fields.
    """
    names = F.array_compact(F.array("provider_key", "url_key", "legacy_url_key"))
    found = listings.join(members, "posting_id").select("entity_id", F.explode(names).alias("alias"))
    own = merged.select("entity_id", F.explode(F.array("dedupe_key", "legacy_key")).alias("alias"))
    return found.unionByName(own).distinct()


def facts(listings: DataFrame, members: DataFrame) -> DataFrame:
    """An entity's first record in the order of FIELDS, its latest fetched_at, how many records it has, and its attribution:
    the distinct ones in order, joined by ` | `."""
    rows = listings.join(members, "posting_id")
    said = rows.select("entity_id", trimmed(F.col("attribution")).alias("a")).where("a <> ''").distinct()
    said = said.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list("a")), " | ").alias("attribution"))
    each = records(listings, members).groupBy("entity_id").agg(F.count("*").alias("n_records"), F.min(F.struct(*FIELDS)).alias("first"), F.max("fetched_at").alias("fetched_at"))
    return each.join(said, "entity_id", "left").select("entity_id", "n_records", *[F.col(f"first.{c}").alias(f"first_{c}") for c in FIELDS], "fetched_at", "attribution")


def new_records(stored: DataFrame, landed: DataFrame) -> DataFrame:
    """The records of a landing that the table doesn't have yet, by entity and all five fields.

    Both are counted together by these columns, so each moves once and equal ones combine before they do; nulls are equal.
    """
    keys = ("entity_id", *FIELDS)
    both = landed.select(*keys, F.lit(0).alias("there")).unionByName(stored.select(*keys, F.lit(1).alias("there")))
    return both.groupBy(*keys).agg(F.max("there").alias("there")).where("there = 0").select(*keys)
