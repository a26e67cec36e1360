"""Queries of published runs: result sets, the states behind them and the numbers observed by the write, with DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrook.operators import listings as L
from tallyrook.operators import state as S
from tallyrook.operators.publish import ENTRY, SETS, RunStore, part_of
from tallyrook.operators.state_table import StateTable
from tallyrook.plans.derived import REFERENCE_DATE
from tallyrook.plans.listing_queries import POLICY
from tallyrook.plans.state_queries import _STATE, SEEN_SQL, base_listings, lifecycle_state, seen_state
from tallyrook.plans.keyed_queries import _SEEN
from tallyrook.session import materialize, work_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_LEVELS = ("staff_lead", "senior", "junior", "mid", "unknown")
REASONS = (
    "role mismatch", *[f"level not allowed: {x}" for x in _LEVELS], "home continent explicitly excluded", "region, hybrid or on-site signals", "remote scope too restricted", "unlikely eligible from home",
)


def add(name: str, run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def judged(base: DataFrame, seen: DataFrame, profile: str = "front") -> DataFrame:
    """Listings as a run publishes them: narrow, with their part, and tier_rank where they are active."""
    rows = L.scored(L.apply_policy(base, POLICY), profile, REFERENCE_DATE)
    rows = S.partition_active(rows, seen, lifecycle_state(base).select("key", "disposition"), profile)
    return ranked_parts(rows.withColumn("part", part_of()).select(*ENTRY, "source_id", "geo", "total", "reason", "status", "disposition", "likely_expired", "part"))


def ranked_parts(rows: DataFrame) -> DataFrame:
    """tier_rank of active rows among themselves; null for others. Ranks by tier and activity, so that rows are judged once."""
    tiers = L.ranked(rows.withColumn("tier", F.col("geo")).withColumn("geo", F.concat_ws("/", F.when(F.col("part").isin(*SETS["ranked"]), "active").otherwise("rest"), "geo")))
    return tiers.withColumn("geo", F.col("tier")).withColumn("tier_rank", F.when(F.col("part").isin(*SETS["ranked"]), F.col("tier_rank"))).drop("tier")


def published(spark: SparkSession, sf_dir: str) -> RunStore:
    """A run in which all sources fail, then one in which they don't."""
    base, path = base_listings(spark, sf_dir), f"{work_folder(spark)}/store-{uuid.uuid4().hex}"
    seen = StateTable(spark, f"{path}/seen", _SEEN, ("key",), 16)
    before, _ = materialize(seen_state(base), "seen-before")  # asked for its buckets, then stored
    seen.upsert(before.select("key"), lambda _: before)
    polls = StateTable(spark, f"{path}/polls", _STATE, ("source_id",), 4)
    store = RunStore(spark, path, seen, polls, "front", REASONS)
    rows = judged(base, seen.read())
    sources = base.select("source_id").distinct()

    def attempts(at: str, ok: bool) -> DataFrame:
        return sources.select("source_id", F.lit(1).alias("ordinal"), F.lit(at).cast("timestamp_ntz").alias("at"), F.lit(ok).alias("ok"), F.when(~F.lit(ok), "no answer").alias("error"))

    store.publish("run-1", "2001-08-15 00:00:00", rows.limit(0), attempts("2001-08-15 00:00:00", False))
    store.publish("run-2", "2001-08-16 00:00:00", rows, attempts("2001-08-16 00:00:00", True))
    store.publish("run-2", "2001-08-16 00:00:00", rows, attempts("2001-08-16 00:00:00", True))  # again: left alone
    return store


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = published(spark, sf_dir)
    out = None
    for name in SETS:
        part = store.result(name).select(F.lit(name).alias("result_set"), "posting_id", "tier_rank", "reason")
        out = part if out is None else out.unionByName(part)
    return out


_PLACES = f"""{SEEN_SQL}, placed as (select *, case when reason is not null then 'excluded' when disposition is not null then 'suppressed' else status end as bin from part),
live as (select posting_id, row_number() over (partition by geo order by total desc, company, dedupe_key, posting_id) as tier_rank from placed where bin in ('new', 'seen'))"""
add("a20_result_sets", _sets, f"""{_PLACES}, named as (select * from placed left join live using (posting_id))
select 'ranked' as result_set, posting_id, tier_rank::int as tier_rank, reason from named where bin in ('new', 'seen') union all select bin, posting_id, tier_rank::int, reason from named where bin <> 'suppressed'""")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = published(spark, sf_dir)
    seen = store.seen.read().select("profile", "key", F.col("first_seen_at").alias("first_at"), F.col("last_seen_at").alias("last_at"), F.lit(None).cast("string").alias("error"))
    polls = store.polls.read().select("profile", F.concat(F.lit("source "), "source_id").alias("key"), F.col("last_failure_at").alias("first_at"), F.col("last_success_at").alias("last_at"), F.col("last_error").alias("error"))
    return seen.unionByName(polls)


add("j10_state_after_publish", _states, f"""{_PLACES}, fresh as (select l.dedupe_key as key, min(h.first_seen_at) as known from placed l left join hit h using (posting_id) where bin <> 'excluded' group by 1),
gone as (select distinct legacy_key as key from placed where bin <> 'excluded' and legacy_key <> dedupe_key)
select profile, key, first_seen_at as first_at, first_seen_at as last_at, null::varchar as error from seen where profile <> 'front' or (key not in (select key from fresh) and key not in (select key from gone))
union all select 'front', key, coalesce(known, timestamp '2001-08-16'), timestamp '2001-08-16', null from fresh
union all select distinct 'front', 'source ' || source_id, timestamp '2001-08-15', timestamp '2001-08-16', null from listing""")


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5, F8 and F9 of one run, all observed by the write of its rows."""
    return published(spark, sf_dir).summary().where("n > 0").select("run_id", "metric", "n")


add("j09_run_summary", _summary, f"""{_PLACES},
one as (select count(*) as "rows", count(*) filter (where bin <> 'excluded') as policy_matched, count(*) filter (where bin = 'excluded') as excluded, count(*) filter (where bin in ('new', 'seen')) as active,
 count(*) filter (where bin = 'suppressed') as suppressed, count(*) filter (where bin = 'new') as "new", count(*) filter (where bin = 'seen') as seen, count(*) filter (where bin in ('new', 'seen') and geo = 'eligible') as eligible,
 count(*) filter (where bin in ('new', 'seen') and geo = 'verify') as verify, count(*) filter (where bin in ('new', 'seen') and likely_expired) as likely_expired from placed),
every as (select metric, n from (unpivot one on * into name metric value n) union all select disposition, count(*) from placed where bin = 'suppressed' group by 1 union all select 'excluded: ' || reason, count(*) from placed where bin = 'excluded' group by 1)
select 'run-2' as run_id, metric, n from every where n > 0""")
