"""Queries of state and metrics on derived inputs, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyrook.operators import listings as L
from tallyrook.operators import metrics as M
from tallyrook.operators import resolve as E
from tallyrook.operators import state as S
from tallyrook.plans.derived import REFERENCE_DATE, table
from tallyrook.plans.listing_queries import MERGED_SQL, POLICY, SCORE_SQL, _front_sql, _geo_sql, _reason_sql, blocklist, entity_rows, listings, norm_sql, score_rows
from tallyrook.session import materialize

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def _when(text: str = REFERENCE_DATE):
    return F.lit(text).cast("timestamp_ntz")


def seen_state(rows: DataFrame) -> DataFrame:
    """Seen before: even keys, under their own key or a legacy one; two profiles."""
    k = F.col("posting_id")
    key = F.when(k % 8 == 0, F.col("legacy_key")).when(k % 8 == 2, F.coalesce("legacy_url_key", "dedupe_key")).otherwise(F.col("dedupe_key"))
    out = rows.where(k % 2 == 0).select(F.when(k % 3 == 0, "back").otherwise("front").alias("profile"), key.alias("key"), "company", "title", "url", F.to_timestamp_ntz(F.lit("2001-01-01 00:00:00")).alias("t"), k.alias("k"))
    seen = out.groupBy("profile", "key").agg(F.max_by("company", "k").alias("company"), F.max_by("title", "k").alias("title"), F.max_by("url", "k").alias("url"), F.min("k").alias("k"))
    at = F.lit("2001-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("k").cast("int"))
    return seen.select("profile", "key", "company", "title", "url", at.alias("first_seen_at"), at.alias("last_seen_at"))


SEEN_SQL = f"""{SCORE_SQL},
seen0 as (select case when posting_id % 3 = 0 then 'back' else 'front' end as profile, case posting_id % 8 when 0 then legacy_key when 2 then coalesce(legacy_url_key, dedupe_key) else dedupe_key end as key,
  company, title, url, posting_id as k from listing where posting_id % 2 = 0),
seen as (select profile, key, arg_max(company, k) as company, arg_max(title, k) as title, arg_max(url, k) as url, timestamp '2001-01-01 00:00:00' + min(k) * interval 1 hour as first_seen_at from seen0 group by all),
alias as (select posting_id, 0 as pos, dedupe_key as key from listing union all select posting_id, 1, legacy_key from listing union all select posting_id, 2, url_key from listing where url_key is not null
  union all select posting_id, 3, legacy_url_key from listing where legacy_url_key is not null union all select posting_id, 4, provider_key from listing where provider_key is not null),
hit as (select posting_id, arg_min(first_seen_at, pos) as first_seen_at from alias join seen using (key) where profile = 'front' group by posting_id),
life0 as (select ['applied', 'dismissed', 'expired'][((posting_id // 7) % 3)::int + 1] as disposition, case when posting_id % 2 = 0 then legacy_key else dedupe_key end as key, posted_at, posting_id from listing where posting_id % 7 < 2),
life as (select disposition, key, timestamp '2001-01-01 00:00:00' + min(posting_id) * interval 1 hour as at from life0 group by all),
disp as (select posting_id, min(case disposition when 'applied' then 1 when 'dismissed' then 2 else 3 end) as r from alias join life using (key) group by posting_id),
part as (select s.*, ['applied', 'dismissed', 'expired'][r::int] as disposition, case when h.posting_id is null then 'new' else 'seen' end as status, h.first_seen_at
  from scored s left join hit h using (posting_id) left join disp using (posting_id))"""


def lifecycle_state(rows: DataFrame) -> DataFrame:
    k = F.col("posting_id")
    key = F.when(k % 2 == 0, F.col("legacy_key")).otherwise(F.col("dedupe_key"))
    what = F.element_at(F.array(*map(F.lit, S.DISPOSITIONS)), (F.floor(k / 7) % 3).cast("int") + 1)
    out = rows.where(k % 7 < 2).groupBy(what.alias("disposition"), key.alias("key")).agg(F.min("posting_id").alias("k"))
    return out.select("disposition", "key", (F.lit("2001-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("k").cast("int"))).alias("at"))


def base_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings that a query reads more than once, written once."""
    return materialize(listings(spark, sf_dir), "listings")[0]


_KEYED = ("posting_id", "source_id", "adapter", "company", "title", "url", "dedupe_key", "legacy_key", "url_key", "legacy_url_key", "provider_key", "aliases")


def keyed_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings' identities, written once: what state queries read, without scope, level and texts."""
    return materialize(listings(spark, sf_dir).select(*_KEYED), "keyed")[0]


def parted(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = base_listings(spark, sf_dir)
    rows = L.scored(L.apply_policy(base, POLICY), "front", REFERENCE_DATE)
    return S.partition_active(rows, seen_state(base), lifecycle_state(base).select("key", "disposition"), "front")


add("d01_alias_lookup", lambda s, d: S.alias_lookup(b := keyed_listings(s, d), seen_state(b).where("profile = 'front'").select("key", "first_seen_at")).select("posting_id", F.col("hit.first_seen_at").alias("first_seen_at")),
    f"{SEEN_SQL} select posting_id, first_seen_at from hit")
add("d02_seen_split", lambda s, d: S.split_seen(b := keyed_listings(s, d), seen_state(b), "front").select("posting_id", "status", "first_seen_at"), f"{SEEN_SQL} select posting_id, status, first_seen_at from part")
add("d03_lifecycle_lookup", lambda s, d: S.disposition_of(b := keyed_listings(s, d), lifecycle_state(b)).select("posting_id", "disposition"), f"{SEEN_SQL} select posting_id, disposition from part")
add("h02_active_partition", lambda s, d: parted(s, d).where("reason is null").select("posting_id", "active", "status", "disposition"),
    f"{SEEN_SQL} select posting_id, disposition is null as active, status, disposition from part where reason is null")
add("f08_suppressed", lambda s, d: M.count_by(parted(s, d).where("reason is null"), "disposition"), f"{SEEN_SQL} select disposition, count(*) as n from part where reason is null and disposition is not null group by 1")
add("f05_exclusions", lambda s, d: M.count_by(score_rows(s, d), "reason"), f"{SCORE_SQL} select reason, count(*) as n from scored where reason is not null group by 1")
add("f04_false_positive_proxy", lambda s, d: M.false_positive_proxy(parted(s, d).where("reason is null")),
    f"{SEEN_SQL} select floor(count(*) filter (where disposition = 'dismissed') / count(*)::double * 100 + 0.5) / 100 as proxy from part where reason is null")
add("f09_funnel", lambda s, d: M.funnel(parted(s, d)), f"""{SEEN_SQL},
one as (select count(*) filter (where reason is null) as policy_matched, count(*) filter (where reason is not null) as excluded, count(*) filter (where reason is null and disposition is null) as active,
 count(*) filter (where reason is null and disposition is not null) as suppressed, count(*) filter (where reason is null and disposition is null and status = 'new') as "new",
 count(*) filter (where reason is null and disposition is null and status = 'seen') as seen, count(*) filter (where reason is null and disposition is null and geo = 'eligible') as eligible,
 count(*) filter (where reason is null and disposition is null and geo = 'verify') as verify, count(*) filter (where reason is null and disposition is null and likely_expired) as likely_expired from part)
select metric, n from (unpivot one on * into name metric value n)""")
add("f10_blocklist_count", lambda s, d: L.not_blocklisted(listings(s, d), blocklist(s), "left_semi").agg(F.count("*").alias("n")),
    f"{SCORE_SQL} select count(*) as n from listing where {norm_sql('company')} in (select b from blocked)")


def _source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("source_id").distinct()


add("f02_matches_by_source", lambda s, d: M.matches_by_source(L.apply_policy(entity_rows(s, d), POLICY).where("reason is null"), _source_ids(s, d)), f"""{MERGED_SQL}, e0 as (select *, {_geo_sql()} as geo, {_front_sql()} as front, {_reason_sql()} as geo_reason from ent2),
e1 as (select source_ids from e0 where front and level <> 'staff_lead' and geo <> 'excluded' and not (remote_scope = 'regional' and geo <> 'eligible')),
n as (select source_id, count(*) as n from (select unnest(string_split(source_ids, ',')) as source_id from e1) group by 1)
select source_id, coalesce(n, 0) as matched from (select distinct source_id from listing) left join n using (source_id)""")
add("f03_source_effectiveness", lambda s, d: M.effectiveness(listings(s, d).groupBy("source_id").agg(F.count("*").alias("fetched")), parted(s, d).where("reason is null").withColumn("source_ids", F.array("source_id"))),
    f"""{SEEN_SQL} select source_id, fetched, coalesce(matched, 0) as matched, coalesce(new, 0) as "new", coalesce(seen, 0) as seen, coalesce(applied, 0) as applied, coalesce(dismissed, 0) as dismissed, coalesce(expired, 0) as expired,
 coalesce(likely_expired, 0) as likely_expired, floor(coalesce(matched, 0) / fetched::double * 100 + 0.5) / 100 as "yield" from (select source_id, count(*) as fetched from listing group by 1)
 left join (select source_id, count(*) as matched, count(*) filter (where status = 'new' and disposition is null) as "new", count(*) filter (where status = 'seen' and disposition is null) as seen,
 count(*) filter (where disposition = 'applied') as applied, count(*) filter (where disposition = 'dismissed') as dismissed, count(*) filter (where disposition = 'expired') as expired,
 count(*) filter (where likely_expired) as likely_expired from part where reason is null group by 1) using (source_id)""")  # fmt: skip


def poll_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.where("event_type in ('error', 'signup', 'click')").select(
        F.lit("front").alias("profile"), F.concat(F.lit("src"), (F.col("user_id") % 7).cast("string")).alias("source_id"), F.col("event_id").alias("ordinal"),
        F.col("ts").cast("timestamp_ntz").alias("at"), (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type") == "error", F.concat(F.lit("failed "), "event_id")).alias("error"),
    )


_STATE = "profile string, source_id string, last_attempt_at timestamp_ntz, last_success_at timestamp_ntz, last_failure_at timestamp_ntz, last_error string"


def poll_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after a first half of attempts, then after all of them: an upsert upon an upsert."""
    rows = poll_updates(spark, sf_dir)
    first = S.upsert_poll(spark.createDataFrame([], _STATE), rows.where("ordinal % 2 = 0"))
    return S.upsert_poll(first, rows.where("ordinal % 2 = 1"))


POLL_SQL = """with u as (select 'front' as profile, 'src' || (user_id % 7) as source_id, event_id, ts as tm, event_type <> 'error' as ok, event_id % 2 as half from events where event_type in ('error', 'signup', 'click')),
l as (select profile, source_id, half, arg_max(tm, event_id) as tm, arg_max(ok, event_id) as ok, max(event_id) as id from u group by all),
s as (select coalesce(a.source_id, b.source_id) as source_id, a.tm as at0, a.ok as ok0, b.tm as at1, b.ok as ok1, b.id as id1, a.id as id0
 from (select * from l where half = 0) a full join (select * from l where half = 1) b using (source_id)),
state as (select 'front' as profile, source_id, coalesce(at1, at0) as last_attempt_at, case when ok1 then at1 when ok0 then at0 end as last_success_at,
 case when not ok1 then at1 when not ok0 then at0 end as last_failure_at, case when ok1 is null then case when not ok0 then 'failed ' || id0 end when not ok1 then 'failed ' || id1 end as last_error from s)"""
add("e13_poll_upsert", poll_state, f"{POLL_SQL} select * from state")
_now = "2024-01-30 23:00:00"
add("c18_cadence", lambda s, d: S.cadence(poll_state(s, d), F.lit(_now).cast("timestamp"), F.when(F.col("source_id") == "src0", 0).otherwise(6)).select("source_id", "skip", "next_eligible_at", "hours_remaining"),
    f"""{POLL_SQL}, a as (select source_id, greatest(last_attempt_at, last_success_at, last_failure_at) as anchor, case when source_id = 'src0' then 0 else 6 end as h from state),
 b as (select *, anchor + h * interval 1 hour as due from a), c as (select *, h > 0 and due > timestamp '{_now}' as skip from b)
 select source_id, skip, case when skip then due end as next_eligible_at, case when skip then ceil((epoch_us(due) - epoch_us(timestamp '{_now}')) / 3.6e9::double)::bigint else 0 end as hours_remaining from c""")  # fmt: skip
add("f07_run_outcome", lambda s, d: M.run_outcome(S.cadence(poll_state(s, d), F.lit(_now).cast("timestamp"), F.lit(6)).select("source_id", F.when(F.col("skip"), "skipped").when(F.col("last_error").isNull(), "success").otherwise("failure").alias("status"))),
    f"""{POLL_SQL}, a as (select greatest(last_attempt_at, last_success_at, last_failure_at) + interval 6 hour > timestamp '{_now}' as skip, last_error from state),
 b as (select count(*) as n, count(*) filter (where skip) as skipped, count(*) filter (where not skip and last_error is null) as succeeded, count(*) filter (where not skip and last_error is not null) as failed from a)
 select n - skipped as attempted, skipped, succeeded, failed, case when n > 0 and skipped = n then 'all_cadence_skipped' when failed > 0 and succeeded = 0 then 'total_outage' when failed > 0 then 'partial' else 'success' end as status from b""")  # fmt: skip


def _transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed_listings(spark, sf_dir)
    state = rows.join(lifecycle_state(rows).withColumnRenamed("key", "k2"), F.col("k2") == F.col("dedupe_key")).groupBy("disposition", F.col("dedupe_key").alias("key")).agg(
        F.min("company").alias("company"), F.min("title").alias("title"), F.min("url").alias("url"), F.min("at").alias("at"), F.lit("prior").alias("source_report"))
    at = _when()
    entries = rows.where("adapter = 'board1'").select("dedupe_key", "legacy_key", "legacy_url_key", "company", "title", "url").withColumnsRenamed({"dedupe_key": "key"}).withColumns({"disposition": F.lit("applied"), "at": at, "source_report": F.lit("report-1")})
    return S.transition(state, entries).select("disposition", "key", "at", "source_report")


add("e12_lifecycle_transition", _transition, f"""{SEEN_SQL},
st as (select l.disposition, b.dedupe_key as key, min(l.at) as tm from listing b join life l on l.key = b.dedupe_key group by all),
en as (select * from listing where adapter = 'board1'),
nm as (select distinct own, key from (select dedupe_key as own, unnest([dedupe_key, legacy_key, legacy_url_key]) as key from en) where key is not null),
kn as (select own, min(tm) as known_at, min({{'a': tm, 'k': key}}).k as known_key from st join (select key, min(own) as own from nm group by key) using (key) where disposition = 'applied' group by own)
select disposition, key, tm as at, 'prior' as source_report from st where key not in (select key from nm)
union all select 'applied', coalesce(known_key, own), coalesce(known_at, timestamp '{REFERENCE_DATE}'), 'report-1' from (select distinct dedupe_key as own from en) left join kn using (own)""")
add("e11_seen_upsert", lambda s, d: S.upsert_seen(seen_state(b := keyed_listings(s, d)), b.where("source_id = 'src1'"), "front", _when()).select("profile", "key", "first_seen_at", "last_seen_at"),
    f"""{SEEN_SQL}, r as (select * from listing where source_id = 'src1'), st as (select *, first_seen_at as last_seen_at from seen),
 fresh as (select dedupe_key as key, min(h.first_seen_at) as known from r left join hit h using (posting_id) group by 1), gone as (select distinct legacy_key as key from r where legacy_key <> dedupe_key)
 select profile, key, first_seen_at, last_seen_at from st where profile <> 'front' or (key not in (select key from fresh) and key not in (select key from gone))
 union all select 'front', key, coalesce(known, timestamp '{REFERENCE_DATE}'), timestamp '{REFERENCE_DATE}' from fresh""")  # fmt: skip
add("e01_first_wins", lambda s, d: S.first_wins(listings(s, d), ["dedupe_key"], ["posting_id"]).select("posting_id", "dedupe_key"), f"{SCORE_SQL} select min(posting_id) as posting_id, dedupe_key from listing group by dedupe_key")
add("e02_composite_dedupe", lambda s, d: S.first_wins(listings(s, d).withColumn("k", L.X.normalize_text(F.col("company"))), ["k", "title"], ["posting_id"]).select("posting_id"),
    f"{SCORE_SQL} select min(posting_id) as posting_id from listing group by split_part(legacy_key, '::', 1), title")
add("h01_union_sources", lambda s, d: listings(s, d).where("source_id = 'src1'").unionByName(listings(s, d).where("source_id <> 'src1'")).groupBy("source_id").agg(F.count("*").alias("n")),
    f"{SCORE_SQL} select source_id, count(*) as n from listing group by 1")
add("h04_key_difference", lambda s, d: seen_state(b := keyed_listings(s, d)).select("key").join(lifecycle_state(b).select("key"), "key", "left_anti").distinct(),
    f"{SEEN_SQL} select distinct key from seen where key not in (select key from life)")
add("e05_stable_order", lambda s, d: listings(s, d).select("posting_id", F.row_number().over(Window.partitionBy("dedupe_key").orderBy(E.stable_key(), "posting_id")).alias("nth")),
    f"""{SCORE_SQL} select posting_id, row_number() over (partition by dedupe_key order by concat_ws('|', coalesce(url_key, url), source_id, adapter, coalesce(source_job_id, ''), url, trim(company), trim(title), trim(description)), posting_id) as nth from listing""")
