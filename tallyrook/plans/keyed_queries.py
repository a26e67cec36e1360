"""Queries of keyed streams over three landings of the events, the stream started anew after each, and of state tables in
buckets, with DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyrook.operators import evidence as V
from tallyrook.operators import state as S
from tallyrook.operators.state import DISPOSITIONS
from tallyrook.operators.state_table import StateTable, all_names
from tallyrook.plans.derived import table
from tallyrook.plans.evidence_queries import COMMITS_SQL, commits
from tallyrook.plans.state_queries import SEEN_SQL, keyed_listings, lifecycle_state, seen_state
from tallyrook.session import work_folder
from tallyrook.streaming import keyed

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))


def _thirds(rows: DataFrame, part) -> list[DataFrame]:
    return [rows.where(part == k).drop("part") for k in range(3)]


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sights come in any order; two profiles see the same keys."""
    name = F.concat(F.lit("k"), (F.col("user_id") % 5000).cast("string"))
    rows = _events(spark, sf_dir).select(
        (F.col("event_id") % 3).alias("part"), F.when(F.col("event_id") % 2 == 0, "front").otherwise("back").alias("profile"), name.alias("key"),
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("company"), F.col("event_type").alias("title"), F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("url"), "at",
    )
    checkpoint = keyed.over_landings(_thirds(rows, F.col("part")), keyed.seen, "j05")
    out = keyed.state_of(spark, checkpoint)
    return out.select("profile", "key", "company", "title", "url", F.unix_micros("first_seen_at").alias("first_at"), F.unix_micros("last_seen_at").alias("last_at"))


add("j05_keyed_seen", _seen, """with e as (select case when event_id % 2 = 0 then 'front' else 'back' end as profile, 'k' || (user_id % 5000) as key, 'c' || user_id as company, event_type as title, 'u' || event_id as url, epoch_us(ts) as tm from events)
select profile, key, company, title, url, min(tm) over (partition by profile, key) as first_at, tm as last_at from e
qualify row_number() over (partition by profile, key order by tm desc, company desc, title desc, url desc) = 1""")


def _lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key's decision changes with each landing that has it; two names of a listing share its entity."""
    part = F.col("event_id") % 3
    what = F.element_at(F.array(*map(F.lit, DISPOSITIONS)), ((F.col("user_id") + part) % 3).cast("int") + 1)
    rows = _events(spark, sf_dir).select(
        part.alias("part"), F.concat(F.lit("e"), F.floor(F.col("user_id") / 2).cast("string")).alias("entity"), what.alias("disposition"), F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"),
        F.lit("c").alias("company"), F.lit("t").alias("title"), F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("url"), "at", F.concat(F.lit("report-"), part.cast("string")).alias("source_report"), F.col("event_id").alias("ordinal"),
    )
    checkpoint = keyed.over_landings(_thirds(rows, F.col("part")), keyed.lifecycle, "j06")
    return keyed.state_of(spark, checkpoint, "decisions").select("entity", "disposition", "key", "url", F.unix_micros("at").alias("decided_at"), "source_report")


# the last run of equal dispositions of an entity, in the order of landings and ordinals: its first row gives time and key, its last one the rest
add("j06_keyed_lifecycle", _lifecycle, """with e as (select user_id // 2 as n, event_id % 3 as part, event_id, user_id, epoch_us(ts) as tm, ['applied', 'dismissed', 'expired'][((user_id + event_id % 3) % 3)::int + 1] as disposition from events),
c as (select *, disposition is distinct from lag(disposition) over w as turn from e window w as (partition by n order by part, event_id)),
r as (select *, sum(turn::int) over (partition by n order by part, event_id) as run from c),
l as (select *, row_number() over (partition by n order by part, event_id) as k, max(run) over (partition by n) as last from r)
select 'e' || n as entity, arg_max(disposition, k) as disposition, 'k' || arg_min(user_id, k) as key, 'u' || arg_max(event_id, k) as url, arg_min(tm, k) as decided_at, 'report-' || arg_max(part, k) as source_report from l where run = last group by n""")


def _polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts land in the order of time; a source is held for as many hours as its number modulo 9, so some never are."""
    source = F.col("user_id") % 97
    day = F.dayofmonth("at")
    rows = _events(spark, sf_dir).select(
        F.when(day <= 10, 0).when(day <= 20, 1).otherwise(2).alias("part"), F.lit("front").alias("profile"), F.concat(F.lit("src"), source.cast("string")).alias("source_id"), F.unix_micros("at").alias("ordinal"), F.col("at").alias("attempted_at"), "at",
        (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type") == "error", F.concat(F.lit("failed "), "event_id")).alias("error"), (source % 9).cast("double").alias("min_hours"),
    )
    checkpoint = keyed.over_landings(_thirds(rows, F.col("part")), keyed.polls, "j07")
    return keyed.state_of(spark, checkpoint).select("source_id", "last_error", *[F.unix_micros(x).alias(x.removesuffix("_at")) for x in ("last_attempt_at", "last_success_at", "last_failure_at", "held_until")])


add("j07_keyed_polls", _polls, """with e as (select user_id % 97 as s, epoch_us(ts) as tm, event_type <> 'error' as ok, event_id from events),
s as (select s, max(tm) as last_attempt, max(tm) filter (where ok) as last_success, max(tm) filter (where not ok) as last_failure, case when not arg_max(ok, tm) then 'failed ' || arg_max(event_id, tm) end as last_error from e group by s)
select 'src' || s as source_id, last_error, last_attempt, last_success, last_failure,
 case when s % 9 > 0 and (last_attempt + (s % 9) * 3600000000 + 999) // 1000 > (select max(tm) // 1000 from e) then last_attempt + (s % 9) * 3600000000 end as held_until from s""")


# state tables: each landing touches its buckets
_SEEN = "profile string, key string, company string, title string, url string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz"
_DECISIONS = "disposition string, key string, company string, title string, url string, at timestamp_ntz, source_report string"


def _state_table(spark: SparkSession, name: str, columns: str, key: tuple[str, ...], rows: DataFrame, buckets: int = 16, keys: DataFrame | None = None) -> StateTable:
    """A state that begins with rows; keys: what they come from, where its keys are cheaper to look up."""
    out = StateTable(spark, f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}", columns, key, buckets)
    out.upsert((rows if keys is None else keys).select(*key), lambda _: rows)
    return out


def _day(k: int):
    return F.lit(f"2001-09-0{k + 1} 00:00:00").cast("timestamp_ntz")


def _seen_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All listings land in two parts upon a state of two profiles."""
    rows = keyed_listings(spark, sf_dir)
    state = _state_table(spark, "e11-state", _SEEN, ("key",), seen_state(rows))
    for k in range(2):
        part = rows.where(F.col("posting_id") % 2 == k)
        state.upsert(all_names(part, "dedupe_key", "legacy_key", lists=("aliases",)), lambda old, part=part, k=k: S.upsert_seen(old, part, "front", _day(k)))
    return state.read().select("profile", "key", "first_seen_at", "last_seen_at")


def _seen_step(k: int) -> str:
    day = f"timestamp '2001-09-0{k + 1} 00:00:00'"
    return f"""x_r{k} as (select * from listing where posting_id % 2 = {k}),
x_h{k} as (select posting_id, arg_min(first_seen_at, pos) as known from alias join x_s{k} using (key) where profile = 'front' group by posting_id),
x_f{k} as (select dedupe_key as key, min(known) as known from x_r{k} left join x_h{k} using (posting_id) group by 1),
x_g{k} as (select distinct legacy_key as key from x_r{k} where legacy_key <> dedupe_key),
x_s{k + 1} as (select profile, key, first_seen_at, last_seen_at from x_s{k} where profile <> 'front' or (key not in (select key from x_f{k}) and key not in (select key from x_g{k}))
 union all select 'front', key, coalesce(known, {day}), {day} from x_f{k})"""


add("e11_seen_table", _seen_table, f"{SEEN_SQL}, x_s0 as (select profile, key, first_seen_at, first_seen_at as last_seen_at from seen), {_seen_step(0)}, {_seen_step(1)} select * from x_s2")


def _lifecycle_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing is decided anew, in two landings: the first two thirds applied, the rest dismissed."""
    rows = keyed_listings(spark, sf_dir)
    prior = lifecycle_state(rows).select("disposition", "key", F.lit("c").alias("company"), F.lit("t").alias("title"), F.lit("u").alias("url"), "at", F.lit("prior").alias("source_report"))
    state = _state_table(spark, "e12-state", _DECISIONS, ("key",), prior)
    # one row an own key decides where it lands: else a key would be in both landings
    own = rows.groupBy("dedupe_key", "legacy_key", "legacy_url_key").agg(F.min("posting_id").alias("posting_id"), *[F.min(c).alias(c) for c in ("company", "title", "url")])
    first = F.min("posting_id").over(Window.partitionBy("dedupe_key"))
    own = own.withColumn("late", first % 3 == 2)
    for k, (what, part) in enumerate((("applied", own.where("not late")), ("dismissed", own.where("late")))):
        entries = part.select(F.col("dedupe_key").alias("key"), "legacy_key", "legacy_url_key", F.lit(what).alias("disposition"), "company", "title", "url", _day(k).alias("at"), F.lit(f"report-{k}").alias("source_report"))
        state.upsert(all_names(entries, "key", "legacy_key", "legacy_url_key"), lambda old, entries=entries: S.transition(old, entries))
    return state.read().select("disposition", "key", "at", "source_report")


def _lifecycle_step(k: int, what: str) -> str:
    return f"""x_n{k} as (select distinct own, key from (select dedupe_key as own, unnest([dedupe_key, legacy_key, legacy_url_key]) as key from own where late = {k}) where key is not null),
x_k{k} as (select own, min(tm) as known_at, min({{'a': tm, 'k': key}}).k as known_key from x_s{k} join (select key, min(own) as own from x_n{k} group by key) using (key) where disposition = '{what}' group by own),
x_s{k + 1} as (select disposition, key, tm, report from x_s{k} where key not in (select key from x_n{k})
 union all select '{what}', coalesce(known_key, own), coalesce(known_at, timestamp '2001-09-0{k + 1} 00:00:00'), 'report-{k}' from (select distinct own from x_n{k}) left join x_k{k} using (own))"""


add("e12_lifecycle_table", _lifecycle_table, f"""{SEEN_SQL}, own as (select *, (min(posting_id) over (partition by dedupe_key) % 3 = 2)::int as late from listing),
x_s0 as (select disposition, key, life.at as tm, 'prior' as report from life), {_lifecycle_step(0, "applied")}, {_lifecycle_step(1, "dismissed")} select disposition, key, tm as at, report as source_report from x_s2""")


def _commit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of commits in buckets, and a fetch that repeats some, changes some and brings new ones."""
    rows = commits(spark, sf_dir)
    # chosen before they are made distinct, and looked up as they come: only a landing's own rows are dealt, and each once
    landed = rows.where("`date` < '1999-01-01'").select("repo", "sha", "subject", "date")
    prior = landed.dropDuplicates(["repo", "sha"])
    subject = F.when(F.col("l_orderkey") % 10 == 0, F.concat("subject", F.lit("!"))).otherwise(F.col("subject"))
    fetched = rows.where("`date` >= '1998-06-01'").select("repo", "sha", subject.alias("subject"), "date")
    state = _state_table(spark, "e08-state", "repo long, sha string, subject string, `date` string", ("repo", "sha"), prior, keys=landed)
    state.upsert(fetched.select("repo", "sha"), lambda old: V.upsert(old, fetched, ["repo", "sha"], ["subject", "date"]))
    return state.read().groupBy("repo").agg(F.count("*").alias("n"), F.count_if(F.col("subject").endswith("!")).alias("changed"), F.min("subject").alias("least"), F.max("date").alias("latest"))


add("e08_commit_table", _commit_table, f"""{COMMITS_SQL}, u as (select repo, sha, any_value(subject) as subject, any_value("date") as "date", any_value(l_orderkey) as k from c group by all),
s as (select repo, case when "date" >= '1998-06-01' and k % 10 = 0 then subject || '!' else subject end as subject, "date" from u)
select repo, count(*) as n, count(*) filter (where subject like '%!') as changed, min(subject) as least, max("date") as latest from s group by repo""")
