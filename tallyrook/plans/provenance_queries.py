"""Queries of entities' provenance, aliases and latest facts, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrook.operators import provenance as P
from tallyrook.operators import resolve as E
from tallyrook.plans.listing_queries import MERGED_SQL, listings, norm_sql
from tallyrook.session import materialize

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


#: What entities and records need of a listing; other fields aren't worked out or written unless a query names them.
_RECORD = ("posting_id", "source_id", "adapter", "source_job_id", "url", "fetched_at", "url_key", "provider_key", "legacy_key")


def fetched(spark: SparkSession, sf_dir: str, *more: str) -> tuple[DataFrame, DataFrame]:
    """Listings with the day they were fetched on and their source's attribution, written once, of them only _RECORD and more;
    and their entities."""
    k = F.col("posting_id")
    rows = listings(spark, sf_dir).withColumns({
        "fetched_at": F.lit("2001-09-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((k % 4).cast("int")),
        "attribution": F.when(k % 4 != 0, F.concat(F.lit(" Board "), k % 3, F.lit(" "))).when(k % 8 == 0, "  "),
    })
    rows, _ = materialize(rows.select(*_RECORD, *more), "fetched")
    return rows, E.entities(rows)


_FETCHED_SQL = f"""{MERGED_SQL}, fetched as (select *, timestamp '2001-09-01' + (posting_id % 4) * interval 1 day as fetched_at, case when posting_id % 4 <> 0 then 'Board ' || (posting_id % 3) end as attribution from ranked_url)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.records(*fetched(spark, sf_dir))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.facts(*fetched(spark, sf_dir, "attribution"))


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, members = fetched(spark, sf_dir, "legacy_url_key", "company", "title", "posted_at")
    return P.aliases(rows, members, E.merged(rows, members, ("company", "title")))


def _landings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two landings that overlap: what the second one brings."""
    rows, members = fetched(spark, sf_dir)
    records = P.records(rows, members)
    stored, _ = materialize(records.where("fetched_at < '2001-09-03'"), "records")
    return P.new_records(stored, records.where("fetched_at > '2001-09-01'"))


add("h03_provenance_union", _records, f"{_FETCHED_SQL} select distinct entity_id, source_id, adapter, coalesce(source_job_id, '') as source_job_id, url as original_url, fetched_at from fetched")
add("e06_provenance_facts", _facts, f"""{_FETCHED_SQL},
r as (select distinct entity_id, source_id, adapter, coalesce(source_job_id, '') as source_job_id, url as original_url, fetched_at from fetched),
n as (select *, row_number() over (partition by entity_id order by source_id, adapter, source_job_id, original_url, fetched_at) as nth from r),
a as (select entity_id, string_agg(distinct attribution, ' | ' order by attribution) as attribution from fetched group by 1),
m as (select entity_id, count(*) as n_records, max(fetched_at) as fetched_at from r group by 1)
select n.entity_id, n_records, source_id as first_source_id, adapter as first_adapter, source_job_id as first_source_job_id, original_url as first_original_url, n.fetched_at as first_fetched_at, m.fetched_at, attribution
from n join m using (entity_id) join a using (entity_id) where nth = 1""")
add("e07_aliases", _aliases, f"""{_FETCHED_SQL}
select distinct entity_id, alias from (select entity_id, unnest([provider_key, url_key, legacy_url_key]) as alias from fetched union all select entity_id, {norm_sql('company')} || '::' || {norm_sql('title')} from ent) where alias is not null""")
add("h03_new_records", _landings, f"""{_FETCHED_SQL} select distinct entity_id, source_id, adapter, coalesce(source_job_id, '') as source_job_id, url as original_url, fetched_at from fetched where fetched_at >= '2001-09-03'""")
