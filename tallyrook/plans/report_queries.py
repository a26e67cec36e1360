"""Queries of manifests, reports, the refresh log and watermark tables on derived inputs, with DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyrook.functions import text as X
from tallyrook.functions.rules import THEMES
from tallyrook.operators import discovery as D
from tallyrook.operators import evidence as V
from tallyrook.operators import listings as L
from tallyrook.operators import reports as R
from tallyrook.plans.derived import RAW_SQL, raw_postings, table
from tallyrook.plans.evidence_queries import _TOPICS, COMMITS_SQL, commits, pulls
from tallyrook.plans.listing_queries import SCORE_SQL, score_rows
from tallyrook.session import work_folder
from tallyrook.streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_ADAPTERS = ("himalayas", "jobicy", "remoteok", "wwr", "hn-hiring", "another")


def add(name: str, run, sql: str) -> None:
    QUERIES[name], ORACLES[name] = run, sql


def _pick(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values)).cast("int") + 1)


def _picked(values, key: str) -> str:
    return f"[{', '.join(repr(x) for x in values)}][({key} % {len(values)})::int + 1]"


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier is a source, but for every ninth; a fourth of them name no attribution."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").where(k % 9 != 0).select(
        F.col("s_name").alias("source_id"), k.alias("ordinal"), _pick(_ADAPTERS, k).alias("adapter"), (k % 24).alias("min_poll_hours"), F.when(k % 4 != 0, F.concat(F.lit("By "), "s_name")).alias("attribution")
    )


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sources that ran have given: the lines of each supplier, but for every seventh."""
    k = F.col("s_suppkey")
    lines = table(spark, sf_dir, "lineitem").where("l_suppkey % 7 <> 3").groupBy("l_suppkey").agg(
        F.count("*").alias("fetched"), F.count_if(F.col("l_linenumber") < 6).alias("normalized"), F.count_if(F.col("l_linenumber") >= 6).alias("quarantined"), F.count_if((F.col("l_linenumber") < 6) & (F.col("l_quantity") > 25)).alias("matched"),
        F.min("l_shipdate").cast("timestamp_ntz").alias("attempted_at"), F.max("l_shipdate").cast("timestamp_ntz").alias("completed_at"),
    )
    status = F.when(k % 5 == 0, "failure").when(k % 5 == 1, "skipped").otherwise("success")
    named = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("source_id"), _pick(_ADAPTERS, k).alias("adapter"), status.alias("status"), F.when(k % 10 == 1, "disabled").alias("skip_reason"))
    return lines.join(named, F.col("l_suppkey") == k).drop("l_suppkey")


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).where("status = 'failure'").select(
        "source_id", F.concat(F.lit("HTTP "), (F.col("s_suppkey") % 3 + 500).cast("string")).alias("message"), (F.col("s_suppkey") % 3 + 500).alias("http_status"), F.lit(3).alias("attempts"), (F.col("s_suppkey") % 2 == 0).alias("retryable")
    )


_STATS_SQL = f"""with st as (select s_suppkey as k, s_name as source_id, {_picked(_ADAPTERS, 's_suppkey')} as adapter, case s_suppkey % 5 when 0 then 'failure' when 1 then 'skipped' else 'success' end as status,
 case when s_suppkey % 10 = 1 then 'disabled' end as skip_reason, min(l_shipdate)::timestamp as attempted_at, max(l_shipdate)::timestamp as completed_at, count(*) as fetched, count(*) filter (where l_linenumber < 6) as normalized,
 count(*) filter (where l_linenumber >= 6) as quarantined, count(*) filter (where l_linenumber < 6 and l_quantity > 25) as matched from lineitem join supplier on l_suppkey = s_suppkey where l_suppkey % 7 <> 3 group by all),
ca as (select s_name as source_id, s_suppkey as ordinal, {_picked(_ADAPTERS, 's_suppkey')} as adapter, s_suppkey % 24 as min_poll_hours, case when s_suppkey % 4 <> 0 then 'By ' || s_name end as attribution from supplier where s_suppkey % 9 <> 0)"""
add("a22_d06_manifest_sources", lambda s, d: R.manifest_sources(_stats(s, d), _catalog(s, d), _errors(s, d), "All rights"), f"""{_STATS_SQL}
select st.source_id, ca.ordinal, st.adapter, status, skip_reason, case when ca.source_id is null then 'Public job board listing' else coalesce(attribution, 'All rights') end as attribution, coalesce(min_poll_hours, 0) as min_poll_hours,
 attempted_at, completed_at, epoch_ms(completed_at) - epoch_ms(attempted_at) as duration_ms, fetched, normalized, quarantined, matched, case when status = 'failure' then 'HTTP ' || (500 + k % 3) end as message,
 case when status = 'failure' then 500 + k % 3 end as http_status, case when status = 'failure' then 3 end as attempts, case when status = 'failure' then k % 2 = 0 end as retryable from st left join ca using (source_id)""")


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda x: F.to_timestamp_ntz(F.lit(x))
    return R.manifest_run(_stats(spark, sf_dir), "run-1", at("2001-01-01 00:00:00"), at("2001-01-01 00:01:02.5"), F.lit("config"))


add("a22_manifest_run", _run, f"""{_STATS_SQL}, n as (select count(*) filter (where status <> 'skipped') as attempted, count(*) filter (where status = 'skipped') as skipped, count(*) filter (where status = 'success') as succeeded,
 count(*) filter (where status = 'failure') as failed, count(*) as sources from st)
select 'run-1' as run_id, 62500 as duration_ms, sha256('config') as config_sha256, attempted, skipped, succeeded, failed,
 case when sources > 0 and skipped = sources then 'all_cadence_skipped' when failed > 0 and succeeded = 0 then 'total_outage' when failed > 0 then 'partial' else 'success' end as status from n""")
add("a23_b23_source_table", lambda s, d: R.source_table(_catalog(s, d), _stats(s, d)), f"""{_STATS_SQL}
select ca.source_id, {_picked([R.BOARDS.get(x, x) for x in _ADAPTERS], 'ordinal')} || ' (' || ca.adapter || ')' as board, case when status is null then 'not run' when status = 'skipped' then 'skipped (' || coalesce(skip_reason, 'cadence') || ')' else status end as status,
 coalesce(attribution, 'Public job board listing') as attribution from ca left join st using (source_id)""")
_SHOWN = ("posting_id", "geo", "total", "company", "dedupe_key", "title", "level", "remote_scope", "freshness", "likely_expired", "geo_confidence")
add("a23_b23_listing_table", lambda s, d: R.listing_table(L.ranked(score_rows(s, d).select(*_SHOWN)), score_rows(s, d).where("posting_id % 3 = 0").select("dedupe_key")), f"""{SCORE_SQL},
r as (select *, row_number() over (partition by geo order by total desc, company, dedupe_key, posting_id) as tier_rank from scored)
select posting_id, case geo when 'eligible' then 'Nigeria-eligible' when 'verify' then 'Verify geo' else 'Likely excluded' end as tier, tier_rank, case when dedupe_key in (select dedupe_key from scored where posting_id % 3 = 0) then 'Seen' else 'New' end as status,
 company, title, case level when 'junior' then 'Junior' when 'mid' then 'Mid' when 'senior' then 'Senior' when 'staff_lead' then 'Staff/Lead' else 'Unknown' end as level,
 case remote_scope when 'global' then 'Global remote' when 'emea' then 'EMEA/regional' when 'regional' then 'Regional/restricted' else 'Remote (verify scope)' end as scope,
 printf('%.2f', total) as score, printf('%.2f', freshness) || case when coalesce(age > 75, false) then ' ⚠' else '' end as fresh, printf('%.2f', geo_confidence) as geo_conf from r""")


def _refreshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each year: the commits of a repository in it are added, those of December updated; a log read back."""
    year = F.substring("date", 1, 4)
    c = commits(spark, sf_dir).groupBy(year.alias("run_at"), "repo").agg(F.count("*").alias("commits_added"), F.count_if(F.substring("date", 6, 2) == "12").alias("commits_updated"))
    p = pulls(spark, sf_dir).groupBy(F.substring("created", 1, 4).alias("run_at"), "repo").agg(F.count("*").alias("pulls_added"), F.count_if("merged").alias("pulls_updated"))
    rows = c.join(p, ["run_at", "repo"], "full").withColumn("ok", (F.col("repo") % 10 != 3) | (F.col("run_at") < "2000"))
    path = f"{work_folder(spark)}/refresh-log-{uuid.uuid4().hex}"
    R.refresh_log(rows.where("run_at < '2001'")).write.mode("append").parquet(path)
    R.refresh_log(rows.where("run_at >= '2001'")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


add("a24_refresh_log", _refreshes, f"""{COMMITS_SQL}, a as (select "date"[:4] as run_at, repo, count(*) as ca, count(*) filter (where "date"[6:7] = '12') as cu from c group by all),
b as (select created[:4] as run_at, repo, count(*) as pa, count(*) filter (where merged) as pu from p group by all), j as (select *, repo % 10 <> 3 or run_at < '2000' as ok from a full join b using (run_at, repo))
select run_at, case when count(*) filter (where not ok) > 0 then case when count(*) filter (where ok) = 0 then 'failed' else 'partial' end else 'success' end as status, count(*) as repos,
 'commits+' || coalesce(sum(ca), 0) || ' commits~' || coalesce(sum(cu), 0) || ' prs+' || coalesce(sum(pa), 0) || ' prs~' || coalesce(sum(pu), 0) || case when count(*) filter (where not ok) > 0 then ' failed=' || count(*) filter (where not ok) else '' end as summary
from j group by run_at""")


def _fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("m"))
    k = F.col("c_custkey")
    return c.select("c_custkey").join(n, k == F.col("o_custkey"), "left").select(
        k.alias("repo"), (k % 2 == 0).alias("first_run"), (k % 5 != 0).alias("with_pulls"), (k % 3 * 8).alias("commit_limit"), (k % 4 * 3).alias("pull_limit"), F.coalesce("n", F.lit(0)).alias("commits_fetched"),
        F.coalesce("m", F.lit(0)).alias("pulls_fetched"), (k % 7 != 0).alias("commits_were_complete"), (k % 11 != 0).alias("pulls_were_complete"), (k % 13 == 0).alias("commits_cut"), (k % 17 == 0).alias("pulls_cut"),
    )


add("f17_completeness_flags", lambda s, d: V.completeness(_fetches(s, d)), """with n as (select c_custkey as k, count(o_orderkey) as n, count(*) filter (where o_orderstatus = 'F') as m from customer left join orders on o_custkey = c_custkey group by 1),
t as (select *, k % 3 > 0 and n >= k % 3 * 8 as ct, k % 5 <> 0 and k % 4 > 0 and m >= k % 4 * 3 as pt from n)
select k as repo, not ct and k % 13 <> 0 and case when k % 2 = 0 then k % 3 = 0 else k % 7 <> 0 end as commits_complete,
 k % 17 <> 0 and (k % 5 = 0 or (not pt and case when k % 2 = 0 then k % 4 = 0 else k % 11 <> 0 end)) as pulls_complete, ct or k % 13 = 0 as commits_truncated, pt or k % 17 = 0 as pulls_truncated from t""")


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when(F.col("l_orderkey") % 9 == 0, "no date").when(F.col("l_orderkey") % 9 == 1, F.lit(None)).otherwise(F.col("date"))
    return commits(spark, sf_dir).select("repo", "sha", bad.alias("date")).distinct()


add("g07_commit_order", lambda s, d: _dated(s, d).select("repo", "sha", F.row_number().over(Window.partitionBy("repo").orderBy(*V.commit_order())).alias("nth")), f"""{COMMITS_SQL},
u as (select distinct repo, sha, case l_orderkey % 9 when 0 then 'no date' when 1 then null else "date" end as "date" from c)
select repo, sha, row_number() over (partition by repo order by coalesce(try_cast("date" as date), date '1970-01-01') desc, sha) as nth from u""")
add("g11_language_order", lambda s, d: table(s, d, "part").groupBy(F.col("p_type").alias("language")).agg(F.sum("p_size").alias("bytes")).select("language", F.row_number().over(Window.orderBy(F.desc("bytes"), "language")).alias("nth")),
    "select p_type as language, row_number() over (order by sum(p_size) desc, p_type) as nth from part group by 1")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of commits and titles of pull requests, with a topic for a few of them."""
    k = F.col("l_orderkey")
    c = commits(spark, sf_dir).select("repo", F.concat_ws(" ", "subject", F.when((k + F.col("repo")) % 300 == 0, _pick(_TOPICS, k))).alias("text"))
    return c.unionByName(pulls(spark, sf_dir).select("repo", F.concat(F.lit("Pull "), F.when(F.col("number") % 500 == 7, _pick(_TOPICS, F.col("number"))).otherwise("it")).alias("text")))


add("b15_f14_repo_themes", lambda s, d: V.repo_themes(_texts(s, d)).select("repo", F.array_join("themes", ",").alias("themes")), f"""{COMMITS_SQL},
t as (select repo, lower(subject || case when (l_orderkey + repo) % 300 = 0 then ' ' || {_picked(_TOPICS, 'l_orderkey')} else '' end) as text from c union all
 select repo, lower('Pull ' || case when number % 500 = 7 then {_picked(_TOPICS, 'number')} else 'it' end) from p),
w as (select unnest([{", ".join(f"'{x}'" for x in THEMES)}]) as theme)
select repo, array_to_string(list_sort(list(distinct theme)), ',') as themes from t join w on regexp_matches(text, '\\b' || theme || '\\b') group by 1""")


def _artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    note = F.concat(_pick(("see /home/ada/out", "file C:\\ada\\x", "share \\\\host\\x", "https://ada:pw@example.com/a/b", "no path and/or "), k), k.cast("string"), F.lit(" now"))
    rows = table(spark, sf_dir, "orders").select(k, F.struct(F.lit("/home/ada/out").alias("out_dir"), note.alias("note"), F.col("o_orderpriority").alias("kind")).alias("artefact"))
    return rows.select("o_orderkey", X.redact_leaves("artefact", ["note", "kind"]).alias("a")).select("o_orderkey", F.to_json("a").alias("artefact"))


add("b21_nested_redaction", _artefacts, """select o_orderkey, '{"note":"' || case o_orderkey % 5 when 0 then 'see [redacted-path]' when 1 then 'file [redacted-path]' when 2 then 'share [redacted-path]'
 when 3 then 'https://example.com/a/b' || o_orderkey else 'no path and/or ' || o_orderkey end || ' now","kind":"' || o_orderpriority || '"}' as artefact from orders""")


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("posting_id")
    dirty = F.concat("title", F.when(k % 3 == 0, F.lit("\r\nA\rB\x07")).otherwise(F.lit("\x00\t\n")), F.lit("\\*b\\_c\\.\\d \\|"))
    return raw_postings(spark, sf_dir).select("posting_id", X.one_line(dirty).alias("line"), X.unescape_markdown(dirty).alias("plain")).select("posting_id", F.md5("line").alias("line"), F.md5("plain").alias("plain"))


add("b22_text_cleaning", _cleaned, f"""with {RAW_SQL} select posting_id, md5(title || case when posting_id % 3 = 0 then chr(10) || 'A' || chr(10) || 'B' else chr(9) || chr(10) end || '\\*b\\_c\\.\\d \\|') as line,
 md5(encode(title) || case when posting_id % 3 = 0 then '\\x0D\\x0AA\\x0DB\\x07'::blob else '\\x00\\x09\\x0A'::blob end || encode('*b_c.\\d |')) as plain from raw""")


def _backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    hits = o.select(k.alias("job_id"), F.when(k % 5 == 0, F.concat(F.lit("Hit "), k)).otherwise("Unknown").alias("company"))
    other = o.where(k % 4 == 1).select(k.alias("job_id"), F.when(k % 3 == 0, "Unknown").otherwise(F.concat(F.lit("Second "), k)).alias("company"))
    detail = o.where(k % 7 != 2).select(k.alias("job_id"), F.when(k % 7 == 3, F.concat(F.lit("Detail "), k)).alias("company"), F.when(k % 2 == 0, F.concat(F.lit("https://boards.greenhouse.io/big-firm"), k, F.lit("/jobs/1"))).otherwise("https://example.com/x").alias("apply_url"))
    return D.enrich(hits, other, detail).select("job_id", "company")


add("d05_company_backfill", _backfilled, """with t as (select o_orderkey as k from orders)
select k as job_id, coalesce(case when k % 5 = 0 then 'Hit ' || k end, case when k % 4 = 1 and k % 3 <> 0 then 'Second ' || k end, case when k % 7 = 3 then 'Detail ' || k end,
 case when k % 7 <> 2 and k % 2 = 0 then 'Big Firm' || k end, 'Unknown') as company from t""")


def _marks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Three landings of events, each a run of one stream: late rows go to a side table, then watermarks move, written last."""
    path = f"{work_folder(spark)}/marks-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp_ntz").alias("ts"), (F.col("event_type") != "error").alias("complete"), (F.col("event_id") % 3).alias("part"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        marks = s.read.parquet(f"{path}/marks/{batch_id - 1}") if batch_id else s.createDataFrame([], "key long, at timestamp_ntz")
        held = batch.join(marks, "key").where(F.expr("ts < at - interval 1 hour"))
        held.select("key", "ts").write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        jobs.advance_watermarks(marks, batch).write.mode("overwrite").parquet(f"{path}/marks/{batch_id}")

    for k in range(3):
        rows.where(F.col("part") == k).drop("part").write.mode("append").parquet(f"{path}/landed")
        stream = spark.readStream.schema("key long, ts timestamp_ntz, complete boolean").parquet(f"{path}/landed")
        jobs.run_available(stream, "marks", sink, checkpoint=f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/marks/2"), spark.read.parquet(f"{path}/late")


_MARKS_SQL = """with e as (select user_id as key, ts, event_type <> 'error' as complete, event_id % 3 as b from events), s as (select key, b, max(ts) as new, bool_and(complete) as whole from e group by all),
m0 as (select key, case when whole then new end as "at" from s where b = 0),
m1 as (select key, case when whole then greatest("at", new) else "at" end as "at" from m0 full join (from s where b = 1) using (key)),
m2 as (select key, case when whole then greatest("at", new) else "at" end as "at" from m1 full join (from s where b = 2) using (key)),
late as (select e.key, ts from e join m0 on e.key = m0.key and b = 1 and ts < "at" - interval 1 hour union all select e.key, ts from e join m1 on e.key = m1.key and b = 2 and ts < "at" - interval 1 hour)"""
add("j04_watermark_table", lambda s, d: _marks(s, d)[0].select("key", "at"), f'{_MARKS_SQL} select key, "at" from m2')
add("j03_late_rows", lambda s, d: _marks(s, d)[1].groupBy("key").agg(F.count("*").alias("n"), F.min("ts").alias("first")), f'{_MARKS_SQL} select key, count(*) as n, min(ts) as "first" from late group by 1')
