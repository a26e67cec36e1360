"""Queries of joins, orders, watermarks, sinks and state streams on derived inputs, with DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyrook.operators import evidence as V
from tallyrook.operators import metrics as M
from tallyrook.operators import state as S
from tallyrook.plans.derived import RAW_SQL, raw_postings, table
from tallyrook.plans.evidence_queries import COMMITS_SQL, commits, pulls

from tallyrook.session import work_folder
from tallyrook.sources import feeds
from tallyrook.streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def _threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("thread_id"), F.when(k % 7 == 3, F.concat(F.lit("Ask: Who is Hiring "), k)).otherwise("Show: a thing").alias("title"), (1000000 - k).alias("pos"))


add("a08_thread_selection", lambda s, d: feeds.hiring_thread(_threads(s, d)), "select max(o_orderkey) as thread_id from orders where o_orderkey % 7 = 3")


def _raw_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("repo"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("sha"), F.concat(F.lit("Fix "), k, F.lit("\nlong text")).alias("message"),
        F.when(k % 3 != 0, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("author_date"), F.lit("2000-01-01").alias("committer_date"), F.when(k % 2 == 0, "").otherwise("Ada").alias("author_name"), F.lit("ada-l").alias("author_login"),
    )


add("a11_commit_projection", lambda s, d: V.project_commits(_raw_commits(s, d)), "select l_partkey as repo, concat_ws('-', l_orderkey, l_linenumber, l_suppkey) as sha, 'Fix ' || l_orderkey as subject, case when l_orderkey % 3 <> 0 then strftime(l_shipdate, '%Y-%m-%d') else '2000-01-01' end as \"date\", case when l_orderkey % 2 = 0 then 'ada-l' else 'Ada' end as author from lineitem")


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    body = F.when(k % 5 == 0, '{"jobs": {}}').when(k % 5 == 1, "no json").when(k % 5 == 2, "{}").otherwise('{"jobs": []}')
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), k % 10).alias("source_id"), k.alias("page"), body.alias("payload"))


add("a12_shape_guard", lambda s, d: feeds.shape_errors(_payloads(s, d), "jobs"), "select distinct 's' || (o_orderkey % 10) as source_id from orders where o_orderkey % 5 < 3")


def _old_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select((k % 2 + 2).cast("int").alias("schema_version"), k.cast("string").alias("key"), F.when(k % 2 == 1, "back").alias("profile"))
    return S.upgrade(rows, {2: {"profile": F.lit("front")}}, 3)


add("a14_state_upgrade", _old_state, "select 3 as schema_version, o_orderkey::varchar as \"key\", case when o_orderkey % 2 = 1 then 'back' else 'front' end as profile from orders")


def _old_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 1 knew applied listings only."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select((k % 2 + 1).cast("int").alias("schema_version"), k.cast("string").alias("key"), F.when(k % 2 == 1, F.when(k % 3 == 0, "dismissed").otherwise("expired")).alias("disposition"))
    return S.upgrade(rows, {1: {"disposition": F.lit("applied")}}, 2)


add("a14_lifecycle_upgrade", _old_lifecycle, "select 2 as schema_version, o_orderkey::varchar as \"key\", case when o_orderkey % 2 = 0 then 'applied' when o_orderkey % 3 = 0 then 'dismissed' else 'expired' end as disposition from orders")


def _old_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 1 had one flat table of sources, which was the default profile's."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select((k % 2 + 1).cast("int").alias("schema_version"), F.col("s_name").alias("source_id"), F.when(k % 2 == 1, "back").alias("profile"))
    return S.upgrade(rows, {1: {"profile": F.lit("front")}}, 2)


add("a14_poll_upgrade", _old_polls, "select 2 as schema_version, s_name as source_id, case when s_suppkey % 2 = 1 then 'back' else 'front' end as profile from supplier")


def _old_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first discovery state bore no version."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.when(k % 2 == 1, 1).alias("v"), k.alias("state_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("last_run_at"))
    return S.upgrade(rows.withColumn("schema_version", F.coalesce("v", F.lit(0))).drop("v"), {0: {}}, 1)


add("a14_discovery_upgrade", _old_discovery, "select 1 as schema_version, o_orderkey as state_id, strftime(o_orderdate, '%Y-%m-%d') as last_run_at from orders")
#: Names of a run's files: fixed values.
ARTIFACTS = {"report": "report.md", "scan_result": "scan-result.json", "manifest": "manifest.json"}


def _old_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 1 pointed to a folder by its path, version 2 by its name and the names of its files."""
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "orders").select(
        (k % 2 + 1).cast("int").alias("schema_version"), k.alias("run_id"), F.when(k % 2 == 0, F.concat(F.lit("/out/front/run-"), k, F.when(k % 4 == 0, "/").otherwise(""))).alias("output_dir"),
        F.when(k % 2 == 1, F.concat(F.lit("run-"), k)).alias("run_dir_name"), *[F.when(k % 2 == 1, F.lit(v)).otherwise(none).alias(c) for c, v in ARTIFACTS.items()],
    )
    step = {"run_dir_name": F.regexp_extract("output_dir", "([^/]+)/*$", 1)} | {c: F.lit(v) for c, v in ARTIFACTS.items()}
    return S.upgrade(rows, {1: step}, 2).drop("output_dir")


add("a14_pointer_upgrade", _old_pointers, f"select 2 as schema_version, o_orderkey as run_id, 'run-' || o_orderkey as run_dir_name, {', '.join(f"'{v}' as {c}" for c, v in ARTIFACTS.items())} from orders")


def _old_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older index: arrays under another name, malformed records among them, histories to be fetched again."""
    k = F.col("o_orderkey")
    record = F.struct(F.when(k % 4 != 0, F.concat(F.lit("sha"), k)).alias("sha"), F.concat(F.lit("s"), k).alias("subject"))
    rows = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("repo")).agg(F.collect_list(record).alias("sample"))
    rows = rows.select("repo", F.lit(3).alias("schema_version"), F.lit(None).cast("array<struct<sha:string,subject:string>>").alias("commits"), "sample", F.lit(True).alias("complete"))
    whole = F.filter(F.coalesce("commits", "sample"), lambda c: c["sha"].isNotNull() & c["subject"].isNotNull())
    return S.upgrade(rows, {3: {"commits": whole, "complete": F.lit(False)}}, 4).select("repo", F.size("commits").alias("n"), "complete", "schema_version")


add("a15_index_upgrade", _old_index, "select o_custkey % 50 as repo, count(*) filter (where o_orderkey % 4 <> 0) as n, false as complete, 4 as schema_version from orders group by 1")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    base = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("source_id"), F.lit("jobicy").alias("adapter"), (k % 3 != 0).alias("enabled"), (k % 24).alias("min_poll_hours"),
        F.create_map(F.lit("query"), F.lit("all"), F.lit("pages"), k.cast("string")).alias("options"),
        F.create_map(F.lit("front"), F.when(k % 2 == 0, F.create_map(F.lit("query"), F.lit("react"))).otherwise(F.create_map().cast("map<string,string>"))).alias("profile_options"),
    )
    return feeds.source_dimension(base, "front", ["query", "pages"])


add("a16_source_dimension", _sources, "select s_name as source_id, 'jobicy' as adapter, s_suppkey % 24 as min_poll_hours, case when s_suppkey % 2 = 0 then 'react' else 'all' end as query, s_suppkey::varchar as pages from supplier where s_suppkey % 3 <> 0")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("posting_id")
    text = F.concat(F.when(k % 3 == 0, "- [x] ").otherwise("- [ ] "), F.trim("company"), F.lit(" — "), F.replace("title", F.lit("."), F.lit("\\.")), F.lit(" — https://example.com/"), k.cast("string"))
    return raw_postings(spark, sf_dir).select(F.lit("report").alias("path"), k.alias("line_no"), text.alias("text"))


add("a18_applied_lines", lambda s, d: feeds.applied_lines(_lines(s, d)), f"with {RAW_SQL} select 'report' as path, posting_id as line_no, trim(company) as company, title, 'https://example.com/' || posting_id as url from raw where posting_id % 3 = 0")


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by run, then the state that counts them: read back, the state is never ahead of the results."""
    path, run = f"{work_folder(spark)}/runs-{uuid.uuid4().hex}", "run-1"
    rows = raw_postings(spark, sf_dir).select("posting_id", "source_id", F.lit(run).alias("run_id"))
    rows.write.partitionBy("run_id").mode("append").parquet(f"{path}/results")
    written = spark.read.parquet(f"{path}/results").where(F.col("run_id") == run)
    written.groupBy("run_id", "source_id").agg(F.count("*").alias("n"), F.sha2(F.lit("config"), 256).alias("config_sha256")).write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


add("a20_a22_result_and_manifest_sinks", _published, f"with {RAW_SQL} select 'run-1' as run_id, source_id, count(*) as n, sha256('config') as config_sha256 from raw group by source_id")
add("d06_catalog_join", lambda s, d: table(s, d, "supplier").select("s_suppkey", "s_nationkey").join(table(s, d, "nation").where("n_nationkey % 4 <> 0"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("no attribution")).alias("attribution")),
    "select s_suppkey, coalesce(n_name, 'no attribution') as attribution from supplier left join (select * from nation where n_nationkey % 4 <> 0) on s_nationkey = n_nationkey")


def _refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    prior = c.where(k % 5 != 0).select(k.alias("repo"), F.lit("main").alias("branch"), F.concat(F.lit("p"), k).alias("pushed_at"))
    outcome = c.where(k % 3 != 0).select(k.alias("repo"), (k % 4 != 0).alias("ok"), F.when(k % 2 == 0, "").otherwise("dev").alias("branch"), F.concat(F.lit("n"), k).alias("pushed_at"))
    return V.refresh(c.select(k.alias("repo")), prior, outcome)


add("d07_d08_prior_fallback", _refresh, """with c as (select c_custkey as k, c_custkey % 5 <> 0 as p, c_custkey % 3 <> 0 and c_custkey % 4 <> 0 as ok from customer)
select k as repo, case when ok then coalesce(case when k % 2 = 1 then 'dev' end, case when p then 'main' end) when p then 'main' end as branch, case when ok then 'n' || k when p then 'p' || k end as pushed_at, case when ok then 'fetched' else 'prior' end as "from" from c""")
add("f06_quarantine_totals", lambda s, d: M.quarantine_totals(table(s, d, "orders").select(F.col("o_orderstatus").alias("reason"), F.col("o_orderpriority").alias("category"))),
    "select o_orderstatus as reason, o_orderpriority as category, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())")


def _repo_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = commits(spark, sf_dir).groupBy("repo").agg(F.count("*").alias("n"))
    at = lambda x: F.to_timestamp_ntz(F.lit(x))
    rows = n.select("repo", (F.col("repo") % 6 != 0).alias("ok"), (F.col("n") >= 125).alias("truncated"), at("2001-01-01 00:00:00").alias("last_indexed"), at("2001-02-01 00:00:00").alias("run_at"))
    return V.next_watermark(rows).withColumn("since", V.since(F.col("last_indexed"), F.col("ok") & ~F.col("truncated")))


add("f17_i_watermark_and_since", lambda s, d: _repo_runs(s, d).select("repo", "last_indexed", "since"), f"""{COMMITS_SQL}, n as (select repo, repo % 6 <> 0 and count(*) < 125 as whole from c group by 1)
select repo, case when whole then timestamp '2001-02-01' else timestamp '2001-01-01' end as last_indexed, case when whole then timestamp '2001-01-31 23:00:00' end as since from n""")
add("f18_full_index", lambda s, d: _repo_runs(s, d).agg(F.bool_and(F.expr("ok and not truncated")).alias("full"), F.bool_or("truncated").alias("truncation_warning")),
    f"{COMMITS_SQL}, n as (select repo % 6 <> 0 as ok, count(*) >= 125 as t from c group by repo) select bool_and(ok and not t) as \"full\", bool_or(t) as truncation_warning from n")
add("g07_pull_order", lambda s, d: pulls(s, d).select("repo", "number", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("created"), "number")).alias("nth")),
    f"{COMMITS_SQL} select repo, number, row_number() over (partition by repo order by created desc, number) as nth from p")
add("g10_bounded_lists", lambda s, d: V.capped(pulls(s, d), "repo", [F.desc("created"), F.asc("number")], 8).select("repo", "number"),
    f"{COMMITS_SQL} select repo, number from p qualify row_number() over (partition by repo order by created desc, number) <= 8")


def _poll_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poll state kept by a stream: each batch upserts the state table, which is written last."""
    path = f"{work_folder(spark)}/poll-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    empty = "profile string, source_id string, last_attempt_at timestamp_ntz, last_success_at timestamp_ntz, last_failure_at timestamp_ntz, last_error string"

    def sink(batch: DataFrame, batch_id: int) -> None:
        state = spark.createDataFrame([], empty) if batch_id == 0 else spark.read.parquet(f"{path}/{batch_id - 1}")
        S.upsert_poll(state, poll_updates_of(batch)).write.mode("overwrite").parquet(f"{path}/{batch_id}")

    jobs.run_available(stream, "poll", sink)
    done = max(int(x.getPath().getName()) for x in spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(path)))
    return spark.read.parquet(f"{path}/{done}")


def poll_updates_of(events: DataFrame) -> DataFrame:
    return events.where("event_type in ('error', 'signup', 'click')").select(
        F.lit("front").alias("profile"), F.concat(F.lit("src"), (F.col("user_id") % 7).cast("string")).alias("source_id"), F.col("event_id").alias("ordinal"),
        F.col("ts").cast("timestamp_ntz").alias("at"), (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type") == "error", F.concat(F.lit("failed "), "event_id")).alias("error"),
    )


add("j07_j10_poll_state_stream", lambda s, d: _poll_stream(s, d).select("source_id", "last_attempt_at", F.col("last_error")),
    "select 'src' || (user_id % 7) as source_id, arg_max(ts, event_id) as last_attempt_at, case when arg_max(event_type, event_id) = 'error' then 'failed ' || max(event_id) end as last_error from events where event_type in ('error', 'signup', 'click') group by 1")
