"""Queries of feed adapters, discovery and streams on payloads that Spark makes of the tables, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import uuid

from tallyrook.operators import discovery as D
from tallyrook.operators import state as S
from tallyrook.operators.listings import Policy, legacy_key
from tallyrook.plans.derived import RAW_SQL, raw_postings, table
from tallyrook.plans.listing_queries import entities_sql, norm_sql, strip_sql, trim_sql
from tallyrook.session import materialize, work_folder
from tallyrook.sources import feeds
from tallyrook.streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def _pages(rows: DataFrame, record, wrap: str | None) -> DataFrame:
    """Payloads of 20 records; record: a struct column. Every 17th record lacks its title."""
    out = rows.withColumn("r", record).groupBy(F.floor(F.col("posting_id") / 20).cast("int").alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("posting_id", "r"))), lambda x: x["r"]).alias("a"))
    body = F.to_json(F.struct(F.col("a").alias(wrap))) if wrap else F.to_json("a")
    return out.select(F.lit("feed").alias("source_id"), "page", body.alias("payload"))


def _title():
    return F.when(F.col("posting_id") % 17 != 0, F.col("title"))


def _day():
    return F.date_format("posted_at", "yyyy-MM-dd")


def _numbered(names: tuple[str, str, str, str, str]):
    t, c, g, d, p = names
    return lambda: F.struct(F.col("posting_id").alias("id"), "url", _title().alias(t), F.col("company").alias(c), F.nullif("location", F.lit("")).alias(g), F.col("description").alias(d), _day().alias(p))


_FEEDS = {
    "a02_jobicy": ("jobicy", _numbered(("jobTitle", "companyName", "jobGeo", "jobDescription", "pubDate")), "jobs"),
    "a03_remotive": ("remotive", _numbered(("title", "company_name", "candidate_required_location", "description", "publication_date")), "jobs"),
    "a01_himalayas": ("himalayas", lambda: F.struct(F.col("posting_id").cast("string").alias("guid"), _title().alias("title"), F.col("company").alias("companyName"), "description", F.col("url").alias("applicationLink"), _day().alias("pubDate"), F.when(F.col("location") == "", F.array().cast("array<string>")).otherwise(F.array("location")).alias("locationRestrictions")), "jobs"),
    "a04_arbeitnow": ("arbeitnow", lambda: F.struct(F.col("posting_id").cast("string").alias("slug"), F.col("company").alias("company_name"), _title().alias("title"), "description", (F.col("location") == "").alias("remote"), "url", "location", F.unix_timestamp(_day(), "yyyy-MM-dd").alias("created_at")), "data"),
    }
_PLACE = {"a01_himalayas": "Worldwide"}


def _parsed(name: str, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    adapter, record, wrap = _FEEDS[name]
    return feeds.ADAPTERS[adapter](_pages(raw_postings(spark, sf_dir), record(), wrap))


for _name in _FEEDS:
    add(_name, lambda s, d, n=_name: _parsed(n, s, d)[0].select("source_job_id", "company", "title", "url", "location", "description", F.date_format("posted_at", "yyyy-MM-dd").alias("posted")), f"""with {RAW_SQL}
select posting_id::varchar as source_job_id, trim(company) as company, title, url, case when location = '' then '{_PLACE.get(_name, 'Remote')}' else location end as location, description, strftime(posted_at, '%Y-%m-%d') as posted from raw where posting_id % 17 <> 0""")  # fmt: skip


def _remoteok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings, among them metadata records, spam, records without a listing url and such with a number as id."""
    k = F.col("posting_id")
    record = F.struct(
        F.when(k % 13 != 0, k).alias("id"), F.when(k % 13 == 0, F.concat(F.lit("slug-"), k)).alias("slug"), F.when(k % 19 == 0, "terms apply").alias("legal"), F.when(k % 5 == 0, k).alias("last_updated"),
        F.when(k % 23 != 0, F.col("company")).alias("company"), _title().alias("position"), F.when(k % 29 == 0, "<p>This is a <b>beta feature</b> to avoid spam applicants</p>").otherwise(F.col("description")).alias("description"),
        F.nullif("location", F.lit("")).alias("location"), F.when(k % 31 != 0, F.col("url")).alias("url"), F.when(k % 3 == 0, F.concat(F.lit("https://apply.example/"), k)).alias("apply_url"), _day().alias("date"),
    )
    return _pages(raw_postings(spark, sf_dir), record, None)


_REMOTEOK_SQL = f"""with {RAW_SQL}, r as (select *, case when posting_id % 29 = 0 then '<p>This is a <b>beta feature</b> to avoid spam applicants</p>' else description end as body from raw where posting_id % 19 <> 0),
j as (select *, case when posting_id % 17 = 0 or posting_id % 23 = 0 or posting_id % 31 = 0 then 'missing_fields' when regexp_matches({strip_sql('body')}, 'beta feature to avoid spam applicants', 'i') then 'low_quality' end as reason from r)"""
add("a05_remoteok", lambda s, d: feeds.remoteok(_remoteok(s, d))[0].select("source_job_id", "company", "title", "url", "location", F.md5("description").alias("text_md5"), F.date_format("posted_at", "yyyy-MM-dd").alias("posted")), f"""{_REMOTEOK_SQL}
select case when posting_id % 13 = 0 then 'slug-' || posting_id else posting_id::varchar end as source_job_id, {trim_sql(entities_sql('company'))} as company, {trim_sql(entities_sql('title'))} as title, case when posting_id % 3 = 0 then 'https://apply.example/' || posting_id else url end as url,
 case when location = '' then 'Remote' else location end as location, md5({strip_sql('body')}) as text_md5, strftime(posted_at, '%Y-%m-%d') as posted from j where reason is null""")
add("c20_metadata_and_spam", lambda s, d: feeds.remoteok(_remoteok(s, d))[1].groupBy("reason").agg(F.count("*").alias("n"), F.min("identifier").alias("least")), f"""{_REMOTEOK_SQL}
select reason, count(*) as n, min(case when posting_id % 13 = 0 then 'slug-' || posting_id else posting_id::varchar end) as least from j where reason is not null group by 1""")
add("a13_quarantine", lambda s, d: feeds.quarantine_report(_parsed("a02_jobicy", s, d)[1]).select("reason", "n"), f"with {RAW_SQL} select 'missing_fields' as reason, count(*) as n from raw where posting_id % 17 = 0")


def _rss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_postings(spark, sf_dir)
    item = F.concat(F.lit("<item><title>"), F.trim("company"), F.lit(": "), "title", F.lit("</title><link>"), "url", F.lit("</link><region>"), "location", F.lit("</region><description><![CDATA["), "description", F.lit("]]></description></item>"))
    out = rows.groupBy(F.floor(F.col("posting_id") / 30).cast("int").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("posting_id", item.alias("i")))), lambda x: x["i"]), "").alias("b"))
    return out.select(F.lit("rss").alias("source_id"), "page", F.concat(F.lit("<rss><channel>"), "b", F.lit("</channel></rss>")).alias("payload"))


add("a06_rss", lambda s, d: feeds.wwr(_rss(s, d))[0].select("company", "title", "url", "location"), f"""with {RAW_SQL}, k as (select *, row_number() over (partition by url order by posting_id) as nth from raw)
select trim(company) as company, title, url, case when location = '' then 'Remote' else location end as location from k where nth = 1""")


def _graph(rows: DataFrame) -> DataFrame:
    """Entity graphs of raw listings: the firm is an entity of its own; every hit is mentioned twice."""
    urn = F.concat(F.lit("urn:x:company:"), (F.col("posting_id") % 40).cast("string"))
    hit = F.to_json(F.struct(F.concat(F.lit("urn:x:posting:"), F.col("posting_id").cast("string")).alias("entityUrn"), "title", urn.alias("companyUrn")))
    firm = F.to_json(F.struct(urn.alias("entityUrn"), F.concat(F.lit("Firm "), (F.col("posting_id") % 40).cast("string")).alias("name")))
    out = rows.groupBy(F.floor(F.col("posting_id") / 10).cast("int").alias("payload_id")).agg(F.sort_array(F.collect_list(hit)).alias("h"), F.sort_array(F.collect_set(firm)).alias("f"))
    body = F.concat(F.lit('{"included":['), F.array_join(F.concat("h", "f"), ","), F.lit('],"data":{"elements":['), F.array_join("h", ","), F.lit("]}}"))
    return out.select("payload_id", body.alias("payload"))


add("a09_entity_graph_hits", lambda s, d: D.search_hits(_graph(raw_postings(s, d))).select("job_id", "title", "company", "page"), f"with {RAW_SQL} select posting_id::varchar as job_id, title, 'Firm ' || (posting_id % 40) as company, (posting_id // 10)::int as page from raw")
add("f20_hits_by_page", lambda s, d: D.hits_by_page(D.search_hits(_graph(raw_postings(s, d)))), f"with {RAW_SQL} select (posting_id // 10)::int as page, count(*) as n from raw group by 1")


def _details(rows: DataFrame) -> DataFrame:
    """Payloads of raw listings that say how to apply at depths of two to six, and whose firm is the payload's own, an included one's or nobody's."""
    k = F.col("posting_id")
    onsite = F.to_json(F.struct(F.lit("x.ComplexOnsiteApply").alias("type")))
    own = F.to_json(F.struct(F.struct(F.lit("https://www.linkedin.com/x").alias("companyApplyUrl")).alias("applyMethod")))
    link = F.to_json(F.struct(F.lit("x.OffsiteApply").alias("type"), F.struct(F.col("url").alias("url")).alias("offsiteApply")))
    way = F.concat(F.lit('{"applyMethod":'), F.when(k % 4 == 0, onsite).otherwise(link), F.lit("}"))
    for depth in range(4):  # the deeper, the rarer; another way lies behind, later in the payload's order
        way = F.when(k % 5 > depth, F.concat(F.lit('{"z":{"noise":[1,"{}"]},"list":['), own, F.lit(","), way, F.lit(']}'))).otherwise(way)
    posting = F.concat(F.lit('{"entityUrn":"urn:x:jobPosting:'), k, F.lit('","formattedLocation":'), F.to_json(F.array("location")).substr(F.lit(2), F.length(F.to_json(F.array("location"))) - 2), F.lit(',"description":'), F.to_json(F.struct(F.col("description").alias("text"))), F.lit(',"nested":'), way, F.lit("}"))
    firm = F.concat(F.lit('{"entityUrn":"urn:x:company:'), k, F.lit('","name":'), F.substring(F.to_json(F.array(F.trim("company"))), F.lit(2), F.length(F.to_json(F.array(F.trim("company")))) - 2), F.lit("}"))
    later = F.lit('{"applyMethod":{"companyApplyUrl":"https://late.example/"}}')
    body = F.concat(F.lit('{"included":['), posting, F.when(k % 3 == 0, F.concat(F.lit(","), firm)).otherwise(""), F.lit(','), later, F.lit('],"data":{}}'))
    return rows.select(k.cast("string").alias("job_id"), body.alias("payload"))


add("a10_entity_graph_details", lambda s, d: D.details(_details(raw_postings(s, d))), f"""with {RAW_SQL} select posting_id::varchar as job_id, case when posting_id % 3 = 0 then trim(company) end as company, nullif(location, '') as location, description,
 case when posting_id % 4 <> 0 then url end as apply_url, posting_id % 4 = 0 as easy_apply_only from raw""")


def _funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_postings(spark, sf_dir)
    hits, _ = materialize(D.search_hits(_graph(raw)), "hits")  # two hit sets read it
    rows = D.enrich(hits, hits, D.details(_details(raw)))
    return D.funnel(D.judged(rows, Policy(), ["board"], ("example.com",), ["Firm 7"]))


add("f19_discovery_funnel", _funnel, None)


# streams over the events table
def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


add("j02_stream_dedupe", lambda s, d: jobs.collected(jobs.deduplicated(_stream(s, d), "event_id", "ts"), "j02").select("event_id", "user_id"), "select event_id, user_id from events")
add("j05_stream_first_last_seen", lambda s, d: jobs.collected(jobs.first_last_seen(_stream(s, d), ["user_id"], "ts"), "j05", "complete").select("user_id", F.unix_micros("first_seen_at").alias("a"), F.unix_micros("last_seen_at").alias("b")),
    "select user_id, epoch_us(min(ts)) as a, epoch_us(max(ts)) as b from events group by 1")
add("j08_stream_timeline", lambda s, d: jobs.collected(jobs.daily(_stream(s, d), "ts", "event_type"), "j08", "complete").groupBy(F.date_format("day", "yyyy-MM").alias("month"), "event_type").agg(F.sum("n").alias("n")),
    "select strftime(ts, '%Y-%m') as month, event_type, count(*) as n from events group by all")
add("j09_stream_run_metrics", lambda s, d: jobs.collected(_outcomes(s, d), "j09", per_batch=jobs.batch_outcome), """with l as (select user_id % 7 as s, arg_max(event_type, event_id) = 'error' as bad from events group by 1)
select count(*) as attempted, 0 as skipped, count(*) filter (where not bad) as succeeded, count(*) filter (where bad) as failed,
 case when count(*) filter (where bad) = 0 then 'success' when count(*) filter (where not bad) = 0 then 'total_outage' else 'partial' end as status from l""")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir).select(F.concat(F.lit("src"), (F.col("user_id") % 7).cast("string")).alias("source_id"), F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("status"), F.col("event_id").alias("ordinal"))


def _comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hiring threads of 20 comments: `Firm | Role | Place`, plain sentences, and some that are too short."""
    k = F.col("posting_id")
    text = F.when(k % 11 == 0, "gone").when(k % 4 == 1, F.concat(F.lit("We are hiring right now: "), "title")).otherwise(
        F.concat(F.trim("company"), F.lit(" | "), "title", F.lit(" |"), "location", F.lit("<p>"), "description", F.lit("<p>Mail us - soon.")))
    child = F.struct(k.alias("id"), F.concat(F.lit("u"), k % 7).alias("author"), text.alias("text"))
    out = raw_postings(spark, sf_dir).groupBy(F.floor(k / 20).cast("int").alias("page")).agg(F.array_sort(F.collect_list(child)).alias("children"))
    body = F.to_json(F.struct(F.col("page").cast("long").alias("id"), F.lit("Ask: Who is hiring").alias("title"), F.lit("2001-05-01T00:00:00Z").alias("created_at"), "children"))
    return out.select(F.lit("thread").alias("source_id"), "page", body.alias("payload"))


_COMMENTS_SQL = f"""with {RAW_SQL},
c as (select *, case when posting_id % 4 = 1 then 'We are hiring right now: ' || title else trim(company) || ' | ' || title || ' |' || location || '<p>' || description || '<p>Mail us - soon.' end as said from raw where posting_id % 11 <> 0),
b as (select *, {entities_sql('said')} as body from c), l as (select *, {trim_sql("string_split_regex(body, '\n|<p>')[1]")} as line from b)"""
add("a07_thread_comments", lambda s, d: feeds.hn_hiring(_comments(s, d))[0].select("source_job_id", "company", "title", "url", "location", F.md5("description").alias("text_md5")), f"""{_COMMENTS_SQL}
select (posting_id // 20) || '-' || posting_id as source_job_id, case when posting_id % 4 = 1 then 'u' || (posting_id % 7) else trim(split_part(line, '|', 1)) end as company, case when posting_id % 4 = 1 then line else trim(split_part(line, '|', 2)) end as title,
 'https://news.ycombinator.com/item?id=' || posting_id as url, case when regexp_matches(body, '\\bremote\\b', 'i') then 'Remote' else 'Verify geo' end as location, md5({strip_sql('body')}) as text_md5 from l""")


def _merged_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of each source, where the ticked lines of one key come again and again."""
    k = F.col("posting_id")
    text = F.concat(F.when(k % 3 == 0, "- [x] ").otherwise("- [ ] "), F.trim("company"), F.lit(" — "), F.replace("title", F.lit("."), F.lit("\\.")), F.lit(" — https://example.com/"), k.cast("string"))
    lines = feeds.applied_lines(raw_postings(spark, sf_dir).select(F.concat(F.lit("report-"), "source_id").alias("path"), k.alias("line_no"), text.alias("text")))
    return S.merge_applied(lines.withColumn("key", legacy_key()))


add("e14_applied_merge", _merged_applied, f"""with {RAW_SQL}, a as (select 'report-' || source_id as path, posting_id as line_no, trim(company) as company, title, 'https://example.com/' || posting_id as url,
  {norm_sql('trim(company)')} || '::' || {norm_sql('title')} as key from raw where posting_id % 3 = 0),
n as (select *, row_number() over (partition by key order by path, line_no) as nth, count(*) over (partition by key) as c from a), r as (select key, count(distinct path) as reports from a group by 1)
select n.key, path, line_no, company, title, url, reports from n join r using (key) where nth = 1""")


def _kept(spark: SparkSession, stream: DataFrame, name: str, empty: str, step) -> DataFrame:
    """A table kept by a stream: each batch makes the next version of it from the last one, which is read back."""
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    spark.createDataFrame([], empty).write.parquet(f"{path}/version=0")

    def sink(batch: DataFrame, batch_id: int) -> None:
        step(spark.read.parquet(f"{path}/version={batch_id}"), batch).write.mode("overwrite").parquet(f"{path}/version={batch_id + 1}")
        done.append(batch_id + 1)

    done = [0]
    jobs.run_available(stream, name, sink)
    return spark.read.parquet(f"{path}/version={max(done)}")


def _ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads as they land in a folder, through an adapter, into a table of listings."""
    path = f"{work_folder(spark)}/landed-{uuid.uuid4().hex}"
    _pages(raw_postings(spark, sf_dir), _FEEDS["a02_jobicy"][1](), "jobs").write.parquet(path)
    stream = spark.readStream.schema("source_id string, page int, payload string").parquet(path)
    return jobs.collected(stream, "j01", per_batch=lambda b: feeds.jobicy(b)[0].select("source_job_id", "title"))


add("j01_stream_ingest", _ingest, f"with {RAW_SQL} select posting_id::varchar as source_job_id, title from raw where posting_id % 17 <> 0")
add("j03_stream_watermarks", lambda s, d: _kept(s, _stream(s, d).select((F.col("user_id") % 97).alias("key"), "ts", (F.col("event_type") != "error").alias("complete")), "j03", "key long, at timestamp", jobs.advance_watermarks).select("key", F.unix_micros("at").alias("at")),
    "select user_id % 97 as key, case when bool_and(event_type <> 'error') then epoch_us(max(ts)) end as at from events group by 1")
add("j04_stream_late_rows", lambda s, d: jobs.collected(_stream(s, d), "j04", per_batch=lambda b: jobs.late_rows(b, "ts", F.lit("2024-01-15 00:00:00").cast("timestamp"))).select("event_id"),
    "select event_id from events where ts < timestamp '2024-01-15'")
_LIFE = "disposition string, key string, company string, title string, url string, at timestamp, source_report string"


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    what = F.when(F.col("user_id") % 3 == 0, "applied").when(F.col("user_id") % 3 == 1, "dismissed").otherwise("expired")
    name, none = F.concat(F.lit("k"), F.col("user_id").cast("string")), F.lit(None).cast("string")
    return _stream(spark, sf_dir).select(what.alias("disposition"), name.alias("key"), none.alias("legacy_key"), none.alias("legacy_url_key"), F.lit("c").alias("company"), F.lit("t").alias("title"), F.lit("u").alias("url"), F.col("ts").alias("at"), F.lit("r").alias("source_report"))


add("j06_stream_lifecycle", lambda s, d: _kept(s, _decisions(s, d), "j06", _LIFE, S.transition).select("disposition", "key", F.unix_micros("at").alias("at")),
    "select ['applied', 'dismissed', 'expired'][(user_id % 3)::int + 1] as disposition, 'k' || user_id as key, epoch_us(min(ts)) as at from events group by all")


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three landings of decisions, each a run of one stream: a key's decision changes with each landing that has it."""
    path, part, done = f"{work_folder(spark)}/moves-{uuid.uuid4().hex}", F.col("event_id") % 3, [0]
    what = F.element_at(F.array(*map(F.lit, S.DISPOSITIONS)), ((F.col("user_id") + part) % 3).cast("int") + 1)
    name, none = F.concat(F.lit("k"), F.col("user_id").cast("string")), F.lit(None).cast("string")
    rows = table(spark, sf_dir, "events").select(part.alias("part"), what.alias("disposition"), name.alias("key"), none.alias("legacy_key"), none.alias("legacy_url_key"), F.lit("c").alias("company"), F.lit("t").alias("title"), F.lit("u").alias("url"), F.col("ts").cast("timestamp").alias("at"), F.lit("r").alias("source_report"))
    spark.createDataFrame([], _LIFE).write.parquet(f"{path}/state/version=0")

    def sink(batch: DataFrame, batch_id: int) -> None:
        S.transition(batch.sparkSession.read.parquet(f"{path}/state/version={batch_id}"), batch).write.mode("overwrite").parquet(f"{path}/state/version={batch_id + 1}")
        done.append(batch_id + 1)

    landed = rows.drop("part")
    for k in range(3):
        rows.where(F.col("part") == k).drop("part").write.mode("append").parquet(f"{path}/landed")
        jobs.run_available(spark.readStream.schema(landed.schema).parquet(f"{path}/landed"), "moves", sink, checkpoint=f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/state/version={max(done)}")


add("j06_lifecycle_moves", lambda s, d: _moves(s, d).select("disposition", "key", F.unix_micros("at").alias("at")), """with e as (select user_id as u, event_id % 3 as p, ts from events), l as (select u, max(p) as p from e group by 1)
select ['applied', 'dismissed', 'expired'][((u + p) % 3)::int + 1] as disposition, 'k' || u as key, epoch_us(min(ts)) as at from e join l using (u, p) group by u, p""")
