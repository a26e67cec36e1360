"""Joins of tables that grow together: dealt by key, whatever the planner takes a compressed file's size for."""

from pyspark.sql import functions as F

from tallyrook.operators import listings as L
from tallyrook.operators import state as S
from tallyrook.session import materialize

_ROWS = "posting_id long, dedupe_key string, legacy_key string, aliases array<string>, company string, title string, url string"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_states_are_not_broadcast(spark):
    rows = materialize(spark.createDataFrame([(i, f"u{i}", f"c{i}", [f"u{i}", f"c{i}"], "c", "t", "u") for i in range(20)], _ROWS), "rows")[0]
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    seen = materialize(rows.where("posting_id % 2 = 0").select(F.lit("p").alias("profile"), F.col("legacy_key").alias("key"), "company", "title", "url", at.alias("first_seen_at"), at.alias("last_seen_at")), "seen")[0]
    life = materialize(rows.where("posting_id % 3 = 0").select(F.lit("applied").alias("disposition"), F.col("dedupe_key").alias("key")), "life")[0]
    parts = S.partition_active(rows, seen, life, "p")
    assert "Broadcast" not in _plan(parts)
    assert {(r.posting_id, r.status, r.disposition) for r in parts.collect()} == {(i, "new" if i % 2 else "seen", None if i % 3 else "applied") for i in range(20)}
    assert "Broadcast" not in _plan(S.upsert_seen(seen, rows, "p", at))
    ranked = L.ranked(rows.withColumns({"geo": F.lit("g"), "total": F.col("posting_id") / 10}))
    assert _plan(ranked).count("BroadcastHashJoin") <= 1  # the parts' counts
    assert {r.posting_id: r.tier_rank for r in ranked.collect()} == {i: 20 - i for i in range(20)}


def test_one_row_group_is_dealt_before_the_work(spark, tmp_path):
    from tallyrook.operators import metrics as M
    from tallyrook.plans import derived

    # one row group of many splits: all its rows would be read, and judged, by one task
    spark.range(4000).selectExpr("id as o_orderkey", "id % 5 as o_custkey", "timestamp '2001-01-01' as o_orderdate").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(5).selectExpr("id as c_custkey", "concat('Customer ', id) as c_name").write.parquet(f"{tmp_path}/customer.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        rows = derived.raw_postings(spark, str(tmp_path))
        judged = rows.withColumn("reason", F.when(F.col("title").rlike("Engineer"), F.col("location")))
        tasks = judged.where("reason is not null").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(tasks) >= spark.sparkContext.defaultParallelism
    assert {(r.reason, r.n) for r in M.count_by(judged, "reason").collect()} == {(r.reason, r.n) for r in judged.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).collect()}
    assert M.count_by(judged, "reason").where("reason is null").count() == 0


def test_texts_keep_their_normal_form(spark):
    from tallyrook.functions import rules as R
    from tallyrook.functions import text as X

    texts = [None, "", " ", "  a\tb \n", "<p>a  b</p>\n\n<br />c &amp;lt; d\t", "A  B--cé _/+.", "x &#65; &#x42;", "a b  c", "no markup", "a \n b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    ws, t = X.WS, F.col("t")
    decoded = X.decode_entities(t)
    old = rows.select(
        F.regexp_replace(t, f"^{ws}+|{ws}+$", "").alias("a"), F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), r"[^A-Za-z0-9_/+.-]+", " "), " +", " ")).alias("b"),
        F.regexp_replace(F.regexp_replace(decoded, f"{ws}+", " "), f"^{ws}+|{ws}+$", "").alias("c"),
    )
    new = rows.select(X.trimmed(t).alias("a"), X.normalize_text(t).alias("b"), X.clean_text(t).alias("c"))
    assert new.collect() == old.collect()
    assert rows.select(X.strip_html(t).alias("s")).collect()[4].s == "a b\nc &lt; d"
    assert R.pattern(("react", "(?:us|u\\.s\\.) only")).startswith("(?i)(?=[ru])") and "(?=" not in R.pattern(("a?b", "c"))


def test_walk_by_name_leaves_out_what_cant_have_it(spark):
    from tallyrook.operators.discovery import details
    from tallyrook.operators.nested import walk

    payload = '{"a":{"b":{"noise":[1,{}]}},"c":{"d":[{"\\u0061pplyMethod":{"companyApplyUrl":"https://x.example/"}}]},"e":{"applyMethod":{"type":"OnsiteApply"}}}'
    rows = spark.createDataFrame([("1", payload), ("2", "{}"), ("3", None)], "job_id string, payload string")
    assert sorted((r.job_id, list(r.path)) for r in walk(rows, "job_id", "payload", "applyMethod").collect()) == [("1", []), ("1", [1]), ("1", [1, 0]), ("1", [1, 0, 0]), ("1", [2])]
    assert {(r.job_id, r.apply_url, r.easy_apply_only) for r in details(rows).collect()} == {("1", "https://x.example/", False), ("2", None, False), ("3", None, False)}


def test_details_take_one_pass_however_deep(spark, monkeypatch):
    """No table a level; what Spark's parser doesn't take has nothing; payloads of one job are joined, half surrogates are written."""
    from tallyrook.operators import discovery, nested

    def no_level(*_):
        raise AssertionError("a pass for a level")

    monkeypatch.setattr(nested, "materialize", no_level)
    way = '{"applyMethod":{"companyApplyUrl":"https://x.example/"}}'
    deep = '{"name":"A\\ud800","a":[1,[' + '{"b":[' * 400 + '{"applyMethod":"none"},' + way + "]}" * 400 + "]]}"
    rows = [(1, deep), (2, '{"n":NaN,"a":' + way + "}"), (3, '{"a":1,"a":' + way + "}"), (4, way + " and more"), (5, '{"z":{"z":' + way + '}}'), (5, '{"companyName":"Firm","z":{"applyMethod":{"type":"OnsiteApply"}}}'), (6, "")]
    got = {r.job_id: (r.company, r.apply_url, r.easy_apply_only) for r in discovery.details(spark.createDataFrame(rows, "job_id long, payload string")).collect()}
    none = (None, None, False)
    assert got == {1: ("A?", "https://x.example/", False), 2: none, 3: none, 4: (None, "https://x.example/", False), 5: ("Firm", "https://x.example/", False), 6: none}
    types = '{"included":[{"entityUrn":{"of":"organization"},"name":" "},{"type":["x.Company"],"universalName":{"text":" By name "}},{"$type":"JobPosting","type":"x","companyName":"Later","descriptionText":"About"}]}'
    assert discovery.details(spark.createDataFrame([(1, types)], "job_id long, payload string")).collect() == [(1, "By name", None, "About", None, False)]


def test_hits_read_a_payload_once(spark, monkeypatch):
    """Firms and hits come from one reading; the funnel makes its listings and its hits once."""
    from tallyrook.operators.discovery import search_hits
    from tallyrook.plans import feed_queries

    payload = '{"included":[{"entityUrn":"urn:j:1","title":"A","companyUrn":"c:1"},{"entityUrn":"c:1","name":"Z"},{"entityUrn":"c:1","name":"B"},{"entityUrn":"urn:j:2","title":"T","name":"N"},{"entityUrn":"urn:j:3","title":"U","companyUrn":"c:2","companyName":"Own"},{"title":"no job"},{"name":"no urn"},7],"data":{"elements":[{"entityUrn":"urn:j:1","title":"again"}]}}'
    hits = search_hits(spark.createDataFrame([(1, payload), (2, '{"included":[{"entityUrn":"urn:j:4","title":"V","companyUrn":"c:1"}]}'), (3, "no")], "payload_id int, payload string"))
    assert sorted(map(tuple, hits.collect())) == [("1", "A", "B", 1), ("2", "T", "Unknown", 1), ("3", "U", "Own", 1), ("4", "V", "Unknown", 2)]
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Join" not in plan

    made, own = [], feed_queries.raw_postings
    monkeypatch.setattr(feed_queries, "raw_postings", lambda *x: (made.append(x), own(*x))[1])
    row = feed_queries.QUERIES["f19_discovery_funnel"](spark, "/root/testdata/sf0.001")
    assert "Generate" not in row._jdf.queryExecution().optimizedPlan().toString() and len(made) == 1
    assert row.first()["raw"] == 1500


def test_ranking_writes_only_what_orders(spark, monkeypatch):
    from tallyrook.plans import catalog

    written = []
    monkeypatch.setattr(L, "materialize", lambda df, tag: (written.append(set(df.columns)), materialize(df, tag))[1])
    assert catalog.QUERIES["g06_rank"](spark, "/root/testdata/sf0.001").count() == 1500
    assert written[0] == {"posting_id", "geo", "total", "company", "dedupe_key"}
    catalog.QUERIES["a23_b23_listing_table"](spark, "/root/testdata/sf0.001")
    assert not {"description", "aliases", "reasons", "url"} & written[-2]


def test_evidence_moves_once_however_many_terms_share_its_word(spark):
    """The deal by id comes before the terms; ids that repeat are one find, and terms of several words meet them in one."""
    from tallyrook.operators.corpus import evidence_search

    terms = spark.createDataFrame([("a", "fix"), ("b", "fix"), ("c", "fix"), ("c", "add"), ("d", "none")], "term string, word string")
    evidence = spark.createDataFrame(
        [("1", "Fix x", False, "2001"), ("1", "add y", True, "2000"), ("2", "FIX fix", True, "1999"), ("3", "add", False, "2002"), ("4", "other", True, "2003"), ("5", None, True, "2003")],
        "id string, text string, merged boolean, at string",
    )
    best, few = evidence_search(terms.hint("broadcast"), evidence, 2)
    assert sorted((r.term, r.id, r.nth) for r in best.collect()) == [("a", "1", 2), ("a", "2", 1), ("b", "1", 2), ("b", "2", 1), ("c", "1", 1), ("c", "2", 2)]
    assert sorted(r.term for r in few.collect()) == ["a", "b", "d"]
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan and "hashpartitioning(term#" in plan
    assert not [x for x in plan.splitlines() if "hashpartitioning(term" in x and ", id#" in x]


def test_commits_are_looked_up_as_they_come(spark, monkeypatch):
    """What buckets a landing touches is asked of its commits before they are made distinct: no row is dealt for it."""
    from tallyrook.operators.state_table import StateTable
    from tallyrook.plans import catalog

    plans, real = [], StateTable.touched

    def touched(self, keys):
        plans.append(keys._jdf.queryExecution().optimizedPlan().toString())
        return real(self, keys)

    monkeypatch.setattr(StateTable, "touched", touched)
    assert catalog.QUERIES["e08_commit_table"](spark, "/root/testdata/sf0.001").count() == 50
    assert len(plans) == 2 and not [p for p in plans if "Aggregate" in p]


def test_texts_of_any_character_keep_their_normal_form(spark):
    """Every character of the first planes' start: tables of single characters give what classes of ranges gave."""
    from tallyrook.functions import rules as R
    from tallyrook.functions import text as X

    t, ws, other = F.col("t"), X.WS, "[^A-Za-z0-9_/+.-]"
    chars = spark.range(1, 0x3100).where("id <> 38").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    rows = chars.select(F.explode(F.array(F.concat(F.lit("Ab"), "c", F.lit("9z")), F.concat("c", F.lit(" "), "c", "c", F.lit("x ")), F.concat(F.lit("x "), "c"))).alias("t"))
    blank = f"(?: (?={ws})|(?! ){ws}){ws}*"
    new = rows.select(t, X.normalize_text(t).alias("n"), X.clean_text(t).alias("c"), R.says(t, ("ab", "x")).alias("s"))
    odd = new.where(
        (F.col("n") != F.trim(F.regexp_replace(F.lower(t), f"{other}+", " "))) | (F.col("c") != X.trimmed(F.regexp_replace(t, blank, " ")))
        | (F.col("s") != t.rlike("(?i)(?<![A-Za-z0-9_])(?:ab|x)(?![A-Za-z0-9_])"))
    )
    assert new.where("n is null or c is null").isEmpty() and odd.collect() == []
    assert "A-Z" not in X.normalize_text(t)._jc.toString()  # ranges are tried one after the other, ten times slower


def test_url_quality_is_taken_once(spark):
    from tallyrook.functions import urls as U

    urls = ["https://x.com/?utm_a=1&b=2", "HTTP://x.com", "https://10.0.0.5/", "http://localhost", "ftp://x.com/A", "no url", ""]
    got = [tuple(r.q) for r in spark.createDataFrame([(u,) for u in urls], "u string").select(U.url_quality(F.col("u")).alias("q")).collect()]
    assert got == [
        (0, 1, 18, "https://x.com/?b=2", urls[0]), (1, 0, 13, "http://x.com/", urls[1]), (2, 0, 17, "https://10.0.0.5/", urls[2]), (3, 0, 17, "http://localhost/", urls[3]),
        (4, 0, 13, "ftp //x.com/a", urls[4]), (5, 0, 6, "no url", urls[5]), (5, 0, 0, "", ""),
    ]
    assert U.url_quality(F.col("u"))._jc.toString().count("array_sort") == 1


def test_a_runs_state_is_made_once(spark, monkeypatch):
    """What is stored first is written before its buckets are asked for: it isn't made again, and its rows aren't dealt, for that."""
    from tallyrook.operators.state_table import StateTable
    from tallyrook.plans import publish_queries

    class Done(Exception):
        pass

    def touched(self, keys):
        assert "Aggregate" not in keys._jdf.queryExecution().optimizedPlan().toString()
        raise Done

    monkeypatch.setattr(StateTable, "touched", touched)
    try:
        publish_queries.published(spark, "/root/testdata/sf0.001")
    except Done:
        return
    raise AssertionError("no state was stored")


def test_only_shared_entities_are_merged(spark):
    """An entity of one listing is a projection of it, equal to what merging it gives; repeated listings are several."""
    from tallyrook.operators import resolve as E

    raw = [
        (1, "a", "b", "9", " Firm ", "Dev", "https://x.com/1", "Lagos", "long text", None), (2, "c", "b", "", "Firm Ltd", None, "http://x.com/1", "", "text", None),
        (3, "c", "b", None, " Other", "Lead", "HTTPS://y.com/?utm_a=1", None, "", None), (4, "c", "b", "", "", "", "", "", "", None), (5, None, None, "7", "E", "E", " ", "E", "E", None), (6, "a", "b", "3", "F", "F", None, "F", "F", None),
    ]
    rows = spark.createDataFrame(raw + [raw[5]], "posting_id long, source_id string, adapter string, source_job_id string, company string, title string, url string, location string, description string, posted_at timestamp_ntz")
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6)], "posting_id long, entity_id long")
    fields = ["entity_id", "members", "company", "title", "location", "description", "url", "source_ids", "remote_scope", "level", "adapter", "source_job_id", "dedupe_key", "legacy_key"]
    got = {r.entity_id: tuple(r)[1:] for r in E.merged(rows, members).select(*fields).collect()}
    assert got[1] == (2, "Firm Ltd", "Dev", "Lagos", "long text", "https://x.com/1", ["a", "c"], "regional", "unknown", "b", "9", "url::https://x.com/1", "firm ltd::dev")
    assert got[3] == (1, "Other", "Lead", "", "", "HTTPS://y.com/?utm_a=1", ["c"], "regional", "staff_lead", "b", None, "url::https://y.com/", "other::lead")
    assert got[4] == (1, "", "", "", "", None, ["c"], "regional", "unknown", "b", None, "::", "::")
    assert got[5][5:7] == ("", []) and got[5][9:] == (None, "7", "e::e", "e::e")
    assert got[6][0] == 2 and got[6][5] is None and len(got) == 5
    plan = E.merged(rows, members)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "Union" not in E.merged(rows, members).where("members > 1")._jdf.queryExecution().optimizedPlan().toString()
