import json

from tallyrook.sources import feeds
from tallyrook.streaming import jobs


def payloads(spark, *texts):
    return spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "source_id string, page int, payload string")


def test_numbered_feed(spark):
    ok, bad = feeds.jobicy(payloads(spark, json.dumps({"jobs": [{"id": 1, "url": "u", "jobTitle": "T", "companyName": "C", "jobExcerpt": "x"}, {"id": 2, "url": "u", "jobTitle": "", "companyName": "C"}]})))
    row = ok.first()
    assert (row.source_job_id, row.location, row.description) == ("1", "Remote", "x") and ok.count() == 1
    assert [r.reason for r in bad.collect()] == ["missing_fields"]


def test_places(spark):
    jobs_ = [{"title": "T", "companyName": "C", "locationRestrictions": x} for x in (None, [], ["A", "B"], ["A", 3])]
    ok, bad = feeds.himalayas(payloads(spark, json.dumps({"jobs": jobs_})))
    assert [r.location for r in ok.orderBy("ordinal").collect()] == ["Worldwide", "Worldwide", "A, B"]
    assert [r.reason for r in bad.collect()] == ["malformed"]


_JOB = {"id": "55", "company": "Acme", "position": "Backend Engineer", "description": "Build APIs.", "url": "https://e.com/55"}
#: record -> None (skipped), a reason, or some columns of the listing
REMOTEOK = [
    ({"legal": "terms", "last_updated": 1}, None),
    ({**_JOB, "legal": "terms"}, None),
    ({"last_updated": None}, None),
    ({"last_updated": 1, "company": " ", "id": 0, "slug": ""}, None),
    ({"legal": "", "position": "x"}, "missing_fields"),
    ({**_JOB, "last_updated": 1720000100}, {"source_job_id": "55"}),
    ({"last_updated": 1, "slug": "s"}, "missing_fields"),
    ({**_JOB, "description": ""}, {"description": ""}),
    ({k: v for k, v in _JOB.items() if k != "description"}, {"description": ""}),
    ({**_JOB, "description": "<p>A <b>Beta feature</b> to avoid spam applicants</p>"}, "low_quality"),
    ({**_JOB, "description": "There are no articles in this category"}, "low_quality"),
    ({**_JOB, "description": "A casino. Click here to win!"}, {"description": "A casino. Click here to win!"}),
    ({**_JOB, "url": None, "apply_url": "https://a.com"}, "missing_fields"),
    ({**_JOB, "url": 7}, "missing_fields"),
    ({**_JOB, "apply_url": "https://a.com"}, {"url": "https://a.com"}),
    ({**_JOB, "position": "R&amp;D  Lead ", "location": ""}, {"title": "R&D  Lead", "location": "Remote"}),
    ({**_JOB, "position": ["x"]}, "missing_fields"),
    ({**_JOB, "id": 101}, {"source_job_id": "101"}),
    ({**{k: v for k, v in _JOB.items() if k != "id"}, "slug": "s-1"}, {"source_job_id": "s-1"}),
    ({k: v for k, v in _JOB.items() if k != "id"}, {"source_job_id": "Acme-Backend Engineer"}),
    ("text", "malformed"), (None, "malformed"), (3, "malformed"), ([_JOB], "malformed"),
]


def judged(ok, bad, n):
    out = [None] * n
    for r in ok.collect():
        out[r.ordinal.pos] = r.asDict()
    for r in bad.collect():
        out[r.ordinal.pos] = r.reason
    return out


def agrees(got, want):
    return {k: got[k] for k in want} == want if isinstance(want, dict) and isinstance(got, dict) else got == want


def test_metadata_and_spam(spark):
    got = judged(*feeds.remoteok(payloads(spark, json.dumps([r for r, _ in REMOTEOK]))), len(REMOTEOK))
    assert [k for k, (_, want) in enumerate(REMOTEOK) if not agrees(got[k], want)] == []


def test_rss(spark):
    item = "<item><title>{}</title><link>{}</link><pubDate>Mon, 02 Jan 2023 10:00:00 +0000</pubDate></item>"
    ok, bad = feeds.wwr(payloads(spark, "<rss>" + item.format("Acme: Dev", "l1") + item.format("", "l1") + item.format("Dev", "l2") + item.format("", "l3") + "</rss>"))
    assert [(r.company, r.title, r.posted_at.day) for r in ok.orderBy("ordinal").collect()] == [("Acme", "Dev", 2), ("Unknown", "Dev", 2)]
    assert bad.count() == 1


_LONG = "and some more words to be long enough"
COMMENTS = [
    ({"id": 1, "author": "a", "text": f"Acme | Engineer | REMOTE<p>{_LONG}", "children": [{"id": 9, "author": "x", "text": _LONG}]}, {"source_job_id": "5-1", "company": "Acme", "title": "Engineer", "location": "Remote"}),
    ({"id": 2, "author": "b", "text": "short"}, "malformed"),
    ({"id": 3, "author": "c", "text": "we are hiring in Berlin, write to us"}, {"company": "c", "title": "we are hiring in Berlin, write to us", "location": "Verify geo"}),
    ({"id": 4, "author": "d", "text": f"- Firm - Role in town\n{_LONG}"}, {"company": "Firm", "title": "Role in town"}),
    ({"id": 5, "author": "e", "text": f"* Firm — Role\n{_LONG}"}, {"company": "Firm", "title": "Role"}),
    ({"id": 6, "author": "f", "text": f"Acme Co\n{_LONG}"}, {"company": "Acme Co", "title": "Engineering role"}),
    ({"id": 7, "author": "g", "text": f"X | | Berlin\n{_LONG}"}, {"company": "g", "title": "Engineering role"}),
    ({"id": 8, "author": "h", "text": f"Acme | R\n{_LONG}"}, "malformed"),
    ({"id": "9", "author": "i", "text": _LONG}, "missing_fields"),
    ({"id": 10, "text": _LONG}, "missing_fields"),
    ({"id": 11, "author": "j", "text": 7}, "missing_fields"),
    ({"id": 12, "author": "k", "text": None}, "malformed"),
    ({"id": 13, "author": "l", "text": "&#x41;&amp;&lt;&gt;&quot;&#39;&amp;&amp;"}, "malformed"),
    ({"id": 14, "author": "m", "text": f"A &amp; B | Remotely\n{_LONG}"}, {"company": "A & B", "title": "Remotely", "location": "Verify geo"}),
    ("text", "malformed"), (None, "malformed"),
]


def test_thread(spark):
    body = json.dumps({"id": 5, "title": "Ask", "created_at": "2024-01-01T00:00:00Z", "children": [c for c, _ in COMMENTS]})
    ok, bad = feeds.hn_hiring(payloads(spark, body))
    got = judged(ok, bad, len(COMMENTS))
    assert [(k, got[k]) for k, (_, want) in enumerate(COMMENTS) if not agrees(got[k], want)] == []
    assert {r.posted_at.day for r in ok.collect()} == {1}


def test_thread_selection(spark):
    hits = spark.createDataFrame([(1, "Who wants to be hired?", 0), (2, "Ask HN: Who is HIRING (May)", 1), (3, "who is hiring?", 2)], "thread_id long, title string, pos int")
    assert feeds.hiring_thread(hits).first().thread_id == 2


_FIRM = {"entityUrn": "urn:x:company:1", "name": " Acme "}
#: payload -> company, location, apply_url, easy_apply_only
DETAILS = [
    ({"companyName": "Own", "applyMethod": {"companyApplyUrl": "https://a.com"}}, ("Own", None, "https://a.com", False)),
    ({"applyMethod": {"$type": "x.ComplexOnsiteApply"}}, (None, None, None, True)),
    ({"applyMethod": {"$type": "x.OnsiteApply", "companyApplyUrl": "https://a.com"}}, (None, None, "https://a.com", False)),
    ({"applyMethod": {"offsiteApply": {"url": {"text": " https://b.com "}}}}, (None, None, "https://b.com", False)),
    ({"applyMethod": {"companyApplyUrl": "https://www.linkedin.com/x"}, "z": {"a": {"b": [{"c": {"applyMethod": {"type": "SimpleOnsiteApply"}}}]}}}, (None, None, None, True)),
    ({"z": {"z": {"z": {"z": {"applyMethod": {"companyApplyUrl": "https://deep.com"}}}}}, "a": {"applyMethod": {"companyApplyUrl": "https://later.com"}}}, (None, None, "https://deep.com", False)),
    ({"z": [{"applyMethod": "no object"}, "{\"applyMethod\": {\"companyApplyUrl\": \"https://text.com\"}}"]}, (None, None, None, False)),
    ({"included": [{"x": 1}, _FIRM], "data": {"formattedLocation": "Here"}}, ("Acme", "Here", None, False)),
    ({"data": {"companyName": "Not looked at", "included": [{"entityUrn": "urn:x:jobPosting:2", "companyName": "Poster", "locationDescription": {"text": "There"}}, _FIRM]}}, ("Poster", "There", None, False)),
    ({"name": "Root", "formattedLocation": "Root place", "included": [_FIRM]}, ("Root", "Root place", None, False)),
    ([1, 2], (None, None, None, False)), ("no object", (None, None, None, False)), (None, (None, None, None, False)),
]


def test_graph_details(spark):
    from tallyrook.operators.discovery import details

    rows = [(k, json.dumps(p)) for k, (p, _) in enumerate(DETAILS)] + [(98, "no json {"), (99, None)]
    got = {r.job_id: (r.company, r.location, r.apply_url, r.easy_apply_only) for r in details(spark.createDataFrame(rows, "job_id int, payload string")).collect()}
    assert {k: (got[k], want) for k, (_, want) in enumerate(DETAILS) if got[k] != want} == {}
    assert got[98] == got[99] == (None, None, None, False)


def test_walk_is_depth_first(spark):
    from tallyrook.operators.nested import walk

    text = '{"b": {"x": [1, {"y": {}}]}, "a": [[], {"z": "{}"}], "c": null}'
    got = [r.json for r in walk(spark.createDataFrame([(1, text), (2, "no"), (3, None)], "k int, j string"), "k", "j").orderBy("k", "path").collect()]
    assert [json.loads(x) for x in got[:-1]] == [json.loads(text), {"x": [1, {"y": {}}]}, [1, {"y": {}}], {"y": {}}, {}, [[], {"z": "{}"}], [], {"z": "{}"}]
    assert got[-1] == "no"


def test_shape_and_lines(spark):
    assert [r.source_id for r in feeds.shape_errors(payloads(spark, '{"x": 1}'), "jobs").collect()] == ["s"]
    lines = spark.createDataFrame([("p", 1, "- [x] A\\*B — Role — https://e.com/1"), ("p", 2, "- [ ] C — D — https://e.com/2")], "path string, line_no int, text string")
    assert [(r.company, r.url) for r in feeds.applied_lines(lines).collect()] == [("A*B", "https://e.com/1")]


def test_watermarks_need_complete_batches(spark):
    marks = spark.createDataFrame([("a", 1), ("b", 1)], "key string, at int")
    batch = spark.createDataFrame([("a", 5, True), ("b", 6, True), ("b", 7, False), ("c", 2, True)], "key string, ts int, complete boolean")
    assert {r.key: r["at"] for r in jobs.advance_watermarks(marks, batch).collect()} == {"a": 5, "b": 1, "c": 2}
