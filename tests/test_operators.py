from datetime import datetime

from pyspark.sql import functions as F

from tallyrook.operators import evidence as V
from tallyrook.operators import listings as L
from tallyrook.operators import metrics as M
from tallyrook.operators import resolve as E
from tallyrook.operators import state as S
from tallyrook.operators.components import connected_components

_RAW = "posting_id long, source_id string, adapter string, source_job_id string, company string, title string, url string, location string, description string, posted_at timestamp_ntz"


def raw(spark, *rows):
    base = dict(source_id="s1", adapter="b", source_job_id=None, company="Firm", title="React Engineer", url="", location="", description="", posted_at=None)
    return spark.createDataFrame([(i, *{**base, **r}.values()) for i, r in enumerate(rows)], _RAW)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3), (200, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_resolution_is_transitive_and_ignores_order(spark):
    rows = [
        dict(source_id="a", url="https://x.com/1?utm_a=1"), dict(source_id="b", url="https://x.com/1", source_job_id="9"), dict(source_id="c", url="https://y.com/2", source_job_id="9"),
        dict(source_id="a", company="Other", url="https://z.com"), dict(source_id="b", company="Other", title="React  engineer"),
        dict(source_id="a", company="Third"), dict(source_id="a", company="Third"), dict(source_id="b", company="Third"), dict(source_id="a", company="日本", title="開発"), dict(source_id="b", company="中国", title="工程"),
    ]
    want = {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9}
    df = L.with_identity(L.normalize(raw(spark, *rows)))
    for d in (df, df.orderBy(F.desc("posting_id"))):
        members = E.entities(d)
        assert {r.posting_id: r.entity_id for r in members.collect()} == want
    top = E.merged(df, members).where("entity_id = 0").first()
    assert (top.members, top.url, top.source_ids) == (3, "https://x.com/1", ["a", "b", "c"])


def test_classifiers(spark):
    rows = [
        dict(location="Home based - Worldwide"), dict(location="Remote - EMEA"), dict(location="Remote - EMEA", description="Lagos, Nigeria"), dict(location="Hybrid"),
        dict(title="Engineering Manager"), dict(title="Staff React Engineer", location="Worldwide"), dict(title="Software Engineer", description="React", location="Remote"),
    ]
    got = L.apply_policy(L.normalize(raw(spark, *rows)), L.Policy(allowed_levels=("unknown",))).orderBy("posting_id").collect()
    assert [r.remote_scope for r in got[:4]] == ["global", "emea", "emea", "regional"]
    assert [r.geo for r in got[:4]] == ["eligible", "verify", "eligible", "excluded"]
    assert [r.reason for r in got] == [None, None, None, "region, hybrid or on-site signals", "role mismatch", "level not allowed: staff_lead", None]


def test_freshness_steps(spark):
    days = [0, 7, 7.5, 14, 30, 45, 75, 76, -3, None]
    rows = spark.createDataFrame([(None if x is None else float(x),) for x in days], "age double").withColumn("age", F.when(F.col("age").isNotNull(), F.greatest(F.lit(0.0), "age")))
    assert [r[0] for r in rows.select(L.freshness(F.col("age"))).collect()] == [1.0, 1.0, 0.9, 0.9, 0.75, 0.55, 0.35, 0.15, 1.0, 0.4]


def test_state_is_idempotent(spark):
    df = L.with_identity(L.normalize(raw(spark, dict(url="https://x.com/1"), dict(company="B"))))
    empty = spark.createDataFrame([], "profile string, key string, company string, title string, url string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz")
    at = lambda d: F.lit(datetime(2024, 1, d)).cast("timestamp_ntz")
    once = S.upsert_seen(empty, df, "p", at(1))
    twice = S.upsert_seen(once, df, "p", at(2))
    assert [(r.key, r.first_seen_at.day, r.last_seen_at.day) for r in twice.orderBy("key").collect()] == [("b::react engineer", 1, 2), ("url::https://x.com/1", 1, 2)]
    assert {r.status for r in S.split_seen(df, once, "p").collect()} == {"seen"} and {r.status for r in S.split_seen(df, once, "q").collect()} == {"new"}


def test_lifecycle_transition(spark):
    cols = "disposition string, key string, company string, title string, url string, at int, source_report string"
    state = spark.createDataFrame([("dismissed", "old", "c", "t", "u", 1, "r"), ("applied", "k2", "c", "t", "u", 1, "r")], cols)
    entries = spark.createDataFrame([("applied", "k1", "old", None, "c", "t", "u", 5, "r2"), ("applied", "k2", "x", None, "c", "t", "u", 9, "r2")], "disposition string, key string, legacy_key string, legacy_url_key string, company string, title string, url string, at int, source_report string")
    once = S.transition(state, entries)
    want = [("applied", "k1", 5), ("applied", "k2", 1)]
    assert sorted((r.disposition, r.key, r["at"]) for r in once.collect()) == want
    assert sorted((r.disposition, r.key, r["at"]) for r in S.transition(once, entries).collect()) == want


def test_upgrade_rejects_unknown_versions(spark):
    import pytest

    old = spark.createDataFrame([(2, "k")], "schema_version int, key string")
    got = S.upgrade(old, {2: {"profile": F.lit("front")}}, 3).first()
    assert (got.schema_version, got.profile) == (3, "front")
    with pytest.raises(Exception, match="unknown state version"):
        S.upgrade(spark.createDataFrame([(9, "k")], "schema_version int, key string"), {2: {"profile": F.lit("front")}}, 3).collect()


def test_upsert_deltas(spark):
    prior = spark.createDataFrame([("r", "1", "a"), ("r", "2", "b")], "repo string, sha string, subject string")
    new = spark.createDataFrame([("r", "2", "B"), ("r", "3", "c"), ("r", "3", "c")], "repo string, sha string, subject string")
    once = V.upsert(prior, new, ["repo", "sha"], ["subject"])
    assert {r.sha: r.op for r in once.collect()} == {"1": "kept", "2": "updated", "3": "added"}
    assert {r.op for r in V.upsert(once.drop("op"), new, ["repo", "sha"], ["subject"]).collect()} == {"kept", "unchanged"}


def test_run_outcomes(spark):
    for statuses, want in ((["skipped"] * 2, "all_cadence_skipped"), (["failure", "skipped"], "total_outage"), (["failure", "success"], "partial"), (["success"], "success"), ([], "success")):
        df = spark.createDataFrame([(str(i), s) for i, s in enumerate(statuses)], "source_id string, status string")
        assert M.run_outcome(df).first().status == want
