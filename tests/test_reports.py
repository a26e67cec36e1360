from pyspark.sql import functions as F

from tallyrook.operators import evidence as V
from tallyrook.operators import reports as R
from tallyrook.streaming import jobs

_STATS = "source_id string, adapter string, status string, skip_reason string, attempted_at timestamp_ntz, completed_at timestamp_ntz, fetched long, normalized long, quarantined long, matched long"
_ERRORS = "source_id string, message string, http_status int, attempts int, retryable boolean"


def test_manifest_of_failed_skipped_and_forgotten_sources(spark):
    rows = [("a", "jobicy", "failure", None), ("b", "wwr", "skipped", "cadence"), ("gone", "x", "success", None)]
    stats = spark.createDataFrame([(*r, None, None, 1, 1, 0, 1) for r in rows], _STATS)
    catalog = spark.createDataFrame([("b", 0, 6, None, "wwr"), ("a", 1, 12, "By a", "jobicy"), ("c", 2, 1, None, "new")], "source_id string, ordinal int, min_poll_hours int, attribution string, adapter string")
    errors = spark.createDataFrame([("a", "HTTP 503", 503, 3, True)], _ERRORS)
    got = R.manifest_sources(stats, catalog, errors, "All").collect()
    assert [(r.source_id, r.attribution, r.min_poll_hours, r.message, r.duration_ms) for r in got] == [
        ("b", "All", 6, None, 0), ("a", "By a", 12, "HTTP 503", 0), ("gone", R.ATTRIBUTION, 0, None, 0)
    ]
    run = R.manifest_run(stats, "r", F.to_timestamp_ntz(F.lit("2001-01-02 00:00:00")), F.to_timestamp_ntz(F.lit("2001-01-01 00:00:00")), F.lit("x")).first()
    assert (run.duration_ms, run.attempted, run.skipped, run.status) == (0, 2, 1, "partial")
    table = {r.source_id: (r.board, r.status) for r in R.source_table(catalog, stats).collect()}
    assert table == {"a": ("Jobicy (jobicy)", "failure"), "b": ("We Work Remotely (wwr)", "skipped (cadence)"), "c": ("new (new)", "not run")}
    assert R.manifest_sources(stats.limit(0), catalog, errors).count() == 0


def test_refresh_log_status(spark):
    schema = "run_at string, repo string, ok boolean, commits_added long, commits_updated long, pulls_added long, pulls_updated long"
    rows = [("1", "a", True, 2, 1, 0, None), ("1", "b", False, None, None, None, None), ("2", "a", False, 0, 0, 0, 0), ("3", "a", True, 1, 0, 3, 4)]
    got = {r.run_at: (r.status, r.repos, r.summary) for r in R.refresh_log(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"1": ("partial", 2, "commits+2 commits~1 prs+0 prs~0 failed=1"), "2": ("failed", 1, "commits+0 commits~0 prs+0 prs~0 failed=1"), "3": ("success", 1, "commits+1 commits~0 prs+3 prs~4")}


def test_completeness(spark):
    schema = "repo int, first_run boolean, with_pulls boolean, commit_limit int, pull_limit int, commits_fetched int, pulls_fetched int, commits_were_complete boolean, pulls_were_complete boolean, commits_cut boolean, pulls_cut boolean"
    rows = [
        (0, True, True, 0, 0, 9, 9, False, False, False, False), (1, True, True, 5, 5, 2, 5, False, False, False, False), (2, False, True, 5, 5, 2, 2, True, False, False, False),
        (3, False, False, 5, 5, 5, 9, True, False, False, False), (4, False, True, 0, 0, 1, 1, True, True, True, False),
    ]
    got = [tuple(r)[1:] for r in V.completeness(spark.createDataFrame(rows, schema)).orderBy("repo").collect()]
    assert got == [(True, True, False, False), (False, False, False, True), (True, False, False, False), (False, True, True, False), (False, True, True, False)]


def test_labels_and_themes(spark):
    row = spark.range(1).select(R.level_label(F.lit("staff_lead")), R.level_label(F.lit(None).cast("string")), R.scope_label(F.lit("unknown")), R.geo_label(F.lit(None).cast("string")), R.geo_label(F.lit("excluded"))).first()
    assert tuple(row) == ("Staff/Lead", "Unknown", "Remote (verify scope)", "Unknown", "Likely excluded")
    texts = spark.createDataFrame([("r", "React and data"), ("r", "data again"), ("s", None), ("t", "nothing")], "repo string, text string")
    assert [tuple(r) for r in V.repo_themes(texts).collect()] == [("r", ["data", "react"])]


def test_watermarks_move_only_on_complete_batches(spark):
    marks = spark.createDataFrame([("a", 5), ("b", 5), ("d", 9)], "key string, at long")
    batch = spark.createDataFrame([("a", 7, True), ("a", 8, True), ("b", 9, True), ("b", 7, False), ("c", 1, False), ("d", 3, True)], "key string, ts long, complete boolean")
    assert {r.key: r.at for r in jobs.advance_watermarks(marks, batch).collect()} == {"a": 8, "b": 5, "c": None, "d": 9}


def test_orphans_stand_between_the_header_and_the_first_section(spark):
    from tallyrook.operators import corpus as K

    texts = ["# N\nmail\n---\nlost\n\n---\nlost too\n## A\nkept\n---\nkept", "# N\n## A\n---\nkept", "N\n---\nnot judged", "# N\n---\r\nlost", "", None, "---", "\n \n# N\n---\n- x"]
    rows = K.orphans(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert sorted(map(tuple, rows)) == [(0, 4), (0, 7), (3, 3), (7, 5)]
    assert K.orphans(spark.createDataFrame([], "doc_id int, text string")).collect() == []


def test_unversioned_states_are_upgraded_and_unknown_versions_are_errors(spark):
    import pytest
    from pyspark.sql import functions as F

    from tallyrook.operators import state as S

    rows = spark.createDataFrame([(0, "a"), (1, "b")], "schema_version int, at string")
    assert sorted(map(tuple, S.upgrade(rows, {0: {}}, 1).select("schema_version", "at").collect())) == [(1, "a"), (1, "b")]
    with pytest.raises(Exception, match="unknown state version"):
        S.upgrade(rows, {1: {"profile": F.lit("front")}}, 2).collect()
