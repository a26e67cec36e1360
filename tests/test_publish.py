"""Published runs: sets, order of steps, runs that died, outages, one pass."""

import pytest
from pyspark.sql import functions as F

from tallyrook.operators import publish
from tallyrook.operators.publish import RunStore
from tallyrook.operators.state_table import StateTable
from tallyrook.plans.keyed_queries import _SEEN
from tallyrook.plans.state_queries import _STATE

_ROWS = "posting_id long, dedupe_key string, legacy_key string, aliases array<string>, company string, title string, url string, geo string, reason string, status string, disposition string, likely_expired boolean, tier_rank int"


def row(i, reason=None, status="new", disposition=None, geo="eligible"):
    return (i, f"url::{i}", f"c::{i}", [f"url::{i}", f"c::{i}"], "c", str(i), "u", geo, reason, status, disposition, i % 2 == 0, i)


@pytest.fixture
def store(spark, tmp_path):
    def make():
        seen = StateTable(spark, f"{tmp_path}/seen", _SEEN, ("key",), 4)
        return RunStore(spark, str(tmp_path), seen, StateTable(spark, f"{tmp_path}/polls", _STATE, ("source_id",), 4), "p", ("role",))

    return make


def rows(spark, *some):
    return spark.createDataFrame(list(some), _ROWS).withColumn("part", publish.part_of())


def attempts(spark, day, ok=True):
    return spark.createDataFrame([("s", 1, ok, None if ok else "no answer")], "source_id string, ordinal int, ok boolean, error string").withColumn("at", F.lit(f"2024-01-0{day}").cast("timestamp_ntz"))


def first(spark):
    return rows(spark, row(1), row(2, status="seen"), row(3, "role"), row(4, "other"), row(5, disposition="applied"), row(6, geo="verify"))


def seen_keys(s):
    return {(r.key, r.first_seen_at.day, r.last_seen_at.day) for r in s.seen.read().collect()}


def test_sets_and_numbers(spark, store):
    s = store()
    s.publish("run-1", "2024-01-01", first(spark), attempts(spark, 1))
    assert {n: sorted(r.posting_id for r in s.result(n).collect()) for n in publish.SETS} == {"ranked": [1, 2, 6], "new": [1, 6], "seen": [2], "excluded": [3, 4]}
    numbers = {r.metric: r.n for r in s.summary().collect()}
    assert numbers == {
        "rows": 6, "policy_matched": 4, "excluded": 2, "active": 3, "suppressed": 1, "new": 2, "seen": 1, "eligible": 2, "verify": 1, "likely_expired": 2, "applied": 1, "dismissed": 0, "expired": 0,
        "excluded: role": 1, "excluded for another reason": 1,
    }
    # suppressed rows are seen too, excluded ones aren't
    assert seen_keys(s) == {(f"url::{i}", 1, 1) for i in (1, 2, 5, 6)}
    assert s.latest() == "run-1"


def test_a_published_run_is_left_alone(spark, store):
    s = store()
    s.publish("run-1", "2024-01-01", first(spark), attempts(spark, 1))
    s.publish("run-1", "2024-01-05", rows(spark, row(9)), attempts(spark, 5))
    assert s.result("ranked").count() == 3 and seen_keys(s) == {(f"url::{i}", 1, 1) for i in (1, 2, 5, 6)}


def test_an_outage_advances_no_seen_state(spark, store):
    s = store()
    s.publish("run-1", "2024-01-01", first(spark), attempts(spark, 1))
    s.publish("run-2", "2024-01-02", rows(spark, row(1), row(8)), attempts(spark, 2, False))
    assert seen_keys(s) == {(f"url::{i}", 1, 1) for i in (1, 2, 5, 6)}
    poll = s.polls.read().first()
    assert (poll.last_attempt_at.day, poll.last_success_at.day, poll.last_failure_at.day, poll.last_error) == (2, 1, 2, "no answer")
    assert s.latest() == "run-2"


@pytest.mark.parametrize("step", ["commit", "advance", "seen", "point"])
def test_a_run_that_died_is_undone_or_finished(spark, store, monkeypatch, step):
    s = store()
    s.publish("run-1", "2024-01-01", first(spark), attempts(spark, 1))

    class Died(Exception):
        pass

    def die(*_):
        raise Died

    second = rows(spark, row(1, status="seen"), row(8))
    with monkeypatch.context() as m:
        if step == "seen":  # between the two states
            m.setattr(s.seen, "upsert", die)
        else:
            m.setattr(RunStore, step, die)
        with pytest.raises(Died):
            s.publish("run-2", "2024-01-02", second, attempts(spark, 2))
    assert s.latest() == "run-1" and s.result("ranked").count() == 3
    again = store()  # another driver
    again.recover()
    assert not again._names("staging")
    if step == "commit":  # it was staged only
        assert again.latest() == "run-1" and seen_keys(again) == {(f"url::{i}", 1, 1) for i in (1, 2, 5, 6)}
        again.publish("run-2", "2024-01-02", second, attempts(spark, 2))
    assert again.latest() == "run-2" and sorted(r.posting_id for r in again.result("ranked").collect()) == [1, 8]
    assert seen_keys(again) == {("url::1", 1, 2), ("url::8", 2, 2), ("url::2", 1, 1), ("url::5", 1, 1), ("url::6", 1, 1)}
    assert again.polls.read().first().last_attempt_at.day == 2


def test_rows_are_judged_once(spark, store):
    from pyspark.sql.functions import udf

    from tallyrook.plans.publish_queries import ranked_parts

    calls = spark.sparkContext.accumulator(0)

    @udf("string")
    def once(x):
        calls.add(1)
        return x

    judged = first(spark).drop("tier_rank").withColumns({"source_id": F.lit("s"), "total": F.col("posting_id") / 10, "company": once("company")})
    s = store()
    s.publish("run-1", "2024-01-01", ranked_parts(judged), attempts(spark, 1))
    for name in publish.SETS:
        s.result(name).collect()
    s.summary().collect()
    assert calls.value == 6
    assert {r.posting_id: r.tier_rank for r in s.result("ranked").collect()} == {2: 1, 1: 2, 6: 1}


def test_odd_parts_and_no_rows(spark, store):
    s = store()
    with pytest.raises(ValueError, match="1 rows"):
        s.publish("run-1", "2024-01-01", rows(spark, row(1, status=None)), attempts(spark, 1))
    s.publish("run-2", "2024-01-01", first(spark).limit(0), attempts(spark, 1))
    assert s.latest() == "run-2" and s._names("runs") == ["run-2"]
    assert s.summary().where("n > 0").count() == 0
