"""Keyed streams: restarts, touched keys, timers."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallyrook.streaming import keyed

T0 = datetime(2024, 1, 1)


def hour(n):
    return T0 + timedelta(hours=n)


def land(spark, rows, schema, root, make, sink=None):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/landed")
    stream = spark.readStream.schema(schema).parquet(f"{root}/landed")
    return keyed.run(make(stream), f"{root}/checkpoint", sink)


def updates(progress):
    return [(p["numInputRows"], p["stateOperators"][0]["numRowsTotal"], p["stateOperators"][0]["numRowsUpdated"]) for p in progress if p["numInputRows"]]


def test_a_batch_touches_only_its_keys(spark, tmp_path):
    schema = "profile string, key string, company string, title string, url string, at timestamp"
    out = []
    sink = lambda batch, _: out.append({(r.profile, r.key): (r.company, r.first_seen_at, r.last_seen_at) for r in batch.collect()})
    row = lambda k, n, name="c", profile="p": (profile, k, name, "t", None, None if n is None else hour(n))
    first = land(spark, [row(f"k{i}", i % 7) for i in range(40)], schema, tmp_path, keyed.seen, sink)
    second = land(spark, [row("k3", 9, "new"), row("k3", 1, "old"), row("k5", 2, "late"), row("x", None), row(None, 4)], schema, tmp_path, keyed.seen, sink)
    assert updates(first) == [(40, 40, 40)] and updates(second) == [(5, 42, 4)]
    got = {k: v for batch in out[1:] for k, v in batch.items()}
    assert got == {("p", "k3"): ("new", hour(1), hour(9)), ("p", "k5"): ("c", hour(2), hour(5)), ("p", "x"): ("c", None, None), ("p", None): ("c", hour(4), hour(4))}
    state = {(r.profile, r.key): (r.company, r.first_seen_at, r.last_seen_at) for r in keyed.state_of(spark, f"{tmp_path}/checkpoint").collect()}
    assert len(state) == 42 and got.items() <= state.items() and state[("p", "k6")] == ("c", hour(6), hour(6))


def test_a_stream_without_new_rows_changes_nothing(spark, tmp_path):
    schema = "profile string, key string, company string, title string, url string, at timestamp"
    land(spark, [("p", "a", "c", "t", "u", hour(1))], schema, tmp_path, keyed.seen)
    before = keyed.state_of(spark, f"{tmp_path}/checkpoint").collect()
    progress = keyed.run(keyed.seen(spark.readStream.schema(schema).parquet(f"{tmp_path}/landed")), f"{tmp_path}/checkpoint")
    assert not updates(progress)
    assert keyed.state_of(spark, f"{tmp_path}/checkpoint").collect() == before


def test_lifecycle_keeps_first_time_and_key(spark, tmp_path):
    schema = "entity string, disposition string, key string, company string, title string, url string, at timestamp, source_report string, ordinal long"
    row = lambda e, d, key, n, report="r": (e, d, key, "c", "t", "u", hour(n), report, n)
    land(spark, [row("e", "dismissed", "k1", 1), row("f", "applied", "f1", 1), row("g", "expired", "g1", 1)], schema, tmp_path, keyed.lifecycle)
    progress = land(spark, [row("e", "applied", "k2", 5), row("f", "applied", "f2", 6, "r2")], schema, tmp_path, keyed.lifecycle)
    assert updates(progress)[0][0] == 2
    land(spark, [row("e", "dismissed", "k3", 8), row("e", "dismissed", "k4", 9)], schema, tmp_path, keyed.lifecycle)
    got = sorted((r.entity, r.disposition, r.key, r["at"], r.source_report) for r in keyed.state_of(spark, f"{tmp_path}/checkpoint", "decisions").collect())
    assert got == [("e", "dismissed", "k3", hour(8), "r"), ("f", "applied", "f1", hour(1), "r2"), ("g", "expired", "g1", hour(1), "r")]


def test_timers_release_a_source(spark, tmp_path):
    schema = "profile string, source_id string, ordinal long, attempted_at timestamp, at timestamp, ok boolean, error string, min_hours double"
    out = []
    sink = lambda batch, _: out.extend((r.source_id, r.kind) for r in batch.collect())
    row = lambda s, n, ok=True, hours=6.0: ("p", s, n, hour(n), hour(n) + timedelta(minutes=30), ok, None if ok else f"error {n}", hours)
    land(spark, [row("a", 0), row("b", 0, False), row("z", 0, True, 0.0), row("c", 2)], schema, tmp_path, keyed.polls, sink)
    assert sorted(out) == [("a", "held"), ("b", "held"), ("c", "held"), ("z", "free")]
    out.clear()
    # seven hours on: a and b are due, c is not; b is tried again and held anew
    land(spark, [row("b", 7)], schema, tmp_path, keyed.polls, sink)
    assert ("a", "released") in out and ("b", "held") in out and not {("c", "released"), ("z", "released")} & set(out)
    state = {r.source_id: r for r in keyed.state_of(spark, f"{tmp_path}/checkpoint").collect()}
    assert state["a"].held_until is None and state["b"].held_until == hour(13) + timedelta(minutes=30) and state["c"].held_until == hour(8) + timedelta(minutes=30)
    assert (state["b"].last_error, state["b"].last_failure_at) == (None, hour(0) + timedelta(minutes=30))
    # what lands behind the watermark no longer holds a source
    land(spark, [row("a", 2)], schema, tmp_path, keyed.polls, sink)
    assert {r.source_id: r.held_until for r in keyed.state_of(spark, f"{tmp_path}/checkpoint").collect()}["a"] is None


def test_landings_in_one_or_three_give_the_same(spark):
    rows = spark.range(300).select(F.lit("p").alias("profile"), F.concat(F.lit("k"), F.col("id") % 11).alias("key"), F.lit("c").alias("company"), F.col("id").cast("string").alias("title"), F.lit("u").alias("url"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 37 % 101).alias("at"), (F.col("id") % 3).alias("part"))
    states = []
    for parts in ([0, 1, 2], [(0, 1, 2)], [2, 0, 1]):
        landings = [rows.where(F.col("part").isin(*(p if isinstance(p, tuple) else (p,)))).drop("part") for p in parts]
        states.append(sorted(map(tuple, keyed.state_of(spark, keyed.over_landings(landings, keyed.seen, "t")).collect())))
    assert states[0] == states[1] == states[2] and len(states[0]) == 11
