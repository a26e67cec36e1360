"""State tables in buckets: plans, files, restarts."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyrook.operators import state as S
from tallyrook.operators import state_table
from tallyrook.operators.state_table import StateTable, all_names

_COLUMNS = "key string, v long"


def rows(spark, a, b, add=0):
    return spark.range(a, b).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") + add).alias("v"))


def merged(new):
    return lambda old: old.join(new, "key", "left_anti").unionByName(new)


def made(spark, path, n=200, buckets=8):
    out = StateTable(spark, str(path), _COLUMNS, ("key",), buckets)
    first = rows(spark, 0, n)
    out.upsert(first.select("key"), merged(first))
    return out


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def content(table):
    return dict(map(tuple, table.read().collect()))


def test_upsert_touches_its_buckets_alone(spark, tmp_path):
    table = made(spark, tmp_path / "t")
    before = files(tmp_path / "t")
    assert len(before) == 8  # one file a bucket
    new = rows(spark, 3, 5, 1000).union(spark.createDataFrame([("new", 7)], _COLUMNS))
    touched = table.upsert(new.select("key"), merged(new))
    after = files(tmp_path / "t")
    assert 0 < len(touched) <= 3
    assert {p for p in before if after.get(p) != before[p]} == {p for p in before if int(p.split("bucket_no=")[1].split("/")[0]) in touched}
    assert content(table) == {**{f"k{i}": i for i in range(200)}, "k3": 1003, "k4": 1004, "new": 7}
    assert not list((tmp_path / "t").glob("_pending*"))


def test_joins_do_not_move_the_state(spark, tmp_path):
    table = made(spark, tmp_path / "t")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = spark.createDataFrame([(1, ["x", "k5"]), (2, ["k7", "k8"])], "posting_id long, aliases array<string>")
        found = S.alias_lookup(few, table.read())
        part = rows(spark, 0, 20).join(table.part(table.touched(few.select(F.explode("aliases").alias("key")))), "key", "full")
        for df in (found, part):
            plan = df._jdf.queryExecution().executedPlan().toString()
            scan = plan.index("FileScan parquet")
            assert "Bucketed: true" in plan
            # between the join and the state's scan there is no exchange
            join = plan.rindex("Join", 0, scan)
            assert "Exchange" not in plan[join:scan].split("\n      :- ")[-1].split("+- Sort")[-1]
            assert sum("Exchange hashpartitioning(key" in line for line in plan.split("\n")) == 1
        assert {r.posting_id: (r.pos, r.hit.v) for r in found.collect()} == {1: (1, 5), 2: (0, 7)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_only_touched_files_are_read(spark, tmp_path):
    table = made(spark, tmp_path / "t")
    keys = spark.createDataFrame([("k1",)], "key string")
    assert len(table.part(table.touched(keys)).inputFiles()) == 1 and len(table.read().inputFiles()) == 8


def test_emptied_buckets_and_null_keys(spark, tmp_path):
    table = made(spark, tmp_path / "t", n=5)
    gone = rows(spark, 0, 3)
    table.upsert(gone.select("key"), lambda old: old.join(gone, "key", "left_anti"))
    assert content(table) == {"k3": 3, "k4": 4}
    none = spark.createDataFrame([(None, 1)], _COLUMNS)
    table.upsert(none.select("key"), lambda old: old.where("key is not null").unionByName(none))
    assert content(table) == {"k3": 3, "k4": 4, None: 1}
    assert table.upsert(none.where("false").select("key"), merged(none)) == []
    table.close()
    assert content(StateTable(spark, str(tmp_path / "t"), _COLUMNS, ("key",), 8)) == {"k3": 3, "k4": 4, None: 1}


def test_rows_of_other_buckets_are_refused(spark, tmp_path):
    table = made(spark, tmp_path / "t")
    with pytest.raises(Exception, match="wasn't touched"):
        table.upsert(rows(spark, 0, 1).select("key"), lambda old: old.unionByName(rows(spark, 0, 100)))
    assert len(content(table)) == 200


@pytest.mark.parametrize("dies_at", ["before the note", "before the buckets", "between the buckets", "before the note goes"])
def test_a_run_that_died_is_undone_or_finished(spark, tmp_path, monkeypatch, dies_at):
    table = made(spark, tmp_path / "t", n=40)
    new = rows(spark, 0, 10, 500)

    class Died(Exception):
        pass

    def die(*_):
        raise Died

    with monkeypatch.context() as m:
        if dies_at == "before the note":
            real = state_table.materialize
            m.setattr(state_table, "materialize", lambda *a: (real(*a), die()))
        elif dies_at == "before the note goes":
            real = state_table.discard
            m.setattr(state_table, "discard", lambda s, *paths: die() if any("_pending" in p for p in paths) else real(s, *paths))
        else:
            m.setattr(StateTable, "_finish", die)
        with pytest.raises(Died):
            table.upsert(new.select("key"), merged(new))
    if dies_at == "between the buckets":  # as if the writer had deleted a bucket and not yet put the new one in its place
        shutil.rmtree(tmp_path / "t" / f"bucket_no={table.touched(new.select('key'))[0]}")
    table.close()
    again = StateTable(spark, str(tmp_path / "t"), _COLUMNS, ("key",), 8)
    assert content(again) == {f"k{i}": i for i in range(40)} | ({} if dies_at == "before the note" else {f"k{i}": i + 500 for i in range(10)})
    assert not list((tmp_path / "t").glob("_pending*"))


def test_all_names(spark):
    df = spark.createDataFrame([("a", None, ["b", None]), ("c", "d", None)], "x string, y string, z array<string>")
    assert sorted(r.key for r in all_names(df, "x", "y", lists=("z",)).collect()) == ["a", "b", "c", "d"]
