"""Provenance as keyed tables: records, aliases and facts, also of one very large entity."""

from datetime import datetime

from pyspark.sql import functions as F

from tallyrook.operators import listings as L
from tallyrook.operators import provenance as P
from tallyrook.operators import resolve as E

_RAW = "posting_id long, source_id string, adapter string, source_job_id string, company string, title string, url string, location string, description string, posted_at timestamp_ntz, fetched_at timestamp_ntz, attribution string"
DAY = [datetime(2024, 1, d) for d in range(1, 10)]


def made(spark, rows):
    df = L.with_identity(L.normalize(spark.createDataFrame(rows, _RAW))).drop("remote_scope", "level", "dedupe_key", "aliases")
    return df, E.entities(df)


def row(i, source="a", job=None, url="https://x.com/1", fetched=0, said=None, company="Firm"):
    return (i, source, "b", job, company, "Dev", url, "", "", None, None if fetched is None else DAY[fetched], said)


def test_records_are_told_apart_by_five_fields(spark):
    df, members = made(spark, [row(1), row(2), row(3, fetched=1), row(4, job=""), row(5, job="7"), row(6, source="c"), row(7, url="https://x.com/1?utm_a=1"), row(8, fetched=None), row(9, fetched=None)])
    got = [tuple(r) for r in P.records(df, members).collect()]
    assert {g[0] for g in got} == {1} and len(got) == len(set(got)) == 6
    assert sum(g[5] is None for g in got) == 1


def test_facts(spark):
    df, members = made(spark, [
        row(1, source="b", fetched=2, said="Two"), row(2, source="a", job="9", fetched=4, said=" One "), row(3, source="a", job="8", fetched=1, said="One"), row(4, source="c", fetched=None, said="  "),
        row(5, url="https://y.com", company="Other"),
    ])
    got = {r.entity_id: r for r in P.facts(df, members).collect()}
    r = got[1]
    assert (r.n_records, r.first_source_id, r.first_source_job_id, r.fetched_at, r.attribution) == (4, "a", "8", DAY[4], "One | Two")
    assert (got[5].n_records, got[5].attribution) == (1, None)


def test_aliases_are_of_merged_fields_and_of_every_record(spark):
    df, members = made(spark, [row(1, job="9"), row(2, job="9", url="https://y.com/Two/?b=1", company="Firm Ltd"), row(3, url="not a url", company="Other")])
    merged = E.merged(df, members)
    got = sorted((r.entity_id, r.alias) for r in P.aliases(df, members, merged).collect())
    assert got == [(1, "b::9"), (1, "firm ltd::dev"), (1, "url::https://x.com/1"), (1, "url::https://y.com/Two?b=1"), (1, "url::https://y.com/two"), (3, "other::dev")]


def test_new_records_of_a_landing(spark):
    df, members = made(spark, [row(1), row(2, fetched=None), row(3, fetched=3)])
    records = P.records(df, members)
    stored = records.where("fetched_at is null or fetched_at < '2024-01-02'")
    assert [r.fetched_at for r in P.new_records(stored, records.union(records)).collect()] == [DAY[3]]


def test_an_entity_of_many_listings_has_a_narrow_row(spark):
    n = 20_000
    i = F.col("id")
    rows = spark.range(n).select(
        i.alias("posting_id"), F.lit("a").alias("source_id"), F.lit("b").alias("adapter"), i.cast("string").alias("source_job_id"), F.lit("Firm").alias("company"), F.lit("Dev").alias("title"), F.lit("https://x.com/1").alias("url"),
        F.lit("").alias("location"), F.lit("").alias("description"), F.lit(None).cast("timestamp_ntz").alias("posted_at"), F.lit(DAY[0]).cast("timestamp_ntz").alias("fetched_at"), F.lit("One").alias("attribution"),
    )
    df = L.with_identity(L.normalize(rows)).drop("remote_scope", "level", "dedupe_key", "aliases")
    members = df.select("posting_id", F.lit(0).cast("long").alias("entity_id"))
    merged = E.merged(df, members)
    assert merged.first().members == n and all(f.dataType.typeName() != "array" or f.name == "source_ids" for f in merged.schema)
    records = P.records(df, members)
    assert records.count() == n
    plan = records._jdf.queryExecution().executedPlan().toString()
    dealt = next(line for line in plan.split("\n") if "Exchange hashpartitioning" in line)  # the outermost exchange: the distinct
    assert "source_job_id" in dealt, dealt  # by the record, not by the entity; the other fields are constants here
    assert P.facts(df, members).first().n_records == n and P.aliases(df, members, merged).count() == n + 2


def test_queries_write_only_what_they_read(spark, monkeypatch):
    from tallyrook.plans import provenance_queries as Q

    class Done(Exception):
        pass

    written = []

    def materialize(df, tag):
        written.append(set(df.columns))
        raise Done

    monkeypatch.setattr(Q, "materialize", materialize)
    for name in ("h03_provenance_union", "h03_new_records", "e07_aliases", "e06_provenance_facts"):
        try:
            Q.QUERIES[name](spark, "/root/testdata/sf0.001")
        except Done:
            pass
    record = {"posting_id", "source_id", "adapter", "source_job_id", "url", "fetched_at", "url_key", "provider_key", "legacy_key"}
    assert written == [record, record, record | {"legacy_url_key", "company", "title", "posted_at"}, record | {"attribution"}]


def test_a_landing_moves_once(spark):
    """Records are counted with the stored ones: no join that deals both sides again by twelve expressions."""
    columns = "entity_id long, source_id string, adapter string, source_job_id string, original_url string, fetched_at timestamp_ntz"
    a, b, c = (1, "a", "b", "", "u", DAY[1]), (1, None, "b", "", "u", None), (2, "a", "b", "", "u", DAY[1])
    new = P.new_records(spark.createDataFrame([a, a, b], columns), spark.createDataFrame([c, c, b, a], columns))
    assert [tuple(r) for r in new.collect()] == [c] and new.columns == ["entity_id", *P.FIELDS]
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1
    assert P.new_records(spark.createDataFrame([], columns), spark.createDataFrame([b, b], columns)).count() == 1
