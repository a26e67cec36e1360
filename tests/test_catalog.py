"""Some queries against their twins on the smallest data; the driver runs all."""

import duckdb
import pytest

from tallyrook.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = ("plan_ranked_listings", "e03_entity_resolution", "c11_policy_filter", "b05_canonical_url", "e08_commit_upsert", "k06_letter_limits", "a09_entity_graph_hits", "j05_stream_first_last_seen")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    twin = duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, twin))


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
