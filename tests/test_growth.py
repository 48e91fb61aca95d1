"""Queries against their SQL where the events reach further than in the small tables."""

import duckdb
import pytest

from test_queries import canonical
from voxlight.operators import image, regions, sampling
from voxlight.plans.catalog import load
from voxlight.plans.fixtures import Inputs

QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def longer(tmp_path_factory):
    """The events of the smallest table 150 times over, with shifted keys: a rod of 261 slices."""
    folder = tmp_path_factory.mktemp("longer")
    duckdb.sql(f"COPY (SELECT * REPLACE (event_id + 1000*k AS event_id) FROM range(150) r(k), '/root/testdata/sf0.001/events.parquet') TO '{folder}/events.parquet'")
    return str(folder)


def both(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    df, want = QUERIES[name](spark, folder), con.sql(ORACLES[name])
    return canonical(df.columns, [tuple(r) for r in df.collect()]), canonical(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["m2_slice", "m2_slice_quota"])
def test_quota_of_more_slices_than_samples(spark, longer, name):
    found, want = both(spark, longer, name)
    assert found == want


def test_spread_takes_the_fullest_slices(spark, longer):
    quota = sampling.slice_quota(Inputs(spark, longer).voxels, 100).collect()
    assert len(quota) == 261 and sum(r["quota"] for r in quota) == 100 and {r["quota"] for r in quota} == {0, 1}


def test_a_pixel_is_not_sent_once_for_each_shift(spark):
    """Masks over several tiles, and no row for each pixel and shift."""
    a = spark.range(40_000).selectExpr("cast(id div 100 - 150 as int) y", "cast(id % 100 as int) x").where("(y*7+x*5)%11<>0")
    b = a.where("(y*5+x*3)%7<>0").selectExpr("y+2 y", "x-1 x")
    found = image.register_shift(a, b, 3)
    assert "[-3,-2,-1,0,1,2,3]" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(-2, 1, b.count())]


def sent(spark, folder, k, name):
    """Rows that a query on the events of the smallest table, k times over with shifted keys, writes for other tasks."""
    (folder / str(k)).mkdir()
    duckdb.sql(f"COPY (SELECT * REPLACE (event_id + 1000*k AS event_id) FROM range({k}) r(k), '/root/testdata/sf0.001/events.parquet') TO '{folder}/{k}/events.parquet'")
    context, jvm, gateway = spark.sparkContext._jsc.sc(), spark._jvm, spark.sparkContext._gateway
    stages = lambda: context.statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    seen = {stages().apply(i).stageId() for i in range(stages().size())}
    assert QUERIES[name](spark, f"{folder}/{k}").count() == 1000 * k
    context.listenerBus().waitUntilEmpty()
    found = stages()
    return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()) if found.apply(i).stageId() not in seen)


def test_a_leg_is_not_sent_once_for_each_block_of_samples(spark, tmp_path, monkeypatch):
    """Samples grow with the crystal: three times the events are three times the legs and three times the samples, and three times the rows exchanged at most."""
    monkeypatch.setattr(regions, "BLOCK", 4)
    monkeypatch.setattr(regions, "GROUP_RAYS", 20_000)
    few, many = (sent(spark, tmp_path, k, "a6_sample_ratio") for k in (8, 24))
    assert many < 3.3 * few
