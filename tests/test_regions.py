"""Rays followed beside the bricks they can reach, against steps as rows; and that no step is a row where regions fit."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlight.operators import absorb, bricks, regions, sampling
from voxlight.plans.catalog import load
from voxlight.plans.fixtures import Inputs

SMALL = "/root/testdata/sf0.001"
TRACED = ["a11_method_difference", "a5_transmission", "a10_boundary_lengths", "a2_label_steps_full", "a3_path_length_totals", "a7_binned_quantiles", "a7_per_voxel_distribution", "a2_label_steps", "a3_path_lengths", "a12_proportional_totals", "a6_absorption_factor", "a10_boundaries", "a12_proportional_lengths", "a4_path_segments", "a9_straight_through", "a6_sample_ratio", "r13_traced_cuboid"]


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, SMALL)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", TRACED)
def test_no_step_is_a_row(spark, name):
    plan = load()[0][name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "vz#" not in plan


@pytest.mark.parametrize("edge,block,group,chunk,case", [(5, 3, 300, 50, (False, None)), (7, 1, 900, 7, (True, {"FRONT": 2, "TOP": 1, "LE": 9})), (32, 256, 500_000, 1 << 12, (True, 3))])
def test_regions_agree_with_steps(inputs, monkeypatch, edge, block, group, chunk, case):
    """Whatever the size of bricks, blocks and groups, also past gaps."""
    t, (full, limits) = inputs, case
    monkeypatch.setattr(bricks, "EDGE", edge)
    for name, n in (("BLOCK", block), ("GROUP_RAYS", group), ("LEAST_RAYS", 10), ("CHUNK", chunk)):
        monkeypatch.setattr(regions, name, n)
    some = t.legs.where("refl_id < 120 and (leg = 2 or refl_id % 3 = 0)")
    given = some, t.samples, t.volume, t.voxels
    want = absorb.stepped(*given, full, limits).persist()
    assert rows(absorb.trace(*given, full, mode="regions", vacuum_run=limits)) == rows(absorb.path_lengths(want, t.volume))
    steps = want.groupBy(*absorb.RAY).agg(F.count("*").cast("int").alias("steps")).join(absorb.path_segments(want), list(absorb.RAY))
    assert rows(absorb.segments(*given, full, limits)) == rows(steps)
    if not full:
        assert rows(absorb.bounds(*given).drop("runs", "classes").fillna(-1)) == rows(absorb.boundaries(want).fillna(-1))
    each = {r["refl_id"]: (r["factor"], r["n_samples"]) for r in absorb.absorption_factor(absorb.transmission(absorb.path_lengths(want, t.volume), t.coefficients)).collect()}
    got = {r["refl_id"]: (r["factor"], r["n_samples"]) for r in absorb.factors(*given, t.coefficients, mode="regions", full_iteration=full, vacuum_run=limits).collect()}
    assert got.keys() == each.keys() and all(got[k][1] == each[k][1] and abs(got[k][0] - each[k][0]) < 1e-12 for k in each)


def test_steps_are_rows_where_regions_do_not_fit(inputs, monkeypatch):
    t = inputs
    given = t.legs.where("refl_id < 60"), t.samples, t.volume, t.voxels
    want = [rows(absorb.bounds(*given).fillna(-1)), rows(absorb.segments(*given)), rows(absorb.trace(*given))]
    monkeypatch.setattr(regions, "MOST_BRICKS", 0)
    assert absorb.regional(*given, "counts") is None
    assert [rows(absorb.bounds(*given).fillna(-1)), rows(absorb.segments(*given)), rows(absorb.trace(*given))] == want


def odd_legs(spark):
    """Reflections that share one leg, both or none, with one leg or three, and zeros of either sign; every third runs as the first."""
    ways = [(0.3, 1.0, 0.2), (-0.4, 0.1, 0.9), (0.0, -1.0, 0.0), (-0.0, -1.0, -0.0), (0.97, 0.05, -0.02), (-0.2, -0.3, 0.8)]
    legs = [(k, leg, *ways[0 if k % 3 == 0 else (k * leg + k // 7) % len(ways)]) for k in range(90) for leg in ((1, 2), (2,), (1, 2, 3))[0 if k % 3 == 0 else k % 3]]
    return spark.createDataFrame(legs, "refl_id long, leg int, v0 double, v1 double, v2 double")


@pytest.mark.parametrize("span,tile_legs,tile,tile_rays", [(1 << 16, 4096, 1 << 20, 50_000), (3, 4, 6, 5), (5, 1, 1, 1)])
def test_reflections_that_run_alike_take_the_same(inputs, spark, monkeypatch, span, tile_legs, tile, tile_rays):
    """As many rows and the same factors as from each ray of each reflection, whatever a group and its tiles hold."""
    t = inputs
    for name, n in (("BLOCK", 2), ("GROUP_RAYS", 20), ("LEAST_RAYS", 10), ("SPAN", span), ("TILE_LEGS", tile_legs), ("TILE", tile), ("TILE_RAYS", tile_rays)):
        monkeypatch.setattr(regions, name, n)
    given = odd_legs(spark), t.samples, t.volume, t.voxels, t.coefficients
    want, found = ({r["refl_id"]: (r["factor"], r["n_samples"]) for r in absorb.factors(*given, mode=mode).collect()} for mode in ("join", "regions"))
    assert len(want) == 90 and found.keys() == want.keys()
    assert all(found[k][1] == want[k][1] and abs(found[k][0] - want[k][0]) < 1e-12 for k in want)


def test_smaller_blocks_where_large_ones_need_too_many_bricks(inputs, monkeypatch):
    """Legs that lead across the rod, not along it: one block of all samples needs every brick, a small block few."""
    t = inputs
    legs = t.legs.where("refl_id < 30").selectExpr("refl_id", "leg", "0e0 v0", "v1", "v2")
    voxels = t.voxels.union(t.voxels.selectExpr("z + 100", "y", "x", "label"))
    volume = t.volume.selectExpr("nz + 100 AS nz", "ny", "nx", "sz", "sy", "sx")
    samples = t.samples.union(t.samples.selectExpr("sample_id + 8", "z + 100", "y", "x"))
    given = legs, samples, volume, voxels
    want = {r["refl_id"]: r["factor"] for r in absorb.factors(*given, t.coefficients, mode="join").collect()}
    for name, n in (("BLOCK", 2), ("GROUP_RAYS", 20), ("MOST_BRICKS", 3)):
        monkeypatch.setattr(regions, name, n)
    assert regions.block_sizes(60, "passed")[0] > 2 and absorb.regional(*given, "passed", coefficients=t.coefficients) is not None
    found = {r["refl_id"]: r["factor"] for r in absorb.factors(*given, t.coefficients).collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)


def test_equal_bricks_are_held_once(spark, monkeypatch):
    """A sheet that fills many more bricks than a task may hold, nearly all of them equal, is followed in regions; places have a bound of their own."""
    monkeypatch.setattr(bricks, "EDGE", 4)
    monkeypatch.setattr(regions, "BAR", 3)
    want = rows(load()[0]["r13_traced_cuboid"](spark, SMALL))
    monkeypatch.setattr(regions, "MOST_BRICKS", 12)
    query = load()[0]["r13_traced_cuboid"](spark, SMALL)
    t = Inputs(spark, SMALL)
    sheet = spark.range(31 * 32).selectExpr("1 AS z", "int(id div 31) + 1 AS y", "int(id % 31) + 1 AS x", "3 AS label")
    meta = spark.createDataFrame([(3, 34, 33, 1.0, 0.5, 0.5)], "nz int, ny int, nx int, sz double, sy double, sx double")
    legs = spark.createDataFrame([(0, 1, 1e-9, -1.0, -1e-9), (0, 2, 1e-9, 0.8 + 1e-9, -0.6 - 1e-9)], "refl_id long, leg int, v0 double, v1 double, v2 double")
    given = legs, sampling.even(sheet, 300), meta, sheet
    found = absorb.regional(*given, "passed", coefficients=t.coefficients)
    assert found is not None
    assert rows(query) == want
    monkeypatch.setattr(regions, "MOST_PLACES", 60)
    assert absorb.regional(*given, "passed", coefficients=t.coefficients) is None


def patches(spark, n=40):
    """A volume of large patches of each class, some single voxels of another and a hole, and rays in all directions, also along axes."""
    rng = np.random.default_rng(5)
    label = np.kron(rng.integers(1, 5, (2, 3, 2)), np.ones((n // 2, n // 2, n // 2), int))[:, :n, :]
    label[tuple(rng.integers(0, n, (3, 25)))] = 2
    label[10:14, 5:9, 20:31] = 0
    label[:, n - 3, :] = 0
    z, y, x = np.nonzero(label)
    voxels = spark.createDataFrame([(*map(int, v), int(label[v])) for v in zip(z, y, x, strict=True)], "z int, y int, x int, label int")
    meta = spark.createDataFrame([(n, n, n, 0.5, 0.25, 0.3)], "nz int, ny int, nx int, sz double, sy double, sx double")
    ways = [*map(tuple, rng.normal(size=(40, 3)).tolist()), (0.0, 1.0, 0.0), (0.0, -1.0, -0.0), (-1.0, 0.0, 0.0), (0.5, 0.5, -0.5), (1e-9, -0.75, -1e-9), (1e-14, 1.0, -1e-14)]
    legs = spark.createDataFrame([(k, 1 + k % 2, *v) for k, v in enumerate(ways)], "refl_id long, leg int, v0 double, v1 double, v2 double")
    return legs, voxels, meta


@pytest.mark.parametrize("edge,walk,leaping", [(4, 3, 50), (5, 1, 7), (32, 32, 1 << 13)])
def test_leaps_count_like_steps(spark, monkeypatch, edge, walk, leaping):
    """The same lengths, to the last bit, whether a ray is looked at step by step or crosses at once what is alike."""
    legs, voxels, meta = patches(spark)
    samples = sampling.even(voxels, 12)
    monkeypatch.setattr(bricks, "EDGE", edge)
    for name, k in (("LEAP", 1 << 40), ("WALK", walk), ("LEAPING", leaping), ("MOST_PLACES", 1 << 20)):
        monkeypatch.setattr(regions, name, k)
    want = rows(absorb.trace(legs, samples, meta, voxels, mode="regions"))
    monkeypatch.setattr(regions, "LEAP", 1)
    found = rows(absorb.trace(legs, samples, meta, voxels, mode="regions"))
    assert found == want and len(want) == 12 * legs.count()
    if edge == 4:
        assert found == rows(absorb.trace(legs, samples, meta, voxels, mode="join"))


def test_a_block_needs_as_many_bricks_as_are_different(inputs, monkeypatch):
    """Blocks get smaller until their bricks are few; the rod twice over has two different ones."""
    t = inputs
    legs = t.legs.where("refl_id < 30").selectExpr("refl_id", "leg", "0e0 v0", "v1", "v2")
    voxels = t.voxels.union(t.voxels.selectExpr("z + 100", "y", "x", "label"))
    volume = t.volume.selectExpr("nz + 100 AS nz", "ny", "nx", "sz", "sy", "sx")
    samples = t.samples.union(t.samples.selectExpr("sample_id + 8", "z + 100", "y", "x"))
    given = legs, samples, volume, voxels
    want = {r["refl_id"]: r["factor"] for r in absorb.factors(*given, t.coefficients, mode="join").collect()}
    for name, n in (("BLOCK", 2), ("GROUP_RAYS", 20), ("MOST_BRICKS", 1)):
        monkeypatch.setattr(regions, name, n)
    scene = bricks.Scene.of(volume, voxels, [0] * 6)
    far, held = regions.reach(legs, scene), regions.bars(voxels)
    assert [regions.fits(samples, 16, n, far, scene, held) for n in (16, 2)] == [False, True]
    found = {r["refl_id"]: r["factor"] for r in absorb.factors(*given, t.coefficients).collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)


def test_no_task_takes_a_whole_slice(inputs):
    """Places in a slice come from counts of its lines."""
    plan = sampling.ordinal(sampling.select_label(inputs.voxels))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"row_number\(\) windowspecdefinition\(z#\d+, y#\d+, x#\d+ ASC", plan)
    assert [r["ordinal"] for r in sampling.ordinal(sampling.select_label(inputs.voxels)).orderBy("z", "y", "x").collect()] == list(range(sampling.select_label(inputs.voxels).count()))
