"""Tracing against closed forms, both modes against each other, and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlight.operators import absorb, bricks, image, report, sampling, volume
from voxlight.plans import coeff_queries
from voxlight.plans.catalog import QUERIES, load
from voxlight.plans.fixtures import Inputs

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, SMALL)


def section(spark, n, angles):
    """A cuboid of 100 x 120 cut into n x 1.2 n voxels, one slice thick, with vacuum around; the beam runs along x and leaves by the angle."""
    nx, ny = n, n * 6 // 5
    voxels = spark.range(nx * ny).select(F.lit(1).alias("z"), (F.floor(F.col("id") / nx) + 1).cast("int").alias("y"), (F.col("id") % nx + 1).cast("int").alias("x"), F.lit(3).alias("label"))
    meta = spark.createDataFrame([(3, ny + 2, nx + 2, 1.0, 100.0 / n, 100.0 / n)], "nz int, ny int, nx int, sz double, sy double, sx double")
    rows = []
    for a in angles:
        # Leg 1 goes back to the source; leg 2 leaves downwards in y.
        rows += [(a, 1, 1e-9, -1.0, -1e-9), (a, 2, 1e-9, math.cos(math.radians(a)) + 1e-9, -math.sin(math.radians(a)) - 1e-9)]
    legs = spark.createDataFrame(rows, "refl_id long, leg int, v0 double, v1 double, v2 double")
    return legs, meta, voxels


@pytest.mark.parametrize("n,tolerance", [(50, 4.0), (100, 2.0)])
def test_cuboid(spark, n, tolerance):
    angles = [10, 30, 45, 60, 80]
    legs, meta, voxels = section(spark, n, angles)
    mu = spark.createDataFrame([(3, 0.01)], "label int, mu double")
    got = absorb.factors(legs, sampling.even(voxels, voxels.count()), meta, voxels, mu, mode="bricks")
    want = spark.createDataFrame([(a,) for a in angles], "refl_id long").select("refl_id", report.expected_cuboid(F.col("refl_id").cast("double"), F.lit(0.01), F.lit(100.0), F.lit(120.0)).alias("expected"))
    for r in report.validation_report(got, want, "refl_id").collect():
        assert r["error"] < tolerance


def test_traced_cuboid_comes_near_the_closed_form(spark):
    rows = load()[0]["r13_traced_cuboid"](spark, SMALL).collect()
    assert len(rows) == 6 and all(0 < r["error"] < 8 for r in rows)


def test_known_values(spark):
    known = {10.0: 0.376951, 30.0: 0.382325, 45.0: 0.379336, 60.0: 0.378213, 80.0: 0.374732, 90.0: 0.368108}
    df = spark.createDataFrame([(a, v) for a, v in known.items()], "a double, v double")
    got = df.select("v", report.expected_cuboid(F.col("a"), F.lit(0.01), F.lit(100.0), F.lit(120.0)).alias("e")).collect()
    assert all(abs(r["v"] - r["e"]) < 2e-6 for r in got)
    on, back = spark.range(1).select(*report.sphere_limits(F.lit(1.0))).first()
    assert back == pytest.approx(0.3324, abs=1e-4) and 0 < on < back


def test_modes_agree_and_invariants(inputs, spark):
    t = inputs
    join = {r["refl_id"]: r["factor"] for r in absorb.factors(t.legs, t.samples, t.volume, t.voxels, t.coefficients, mode="auto").collect()}
    bricked = {r["refl_id"]: r["factor"] for r in absorb.factors(t.legs, t.samples, t.volume, t.voxels, t.coefficients, mode="bricks").collect()}
    assert join.keys() == bricked.keys() and all(abs(join[k] - bricked[k]) < 1e-12 for k in join)
    assert all(0 < v <= 1 for v in join.values())
    none = t.coefficients.withColumn("mu", F.lit(0.0))
    more = t.coefficients.withColumn("mu", F.col("mu") * 2)
    assert {r["factor"] for r in absorb.factors(t.legs, t.samples, t.volume, t.voxels, none, mode="bricks").collect()} == {1.0}
    assert all(r["factor"] <= join[r["refl_id"]] for r in absorb.factors(t.legs, t.samples, t.volume, t.voxels, more, mode="bricks").collect())


def lengths(df):
    return {tuple(r[c] for c in absorb.RAY): tuple(r[c] for c in ("li", "lo", "cr", "bu")) for r in df.collect()}


@pytest.mark.parametrize("edge,block,group,cases", [(32, 256, 500_000, [(True, None)]), (5, 3, 100, [(False, None), (True, {"FRONT": 2, "TOP": 1, "LE": 9})]), (1, 1, 50, [(True, 3)])])
def test_bricks_agree_with_steps(inputs, monkeypatch, edge, block, group, cases):
    """Whatever the size of bricks, blocks and groups; with one leg; and in full iteration with limits by face."""
    t = inputs
    for name, n in (("EDGE", edge), ("BLOCK", block), ("GROUP_RAYS", group)):
        monkeypatch.setattr(bricks, name, n)
    some = t.legs.where("refl_id < 120 and (leg = 2 or refl_id % 3 = 0)")
    for full, limits in cases:
        found = [lengths(absorb.trace(some, t.samples, t.volume, t.voxels, full, mode=mode, vacuum_run=limits)) for mode in ("join", "bricks")]
        assert found[0] == found[1] and len(found[0]) == some.count() * 8
    if edge != 5:
        return
    monkeypatch.setattr(absorb, "BROADCAST_SAMPLES", 2)
    monkeypatch.setattr(absorb, "JOIN_STEPS", 0)
    assert lengths(absorb.trace(some, t.samples, t.volume, t.voxels)) == lengths(absorb.trace(some, t.samples, t.volume, t.voxels, mode="join"))
    none = t.samples.limit(0)
    assert all(absorb.factors(some, none, t.volume, t.voxels, t.coefficients, mode=mode).count() == 0 for mode in ("join", "bricks"))


def test_rays_end_at_the_labelled_box(spark):
    """A ball in a large volume: clipped rays have fewer steps and the same lengths, also past gaps."""
    n, r = 60, 7
    at = [F.floor(F.col("id") / (n * n)).cast("int"), (F.floor(F.col("id") / n) % n).cast("int"), (F.col("id") % n).cast("int")]
    off = [a - c for a, c in zip(at, (30, 20, 33), strict=True)]
    square = off[0] * off[0] + off[1] * off[1] + off[2] * off[2]
    label = F.when(square <= 9, 3).when(square.between(17, 25), 4).when(square <= r * r, 1)
    voxels = spark.range(n**3).select(at[0].alias("z"), at[1].alias("y"), at[2].alias("x"), F.when(off[1] == 4, None).otherwise(label).alias("label")).where("label is not null")
    meta = spark.createDataFrame([(n, n, n, 0.5, 0.25, 0.25)], "nz int, ny int, nx int, sz double, sy double, sx double")
    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 3))
    legs = spark.createDataFrame([(k, 1 + k % 2, *map(float, x)) for k, x in enumerate(v)], "refl_id long, leg int, v0 double, v1 double, v2 double")
    samples = sampling.even(voxels, 6)
    rays = absorb.plan_rays(legs, samples, meta)
    steps = lambda df: df.agg(F.sum("n")).first()[0]
    assert steps(absorb.clip(rays, voxels)) < 0.5 * steps(rays)
    for full in (False, True):
        whole = absorb.path_lengths(absorb.label_steps(absorb.trace_steps(rays), voxels, full, 6), meta)
        want = lengths(whole)
        for mode in ("join", "bricks"):
            assert lengths(absorb.trace(legs, samples, meta, voxels, full, mode=mode, vacuum_run=6)) == want


def test_boundaries_count_like_labels(inputs):
    counts = absorb.boundary_counts(absorb.boundaries(inputs.labelled))
    plain = inputs.labelled.groupBy(*absorb.RAY).agg(*(F.count_if(F.col("label") == c).alias(f"n_{n}") for c, n in absorb.LABELS.items()), F.count_if(F.lit(True)).alias("n"))
    both = counts.join(plain, list(absorb.RAY))
    odd = both.where("steps <> n").count()
    assert odd == 0
    runs = absorb.path_segments(inputs.labelled).where("size(array_distinct(transform(segments, s -> s.label))) = size(segments)").select(*absorb.RAY)
    assert both.join(runs, list(absorb.RAY)).where("cr <> n_cr or lo <> n_lo or bu <> n_bu or li <> n_li").count() == 0


def test_even_sampling_and_sizes(spark, inputs):
    assert sampling.sample_size(1000, 100) == 10 and sampling.sample_size(50, 100) == 50 and sampling.sample_size(1000, 100, 2.5) == 25
    assert sampling.adaptive_rate(15000) == 1 and sampling.adaptive_rate(15001) == 2 and sampling.adaptive_rate(70000) == 8
    assert sampling.adaptive_step(5_000_000) == 1100 and sampling.adaptive_step(10_500_000) == 1200
    assert sampling.scale_ratio(5, 0.1) == 100.0
    picked = sampling.even_random(inputs.voxels, 5, 10.0)
    assert picked.count() == 5 and sampling.at_random(inputs.voxels, 7).distinct().count() == 7
    quota = {r["z"]: r["quota"] for r in sampling.slice_quota(inputs.voxels, 30).collect()}
    drawn = {r["z"]: r["count"] for r in sampling.by_slice(inputs.voxels, 30).groupBy("z").count().collect()}
    assert drawn == {z: q for z, q in quota.items() if q}


def test_light(spark):
    """Five points turned by eight angles about x through (5, 5, 5) in a beam of 3 to 7."""
    points = {(5.0, 5.0, 5.0): set(range(8)), (3.5, 3.5, 3.5): set(range(8)) - {3, 7}, (6.5, 6.5, 6.5): set(range(8)) - {3, 7}, (2.0, 2.0, 2.0): set(), (8.0, 1.0, 7.0): set()}
    rows = [(k, *p) for p in points for k in range(8)]
    df = spark.createDataFrame(rows, "k int, z double, y double, x double")
    w = F.radians(F.col("k") * 45.0)
    m = [[F.cos(w), -F.sin(w), F.lit(0.0)], [F.sin(w), F.cos(w), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0)]]
    lit = {(r["z"], r["y"], r["x"], r["k"]) for r in volume.in_beam(df, m, (5.0, 5.0, 5.0), (3.0, 7.0, 3.0, 7.0)).collect()}
    for p, ks in points.items():
        got = {k for k in range(8) if (*p, k) in lit}
        assert len(got) == len(ks) or p in ((3.5, 3.5, 3.5), (6.5, 6.5, 6.5)) and len(got) in (4, 6, 8), (p, got)


def test_many_samples_meet_legs_in_blocks(inputs, monkeypatch):
    """Samples beyond the broadcast give the same rays, each once."""
    t = inputs
    want = sorted(tuple(r) for r in absorb.plan_rays(t.legs, t.samples, t.volume).select(*absorb.RAY, "z", "y", "x", "n").collect())
    monkeypatch.setattr(absorb, "BROADCAST_SAMPLES", 3)
    monkeypatch.setattr(absorb, "SAMPLE_BLOCK", 2)
    assert sorted(tuple(r) for r in absorb.plan_rays(t.legs, t.samples, t.volume).select(*absorb.RAY, "z", "y", "x", "n").collect()) == want


def test_lengths_of_long_axes(spark):
    """A volume longer than 2^14 voxels on an axis: one straight ray through crystal."""
    n = 20_000
    voxels = spark.range(n).select(F.lit(0).alias("z"), F.lit(0).alias("y"), F.col("id").cast("int").alias("x"), F.lit(3).alias("label"))
    meta = spark.createDataFrame([(1, 1, n, 1.0, 1.0, 0.5)], "nz int, ny int, nx int, sz double, sy double, sx double")
    legs = spark.createDataFrame([(1, 2, 0.0, 1.0, 0.0)], "refl_id long, leg int, v0 double, v1 double, v2 double")
    samples = spark.createDataFrame([(0, 0, 0, 5)], "sample_id long, z int, y int, x int")
    row = absorb.trace(legs, samples, meta, voxels).first()
    assert row["cr"] == pytest.approx((n - 5) * 0.5) and row["li"] == row["lo"] == row["bu"] == 0


def valley_by_loops(counts):
    h = list(counts)
    for _ in range(10000):
        peaks, rising = [], True
        for i in range(len(h) - 1):
            if rising and h[i + 1] < h[i]:
                peaks.append(i)
                rising = False
            elif not rising and h[i + 1] > h[i]:
                rising = True
        if len(peaks) < 2:
            return None
        if len(peaks) == 2:
            return min(range(peaks[0], peaks[1] + 1), key=lambda i: h[i])
        h = [(h[max(i - 1, 0)] + h[i] + h[min(i + 1, len(h) - 1)]) / 3 for i in range(len(h))]
    return None


def test_minimum_threshold_against_loops(spark):
    """Two humps of noisy counts, one hump, a single value; then the registered query over its images."""
    rng = np.random.default_rng(5)
    humps = [np.rint(np.concatenate([rng.normal(low, 12, 3000), rng.normal(high, 15, 2500)])).clip(0, 255) for low, high in ((60, 180), (40, 120), (90, 215))]
    images = [*humps, np.rint(rng.normal(128, 10, 4000)).clip(0, 255), np.full(50, 7)]
    df = spark.createDataFrame([(k, int(v)) for k, values in enumerate(images) for v in values], "image_id int, u8 int")
    got = {r["image_id"]: r["threshold"] for r in image.threshold_iterative(df, "minimum").collect()}
    want = {k: valley_by_loops(np.bincount(values.astype(int), minlength=256).tolist()) for k, values in enumerate(images)}
    assert got == want and all(want[k] is not None for k in range(3)) and want[4] is None
    inputs = Inputs(spark, SMALL)
    pixels = image.minmax_u8(coeff_queries.pixels(inputs)).groupBy("image_id", "u8").count().collect()
    counts = {}
    for r in pixels:
        counts.setdefault(r["image_id"], [0] * 256)[int(r["u8"])] += r["count"]
    got = {r["image_id"]: r["threshold"] for r in QUERIES["c7_threshold_minimum"](spark, SMALL).collect()}
    assert got == {k: valley_by_loops(c) for k, c in counts.items()}


def test_a_batch_is_handled_in_parts(inputs, spark, monkeypatch):
    """Brick mode lays out about AT_ONCE segments at a time, however many rows a batch has; legs are broadcast where samples are too many."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"k": list(range(10))})
    cut = [p.column("k").to_pylist() for p in bricks.parts(batch, np.array([3, 3, 3, 9, 0, 0, 1, 1, 1, 1]), 6)]
    assert sum(cut, []) == list(range(10)) and len(cut) > 3 and [p.num_rows for p in bricks.parts(batch, np.ones(10, int), 100)] == [10]
    t, some = inputs, inputs.legs.where("refl_id < 40")
    monkeypatch.setattr(bricks, "EDGE", 5)
    want = lengths(absorb.trace(some, t.samples, t.volume, t.voxels, mode="bricks"))
    monkeypatch.setattr(bricks, "AT_ONCE", 40)
    monkeypatch.setattr(bricks, "BLOCK", 3)
    assert lengths(absorb.trace(some, t.samples, t.volume, t.voxels, mode="bricks")) == want
    few = some.where("refl_id < 3")
    monkeypatch.setattr(absorb, "BROADCAST_SAMPLES", few.count())
    given = few, t.samples.union(t.samples.selectExpr("sample_id + 100", "z", "y", "x")), t.volume, t.voxels
    assert lengths(absorb.trace(*given, mode="bricks")) == lengths(absorb.trace(*given, mode="join"))
