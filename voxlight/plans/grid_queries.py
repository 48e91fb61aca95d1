"""Angular grids and lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import absorb, grid, sampling
from .catalog import query
from .fixtures import Inputs, sql
from .ray_queries import ANGLES, R6

#: A coarse grid whose values come from the events: sample s, cell (i, j) takes the mean value of its events.
AXES = grid.Axes(36, 18)
GRID = "SELECT CAST(event_id%4 AS INT) AS sample_id, CAST((event_id//4)%36 AS INT) AS i_theta, CAST((event_id//144)%18 AS INT) AS i_phi, 1/(1+avg(user_id)) AS value FROM events GROUP BY ALL"
DEGREES = "SELECT refl_id, leg, degrees(theta) AS theta, degrees(phi) AS phi FROM angles"
CELL = "CAST(least(greatest(floor(({v}-({low}))/{step}e0),0),{n}-1) AS INT)"
CELLS = f"SELECT refl_id, leg, {CELL.format(v='theta', low='-180', step=10, n=36)} AS i_theta, {CELL.format(v='phi', low='-90', step=10, n=18)} AS i_phi FROM deg"


def values(t: Inputs):
    cells = t.events.select((F.col("event_id") % 4).cast("int").alias("sample_id"), (F.floor(F.col("event_id") / 4) % 36).cast("int").alias("i_theta"), (F.floor(F.col("event_id") / 144) % 18).cast("int").alias("i_phi"), "user_id")
    return cells.groupBy("sample_id", "i_theta", "i_phi").agg((1 / (1 + F.avg("user_id"))).alias("value"))


def degrees(t: Inputs):
    theta, phi = g.angles([F.col(f"v{k}") for k in range(3)])
    return t.legs.select("refl_id", "leg", F.degrees(theta).alias("theta"), F.degrees(phi).alias("phi"))


def sphere(nt: int, np: int) -> str:
    """A leg for each cell of a grid that starts half a degree off the poles and seam."""
    th, ph = f"radians(-179.5e0+(k%{nt})*{360 / nt}e0)", f"radians(-89.5e0+(k//{nt})*{180 / np}e0)"
    return f"SELECT CAST(k AS BIGINT) AS refl_id, 1 AS leg, cos({th})*sin({ph}) AS v0, -cos({th})*cos({ph}) AS v1, -sin({th}) AS v2 FROM range({nt * np}) r(k)"


@query("g1_build_grid", sql("SELECT sample_id, CAST(refl_id%24 AS INT) AS i_theta, CAST(refl_id//24 AS INT) AS i_phi, round(exponent, 9)+0e0 AS value FROM exponents", legs=sphere(24, 12)))
def g1(t: Inputs):
    """Exponents of one leg for a 24 x 12 grid and every sample."""
    return built(t, "exponent")


def built(t: Inputs, method: str):
    legs = grid.grid_legs(t.spark, grid.Axes(24, 12, -179.5, -89.5)).withColumn("leg", F.lit(1))
    paths = absorb.trace(legs.drop("i_theta", "i_phi"), t.samples, t.volume, t.voxels)
    return grid.build_grid(legs, paths, t.coefficients, method).withColumn("value", F.round("value", 9) + 0.0)


@query("g1_build_grid_transmission", sql("SELECT sample_id, CAST(refl_id%24 AS INT) AS i_theta, CAST(refl_id//24 AS INT) AS i_phi, round(transmission, 9)+0e0 AS value FROM rates", legs=sphere(24, 12)))
def g1_transmission(t: Inputs):
    """The other method: what passes through one leg."""
    return built(t, "transmission")


@query("g2_mean_grid", sql("SELECT i_theta, i_phi, round(avg(value), 9) AS value FROM grid GROUP BY ALL", grid=GRID))
def g2(t: Inputs):
    return grid.mean_grid(values(t)).withColumn("value", F.round("value", 9))


@query("g3_pad_grid", sql("SELECT sample_id, CAST(a.t AS INT) AS i_theta, CAST(p.t AS INT) AS i_phi, round(value, 9) AS value FROM grid, range(42) a(t), range(20) p(t) WHERE i_theta = (a.t-3+36)%36 AND i_phi = (p.t-1+18)%18", grid=GRID))
def g3(t: Inputs):
    return grid.pad(values(t), AXES, 3, 1).withColumn("value", F.round("value", 9)).select("sample_id", "i_theta", "i_phi", "value")


@query("g4_shift_half", sql("SELECT sample_id, CAST((i_theta+18)%36 AS INT) AS i_theta, i_phi, round(value, 9) AS value FROM grid", grid=GRID))
def g4(t: Inputs):
    return grid.shift(values(t), 36, 18).withColumn("value", F.round("value", 9))


@query("g5_lookup_nearest", sql("SELECT refl_id, round(avg(tr), 6) AS factor FROM (SELECT refl_id, sample_id, exp(-sum(value)) AS tr FROM cells JOIN grid USING (i_theta, i_phi) GROUP BY ALL) GROUP BY ALL", grid=GRID, angles=ANGLES, deg=DEGREES, cells=CELLS))
def g5(t: Inputs):
    return grid.lookup_nearest(degrees(t), values(t), AXES).withColumn("factor", R6("factor"))


def corner(wrap: bool) -> str:
    at = "((CAST({f} AS INT)+{d})%{n}+{n})%{n}" if wrap else "CAST(least(greatest({f}+{d},0),{n}-1) AS INT)"
    parts = []
    for dt in (0, 1):
        for dp in (0, 1):
            w = f"({'tt-ft' if dt else '1-(tt-ft)'})*({'pp-fp' if dp else '1-(pp-fp)'})"
            parts.append(f"SELECT refl_id, leg, CAST({at.format(f='ft', d=dt, n=36)} AS INT) AS i_theta, CAST({at.format(f='fp', d=dp, n=18)} AS INT) AS i_phi, {w} AS weight FROM spots")
    return " UNION ALL ".join(parts)


SPOTS = "SELECT *, floor(tt) AS ft, floor(pp) AS fp FROM (SELECT refl_id, leg, (theta+180)/10e0 AS tt, (phi+90)/10e0 AS pp FROM deg)"


def bilinear(wrap: bool) -> str:
    return sql("SELECT refl_id, round(avg(tr), 6) AS factor FROM (SELECT refl_id, sample_id, exp(-sum(value)) AS tr FROM each GROUP BY ALL) GROUP BY ALL", grid=GRID, angles=ANGLES, deg=DEGREES, spots=SPOTS, corners=corner(wrap), each="SELECT refl_id, leg, sample_id, sum(weight*value) AS value FROM corners JOIN grid USING (i_theta, i_phi) GROUP BY ALL")


@query("g6_lookup_bilinear", bilinear(False))
def g6(t: Inputs):
    return grid.lookup_bilinear(degrees(t), values(t), AXES).withColumn("factor", R6("factor"))


@query("g7_lookup_local_kernel", bilinear(True))
def g7(t: Inputs):
    """The two nearest cells an axis, wrapping round."""
    return grid.lookup_bilinear(degrees(t), values(t), AXES, wrap=True).withColumn("factor", R6("factor"))


MEANS = "SELECT i_theta, i_phi, avg(value) AS value FROM grid GROUP BY ALL"


@query("g8_lookup_mean_product", sql("SELECT refl_id, round(exp(sum(ln(value))), 6) AS factor FROM (SELECT refl_id, leg, sum(weight*value) AS value FROM corners JOIN means USING (i_theta, i_phi) GROUP BY ALL) GROUP BY ALL", grid=GRID, means=MEANS, angles=ANGLES, deg=DEGREES, spots=SPOTS, corners=corner(False)))
def g8(t: Inputs):
    return grid.lookup_mean_product(degrees(t), grid.mean_grid(values(t)), AXES).withColumn("factor", R6("factor"))


EDGE = "SELECT refl_id, bool_or(abs(theta)>170 OR abs(phi)>80 OR abs(abs(theta)-90)<10) AS edge FROM deg GROUP BY ALL"


@query(
    "g9_near_edge_fallback",
    sql(
        "SELECT refl_id, round(factor, 6) AS factor, 'grid' AS source FROM near JOIN edges USING (refl_id) WHERE NOT edge UNION ALL SELECT refl_id, round(factor, 6), 'trace' FROM factors JOIN edges USING (refl_id) WHERE edge",
        grid=GRID, angles=ANGLES, deg=DEGREES, cells=CELLS, edges=EDGE, near="SELECT refl_id, avg(tr) AS factor FROM (SELECT refl_id, sample_id, exp(-sum(value)) AS tr FROM cells JOIN grid USING (i_theta, i_phi) GROUP BY ALL) GROUP BY ALL",
    ),
)
def g9(t: Inputs):
    return grid.with_fallback(degrees(t), AXES, lambda a: grid.lookup_nearest(a, values(t), AXES), lambda ids: traced(t, ids)).withColumn("factor", R6("factor"))


def traced(t: Inputs, ids):
    """Exact factors of some reflections; no other ray is followed."""
    return absorb.factors(t.legs.join(ids, "refl_id", "left_semi"), t.samples, t.volume, t.voxels, t.coefficients)


PRODUCT = "SELECT refl_id, exp(sum(ln(value))) AS factor FROM (SELECT refl_id, leg, sum(weight*value) AS value FROM corners JOIN means USING (i_theta, i_phi) GROUP BY ALL) GROUP BY ALL"


@query(
    "g8_mean_product_fallback",
    sql(
        "SELECT refl_id, round(factor, 6) AS factor, 'grid' AS source FROM product JOIN edges USING (refl_id) WHERE NOT edge UNION ALL SELECT refl_id, round(factor, 6), 'trace' FROM factors JOIN edges USING (refl_id) WHERE edge",
        grid=GRID, means=MEANS, angles=ANGLES, deg=DEGREES, spots=SPOTS, corners=corner(False), edges=EDGE, product=PRODUCT,
    ),
)
def g8_fallback(t: Inputs):
    """Products of the mean map, traced where a leg is near a pole or the seam."""
    return grid.with_fallback(degrees(t), AXES, lambda a: grid.lookup_mean_product(a, grid.mean_grid(values(t)), AXES), lambda ids: traced(t, ids)).withColumn("factor", R6("factor"))


@query("g10_grid_seam_check", sql("SELECT a.sample_id, round(avg(abs(a.value-b.value)), 9) AS mean_gap, round(max(abs(a.value-b.value)), 9) AS max_gap FROM grid a JOIN grid b ON a.sample_id=b.sample_id AND a.i_phi=b.i_phi AND a.i_theta=(b.i_theta+18)%36 GROUP BY ALL", grid=GRID))
def g10(t: Inputs):
    rows = grid.seam_check(values(t), AXES)
    return rows.select("sample_id", F.round("mean_gap", 9).alias("mean_gap"), F.round("max_gap", 9).alias("max_gap"))


@query(
    "a8_absorption_map",
    sql(
        "SELECT CAST(refl_id%36 AS INT) AS i_theta, CAST(refl_id//36 AS INT) AS i_phi, round(factor, 6) AS factor, n_samples FROM factors",
        legs=sphere(36, 18), samples="SELECT s.i AS sample_id, z, y, x FROM crystal JOIN (SELECT i, CAST(floor(i*(n/(m*1e0))) AS BIGINT) AS o FROM (SELECT unnest(range(m)) AS i, n, m FROM (SELECT count(*) AS n, greatest(1, count(*)//20) AS m FROM crystal))) s ON o = ordinal",
    ),
)
def a8(t: Inputs):
    """Mean transmission of one leg for every direction of a 36 x 18 grid, over an even sample of one voxel in 20."""
    axes = grid.Axes(36, 18, -179.5, -89.5)
    legs = grid.grid_legs(t.spark, axes).withColumn("leg", F.lit(1))
    n = max(1, sampling.select_label(t.voxels).count() // 20)
    rates = absorb.transmission(absorb.trace(legs.drop("i_theta", "i_phi"), sampling.even(t.voxels, n), t.volume, t.voxels), t.coefficients)
    return absorb.absorption_factor(rates).join(legs.select("refl_id", "i_theta", "i_phi"), "refl_id").select("i_theta", "i_phi", R6("factor").alias("factor"), "n_samples")
