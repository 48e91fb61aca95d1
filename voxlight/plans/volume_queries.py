"""Filters on reflections, rays and pixels, and transforms of volumes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import image, reflections, sampling, volume
from .catalog import query
from .fixtures import Inputs, sql

PIXELS = "SELECT event_id//576 AS image_id, CAST((event_id//24)%24 AS INT) AS y, CAST(event_id%24 AS INT) AS x, value FROM events"


def pixels(t: Inputs):
    return t.spark.sql("SELECT event_id div 576 AS image_id, CAST((event_id div 24)%24 AS INT) AS y, CAST(event_id%24 AS INT) AS x, value FROM {e}", e=t.events)


@query("p1_select_label", sql("SELECT z, y, x FROM voxels WHERE label = 3"))
def p1(t: Inputs):
    return sampling.select_label(t.voxels)


@query("p2_slice_rows", sql("SELECT refl_id, v0 FROM reflections WHERE refl_id >= 50"))
def p2(t: Inputs):
    return reflections.slice_rows(t.reflections, 50, -1).select("refl_id", "v0")


@query("p3_drop_excluded", sql("SELECT refl_id, flags FROM reflections WHERE (flags & 5) = 0"))
def p3(t: Inputs):
    return reflections.drop_excluded(t.reflections, 5).select("refl_id", "flags")


BEAM_Z = "(CASE WHEN odd=1 THEN 6e-1*(z-8e0)-8e-1*(y-115e-1) ELSE z-8e0 END)+8e0"
BEAM_Y = "(CASE WHEN odd=1 THEN 8e-1*(z-8e0)+6e-1*(y-115e-1) ELSE y-115e-1 END)+115e-1"


@query("p4_in_beam", sql(f"SELECT refl_id, sample_id FROM reflections, samples WHERE {BEAM_Y} BETWEEN 8e0 AND 15e0 AND {BEAM_Z} BETWEEN 3e0 AND 13e0"))
def p4(t: Inputs):
    """Odd reflections are turned by the 3-4-5 angle about the x axis through (8, 11.5, 11.5)."""
    c, s = (F.when(F.col("odd") == 1, v).otherwise(w) for v, w in ((0.6, 1.0), (0.8, 0.0)))
    m = [[c, -s, F.lit(0.0)], [s, c, F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0)]]
    pairs = t.reflections.select("refl_id", "odd").crossJoin(F.broadcast(t.samples))
    return volume.in_beam(pairs, m, (8.0, 11.5, 11.5), (8.0, 15.0, 3.0, 13.0)).select("refl_id", "sample_id")


def _hit(axis: str, side: str) -> str:
    others = [b for b in "zyx" if b != axis]
    at = f"({side}_{axis}-o{axis})/nullif(d{axis},0)"
    return "(" + " AND ".join(f"coalesce(o{b}+{at}*d{b} BETWEEN min_{b} AND max_{b}, false)" for b in others) + ")"


@query("p5_ray_hits_box", sql("SELECT refl_id, " + " OR ".join(_hit(a, s) for a in "zyx" for s in ("min", "max")) + " AS hit FROM origins, box", origins="SELECT refl_id, 8e0 AS oz, 3e0 AS oy, 5e0 AS ox, v0 AS dz, v2 AS dy, v1 AS dx FROM reflections", box="SELECT min(z) AS min_z, max(z) AS max_z, min(y) AS min_y, max(y) AS max_y, min(x) AS min_x, max(x) AS max_x FROM voxels WHERE label = 4"))
def p5(t: Inputs):
    origins = t.reflections.select("refl_id", F.lit(8.0).alias("oz"), F.lit(3.0).alias("oy"), F.lit(5.0).alias("ox"), F.col("v0").alias("dz"), F.col("v2").alias("dy"), F.col("v1").alias("dx"))
    return volume.ray_hits_box(origins, volume.bounding_box(t.voxels.where("label = 4"))).select("refl_id", "hit")


@query("p6_masks", sql("SELECT image_id, y, x, CAST(value<5 AS INT) AS below, CAST(value>20 AS INT) AS above FROM pixels", pixels=PIXELS))
def p6(t: Inputs):
    low = image.mask_below(pixels(t), 5).withColumnRenamed("mask", "below")
    return image.mask_above(low, 20).select("image_id", "y", "x", "below", F.col("mask").alias("above"))


U8 = "SELECT image_id, y, x, coalesce(CAST(trunc(255*(value-mn)/nullif(mx-mn,0)) AS INT), 0) AS u8 FROM pixels JOIN (SELECT image_id, min(value) AS mn, max(value) AS mx FROM pixels GROUP BY image_id) USING (image_id)"


@query("p7_minmax_u8", sql("SELECT image_id, y, x, u8, 255-u8 AS inverse FROM u8", pixels=PIXELS, u8=U8))
def p7(t: Inputs):
    rows = image.minmax_u8(pixels(t))
    return rows.select("image_id", "y", "x", "u8", (255 - F.col("u8")).alias("inverse"))


@query("p8_range_mask", "SELECT event_id, class, CAST(CASE WHEN class='li' THEN NOT (h BETWEEN 20 AND 90 AND s BETWEEN 10 AND 99) ELSE h BETWEEN 0 AND 60 AND s BETWEEN 30 AND 99 END AS INT) AS mask FROM (SELECT event_id, event_id%180 AS h, user_id%100 AS s FROM events), (VALUES ('li'), ('cr')) c(class)")
def p8(t: Inputs):
    px = t.events.select("event_id", (F.col("event_id") % 180).alias("h"), (F.col("user_id") % 100).alias("s"), F.lit(7).alias("v"))
    boxes = t.spark.createDataFrame([("li", 20, 90, 10, 99, 0, 255, True), ("cr", 0, 60, 30, 99, 0, 255, False)], "class string, h0 int, h1 int, s0 int, s1 int, v0 int, v1 int, inverted boolean")
    return image.range_mask(px, boxes).select("event_id", "class", "mask")


@query("p9_crop", sql("SELECT image_id, CAST(y-3 AS INT) AS y, CAST(x-4 AS INT) AS x, value FROM pixels WHERE y >= 3 AND x >= 4 AND x < 20", pixels=PIXELS))
def p9(t: Inputs):
    return image.crop(pixels(t), (4, 20), (3, None))


@query("p10_center_fit", sql("SELECT image_id, CAST(y+3 AS INT) AS y, CAST(x-2 AS INT) AS x, value FROM pixels WHERE x-2 BETWEEN 0 AND 19", pixels=PIXELS))
def p10(t: Inputs):
    return image.center_fit(pixels(t), (24, 24), (30, 20))


@query("p11_flip", sql("SELECT CAST(nz-1-z AS INT) AS z, CAST(ny-1-y AS INT) AS y, x, label FROM voxels, volume"))
def p11(t: Inputs):
    return volume.flip(t.voxels, t.volume, "z", "y")


@query("v1_resize_nearest", sql("SELECT CAST(a.i AS INT) AS z, CAST(b.i AS INT) AS y, CAST(c.i AS INT) AS x, label FROM (SELECT unnest(range(nz*3//4)) AS i, nz, CAST(nz*3//4 AS BIGINT) AS m FROM volume) a, range(18) b(i), range(18) c(i), voxels v WHERE v.z = a.i*a.nz//a.m AND v.y = b.i*24//18 AND v.x = c.i*24//18"))
def v1(t: Inputs):
    return volume.resize_nearest(t.voxels, t.volume, 0.75)


def resized(n: str, side: int, factor: str) -> str:
    return f"SELECT {factor} AS factor, label, count(*) AS n FROM (SELECT unnest(range({n})) AS i, nz, CAST({n} AS BIGINT) AS m FROM volume) a, range({side}) b(i), range({side}) c(i), voxels v WHERE v.z = a.i*a.nz//a.m AND v.y = b.i*24//{side} AND v.x = c.i*24//{side} GROUP BY ALL"


@query("v1_resize_sweep", sql(" UNION ALL ".join([resized("nz*3//4", 18, "75e-2"), resized("nz//2", 12, "5e-1"), resized("nz*2", 48, "2e0")])))
def v1_sweep(t: Inputs):
    return volume.resize_sweep(t.voxels, t.volume, [0.75, 0.5, 2.0]).groupBy("factor", "label").agg(F.count("*").alias("n"))


@query("v2_rotate_slices", sql("SELECT z, CAST(ty AS INT) AS y, CAST(tx AS INT) AS x, label FROM (SELECT a.i AS ty, b.i AS tx, CAST(floor((a.i-115e-1)*6e-1-(b.i-115e-1)*8e-1+115e-1+5e-1) AS INT) AS fy, CAST(floor((a.i-115e-1)*8e-1+(b.i-115e-1)*6e-1+115e-1+5e-1) AS INT) AS fx FROM range(24) a(i), range(24) b(i)) JOIN voxels ON y = fy AND x = fx"))
def v2(t: Inputs):
    return volume.rotate_slices(t.voxels, t.volume, 0.6, 0.8)


@query("v3_project", sql("SELECT z, x, sum(label)/24e0 AS mean, CAST(sum(label) AS BIGINT) AS total, count(*) AS nonzero, max(label) AS highest FROM voxels GROUP BY ALL"))
def v3(t: Inputs):
    return volume.project(t.voxels, t.volume)


@query("v4_color_to_label", "SELECT event_id, CASE WHEN event_id%3=0 AND user_id%3=1 THEN 2 WHEN event_id%3=1 AND user_id%3=1 THEN 4 ELSE 0 END AS label FROM events")
def v4(t: Inputs):
    px = t.events.select("event_id", (F.col("event_id") % 3).cast("int").alias("r"), (F.col("user_id") % 3).cast("int").alias("g"), F.lit(9).alias("b"))
    colors = t.spark.createDataFrame([(0, 1, 9, 1, 0), (1, 1, 9, 4, 1), (0, 1, 9, 2, 2)], "r int, g int, b int, label int, rank int")
    return volume.color_to_label(px, colors).select("event_id", "label")


@query("v5_rank_labels", sql("SELECT count(DISTINCT label) AS classes FROM voxels"))
def v5(t: Inputs):
    return volume.distinct_labels(t.voxels)


@query("r16_illumination_cases", sql("SELECT CAST(event_id%8 AS INT) AS turn, count(*) AS lit, CAST(sum(z) AS BIGINT) AS zs FROM (SELECT event_id, event_id%10 AS z, (event_id//10)%10 AS y, CASE event_id%8 WHEN 0 THEN 1e0 WHEN 2 THEN 0e0 WHEN 4 THEN -1e0 WHEN 6 THEN 0e0 WHEN 1 THEN 6e-1 WHEN 3 THEN -6e-1 WHEN 5 THEN -8e-1 ELSE 8e-1 END AS c, CASE event_id%8 WHEN 0 THEN 0e0 WHEN 2 THEN 1e0 WHEN 4 THEN 0e0 WHEN 6 THEN -1e0 WHEN 1 THEN 8e-1 WHEN 3 THEN 8e-1 WHEN 5 THEN -6e-1 ELSE -6e-1 END AS s FROM events) WHERE s*(z-5)+c*(y-5)+5 BETWEEN 3 AND 7 AND c*(z-5)-s*(y-5)+5 BETWEEN 3 AND 7 GROUP BY ALL"))
def r16(t: Inputs):
    """Voxels of a 10-cube lit at eight turns about x through its middle."""
    turn = F.col("event_id") % 8
    cos, sin = {0: 1.0, 1: 0.6, 2: 0.0, 3: -0.6, 4: -1.0, 5: -0.8, 6: 0.0, 7: 0.8}, {0: 0.0, 1: 0.8, 2: 1.0, 3: 0.8, 4: 0.0, 5: -0.6, 6: -1.0, 7: -0.6}
    look = lambda d: F.element_at(F.array(*(F.lit(d[k]) for k in range(8))), (turn + 1).cast("int"))
    rows = t.events.select(turn.cast("int").alias("turn"), (F.col("event_id") % 10).alias("z"), (F.floor(F.col("event_id") / 10) % 10).alias("y"), F.lit(5).alias("x"), look(cos).alias("c"), look(sin).alias("s"))
    m = [[F.col("c"), -F.col("s"), F.lit(0.0)], [F.col("s"), F.col("c"), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0)]]
    return volume.in_beam(rows, m, (5.0, 5.0, 5.0), (3.0, 7.0, 3.0, 7.0)).groupBy("turn").agg(F.count("*").alias("lit"), F.sum("z").alias("zs"))


@query("r17_transform_points", sql("SELECT z, y, x, round(6e-1*(z-5)-8e-1*(y-5)+5, 6)+0e0 AS tz, round(8e-1*(z-5)+6e-1*(y-5)+5, 6)+0e0 AS ty FROM voxels"))
def r17(t: Inputs):
    m = g.rotation([F.lit(0.0), F.lit(0.0), F.lit(1.0)], F.lit(0.6), F.lit(0.8))
    moved = g.turn(m, [F.col(c) - 5 for c in "zyx"])
    return t.voxels.select("z", "y", "x", *((F.round(e + 5, 6) + 0.0).alias(f"t{a}") for a, e in zip("zy", moved, strict=False)))
