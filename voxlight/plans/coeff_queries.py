"""Coefficients from projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coeff, image
from .catalog import query
from .fixtures import Inputs, sql
from .ray_queries import R6
from .volume_queries import PIXELS, U8, pixels

#: The projection's image: what Beer-Lambert leaves of a ray, with a touch of noise from the place.
PIXEL = 0.25
RAYS = "SELECT z, x, count(*) FILTER (label=1) AS li, count(*) FILTER (label=2) AS lo, count(*) FILTER (label=3) AS cr, count(*) FILTER (label=4) AS bu, 24-count(*) AS va FROM voxels GROUP BY z, x"
SEEN = "SELECT *, round(exp(-(li*0.02e0+lo*0.01e0+cr*0.03e0+bu*0.005e0)*0.25e0)*(1-((z*7+x*3)%11)/1000e0), 6) AS intensity FROM rays"


def rays(t: Inputs):
    return coeff.ray_class_counts(t.voxels, t.volume)


def projection(t: Inputs):
    r = rays(t)
    e = F.exp(-(F.col("li") * 0.02 + F.col("lo") * 0.01 + F.col("cr") * 0.03 + F.col("bu") * 0.005) * PIXEL)
    return r.select(F.col("z").alias("y"), "x", F.round(e * (1 - ((F.col("z") * 7 + F.col("x") * 3) % 11) / 1000.0), 6).alias("value"))


def seen(t: Inputs):
    return coeff.at_pixels(rays(t), projection(t))


@query("c1_ray_class_counts", sql("SELECT z, x, li, lo, cr, bu, va FROM rays", rays=RAYS))
def c1(t: Inputs):
    return rays(t).select("z", "x", "li", "lo", "cr", "bu", "va")


@query("c2_region_only", sql("SELECT z, x, min(label)=max(label) AS strict FROM voxels GROUP BY z, x HAVING sum(label)=count(*)"))
def c2(t: Inputs):
    strict = coeff.region_only(t.voxels, 1, strict=True).withColumn("strict", F.lit(True))
    return coeff.region_only(t.voxels, 1).join(strict, ["z", "x"], "left").select("z", "x", F.coalesce("strict", F.lit(False)).alias("strict"))


@query("c3_region_with_base", sql("SELECT z, x FROM voxels WHERE label<>1 GROUP BY z, x HAVING sum(label)=2*count(*)"))
def c3(t: Inputs):
    return coeff.region_only(t.voxels, 2, base=1)


@query("c4_region_any", sql("SELECT DISTINCT z, x FROM voxels WHERE label = 4"))
def c4(t: Inputs):
    return coeff.region_any(t.voxels, 4)


#: A region with holes: cells of the projection whose event is no error.
REGION = "SELECT DISTINCT CAST(event_id//24 AS INT) AS y, CAST(event_id%24 AS INT) AS x FROM events WHERE user_id%50<>0"


def region(t: Inputs):
    return t.events.where("user_id%50<>0").selectExpr("CAST(event_id div 24 AS INT) AS y", "CAST(event_id%24 AS INT) AS x").distinct()


#: Two uneven blobs, far from periodic.
BLOB = "SELECT CAST(event_id//48 AS INT) AS y, CAST(event_id%48 AS INT) AS x FROM events WHERE (event_id//48-14)*(event_id//48-14)+(event_id%48-20)*(event_id%48-20)<70 OR (event_id//48-9)*(event_id//48-9)+2*(event_id%48-33)*(event_id%48-33)<50"


@query(
    "c5_erode",
    sql(
        "SELECT y, x FROM e2, size WHERE y >= CAST(floor(ny*1e-1) AS INT) AND y < CAST(floor(ny*9e-1) AS INT) AND x >= 2 AND x < 21",
        region=REGION, size="SELECT CAST(max(event_id)//24+1 AS INT) AS ny FROM events", e1="SELECT a.y, a.x FROM region a JOIN region b ON a.y=b.y AND b.x BETWEEN a.x-1 AND a.x+1 GROUP BY ALL HAVING count(*) = least(a.x+1,23)-greatest(a.x-1,0)+1",
        e2="SELECT a.y, a.x FROM e1 a JOIN e1 b ON a.x=b.x AND b.y BETWEEN a.y-1 AND a.y+1 CROSS JOIN size GROUP BY a.y, a.x, ny HAVING count(*) = least(a.y+1,ny-1)-greatest(a.y-1,0)+1",
    ),
)
def c5(t: Inputs):
    ny = t.events.agg(F.max("event_id")).first()[0]
    return image.erode(region(t), ((ny or 0) // 24 + 1, 24), k=3, iterations=1)


@query(
    "c6_fill_gaps",
    sql(
        "SELECT DISTINCT x, unnest(range(y, CASE WHEN n-y<4 THEN n ELSE y+1 END)) AS y FROM (SELECT *, lead(y) OVER (PARTITION BY x ORDER BY y) AS n FROM f1)",
        spots="SELECT DISTINCT CAST(event_id//24 AS INT) AS y, CAST(event_id%24 AS INT) AS x FROM events WHERE user_id%3=0",
        f1="SELECT DISTINCT y, CAST(unnest(range(x, CASE WHEN n-x<4 THEN n ELSE x+1 END)) AS INT) AS x FROM (SELECT *, lead(x) OVER (PARTITION BY y ORDER BY x) AS n FROM spots)",
    ),
)
def c6(t: Inputs):
    some = t.events.where("user_id%3=0").selectExpr("CAST(event_id div 24 AS INT) AS y", "CAST(event_id%24 AS INT) AS x").distinct()
    return image.fill_gaps(some, 4).select("x", F.col("y").cast("long").alias("y"))


HIST = "SELECT *, sum(n) OVER up AS w, sum(n*u8) OVER up AS m, sum(n*n) OVER up AS q, sum(n) OVER whole AS wt, sum(n*u8) OVER whole AS mt, sum(n*n) OVER whole AS qt FROM (SELECT image_id, u8, count(*)::BIGINT AS n FROM u8 GROUP BY ALL) WINDOW up AS (PARTITION BY image_id ORDER BY u8), whole AS (PARTITION BY image_id)"
SCORES = {
    "otsu": "(w::DOUBLE)*(wt-w)::DOUBLE*pow(m/w::DOUBLE-(mt-m)/nullif(wt-w,0)::DOUBLE,2)",
    "isodata": "-abs((m/w::DOUBLE+(mt-m)/nullif(wt-w,0)::DOUBLE)/2-u8)",
    "yen": "ln((w/wt::DOUBLE)*(w/wt::DOUBLE)*(1-w/wt::DOUBLE)*(1-w/wt::DOUBLE)/((q/(wt::DOUBLE*wt))*nullif((qt-q)/(wt::DOUBLE*wt),0)))",
}


def best(method: str) -> str:
    return sql(f"SELECT image_id, CAST(u8 AS DOUBLE) AS threshold FROM (SELECT image_id, u8, row_number() OVER (PARTITION BY image_id ORDER BY s DESC, u8) AS r FROM (SELECT image_id, u8, {SCORES[method]} AS s FROM hist) WHERE s IS NOT NULL) WHERE r = 1", pixels=PIXELS, u8=U8, hist=HIST)


@query("c7_threshold_mean", sql("SELECT image_id, avg(u8) AS threshold FROM u8 GROUP BY ALL", pixels=PIXELS, u8=U8))
def c7_mean(t: Inputs):
    return image.threshold(image.minmax_u8(pixels(t)), "mean")


@query("c7_threshold_otsu", best("otsu"))
def c7_otsu(t: Inputs):
    return image.threshold(image.minmax_u8(pixels(t)), "otsu")


@query("c7_threshold_isodata", best("isodata"))
def c7_isodata(t: Inputs):
    return image.threshold(image.minmax_u8(pixels(t)), "isodata")


@query("c7_threshold_yen", best("yen"))
def c7_yen(t: Inputs):
    return image.threshold(image.minmax_u8(pixels(t)), "yen")


@query(
    "c7_threshold_triangle",
    sql(
        "SELECT image_id, CAST(u8 AS DOUBLE) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY top*abs(u8-far)-n*abs(peak-far) DESC, u8) AS r FROM ends WHERE u8 BETWEEN least(peak, far) AND greatest(peak, far) AND far<>peak) WHERE r = 1",
        pixels=PIXELS, u8=U8, bins="SELECT image_id, u8, count(*) AS n FROM u8 GROUP BY ALL",
        peaks="SELECT image_id, u8 AS peak, n AS top FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, u8) AS r FROM bins) WHERE r = 1",
        ends="SELECT b.*, peak, top, CASE WHEN hi-peak>=peak-lo THEN hi ELSE lo END AS far FROM bins b JOIN peaks USING (image_id) JOIN (SELECT image_id, min(u8) AS lo, max(u8) AS hi FROM bins GROUP BY ALL) USING (image_id)",
    ),
)
def c7_triangle(t: Inputs):
    return image.threshold(image.minmax_u8(pixels(t)), "triangle")


@query(
    "c7_threshold_li",
    sql(
        "SELECT image_id, CASE WHEN t IS NOT NULL THEN round(t - 1, 6) END AS threshold FROM rounds JOIN (SELECT image_id, max(r) AS r FROM rounds GROUP BY image_id) USING (image_id, r)",
        pixels=PIXELS, u8=U8, bins="SELECT image_id, u8 + 1e0 AS level, count(*) AS n FROM u8 GROUP BY ALL",
        rounds="""SELECT image_id, 0 AS r, sum(n*level)/sum(n) AS t, false AS ended FROM bins GROUP BY image_id UNION ALL
            SELECT image_id, r + 1, (m1-m0)/(ln(m1)-ln(m0)), coalesce(abs((m1-m0)/(ln(m1)-ln(m0))-t) < 1e-6, true) FROM (
                SELECT s.image_id, r, t, sum(n*level) FILTER (level <= t)/sum(n) FILTER (level <= t) AS m0, sum(n*level) FILTER (level > t)/sum(n) FILTER (level > t) AS m1
                FROM rounds s JOIN bins b USING (image_id) WHERE NOT ended AND r < 1000 GROUP BY s.image_id, r, t)""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def c7_li(t: Inputs):
    return image.threshold_iterative(image.minmax_u8(pixels(t)), "li").withColumn("threshold", R6("threshold"))


#: Of a smoothed histogram h: its slopes that are not 0, and the bins before which it rises and after which it falls.
SLOPES = "SELECT *, list_filter(list_transform(range(1, 256), lambda i: {'bin': i - 1, 's': sign(h[i+1] - h[i])}), lambda e: e.s <> 0) AS slopes FROM "
PEAKS = "list_transform(list_filter(range(1, len(slopes) + 1), lambda k: slopes[k].s < 0 AND (k = 1 OR slopes[k-1].s > 0)), lambda k: slopes[k].bin) AS peaks"


@query(
    "c7_threshold_minimum",
    sql(
        """SELECT image_id, CASE WHEN len(peaks) = 2 THEN CAST(peaks[1] + list_position(h[peaks[1]+1:peaks[2]+1], list_min(h[peaks[1]+1:peaks[2]+1])) - 1 AS DOUBLE) END AS threshold
            FROM rounds JOIN (SELECT image_id, max(r) AS r FROM rounds GROUP BY image_id) USING (image_id, r)""",
        pixels=PIXELS, u8=U8, bins="SELECT image_id, u8, count(*)::DOUBLE AS n FROM u8 GROUP BY ALL",
        start="SELECT image_id, list(coalesce(n, 0e0) ORDER BY u8) AS h FROM (SELECT DISTINCT image_id FROM bins) CROSS JOIN range(256) s(u8) LEFT JOIN bins USING (image_id, u8) GROUP BY image_id",
        rounds=f"""SELECT image_id, 0 AS r, h, {PEAKS} FROM ({SLOPES} start) UNION ALL
            SELECT image_id, r, h, {PEAKS} FROM ({SLOPES} (SELECT image_id, r + 1 AS r, list_transform(range(1, 257), lambda i: h[greatest(i-1, 1)]*(1e0/3) + h[i]*(1e0/3) + h[least(i+1, 256)]*(1e0/3)) AS h FROM rounds WHERE len(peaks) > 2 AND r < 9999))""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def c7_minimum(t: Inputs):
    return image.threshold_iterative(image.minmax_u8(pixels(t)), "minimum")


@query("c7_threshold_local", sql("SELECT a.image_id, a.y, a.x, round(avg(b.value), 6) AS local FROM pixels a JOIN pixels b ON a.image_id = b.image_id AND b.y BETWEEN a.y-2 AND a.y+2 AND b.x BETWEEN a.x-2 AND a.x+2 GROUP BY ALL", pixels=PIXELS))
def c7_local(t: Inputs):
    return image.local_mean(pixels(t), 5).select("image_id", "y", "x", R6("local").alias("local"))


@query(
    "c8_register_shift",
    sql(
        "SELECT * FROM (SELECT CAST(dy AS INT) AS dy, CAST(dx AS INT) AS dx, count(*) AS overlap FROM b, range(-3, 4) s(dy), range(-3, 4) u(dx), region a WHERE a.y = b.y+dy AND a.x = b.x+dx GROUP BY ALL) ORDER BY overlap DESC, dy*dy+dx*dx, dy, dx LIMIT 1",
        region=REGION, b="SELECT y+2 AS y, x-1 AS x FROM region WHERE (y*5+x*3)%7<>0",
    ),
)
def c8(t: Inputs):
    a = region(t)
    b = a.where("(y*5+x*3)%7<>0").select((F.col("y") + 2).alias("y"), (F.col("x") - 1).alias("x"))
    return image.register_shift(a, b, 3)


@query(
    "c8_register_far",
    sql(
        "SELECT * FROM (SELECT CAST(dy AS INT) AS dy, CAST(dx AS INT) AS dx, count(*) AS overlap FROM b, range(-12, 13) s(dy), range(-12, 13) u(dx), region a WHERE a.y = b.y+dy AND a.x = b.x+dx GROUP BY ALL) ORDER BY overlap DESC, dy*dy+dx*dx, dy, dx LIMIT 1",
        region=BLOB, b="SELECT y+9 AS y, x-6 AS x FROM region WHERE (y*5+x*3)%7<>0",
    ),
)
def c8_far(t: Inputs):
    """A shift of (-9, 6), found from bins; the SQL tries every shift up to 12."""
    a = t.spark.sql(BLOB.replace("//", " div ").replace("FROM events", "FROM {events}"), events=t.events)
    b = a.where("(y*5+x*3)%7<>0").select((F.col("y") + 9).alias("y"), (F.col("x") - 6).alias("x"))
    return image.register_coarse_to_fine(a, b, 12)


@query(
    "c8_register_periodic",
    sql(
        "SELECT * FROM (SELECT CAST(dy AS INT) AS dy, CAST(dx AS INT) AS dx, count(*) AS overlap FROM b, range(-12, 13) s(dy), range(-12, 13) u(dx), stripes a WHERE a.y = b.y+dy AND a.x = b.x+dx GROUP BY ALL) ORDER BY overlap DESC, dy*dy+dx*dx, dy, dx LIMIT 1",
        stripes="SELECT DISTINCT CAST((event_id//60)%40 AS INT) AS y, CAST(event_id%60 AS INT) AS x FROM events WHERE ((event_id//60)%40)%5 < 2 AND (event_id%60)%6 < 3 AND user_id%7<>0", b="SELECT y+8 AS y, x-7 AS x FROM stripes WHERE (y*5+x*3)%11<>0",
    ),
)
def c8_periodic(t: Inputs):
    """A mask that repeats every 5 and 6 pixels, moved by (-8, 7): many shifts overlap nearly as well as the right one."""
    a = t.events.selectExpr("CAST((event_id div 60)%40 AS INT) AS y", "CAST(event_id%60 AS INT) AS x", "user_id").where("y%5 < 2 and x%6 < 3 and user_id%7<>0").select("y", "x").distinct()
    b = a.where("(y*5+x*3)%11<>0").select((F.col("y") + 8).alias("y"), (F.col("x") - 7).alias("x"))
    return image.register_coarse_to_fine(a, b, 12)


TURNED = "SELECT CAST(event_id%180 AS INT) AS angle, CAST((event_id//180)%12 AS INT) AS y, CAST((event_id//180)//12 AS INT) AS x, CAST((user_id+event_id%180)%3=0 AS INT) AS mask FROM events"
MODEL = "SELECT y, x, CAST((y*3+x)%2 AS INT) AS mask FROM (SELECT DISTINCT y, x FROM masks)"
SCAN = "SELECT angle, avg(abs(a.mask-coalesce(m.mask,0))) AS difference, sum(a.mask) AS area FROM masks a LEFT JOIN model m USING (y, x) GROUP BY ALL"


@query(
    "c9_pick_angles",
    sql(
        "SELECT (SELECT angle FROM scan, first WHERE abs(angle-o)<=10 ORDER BY difference, angle LIMIT 1) AS offset, (SELECT angle FROM scan, first WHERE abs(angle-v)<=10 ORDER BY area DESC, angle LIMIT 1) AS viewing",
        masks=TURNED, model=MODEL, scan=SCAN, first="SELECT (SELECT angle FROM scan WHERE angle%10=0 ORDER BY difference, angle LIMIT 1) AS o, (SELECT angle FROM scan WHERE angle%10=0 ORDER BY area DESC, angle LIMIT 1) AS v",
    ),
)
def c9_pick(t: Inputs):
    """Every ten degrees, then single degrees around the picks."""
    masks = t.spark.sql(TURNED.replace("//", " div ").replace("FROM events", "FROM {events}"), events=t.events)
    model = masks.select("y", "x").distinct().select("y", "x", ((F.col("y") * 3 + F.col("x")) % 2).cast("int").alias("mask"))
    return image.two_pass_angles(masks, model)


@query(
    "c9_scan_angles",
    sql(
        "SELECT a.angle, avg(abs(a.mask-coalesce(m.mask,0))) AS difference, CAST(sum(a.mask) AS BIGINT) AS area FROM masks a LEFT JOIN model m USING (y, x) GROUP BY ALL",
        masks="SELECT CAST(event_id%18*10 AS INT) AS angle, CAST((event_id//18)//24 AS INT) AS y, CAST((event_id//18)%24 AS INT) AS x, CAST(user_id%3=0 AS INT) AS mask FROM events", model="SELECT CAST((event_id//18)//24 AS INT) AS y, CAST((event_id//18)%24 AS INT) AS x, CAST(max(event_id)%2 AS INT) AS mask FROM events GROUP BY ALL",
    ),
)
def c9(t: Inputs):
    cell = ["CAST((event_id div 18) div 24 AS INT) AS y", "CAST((event_id div 18)%24 AS INT) AS x"]
    masks = t.events.selectExpr("CAST(event_id%18*10 AS INT) AS angle", *cell, "CAST(user_id%3=0 AS INT) AS mask")
    model = t.events.selectExpr(*cell, "event_id").groupBy("y", "x").agg((F.max("event_id") % 2).cast("int").alias("mask"))
    return image.scan_angles(masks, model)


RANKED = "SELECT *, row_number() OVER (ORDER BY CASE WHEN li<>0 THEN cr/li::DOUBLE ELSE 1e0 END DESC, z, x) AS r, count(*) OVER () AS total FROM seen WHERE cr > 0"


@query("c10_rank_columns", sql("SELECT z, x, CASE WHEN li<>0 THEN cr/li::DOUBLE ELSE 1e0 END AS score FROM ranked WHERE r <= floor(total*0.5e0)", rays=RAYS, seen=SEEN, ranked=RANKED))
def c10(t: Inputs):
    return coeff.rank_columns(seen(t).where("cr > 0"), "cr", 0.5, "proportion").select("z", "x", "score")


@query("c11_coef_single", sql("SELECT z, x, round(-ln(intensity)/(li*0.25e0), 6) AS coef FROM seen WHERE li > 0", rays=RAYS, seen=SEEN))
def c11(t: Inputs):
    return coeff.coef_single(seen(t), "li", PIXEL).select("z", "x", R6("coef").alias("coef"))


@query("c12_coef_multi", sql("SELECT z, x, round(-((li*0.02e0+lo*0.01e0+bu*0.005e0)*0.25e0+ln(intensity))/(cr*0.25e0), 6) AS coef FROM seen WHERE cr > 0", rays=RAYS, seen=SEEN))
def c12(t: Inputs):
    return coeff.coef_multi(seen(t), "cr", PIXEL, {"li": 0.02, "lo": 0.01, "bu": 0.005}).select("z", "x", R6("coef").alias("coef"))


def _step(name: str, fraction: float, target: str, single: bool, given: str) -> dict[str, str]:
    score = f"{target}::DOUBLE" if single else f"CASE WHEN li<>0 THEN {target}/li::DOUBLE ELSE 1e0 END"
    where = "lo=0 AND cr=0 AND bu=0" if single else "cr > 0"
    value = "-ln(intensity)/(li*0.25e0)" if single else f"-((li*{given}+lo*0.01e0+bu*0.005e0)*0.25e0+ln(intensity))/(cr*0.25e0)"
    top = f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {score} DESC, z, x) AS r, count(*) OVER () AS total FROM seen WHERE {where}) WHERE r <= floor(total*{fraction}e0)"
    return {f"{name}_top": top, name: f"SELECT avg({value}) AS mu FROM {name}_top"}


SEQUENCE, PARTS = {}, []
for _f in (1.0, 0.75, 0.5, 0.25):
    _n = f"f{int(_f * 100)}"
    SEQUENCE |= _step(f"{_n}_li", _f, "li", True, "") | _step(f"{_n}_cr", _f, "cr", False, f"(SELECT mu FROM {_n}_li)")
    PARTS += [f"SELECT {_f}e0 AS fraction, '{c}' AS label, round(mu, 6) AS mu FROM {_n}_{c}" for c in ("li", "cr")]


@query("c13_coef_sequence", sql(" UNION ALL ".join(PARTS), rays=RAYS, seen=SEEN, **SEQUENCE))
def c13(t: Inputs):
    rows = seen(t).cache()
    columns = {"li": rows.where("lo=0 and cr=0 and bu=0"), "cr": rows.where("cr > 0")}
    found = coeff.coef_sequence(columns, PIXEL, given={"lo": 0.01, "bu": 0.005})
    rows.unpersist()
    return found.withColumn("mu", R6("mu"))


def _all_classes(fraction: float) -> tuple[dict[str, str], list[str]]:
    """Each class in turn, given those before it; the base class among its own columns alone."""
    out, known, n = {}, [], f"a{int(fraction * 100)}"
    for c in ("li", "lo", "cr", "bu"):
        base = c == "li"
        score = "li::DOUBLE" if base else f"CASE WHEN li<>0 THEN {c}/li::DOUBLE ELSE 1e0 END"
        where = "lo=0 AND cr=0 AND bu=0 AND li>0" if base else f"{c}>0"
        others = "+".join(f"{k}*(SELECT mu FROM {n}_{k})" for k in known) or "0"
        value = f"-(({others})*0.25e0+ln(intensity))/({c}*0.25e0)"
        out[f"{n}_{c}_top"] = f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {score} DESC, z, x) AS r, count(*) OVER () AS total FROM seen WHERE {where}) WHERE r <= floor(total*{fraction}e0)"
        out[f"{n}_{c}"] = f"SELECT coalesce(avg({value}), 0) AS mu FROM {n}_{c}_top"
        known.append(c)
    return out, [f"SELECT {fraction}e0 AS fraction, '{c}' AS label, round(mu, 6) AS mu FROM {n}_{c}" for c in known]


ALL_STEPS, ALL_PARTS = {}, []
for _f in (1.0, 0.75, 0.5, 0.25):
    _steps, _parts = _all_classes(_f)
    ALL_STEPS |= _steps
    ALL_PARTS += _parts


@query("c13_coef_sequence_all", sql(" UNION ALL ".join(ALL_PARTS), rays=RAYS, seen=SEEN, **ALL_STEPS))
def c13_all(t: Inputs):
    """All four classes, none given."""
    rows = seen(t).cache()
    columns = {"li": rows.where("lo=0 and cr=0 and bu=0 and li>0"), **{c: rows.where(f"{c} > 0") for c in ("lo", "cr", "bu")}}
    found = coeff.coef_sequence(columns, PIXEL)
    rows.unpersist()
    return found.withColumn("mu", R6("mu"))


@query("c14_coef_stats", sql("SELECT event_type AS label, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_pop(value), 6) AS std, round(skewness_pop, 4) AS skew, round(avg(value)+2*stddev_pop(value), 6) AS plus2, round(avg(value)*0.8e0, 6) AS low_limit FROM (SELECT event_type, value, avg(pow(value-m, 3)) OVER (PARTITION BY event_type)/pow(s, 3) AS skewness_pop FROM events JOIN (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY ALL) USING (event_type)) GROUP BY event_type, skewness_pop"))
def c14(t: Inputs):
    out = coeff.coef_stats(t.events.select(F.col("event_type").alias("label"), F.col("value").alias("coef")), "label")
    return out.select("label", "n", R6("mean").alias("mean"), R6("median").alias("median"), R6("std").alias("std"), F.round("skew", 4).alias("skew"), R6("plus2").alias("plus2"), R6("low_limit").alias("low_limit"))


@query("c14_histogram", "SELECT event_type, CAST(least(floor((value-lo)/(hi-lo)*50),49) AS BIGINT) AS bin, count(*) AS n FROM events JOIN (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY ALL) USING (event_type) GROUP BY ALL")
def c14_histogram(t: Inputs):
    return coeff.histogram(t.events, 50, "value", ("event_type",))


#: Values around 20 and around 60, so that two peaks stand out.
PEAKED = "SELECT event_id, CAST(CASE WHEN event_id%2=0 THEN 20 ELSE 60 END + event_id*7%11 + event_id*13%7 - 8 AS DOUBLE) AS coef FROM events"


@query(
    "c15_split_two_peaks",
    sql(
        "SELECT event_id, coef FROM peaked, border WHERE b IS NULL OR coef < b",
        peaked=PEAKED, ends="SELECT min(coef) AS lo, max(coef) AS hi FROM peaked", bins="SELECT i AS bin, count(coef) AS n FROM range(50) r(i) LEFT JOIN (SELECT CAST(least(floor((coef-lo)/(hi-lo)*50),49) AS BIGINT) AS bin, coef FROM peaked, ends) h ON h.bin = i GROUP BY ALL",
        tops="SELECT bin, n FROM (SELECT *, lag(n) OVER (ORDER BY bin) AS l, lead(n) OVER (ORDER BY bin) AS r FROM bins) WHERE n>l AND n>r",
        sides="SELECT t.bin, t.n, coalesce(max(b.bin) FILTER (b.bin<t.bin AND b.n>t.n), -1) AS a, coalesce(min(b.bin) FILTER (b.bin>t.bin AND b.n>t.n), 50) AS z FROM tops t CROSS JOIN bins b GROUP BY ALL",
        strong="SELECT s.bin FROM sides s JOIN bins b ON b.bin > a AND b.bin < z GROUP BY s.bin, s.n HAVING s.n - greatest(min(b.n) FILTER (b.bin<=s.bin), min(b.n) FILTER (b.bin>=s.bin)) >= 100 ORDER BY s.bin LIMIT 2",
        border="SELECT CASE WHEN count(*)=2 THEN max(lo)+avg(bin)*(max(hi)-max(lo))/50 END AS b FROM strong, ends",
    ),
)
def c15(t: Inputs):
    base = F.when(F.col("event_id") % 2 == 0, 20).otherwise(60)
    rows = t.events.select("event_id", (base + F.col("event_id") * 7 % 11 + F.col("event_id") * 13 % 7 - 8).cast("double").alias("coef"))
    return coeff.split_two_peaks(rows)


@query("c16_pick_coefficients", "SELECT event_type AS label, quantile_cont(value, 0.5) AS mu FROM events WHERE event_id%4=2 GROUP BY ALL")
def c16(t: Inputs):
    rows = t.events.select(F.col("event_type").alias("label"), ((F.col("event_id") % 4) / 4.0).alias("fraction"), F.col("value").alias("coef"))
    return coeff.pick_coefficients(coeff.coef_stats(rows, "fraction", "label"))


@query(
    "c17_tabulate_orientations",
    sql(
        "SELECT w.orientation, w.click, w.view, round((c.click-w.click)/c.click*100, 6) AS click_diff, round((c.view-w.view)/c.view*100, 6) AS view_diff FROM wide w, centre c",
        wide="SELECT CAST(event_id%19*10 AS VARCHAR) AS orientation, round(avg(value) FILTER (event_type='click'), 6) AS click, round(avg(value) FILTER (event_type='view'), 6) AS view FROM events GROUP BY ALL", centre="SELECT * FROM wide WHERE orientation = '90'",
    ),
)
def c17(t: Inputs):
    long = t.events.groupBy((F.col("event_id") % 19 * 10).cast("string").alias("orientation"), F.col("event_type").alias("label")).agg(R6(F.avg("value")).alias("mean"))
    out = coeff.tabulate_orientations(long, "90", ("click", "view"))
    return out.select("orientation", "click", "view", R6("click_diff").alias("click_diff"), R6("view_diff").alias("view_diff"))
