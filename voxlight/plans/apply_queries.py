"""Factors applied, statistics, reports, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import absorb, reflections, report, sampling
from ..session import scratch
from ..sources import ingest
from .catalog import query
from .fixtures import Inputs, sql
from .ray_queries import R6

FACTOR = "SELECT refl_id, 1/(1+intensity_sum) AS factor FROM reflections"


def simple_factors(t: Inputs):
    return t.reflections.select("refl_id", (1 / (1 + F.col("intensity_sum"))).alias("factor"))


@query("r1_attach_factor", sql("SELECT refl_id, intensity_sum, factor AS analytical_correction FROM reflections JOIN f USING (refl_id)", f=FACTOR))
def r1(t: Inputs):
    return reflections.attach_factor(t.reflections, simple_factors(t)).select("refl_id", "intensity_sum", "analytical_correction")


@query("r2_apply_factor", sql("SELECT refl_id, round(intensity_sum/factor, 6) AS intensity_sum, round(variance_sum/(factor*factor), 6) AS variance_sum, round(intensity_prf/factor, 6) AS intensity_prf, round(variance_prf/(factor*factor), 6) AS variance_prf FROM reflections JOIN f USING (refl_id)", f=FACTOR))
def r2(t: Inputs):
    pairs = [("intensity_sum", "variance_sum"), ("intensity_prf", "variance_prf")]
    rows = reflections.apply_factor(reflections.attach_factor(t.reflections, simple_factors(t)), pairs)
    return rows.select("refl_id", *(R6(c).alias(c) for p in pairs for c in p))


@query("r3_assert_aligned", sql("SELECT refl_id, 'left' AS only_in FROM reflections WHERE flags = 3 UNION ALL SELECT -event_id-1, 'right' FROM events WHERE event_type = 'error'"))
def r3(t: Inputs):
    other = t.reflections.where("flags <> 3").select("refl_id").union(t.events.where("event_type = 'error'").select(-F.col("event_id") - 1))
    return reflections.misaligned(t.reflections, other)


OBS = "SELECT l_returnflag AS dataset, l_linestatus AS method, CAST(l_partkey%400//100 AS INT) AS h, CAST(l_partkey%100//10 AS INT) AS k, CAST(l_partkey%10 AS INT) AS l, CASE WHEN l_linenumber%2=0 THEN 1 ELSE -1 END AS sign, l_extendedprice AS i, l_quantity AS sigma, CAST(l_suppkey%2 AS INT) AS half FROM lineitem"
MERGED = """SELECT {by} h, k, l, avg(i) AS mean, count(*) AS n, sum(i/(sigma*sigma))/sum(1/(sigma*sigma)) AS merged, sqrt(1/sum(1/(sigma*sigma))) AS ms, avg(i) FILTER (sign>0) AS plus, avg(i) FILTER (sign<0) AS minus,
    avg(i) FILTER (sign>0 AND half=0)-avg(i) FILTER (sign<0 AND half=0) AS d0, avg(i) FILTER (sign>0 AND half=1)-avg(i) FILTER (sign<0 AND half=1) AS d1 FROM obs GROUP BY ALL"""


def observations(t: Inputs):
    return t.table("lineitem").selectExpr("l_returnflag AS dataset", "l_linestatus AS method", "CAST(l_partkey%400 div 100 AS INT) AS h", "CAST(l_partkey%100 div 10 AS INT) AS k", "CAST(l_partkey%10 AS INT) AS l", "CASE WHEN l_linenumber%2=0 THEN 1 ELSE -1 END AS sign", "l_extendedprice AS i", "l_quantity AS sigma", "CAST(l_suppkey%2 AS INT) AS half")


STATS = "round(avg(merged/ms), 6) AS i_over_sigma_mean, round(sum(abs(plus-minus))/sum((plus+minus)/2), 6) AS r_anom, round(corr(d0, d1), 5) AS cc_anom"
FIGURES = [("r_merge", 6), ("i_over_sigma_mean", 6), ("r_anom", 6), ("cc_anom", 5)]


@query("r4_merging_stats", sql(f"SELECT (SELECT round(sum(abs(i-mean))/sum(i), 6) FROM obs JOIN per USING (h, k, l) WHERE n>1) AS r_merge, {STATS} FROM per", obs=OBS, per=MERGED.format(by="")))
def r4(t: Inputs):
    return reflections.merging_stats(observations(t)).select(*(F.round(c, n).alias(c) for c, n in FIGURES))


@query("r5_stats_by_dataset", sql(f"SELECT a.*, r_merge FROM (SELECT dataset, method, {STATS} FROM per GROUP BY ALL) a JOIN (SELECT dataset, method, round(sum(abs(i-mean))/sum(i), 6) AS r_merge FROM obs JOIN per USING (dataset, method, h, k, l) WHERE n>1 GROUP BY ALL) USING (dataset, method)", obs=OBS, per=MERGED.format(by="dataset, method,")))
def r5(t: Inputs):
    rows = reflections.merging_stats(observations(t), "dataset", "method")
    return rows.select("dataset", "method", *(F.round(c, n).alias(c) for c, n in FIGURES))


@query(
    "r5_stats_filled",
    sql(
        "SELECT dataset, method, round(CASE WHEN method='F' THEN o.r_merge ELSE a.r_merge END, 6) AS r_merge, round(o.i_mean, 6) AS i_over_sigma_mean FROM overall o JOIN apart a USING (dataset, method)",
        obs=OBS, per=MERGED.format(by="dataset, method,"),
        overall="SELECT dataset, method, sum(abs(i-mean))/sum(i) AS r_merge, max(i_mean) AS i_mean FROM obs JOIN per USING (dataset, method, h, k, l) JOIN (SELECT dataset, method, avg(merged/ms) AS i_mean FROM per GROUP BY ALL) USING (dataset, method) WHERE n>1 GROUP BY ALL",
        signed="SELECT dataset, method, h, k, l, sign, avg(i) AS mean, count(*) AS n FROM obs GROUP BY ALL",
        apart="SELECT dataset, method, sum(abs(i-mean))/sum(i) AS r_merge FROM obs JOIN signed USING (dataset, method, h, k, l, sign) WHERE n>1 GROUP BY ALL",
    ),
)
def r5_filled(t: Inputs):
    """The figure is missing for all methods but one, and is taken from the anomalous statistics there."""
    stats = reflections.merging_stats(observations(t), "dataset", "method").select("dataset", "method", F.when(F.col("method") == "F", F.col("r_merge")).alias("r_merge"), "i_over_sigma_mean")
    return reflections.fill_from_anomalous(stats, observations(t), "dataset", "method").select("dataset", "method", R6("r_merge").alias("r_merge"), R6("i_over_sigma_mean").alias("i_over_sigma_mean"))


@query("r6_factor_sensitivity", sql("SELECT event_type AS variant, round(avg(abs(value/100-factor)), 6) AS mean_gap, round(max(abs(value/100-factor)), 6) AS max_gap, round(min(abs(value/100-factor)), 6) AS min_gap FROM events JOIN f ON refl_id = event_id GROUP BY ALL", f=FACTOR))
def r6(t: Inputs):
    variants = t.events.select(F.col("event_type").alias("variant"), F.col("event_id").alias("refl_id"), (F.col("value") / 100).alias("factor"))
    out = reflections.factor_sensitivity(simple_factors(t), variants)
    return out.select("variant", *(R6(c).alias(c) for c in ("mean_gap", "max_gap", "min_gap")))


LOGS = "SELECT event_id, 'set' || (user_id%9) AS dataset, event_type AS kind, CAST(event_id%5 AS DOUBLE)+5e-1*(event_id%2) AS a, (user_id%4)/100e0 AS b FROM events"


def logs(t: Inputs):
    text = F.concat(F.lit("start\nParameters: a = 9.5, b = 0.5\nmore\nParameters: a = "), F.concat((F.col("event_id") % 5).cast("string"), F.when(F.col("event_id") % 2 == 1, ".5").otherwise(".0")), F.lit(", b = "), F.format_string("0.0%d", F.col("user_id") % 4), F.lit("\nend"))
    return t.events.select(F.col("event_id").cast("string").alias("file_path"), F.when(F.col("event_type") == "view", "no parameters").otherwise(text).alias("text"))


@query("r7_errormodel_scan", sql("SELECT CAST(event_id AS VARCHAR) AS file_path, CASE WHEN kind<>'view' THEN a ELSE -1 END AS a, CASE WHEN kind<>'view' THEN b ELSE -1 END AS b, CASE WHEN kind='view' THEN 'None' WHEN a=1 OR b=0.02e0 THEN 'Fail' ELSE 'Ok' END AS status FROM logs", logs=LOGS))
def r7(t: Inputs):
    return report.errormodel_scan(logs(t)).fillna(-1.0, ["a", "b"]).fillna("None", ["status"])


@query("r8_errormodel_table", sql("SELECT dataset, max(CASE WHEN kind='click' THEN a END) AS a_click, max(CASE WHEN kind='click' THEN b END) AS b_click, max(CASE WHEN kind='error' THEN a END) AS a_error, max(CASE WHEN kind='error' THEN b END) AS b_error FROM logs GROUP BY ALL", logs=LOGS))
def r8(t: Inputs):
    scans = t.events.selectExpr("concat('set', user_id%9) AS dataset", "event_type AS kind", "CAST(event_id%5 AS DOUBLE)+0.5D*(event_id%2) AS a", "(user_id%4)/100D AS b")
    return report.errormodel_table(scans, ["click", "error"])


@query("r9_find_newest_match", "SELECT 'set' || (user_id%9) AS dataset, min('/data/set' || (user_id%9) || '/' || event_type || '_' || event_id || '.log') AS file_path FROM events WHERE event_type LIKE '%click%' GROUP BY ALL")
def r9(t: Inputs):
    files = t.events.selectExpr("concat('set', user_id%9) AS dataset", "concat('/data/set', user_id%9, '/', event_type, '_', event_id, '.log') AS file_path")
    return report.newest_match(files, "click")


@query(
    "r9_scan_log_tree",
    sql(
        "SELECT dataset, CASE WHEN kind<>'view' THEN a ELSE -1 END AS a, CASE WHEN kind<>'view' THEN b ELSE -1 END AS b, CASE WHEN kind='view' THEN 'None' WHEN a=1 OR b=0.02e0 THEN 'Fail' ELSE 'Ok' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY kind || '_' || n) AS r FROM heads WHERE n % 2 = 1) WHERE r = 1",
        logs=LOGS, heads="SELECT dataset, kind, min(event_id) AS n, arg_min(a, event_id) AS a, arg_min(b, event_id) AS b FROM logs GROUP BY ALL",
    ),
)
def r9_tree(t: Inputs):
    """A tree of logs, one folder a dataset and one a run, written and searched: the first log of each dataset whose run ends in an odd number."""
    path = scratch(t.spark, "logs")
    kinds = t.events.selectExpr("event_id", "event_type AS kind", "concat('set', user_id%9) AS dataset")
    text = logs(t).withColumn("event_id", F.col("file_path").cast("long")).select("event_id", "text")
    first = kinds.join(text, "event_id").groupBy("dataset", "kind").agg(F.min("event_id").alias("n"), F.min_by("text", "event_id").alias("value"))
    first.select("dataset", F.concat_ws("_", "kind", "n").alias("run"), "value").write.option("lineSep", "\n").partitionBy("dataset", "run").text(path)
    files = ingest.files_below(t.spark, path).select(F.regexp_extract("file_path", "dataset=([^/]+)", 1).alias("dataset"), F.regexp_extract("file_path", "run=([^/]+)", 1).alias("run"), "text")
    wanted = files.where(F.regexp_extract("run", "([0-9]+)$", 1).cast("long") % 2 == 1)
    newest = report.newest_match(wanted.select("dataset", F.col("run").alias("file_path")), "_").withColumnRenamed("file_path", "run")
    scans = report.errormodel_scan(files.join(newest, ["dataset", "run"]).select(F.col("dataset").alias("file_path"), "text"))
    return scans.withColumnRenamed("file_path", "dataset").fillna(-1.0, ["a", "b"]).fillna("None", ["status"])


@query(
    "r8_errormodel_wide",
    sql(
        "SELECT dataset, max(CASE WHEN kind='click' THEN status END) AS status_click, max(CASE WHEN kind='click' THEN a END) AS a_click, max(CASE WHEN kind='click' THEN b END) AS b_click, max(CASE WHEN kind='error' THEN status END) AS status_error, max(CASE WHEN kind='error' THEN a END) AS a_error, max(CASE WHEN kind='error' THEN b END) AS b_error FROM (SELECT *, CASE WHEN a=1 OR b=0.02e0 THEN 'Fail' ELSE 'Ok' END AS status FROM logs) GROUP BY ALL",
        logs=LOGS,
    ),
)
def r8_wide(t: Inputs):
    """The layout that names the outcome of each kind before its parameters."""
    scans = t.events.selectExpr("concat('set', user_id%9) AS dataset", "event_type AS kind", "CAST(event_id%5 AS DOUBLE)+0.5D*(event_id%2) AS a", "(user_id%4)/100D AS b")
    scans = scans.withColumn("status", F.when((F.col("a") == 1) | (F.col("b") == 0.02), "Fail").otherwise("Ok"))
    return report.errormodel_table(scans, ["click", "error"], ("status", "a", "b"))


PEAKS = "SELECT CAST(event_id//100 AS VARCHAR) AS file_path, event_id%100 AS pos, CAST(event_id%37 AS DOUBLE)+5e-1 AS height, CASE user_id%4 WHEN 0 THEN 'S' WHEN 1 THEN 'O' WHEN 2 THEN 'P' ELSE 'N' END AS atom FROM events WHERE event_id%100 BETWEEN 11 AND 79"


@query("r10_peak_table", sql("SELECT file_path, coalesce(arg_min(height, pos) FILTER (atom='S'), -1) AS S, coalesce(arg_min(height, pos) FILTER (atom='P'), -1) AS P FROM peaks GROUP BY ALL", peaks=PEAKS))
def r10(t: Inputs):
    """Files of a hundred lines, the list between lines 10 and 80."""
    pos = F.col("event_id") % 100
    atom = F.element_at(F.array(*map(F.lit, "SOPN")), (F.col("user_id") % 4 + 1).cast("int"))
    row = F.concat(F.format_string(" 0.1 0.2 0.3 x %d.5 1.0 ", F.col("event_id") % 37), atom)
    line = F.when(pos == 10, report.PEAKS_BEGIN).when(pos == 80, report.PEAKS_END).otherwise(row)
    lines = t.events.select(F.floor(F.col("event_id") / 100).cast("string").alias("file_path"), pos.alias("pos"), line.alias("line"))
    return report.peak_table(report.peak_rows(lines), ["S", "P"]).fillna(-1.0)


@query("r11_numeric_sort", "SELECT name, coalesce(number, -1) AS number, CAST(row_number() OVER (ORDER BY number NULLS LAST, name) AS INT) AS place FROM (SELECT DISTINCT name, CAST(nullif(regexp_extract(name, '(\\d+)', 1), '') AS BIGINT) AS number FROM (SELECT CASE WHEN event_id%11=0 THEN event_type ELSE 'x' || (user_id*17%1000) || '_' || (event_id%3) END AS name FROM events))")
def r11(t: Inputs):
    names = t.events.selectExpr("CASE WHEN event_id%11=0 THEN event_type ELSE concat('x', user_id*17%1000, '_', event_id%3) END AS name")
    return report.numeric_order(names, "name").fillna(-1)


def cuboid_sql() -> str:
    """A sum over a 200 x 200 midpoint mesh: another way to the same integral."""
    side = "CASE WHEN d<90 THEN (w-x)/nullif(abs(cos(radians(d))),0) ELSE x/nullif(abs(cos(radians(d))),0) END"
    return sql(
        f"SELECT CAST(d AS INT) AS degrees, round(avg(exp(-1e-2*(x+least({side}, (120e0-y)/nullif(sin(radians(d)),0))))), 3) AS expected FROM mesh GROUP BY ALL",
        mesh="SELECT a.d, 100e0 AS w, (i+5e-1)*5e-1 AS x, (j+5e-1)*6e-1 AS y FROM (SELECT DISTINCT event_id%18*10e0+5e0 AS d FROM events) a, range(200) b(i), range(200) c(j)",
    )


@query("r12_expected_absorption", cuboid_sql())
def r12(t: Inputs):
    angles = t.events.select((F.col("event_id") % 18 * 10.0 + 5.0).alias("d")).distinct()
    return angles.select(F.col("d").cast("int").alias("degrees"), F.round(report.expected_cuboid(F.col("d"), F.lit(0.01), F.lit(100.0), F.lit(120.0)), 3).alias("expected"))


@query("r13_validation_report", sql("SELECT refl_id, round(abs(exp(-intensity_sum/100)-factor)/exp(-intensity_sum/100)*100, 6) AS error, round(abs(exp(-intensity_sum/100)-factor)/factor*100, 6) AS error_by_factor FROM reflections JOIN f USING (refl_id)", f=FACTOR))
def r13(t: Inputs):
    expected = t.reflections.select("refl_id", F.exp(-F.col("intensity_sum") / 100).alias("expected"))
    rows = report.validation_report(simple_factors(t), expected, "refl_id")
    return rows.select("refl_id", R6("error").alias("error"), R6("error_by_factor").alias("error_by_factor"))


#: Cosines and sines between the beams in r13_traced_cuboid, rational so that no angle depends on a library's sine.
TURNS = [(0.8, 0.6), (0.6, 0.8), (12 / 13, 5 / 13), (5 / 13, 12 / 13), (-0.6, 0.8), (-0.8, 0.6)]
WIDTH, MU, AWAY = 40.0, 0.03, 1e-9


def traced_cuboid_sql() -> str:
    turns = ", ".join(f"({k}, {c!r}::DOUBLE, {s!r}::DOUBLE)" for k, (c, s) in enumerate(TURNS))
    side = "CASE WHEN c>0 THEN (w-x)/c ELSE x/-c END"
    return sql(
        "SELECT degrees, factor, expected, round(abs(expected-factor)*100/expected, 6) AS error FROM (SELECT CAST(round(degrees(atan2(s, c))) AS INT) AS degrees, round(factor, 6) AS factor, expected FROM factors JOIN turns ON refl_id = k JOIN (SELECT k, round(avg(exp(-0.03e0*(x+least(" + side + ", (h-y)/s)))), 3) AS expected FROM mesh GROUP BY k) USING (k))",
        turns=f"SELECT * FROM (VALUES {turns}) t(k, c, s)",
        dims="SELECT count(*) AS n, CAST(floor(sqrt(count(*))) AS INT) AS wide FROM events",
        voxels="SELECT 1 AS z, CAST(event_id//wide AS INT)+1 AS y, CAST(event_id%wide AS INT)+1 AS x, 3 AS label FROM events, dims WHERE event_id < wide*(n//wide)",
        volume="SELECT 3 AS nz, CAST(n//wide AS INT)+2 AS ny, wide+2 AS nx, 1e0 AS sz, 40e0/wide AS sy, 40e0/wide AS sx FROM dims",
        legs="SELECT k AS refl_id, 1 AS leg, 1e-9 AS v0, -1e0 AS v1, -1e-9 AS v2 FROM turns UNION ALL SELECT k, 2, 1e-9, c+1e-9, -s-1e-9 FROM turns",
        samples="SELECT ordinal AS sample_id, z, y, x FROM crystal",
        mesh="SELECT k, c, s, 40e0 AS w, (n//wide)*(40e0/wide) AS h, (i+5e-1)*0.08e0 AS x, (j+5e-1)*((n//wide)*(40e0/wide)/500) AS y FROM turns, dims, range(500) b(i), range(500) d(j)",
    )


@query("r13_traced_cuboid", traced_cuboid_sql())
def r13_traced(t: Inputs):
    """Factors of a cuboid cut from the events, traced from every voxel, against the closed form, by the angle between the beams; the SQL traces too, and sums the closed form's integral over a mesh."""
    n = t.events.count()
    wide = int(n**0.5)
    size = WIDTH / wide
    voxels = t.events.where(F.col("event_id") < wide * (n // wide)).select(F.lit(1).alias("z"), (F.floor(F.col("event_id") / wide) + 1).cast("int").alias("y"), (F.col("event_id") % wide + 1).cast("int").alias("x"), F.lit(3).alias("label"))
    meta = t.spark.createDataFrame([(3, n // wide + 2, wide + 2, 1.0, size, size)], "nz int, ny int, nx int, sz double, sy double, sx double")
    legs = [row for k, (c, s) in enumerate(TURNS) for row in ((k, 1, AWAY, -1.0, -AWAY), (k, 2, AWAY, c + AWAY, -s - AWAY))]
    legs = t.spark.createDataFrame(legs, "refl_id long, leg int, v0 double, v1 double, v2 double")
    mu = t.spark.createDataFrame([(3, MU)], "label int, mu double")
    traced = absorb.factors(legs, sampling.even(voxels, wide * (n // wide)), meta, voxels, mu).withColumn("factor", R6("factor"))
    turns = t.spark.createDataFrame([(k, c, s) for k, (c, s) in enumerate(TURNS)], "refl_id long, c double, s double")
    degrees = F.degrees(F.atan2("s", "c"))
    expected = turns.select("refl_id", degrees.alias("degrees"), F.round(report.expected_cuboid(degrees, F.lit(MU), F.lit(WIDTH), F.lit(n // wide * size)), 3).alias("expected"))
    rows = report.validation_report(traced, expected, "refl_id").join(expected.select("refl_id", "degrees"), "refl_id")
    return rows.select(F.round("degrees").cast("int").alias("degrees"), "factor", "expected", R6("error").alias("error"))


@query("r14_table_to_factor", "SELECT event_id, CAST(p AS INT) AS place, 1/(user_id+2*p+1e0) AS factor FROM events, range(3) r(p)")
def r14(t: Inputs):
    rows = t.events.select("event_id", F.array(*(F.col("user_id") + F.lit(k + 1.0) for k in range(6))).alias("entries"))
    return report.table_to_factor(rows).select("event_id", "place", "factor")


@query("r15_sphere_limits", "SELECT event_id, round(3/(4*pow(m,3))*(1-exp(-2*m)*(1+2*m+2*m*m)), 6) AS on_axis, round(3/(64*pow(m,3))*(8*m*m-1+(1+4*m)*exp(-4*m)), 6) AS back FROM (SELECT event_id, (event_id%40+5)/20e0 AS m FROM events)")
def r15(t: Inputs):
    m = (F.col("event_id") % 40 + 5) / 20.0
    on, back = report.sphere_limits(m)
    return t.events.select("event_id", R6(on).alias("on_axis"), R6(back).alias("back"))


@query("r18_count_reflections", sql("SELECT count(*) AS n FROM reflections WHERE (flags & 5) = 0"))
def r18(t: Inputs):
    return reflections.drop_excluded(t.reflections, 5).agg(F.count("*").alias("n"))
