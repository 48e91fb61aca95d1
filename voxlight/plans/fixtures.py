"""Inputs of the registered queries, derived from the given tables; each has the same text in SQL.

A crystal rod along z, wrapped in loop and liquor and holding a bubble, is cut from the
events: 576 of them are a slice of 24 x 24. Every event is a reflection too; directions
are rationals that never meet a tie.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import absorb, sampling

SIDE = 24
SAMPLES = 8
COEFFICIENTS = {1: 0.02, 2: 0.01, 3: 0.03, 4: 0.005}
BEAM = (0.0078125, 1.0, 0.00390625)

_D = "((2*Y-23)*(2*Y-23)+(2*X-23)*(2*X-23))".replace("Y", "((event_id{div}24)%24)").replace("X", "(event_id%24)")
_B = "((2*Y-31)*(2*Y-31)+(2*X-23)*(2*X-23))".replace("Y", "((event_id{div}24)%24)").replace("X", "(event_id%24)")
_LABEL = f"CASE WHEN {_B}<=9 THEN 4 WHEN {_D}<=225 THEN 3 WHEN {_D}<=289 THEN 2 WHEN {_D}<=441 THEN 1 ELSE 0 END"
VOXELS = f"SELECT * FROM (SELECT CAST(event_id{{div}}576 AS INT) AS z, CAST((event_id{{div}}24)%24 AS INT) AS y, CAST(event_id%24 AS INT) AS x, CAST({_LABEL} AS INT) AS label FROM events) v WHERE label<>0"
VOLUME = "SELECT CAST(max(event_id){div}576+1 AS INT) AS nz, 24 AS ny, 24 AS nx, CAST(0.5 AS DOUBLE) AS sz, CAST(0.25 AS DOUBLE) AS sy, CAST(0.25 AS DOUBLE) AS sx FROM events"
REFLECTIONS = """SELECT event_id AS refl_id, ((event_id*37)%61-30)/32e0+1/128e0 AS v0, ((event_id*41)%53-26)/32e0+1/256e0 AS v1,
    ((user_id*29+event_id%7)%47-23)/32e0+1/512e0 AS v2, value AS intensity_sum, value*2e0 AS variance_sum, value+1e0 AS intensity_prf, value*3e0 AS variance_prf,
    CAST(event_id%8 AS INT) AS flags, CAST(event_id%2 AS INT) AS odd FROM events"""
LEGS = """SELECT refl_id, 2 AS leg, v0, v1, v2 FROM reflections UNION ALL
    SELECT refl_id, 1 AS leg, CASE WHEN odd=1 THEN 6e-1*0.0078125e0+8e-1*1e0 ELSE 0.0078125e0 END, CASE WHEN odd=1 THEN -8e-1*0.0078125e0+6e-1*1e0 ELSE 1e0 END, 0.00390625e0 FROM reflections"""


def both(text: str) -> tuple[str, str]:
    """A text for Spark and for DuckDB."""
    return text.replace("{div}", " div "), text.replace("{div}", "//")


class Inputs:
    """The given tables and what is derived from them, for one session and folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def voxels(self) -> DataFrame:
        return self.spark.sql(both(VOXELS)[0].replace("FROM events", "FROM {events}"), events=self.events)

    @cached_property
    def volume(self) -> DataFrame:
        return self.spark.sql(both(VOLUME)[0].replace("FROM events", "FROM {events}"), events=self.events)

    @cached_property
    def reflections(self) -> DataFrame:
        return self.spark.sql(both(REFLECTIONS)[0].replace("FROM events", "FROM {events}"), events=self.events)

    @cached_property
    def legs(self) -> DataFrame:
        return self.spark.sql(LEGS.replace("FROM reflections", "FROM {reflections}"), reflections=self.reflections)

    @cached_property
    def samples(self) -> DataFrame:
        return sampling.even(self.voxels, SAMPLES)

    @cached_property
    def coefficients(self) -> DataFrame:
        return self.spark.createDataFrame(list(COEFFICIENTS.items()), "label int, mu double")

    @cached_property
    def rays(self) -> DataFrame:
        return absorb.plan_rays(self.legs, self.samples, self.volume)

    @cached_property
    def labelled(self) -> DataFrame:
        return absorb.label_steps(absorb.trace_steps(absorb.clip(self.rays, self.voxels)), self.voxels)

    @cached_property
    def paths(self) -> DataFrame:
        return absorb.trace(self.legs, self.samples, self.volume, self.voxels)

    @cached_property
    def factors(self) -> DataFrame:
        return absorb.factors(self.legs, self.samples, self.volume, self.voxels, self.coefficients)


def at(axis: str, k: str) -> str:
    """The voxel of step k, in SQL."""
    p = f"({axis}+({k})*d{axis})"
    return f"CAST(least(greatest(CASE WHEN v2<0 THEN floor{p} ELSE CASE WHEN {p}<0 THEN -floor(-{p}+0.5e0) ELSE floor({p}+0.5e0) END END,0),n{axis}-1) AS INT)"


CTE = {
    "voxels": both(VOXELS)[1],
    "volume": both(VOLUME)[1],
    "reflections": REFLECTIONS,
    "legs": LEGS,
    "coefficients": "SELECT * FROM (VALUES (1, 0.02e0), (2, 0.01e0), (3, 0.03e0), (4, 0.005e0)) c(label, mu)",
    "crystal": "SELECT z, y, x, row_number() OVER (ORDER BY z, y, x) - 1 AS ordinal FROM voxels WHERE label = 3",
    "samples": f"SELECT s.i AS sample_id, z, y, x FROM crystal JOIN (SELECT i, CAST(floor(i * ((SELECT count(*) FROM crystal) / {SAMPLES}e0)) AS BIGINT) AS o FROM range({SAMPLES}) r(i)) s ON o = ordinal",
    "crossings": "SELECT l.*, s.*, v.*, "
    + ", ".join(f"CASE WHEN {d}<>0 AND ({w}-s.{a})/{d}>=0 THEN ({w}-s.{a})/{d} END AS {t}" for t, w, a, d in (("tb", "0", "x", "v1"), ("tf", "nx", "x", "v1"), ("tt", "0", "y", "v2"), ("to_", "ny", "y", "v2"), ("tl", "0", "z", "v0"), ("tr", "nz", "z", "v0")))
    + " FROM legs l, samples s, volume v",
    "faces": "SELECT *, CASE least(tb,tf,tt,to_,tl,tr) WHEN tb THEN 'BACK' WHEN tf THEN 'FRONT' WHEN tt THEN 'TOP' WHEN to_ THEN 'BOT' WHEN tl THEN 'LE' WHEN tr THEN 'RI' END AS face FROM crossings",
    "headed": "SELECT *, abs(CASE WHEN face IN ('LE','RI') THEN v0 WHEN face IN ('TOP','BOT') THEN v2 ELSE v1 END) AS along FROM faces",
    "rays": "SELECT refl_id, sample_id, leg, z, y, x, nz, ny, nx, sz, sy, sx, v0, v1, v2, face, v0/along AS dz, v2/along AS dy, v1/along AS dx, "
    "CAST(CASE face WHEN 'BACK' THEN x+1 WHEN 'FRONT' THEN nx-x WHEN 'LE' THEN z+1 WHEN 'RI' THEN nz-z+CASE WHEN v1>0 THEN 1 ELSE 0 END WHEN 'TOP' THEN y+1 ELSE ny-y+CASE WHEN v1>0 THEN 1 ELSE 0 END END AS INT) AS n FROM headed",
    "expanded": "SELECT *, unnest(range(n)) AS k FROM rays",
    "steps": f"SELECT refl_id, sample_id, leg, CAST(k AS INT) AS k, n, {at('z', 'k')} AS vz, {at('y', 'k')} AS vy, {at('x', 'k')} AS vx FROM expanded",
    "found": "SELECT s.*, coalesce(label, 0) AS label FROM steps s LEFT JOIN voxels v ON vz = v.z AND vy = v.y AND vx = v.x",
    "stops": "SELECT refl_id, sample_id, leg, min(k) FILTER (label = 0) AS stop FROM found GROUP BY ALL",
    "labelled": "SELECT f.* FROM found f JOIN stops USING (refl_id, sample_id, leg) WHERE stop IS NULL OR k < stop",
    "counts": "SELECT refl_id, sample_id, leg, max(k) AS last, count(*) FILTER (label=1) AS li, count(*) FILTER (label=2) AS lo, count(*) FILTER (label=3) AS cr, count(*) FILTER (label=4) AS bu FROM labelled GROUP BY ALL",
    "ends": f"SELECT c.*, sqrt(pow(({at('z', 'last')}-{at('z', '0')})*sz,2)+pow(({at('y', 'last')}-{at('y', '0')})*sy,2)+pow(({at('x', 'last')}-{at('x', '0')})*sx,2)) AS total FROM counts c JOIN rays USING (refl_id, sample_id, leg)",
    "paths": "SELECT refl_id, sample_id, leg, " + ", ".join(f"CASE WHEN last>0 THEN total*{c}/last ELSE 0e0 END AS {c}" for c in ("li", "lo", "cr", "bu")) + " FROM ends",
    "exponents": "SELECT refl_id, sample_id, sum(li*0.02e0)+sum(lo*0.01e0)+sum(cr*0.03e0)+sum(bu*0.005e0) AS exponent FROM paths GROUP BY ALL",
    "rates": "SELECT refl_id, sample_id, exp(-exponent) AS transmission FROM exponents",
    "factors": "SELECT refl_id, avg(transmission) AS factor, count(*) AS n_samples FROM rates GROUP BY ALL",
}


def sql(body: str, **more: str) -> str:
    """body with the fixtures that it and they name, in order."""
    import re

    known = CTE | more
    used: dict[str, str] = {}

    def need(text: str, inside: tuple[str, ...] = ()) -> None:
        for name in known:
            if name not in used and name not in inside and re.search(rf"(?:\bFROM|\bJOIN|,)\s+{name}\b", text):
                need(known[name], (*inside, name))  # a recursive part names itself
                used.setdefault(name, known[name])

    need(body)
    # What several others read is made once.
    return ("WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in ('rays', 'found', 'labelled', 'counts') else ''}({t})" for n, t in used.items()) + "\n" if used else "") + body
