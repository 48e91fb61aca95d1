"""Reports: log scans, peak tables, validation against closed forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import running_sum

#: What a scaling log says about its error model, and the lines around a peak list (fixed values).
PARAMETERS = r"a = ([0-9.eE+-]+), b = ([0-9.eE+-]+)"
PEAKS_BEGIN = "X        Y        Z   Height(sig)  SOF     Nearest atom"
PEAKS_END = "Peaks output to file"


def errormodel_scan(logs: DataFrame) -> DataFrame:
    """(file_path, text) to the last pair of parameters of each log; 'Fail' where a is 1 or b is 0.02, nulls where there is none."""
    last = lambda k: F.try_element_at(F.regexp_extract_all("text", F.lit(PARAMETERS), F.lit(k)), F.lit(-1)).cast("double")
    found = logs.select("file_path", last(1).alias("a"), last(2).alias("b"))
    return found.withColumn("status", F.when((F.col("a") == 1) | (F.col("b") == 0.02), "Fail").when(F.col("a").isNotNull(), "Ok"))


def errormodel_table(scans: DataFrame, kinds: list[str], fields: Sequence[str] = ("a", "b")) -> DataFrame:
    """(dataset, kind, fields) to a row a dataset with <field>_<kind>; with 'status' among the fields the outcome stands beside the parameters, alone it is the short table."""
    return scans.groupBy("dataset").agg(*(F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{c}_{k}") for k in kinds for c in fields))


def newest_match(files: DataFrame, text: str) -> DataFrame:
    """(dataset, file_path): the first path of each dataset whose file name holds the text."""
    name = F.element_at(F.split("file_path", "/"), -1)
    return files.where(name.contains(text)).groupBy("dataset").agg(F.min("file_path").alias("file_path"))


def first_number(name: Column) -> Column:
    """Sort key: the first group of digits, null (to go last) without any."""
    digits = F.regexp_extract(name, r"(\d+)", 1)
    return F.when(digits != "", digits.cast("long"))


def numeric_order(df: DataFrame, name: str) -> DataFrame:
    """Distinct names with their place."""
    named = df.select(name).distinct().withColumn("number", first_number(F.col(name)))
    placed = running_sum(named, [F.col("number").asc_nulls_last(), F.col(name)], F.lit(1), "place")
    return placed.withColumn("place", (F.col("place") + 1).cast("int"))


def peak_rows(lines: DataFrame) -> DataFrame:
    """(file_path, pos, line) to the rows between the two marker lines, as fields and atom."""
    order = Window.partitionBy("file_path").orderBy("pos")
    began = F.max(F.when(F.col("line").contains(PEAKS_BEGIN), 1).otherwise(0)).over(order)
    ended = F.max(F.when(F.col("line").contains(PEAKS_END), 1).otherwise(0)).over(order)
    inside = lines.withColumns({"began": began, "ended": ended}).where(~F.col("line").contains(PEAKS_BEGIN)).where("began = 1 and ended = 0")
    fields = F.split(F.trim("line"), r"\s+")
    return inside.select("file_path", "pos", fields.alias("fields")).where("size(fields) >= 7").select("file_path", "pos", F.col("fields")[4].cast("double").alias("height"), F.col("fields")[6].alias("atom"))


def peak_table(peaks: DataFrame, atoms: list[str]) -> DataFrame:
    """The height of each wanted atom's first peak a file, null without one."""
    return peaks.groupBy("file_path").agg(*(F.min_by(F.when(F.col("atom") == a, F.col("height")), F.when(F.col("atom") == a, F.col("pos"))).alias(a) for a in atoms))


def expected_cuboid(degrees: Column, mu: Column, w: Column, h: Column) -> Column:
    """Mean transmission of a w x h section with `degrees`, 0 to 180, between the beams.

    The way in runs along w. The way out takes the side that faces it or the top, whichever
    is nearer: at distance a from that side, points less than a * tan below the top leave by
    the top. Integrating exp(-mu (in + out)) over the section leaves three exponential
    integrals in a, over the part where both exits occur and the part where only the top does.
    """
    turn = F.radians(degrees)
    forward = degrees < 90
    sin, cos, tan = F.sin(turn), F.abs(F.cos(turn)), F.abs(F.tan(turn))
    p = F.when(forward, mu).otherwise(-mu)  # growth of exp(-mu in) with a
    q = p - mu / cos
    a = F.least(w, h / tan)
    grow = lambda rate, end: F.expm1(rate * end) / rate
    moment = (F.exp(q * a) * (q * a - 1) + 1) / (q * q)
    mixed = sin / mu * (grow(p, a) - grow(q, a)) + h * grow(q, a) - tan * moment
    top_only = sin / mu * (1 - F.exp(-mu * h / sin)) * (grow(p, w) - grow(p, a))
    whole = (mixed + top_only) * F.when(forward, F.exp(-mu * w)).otherwise(1.0) / (w * h)
    return F.when(degrees == 0, F.exp(-mu * w)).when(degrees == 180, -F.expm1(-2 * mu * w) / (2 * mu * w)).otherwise(whole)


def sphere_limits(mu_r: Column) -> tuple[Column, Column]:
    """Mean transmission of a sphere straight on and straight back, mu_r its radius in absorption lengths: chords have density proportional to their length."""
    on = 3 / (4 * mu_r**3) * (1 - F.exp(-2 * mu_r) * (1 + 2 * mu_r + 2 * mu_r * mu_r))
    back = 3 / (64 * mu_r**3) * (8 * mu_r * mu_r - 1 + (1 + 4 * mu_r) * F.exp(-4 * mu_r))
    return on, back


def table_to_factor(tables: DataFrame, column: str = "entries") -> DataFrame:
    """Every second entry of a published table, inverted, with its place."""
    rows = tables.select("*", F.posexplode(column).alias("pos", "entry")).drop(column)
    return rows.where("pos % 2 = 0").withColumns({"place": (F.col("pos") / 2).cast("int"), "factor": 1 / F.col("entry")}).drop("pos", "entry")


def validation_report(traced: DataFrame, expected: DataFrame, *on: str) -> DataFrame:
    """Per cent error of factors against expected ones, by either."""
    both = traced.select(*on, "factor").join(expected.select(*on, "expected"), list(on))
    gap = F.abs(F.col("expected") - F.col("factor")) * 100
    return both.withColumns({"error": gap / F.col("expected"), "error_by_factor": gap / F.col("factor")})
