"""Angular grids: precompute transmission or exponent by direction and sample, then look up.

A grid is (sample_id, i_theta, i_phi, value); axes start at theta_min, phi_min and have
n_theta, n_phi cells of equal steps, in degrees.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import absorb


@dataclass(frozen=True)
class Axes:
    n_theta: int
    n_phi: int
    theta_min: float = -180.0
    phi_min: float = -90.0
    theta_span: float = 360.0
    phi_span: float = 180.0

    def cell(self, theta: Column, phi: Column) -> tuple[Column, Column]:
        """The cell below a pair of angles, kept inside the grid."""
        at = lambda v, low, span, n: F.least(F.greatest(F.floor((v - low) / (span / n)), F.lit(0)), F.lit(n - 1)).cast("int")
        return at(theta, self.theta_min, self.theta_span, self.n_theta), at(phi, self.phi_min, self.phi_span, self.n_phi)


def grid_legs(spark: SparkSession, axes: Axes) -> DataFrame:
    """A leg for each cell, its number as refl_id: i_phi * n_theta + i_theta."""
    cells = spark.range(axes.n_theta * axes.n_phi).select(F.col("id").alias("refl_id"), (F.col("id") % axes.n_theta).cast("int").alias("i_theta"), F.floor(F.col("id") / axes.n_theta).cast("int").alias("i_phi"))
    theta = F.radians(F.lit(axes.theta_min) + F.col("i_theta") * (axes.theta_span / axes.n_theta))
    phi = F.radians(F.lit(axes.phi_min) + F.col("i_phi") * (axes.phi_span / axes.n_phi))
    v = g.direction(theta, phi)
    return cells.select("*", *(e.alias(f"v{k}") for k, e in enumerate(v)))


def build_grid(legs: DataFrame, paths: DataFrame, coefficients: DataFrame, method: str = "exponent") -> DataFrame:
    """(sample_id, i_theta, i_phi, value) of the grid's legs and their paths: the 'exponent' or the 'transmission' of one leg."""
    rates = absorb.exponent(paths, coefficients) if method == "exponent" else absorb.transmission(paths, coefficients)
    return rates.join(legs.select("refl_id", "i_theta", "i_phi"), "refl_id").select("sample_id", "i_theta", "i_phi", F.col(method).alias("value"))


def mean_grid(grid: DataFrame) -> DataFrame:
    return grid.groupBy("i_theta", "i_phi").agg(F.avg("value").alias("value"))


def shift(grid: DataFrame, n: int, by: int, index: str = "i_theta") -> DataFrame:
    """Rolled along an axis."""
    return grid.withColumn(index, F.pmod(F.col(index) + by, F.lit(n)).cast("int"))


def pad(grid: DataFrame, axes: Axes, t_theta: int | None = None, t_phi: int | None = None) -> DataFrame:
    """The grid with bands of its opposite edges on every side; a twelfth of each axis by default."""
    out = grid
    for index, n, t in (("i_theta", axes.n_theta, t_theta), ("i_phi", axes.n_phi, t_phi)):
        t = round(n // 6 / 2) if t is None else t
        places = F.filter(F.array(F.col(index) + t, F.when(F.col(index) >= n - t, F.col(index) + t - n), F.when(F.col(index) < t, F.col(index) + t + n)), lambda p: p.isNotNull())
        out = out.withColumn(index, F.explode(F.transform(places, lambda p: p.cast("int"))))
    return out


def seam_check(grid: DataFrame, axes: Axes) -> DataFrame:
    """Per sample the mean and largest difference between the grid and itself rolled by half of theta."""
    other = shift(grid, axes.n_theta, axes.n_theta // 2).withColumnRenamed("value", "other")
    gap = F.abs(F.col("value") - F.col("other"))
    return grid.join(other, ["sample_id", "i_theta", "i_phi"]).groupBy("sample_id").agg(F.avg(gap).alias("mean_gap"), F.max(gap).alias("max_gap"))


def corners(axes: Axes, theta: Column, phi: Column, wrap: bool = False) -> Column:
    """The four cells around a pair of angles with their bilinear weights, as an array; cells off the grid are its edge, or wrap round."""
    t, p = (theta - axes.theta_min) / (axes.theta_span / axes.n_theta), (phi - axes.phi_min) / (axes.phi_span / axes.n_phi)
    t0, p0 = F.floor(t), F.floor(p)
    place = lambda i, n: F.pmod(i, F.lit(n)) if wrap else F.least(F.greatest(i, F.lit(0)), F.lit(n - 1))
    items = []
    for dt in (0, 1):
        for dp in (0, 1):
            weight = (t - t0 if dt else 1 - (t - t0)) * (p - p0 if dp else 1 - (p - p0))
            items.append(F.struct(place(t0 + dt, axes.n_theta).cast("int").alias("i_theta"), place(p0 + dp, axes.n_phi).cast("int").alias("i_phi"), weight.alias("weight")))
    return F.array(*items)


def combine(found: DataFrame, method: str) -> DataFrame:
    """(refl_id, sample_id, value, of both legs) to factors: 'exponent' adds up, 'transmission' multiplies."""
    total = F.exp(-F.sum("value")) if method == "exponent" else F.exp(F.sum(F.ln("value")))
    per_sample = found.groupBy("refl_id", "sample_id").agg(total.alias("t"))
    return per_sample.groupBy("refl_id").agg(F.avg("t").alias("factor"))


def lookup_nearest(angles: DataFrame, grid: DataFrame, axes: Axes, method: str = "exponent") -> DataFrame:
    """angles: (refl_id, leg, theta, phi) in degrees. An equi-join on the cell, then the mean over samples."""
    it, ip = axes.cell(F.col("theta"), F.col("phi"))
    cells = angles.select("refl_id", "leg", it.alias("i_theta"), ip.alias("i_phi"))
    return combine(cells.join(grid, ["i_theta", "i_phi"]), method)


def lookup_bilinear(angles: DataFrame, grid: DataFrame, axes: Axes, method: str = "exponent", wrap: bool = False) -> DataFrame:
    cells = angles.select("refl_id", "leg", F.explode(corners(axes, F.col("theta"), F.col("phi"), wrap)).alias("c")).select("refl_id", "leg", "c.*")
    values = cells.join(grid, ["i_theta", "i_phi"]).groupBy("refl_id", "leg", "sample_id").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))
    return combine(values, method)


def lookup_mean_product(angles: DataFrame, means: DataFrame, axes: Axes) -> DataFrame:
    """The product of two bilinear lookups in a mean map of transmissions."""
    cells = angles.select("refl_id", "leg", F.explode(corners(axes, F.col("theta"), F.col("phi"))).alias("c")).select("refl_id", "leg", "c.*")
    legs = cells.join(means, ["i_theta", "i_phi"]).groupBy("refl_id", "leg").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))
    return legs.groupBy("refl_id").agg(F.exp(F.sum(F.ln("value"))).alias("factor"))


def near_edge(axes: Axes, theta: Column, phi: Column) -> Column:
    """Within one cell of a pole or the seam, where lookups are poor."""
    t, p = axes.theta_span / axes.n_theta, axes.phi_span / axes.n_phi
    return (F.abs(theta) > 180 - t) | (F.abs(phi) > 90 - p) | (F.abs(F.abs(theta) - 90) < t)


def with_fallback(angles: DataFrame, axes: Axes, lookup: Callable[[DataFrame], DataFrame], trace: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Factors by lookup(angles), but by trace(refl_id) for reflections of which a leg is near an edge; each sees only the reflections that are its own."""
    flagged = angles.groupBy("refl_id").agg(F.bool_or(near_edge(axes, F.col("theta"), F.col("phi"))).alias("edge"))
    safe = lookup(angles.join(flagged.where("not edge"), "refl_id", "left_semi")).select("refl_id", "factor", F.lit("grid").alias("source"))
    return safe.unionByName(trace(flagged.where("edge").select("refl_id")).select("refl_id", "factor", F.lit("trace").alias("source")))
