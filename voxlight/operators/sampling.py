"""Which crystal voxels to trace. Tables: voxels(z, y, x, label); results are (sample_id, z, y, x)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CRYSTAL = 3
#: Rows that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def select_label(voxels: DataFrame, label: int = CRYSTAL) -> DataFrame:
    return voxels.where(F.col("label") == label).select("z", "y", "x")


def ordinal(voxels: DataFrame) -> DataFrame:
    """voxels with their place in row-major order. Lines along x and slices are counted first: one task takes the counts of slices, one for each slice the counts of its lines, and no task a whole slice."""
    lines = voxels.groupBy("z", "y").agg(F.count("*").alias("n"))
    per_slice = lines.groupBy("z").agg(F.sum("n").alias("n"))
    before = per_slice.select("z", (F.sum("n").over(Window.orderBy("z")) - F.col("n")).alias("before"))
    above = F.sum("n").over(Window.partitionBy("z").orderBy("y")) - F.col("n")
    lines = lines.withColumn("above", above).join(F.broadcast(before), "z").select("z", "y", (F.col("above") + F.col("before")).alias("before"))
    row = F.row_number().over(Window.partitionBy("z", "y").orderBy("x")) - 1
    return voxels.withColumn("row", row).join(lines, ["z", "y"]).withColumn("ordinal", (F.col("row") + F.col("before")).cast("long")).drop("row", "before")


def sample_size(total: int, size: int, ratio: float | None = None) -> int:
    """Voxels to take: a ratio in per cent, or all when there are fewer than size, or one in size."""
    return int(total * ratio / 100) if ratio else total if total < size else total // size


def even(voxels: DataFrame, n: int) -> DataFrame:
    """Of N voxels in row-major order the ones at i * N / n, rounded down."""
    placed = ordinal(select_label(voxels))
    total = select_label(voxels).agg(F.count("*").alias("total"))
    wanted = voxels.sparkSession.range(n).crossJoin(F.broadcast(total)).where("total > 0")
    wanted = wanted.select(F.col("id").alias("sample_id"), F.floor(F.col("id") * (F.col("total").cast("double") / n)).alias("ordinal"))
    return placed.join(F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted, "ordinal").select("sample_id", "z", "y", "x")


def slice_quota(voxels: DataFrame, n: int, axis: str = "z", spread: bool = True) -> DataFrame:
    """(axis value, quota): how many to take of each slice. Slices before the first crystal count as empty ones in the mean.

    Where there are more than two slices to a sample, rounding gives most slices none; with spread the n
    fullest slices get one each then, without it the rounded share stands.
    """
    counts = select_label(voxels).groupBy(axis).agg(F.count("*").alias("count"))
    totals = counts.agg(F.sum("count").alias("total"), (F.max(axis) + 1).alias("slices"))
    share = F.rint(F.col("count") / (F.col("total") / F.col("slices")) * n / F.col("slices")).cast("long")
    each = counts.crossJoin(F.broadcast(totals))
    if not spread:
        return each.select(axis, share.alias("quota"))
    few = F.lit(float(n)) / F.col("slices") < 0.5
    fullest = counts.orderBy(F.col("count").desc(), F.col(axis).desc()).limit(n).select(axis, F.lit(1).alias("one"))
    return each.join(fullest, axis, "left").select(axis, F.when(few, F.coalesce("one", F.lit(0)).cast("long")).otherwise(share).alias("quota"))


def chance(seed: int) -> Column:
    """A number for each voxel that stays the same when a task runs again."""
    return F.md5(F.concat_ws(",", "z", "y", "x", F.lit(seed)))


def by_slice(voxels: DataFrame, n: int, axis: str = "z", seed: int = 0, spread: bool = True) -> DataFrame:
    drawn = F.row_number().over(Window.partitionBy(axis).orderBy(chance(seed), "z", "y", "x"))
    rows = select_label(voxels).withColumn("drawn", drawn).join(F.broadcast(slice_quota(voxels, n, axis, spread)), axis).where("drawn <= quota")
    return rows.select("z", "y", "x")


def at_random(voxels: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n voxels without replacement: a top-k by a hash."""
    return select_label(voxels).orderBy(chance(seed), "z", "y", "x").limit(n)


def even_random(voxels: DataFrame, n: int, ratio: float, order: Column | None = None, seed: int = 0) -> DataFrame:
    """One voxel of each interval of 100 / ratio in row-major order, the first n intervals."""
    bucket = F.floor(F.col("ordinal") / F.lit(100.0 / ratio))
    drawn = ordinal(select_label(voxels)).withColumn("bucket", bucket).where(F.col("bucket") < n)
    pick = F.min_by(F.struct("z", "y", "x"), F.struct((chance(seed) if order is None else order).alias("o"), "ordinal"))
    return drawn.groupBy("bucket").agg(pick.alias("v")).select(F.col("bucket").alias("sample_id"), "v.z", "v.y", "v.x")


def stratified(voxels: DataFrame, n: int, seed: int = 0, rounds: int = 5) -> DataFrame:
    """Rounded centres of n clusters that are crystal themselves: Lloyd's rounds from n voxels drawn by hash.

    Sums are of whole numbers and ties go to the lower cluster, so the result is the same however
    the voxels are dealt. A cluster that loses all its voxels is gone. Each voxel meets all
    centres, n of them and few by nature, up to BROADCAST_ROWS.
    """
    if n > BROADCAST_ROWS:
        raise ValueError("more clusters than can be broadcast")
    crystal = select_label(voxels)
    order = F.row_number().over(Window.orderBy(chance(seed), "z", "y", "x"))
    centres = at_random(voxels, n, seed).select((order - 1).alias("c"), *(F.col(a).cast("double").alias(f"c{a}") for a in "zyx"))
    for _ in range(rounds):
        gap = [F.col(a) - F.col(f"c{a}") for a in "zyx"]
        near = F.min_by("c", F.struct((gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]).alias("d"), "c"))
        owned = crystal.crossJoin(F.broadcast(centres)).groupBy("z", "y", "x").agg(near.alias("c"))
        centres = owned.groupBy("c").agg(*((F.sum(F.col(a).cast("long")) / F.count("*")).alias(f"c{a}") for a in "zyx"))
    rounded = centres.select(*(F.floor(F.col(f"c{a}") + 0.5).cast("int").alias(a) for a in "zyx")).distinct()
    return crystal.select(*(F.col(c).cast("int").alias(c) for c in "zyx")).join(F.broadcast(rounded), ["z", "y", "x"], "left_semi")


def weighted_draw(weighed: DataFrame, n: int, weight: str = "weight", by: str = "cluster", seed: int = 0) -> DataFrame:
    """n rows of each cluster without replacement, by weight: the n smallest of -ln(u) / weight, u a hash of the voxel. Rows with no weight are never drawn."""
    u = (F.conv(F.substring(chance(seed), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    drawn = F.row_number().over(Window.partitionBy(by).orderBy(-F.log(u) / F.col(weight), "z", "y", "x"))
    return weighed.where(F.col(weight) > 0).withColumn("drawn", drawn).where(F.col("drawn") <= n).drop("drawn")


def inverse_distance_weights(points: DataFrame, distance: str = "distance", by: str = "cluster") -> DataFrame:
    """Weights 1 / (1 + distance) that add up to 1 in each cluster; totals are aggregated first, so a large cluster is no large task."""
    weighed = points.withColumn("raw", 1 / (1 + F.col(distance)))
    totals = weighed.groupBy(by).agg(F.sum("raw").alias("all"))
    return weighed.join(totals, by).withColumn("weight", F.col("raw") / F.col("all")).drop("raw", "all")


def adaptive_rate(total: int | Column, most: int = 15000) -> int | Column:
    """Doubled from 1 until total / rate is at most `most`."""
    if isinstance(total, Column):
        return F.when(total <= most, 1).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(total / float(most))))).cast("long")
    return 1 if total <= most else 2 ** math.ceil(math.log2(total / most))


def adaptive_step(total: int | Column, first: int = 1000, step: int = 100, most: int = 10000) -> int | Column:
    """The step after the first of first, first + step, ... that brings total / rate to `most` or less."""
    if isinstance(total, Column):
        return (first + step * (F.greatest(F.lit(0), F.ceil((total / float(most) - first) / float(step))) + 1)).cast("long")
    needed = max(0, math.ceil((total / most - first) / step))
    return first + step * (needed + 1)


def scale_ratio(ratio: float, factor: float | Column) -> float | Column:
    """A ratio for a volume resized by factor, 100 at most."""
    if isinstance(factor, Column):
        return F.least(F.lit(100.0), F.lit(float(ratio)) / F.pow(factor, F.lit(3.0)))
    return min(100.0, ratio / factor**3)
