"""Volumes as sparse voxel tables (z, y, x, label), and the slices they are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import running_sum


def resize_nearest(voxels: DataFrame, volume: DataFrame, factor: float) -> DataFrame:
    """Nearest-neighbour resampling to int(n * factor) voxels an axis: each source voxel goes to the targets that read it."""
    out = voxels.crossJoin(F.broadcast(volume))
    for a in "zyx":
        old, new = F.col(f"n{a}"), F.floor(F.col(f"n{a}") * F.lit(factor)).cast("long")
        lo = F.floor((F.col(a) * new + old - 1) / old)
        hi = F.floor(((F.col(a) + 1) * new + old - 1) / old) - 1
        out = out.withColumn(f"t{a}", F.explode(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))))
    return out.select(*(F.col(f"t{a}").cast("int").alias(a) for a in "zyx"), "label")


def resize_sweep(voxels: DataFrame, volume: DataFrame, factors: list[float]) -> DataFrame:
    """The volume at several sizes, each with its factor."""
    sizes = [resize_nearest(voxels, volume, f).withColumn("factor", F.lit(f)) for f in factors]
    out = sizes[0]
    for more in sizes[1:]:
        out = out.union(more)
    return out


def rotate_slices(voxels: DataFrame, volume: DataFrame, cos: float, sin: float) -> DataFrame:
    """Each slice turned about its centre, nearest voxel: every target cell reads the source cell that turning back leads to."""
    area = volume.select("ny", "nx", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("x"))
    y, x = F.col("y") - (F.col("ny") - 1) / 2, F.col("x") - (F.col("nx") - 1) / 2
    source = area.select("y", "x", F.floor(y * cos - x * sin + (F.col("ny") - 1) / 2 + 0.5).cast("int").alias("from_y"), F.floor(y * sin + x * cos + (F.col("nx") - 1) / 2 + 0.5).cast("int").alias("from_x"))
    old = voxels.select("z", F.col("y").alias("from_y"), F.col("x").alias("from_x"), "label")
    return old.join(source, ["from_y", "from_x"]).select("z", "y", "x", "label")


def project(voxels: DataFrame, volume: DataFrame) -> DataFrame:
    """(z, x) with mean, sum, count and maximum of labels along y; vacuum counts in the mean."""
    rows = voxels.groupBy("z", "x").agg(F.sum("label").alias("total"), F.count("*").alias("nonzero"), F.max("label").alias("highest"))
    return rows.crossJoin(F.broadcast(volume.select("ny"))).select("z", "x", (F.col("total") / F.col("ny")).alias("mean"), "total", "nonzero", "highest")


def flip(voxels: DataFrame, volume: DataFrame, *axes: str) -> DataFrame:
    rows = voxels.crossJoin(F.broadcast(volume))
    return rows.select(*((F.col(f"n{a}") - 1 - F.col(a) if a in axes else F.col(a)).cast("int").alias(a) for a in "zyx"), "label")


def distinct_labels(voxels: DataFrame) -> DataFrame:
    """Number of labels besides vacuum."""
    return voxels.agg(F.countDistinct("label").alias("classes"))


def last_number(name: Column) -> Column:
    """The last group of digits of a name, -1 without any."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(name, F.lit(r"(\d+)"), F.lit(1)), F.lit(-1)).cast("int"), F.lit(-1))


def natural_order(files: DataFrame, name: str = "file_name", reverse: bool = False) -> DataFrame:
    """Distinct files with their number and place, the last number first if reversed."""
    named = files.select(name).distinct().withColumn("number", last_number(F.col(name)))
    keys = [F.col("number").desc(), F.col(name).desc()] if reverse else [F.col("number"), F.col(name)]
    placed = running_sum(named, keys, F.lit(1), "place")
    return placed.withColumn("place", F.col("place").cast("int"))


def gray_to_label(slices: DataFrame, values: dict[int, int]) -> DataFrame:
    """Gray values to labels; values without label become vacuum and go."""
    pairs = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return slices.withColumn("label", F.try_element_at(pairs, F.col("gray"))).where("label <> 0").drop("gray")


def color_to_label(pixels: DataFrame, colors: DataFrame) -> DataFrame:
    """(r, g, b) to labels by a table (r, g, b, label, rank); the highest rank wins, no match is 0."""
    chosen = colors.groupBy("r", "g", "b").agg(F.max_by("label", "rank").alias("label"))
    return pixels.join(chosen, ["r", "g", "b"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def slices_to_voxels(slices: DataFrame, values: dict[int, int]) -> DataFrame:
    """(file_name, y, x, gray) to voxels; z is a file's place in natural order."""
    order = natural_order(slices)
    placed = slices.join(order, "file_name").select(F.col("place").alias("z"), "y", "x", "gray")
    return gray_to_label(placed, values).select("z", "y", "x", "label")


def bounding_box(voxels: DataFrame) -> DataFrame:
    return voxels.agg(*(f(a).alias(f"{n}_{a}") for a in "zyx" for n, f in (("min", F.min), ("max", F.max))))


def ray_hits_box(rays: DataFrame, box: DataFrame) -> DataFrame:
    """rays (oz, oy, ox, dz, dy, dx) with `hit`: whether the line meets one of the six faces of the box."""
    out = rays.crossJoin(F.broadcast(box))
    hits = []
    for a in "zyx":
        others = [b for b in "zyx" if b != a]
        for side in ("min", "max"):
            t = (F.col(f"{side}_{a}") - F.col(f"o{a}")) / F.when(F.col(f"d{a}") != 0, F.col(f"d{a}"))
            inside = [(F.col(f"o{b}") + t * F.col(f"d{b}")).between(F.col(f"min_{b}"), F.col(f"max_{b}")) for b in others]
            hits.append(F.coalesce(inside[0] & inside[1], F.lit(False)))
    any_hit = hits[0]
    for h in hits[1:]:
        any_hit = any_hit | h
    return out.withColumn("hit", any_hit).drop(*box.columns)


def in_beam(pairs: DataFrame, matrix: list[list[Column]], point: tuple[float, float, float], region: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose voxel (z, y, x), turned about a point on the axis, lies in the beam: y and z between the region's bounds, bounds included."""
    moved = [F.col(c) - p for c, p in zip("zyx", point, strict=True)]
    z, y = (sum((row[k] * moved[k] for k in range(1, 3)), row[0] * moved[0]) + p for row, p in zip(matrix[:2], point[:2], strict=True))
    return pairs.where(y.between(region[0], region[1]) & z.between(region[2], region[3]))
