"""Absorption coefficients from a projection and a labelled volume seen along y."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import running_sum

CLASSES = {"li": 1, "lo": 2, "cr": 3, "bu": 4}


def ray_class_counts(voxels: DataFrame, volume: DataFrame) -> DataFrame:
    """(z, x) with the voxels of each class along y; va is what is left."""
    counts = voxels.groupBy("z", "x").agg(*(F.count_if(F.col("label") == c).alias(n) for n, c in CLASSES.items()), F.count("*").alias("all"))
    return counts.crossJoin(F.broadcast(volume.select("ny"))).withColumn("va", F.col("ny") - F.col("all")).drop("ny", "all")


def region_only(voxels: DataFrame, label: int, strict: bool = False, base: int | None = None) -> DataFrame:
    """(z, x) whose mean label, after leaving out the base class, is `label`; strict: that hold nothing else."""
    rows = voxels if base is None else voxels.where(F.col("label") != base)
    g = rows.groupBy("z", "x").agg(F.sum("label").alias("s"), F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    test = (F.col("lo") == label) & (F.col("hi") == label) if strict else F.col("s") == label * F.col("n")
    return g.where(test).select("z", "x")


def region_any(voxels: DataFrame, label: int) -> DataFrame:
    return voxels.where(F.col("label") == label).select("z", "x").distinct()


def rank_columns(counts: DataFrame, target: str, fraction: float, mode: str = "absolute", by: tuple[str, ...] = ()) -> DataFrame:
    """The columns (z, x) with the longest way through the target, or the largest ratio to liquor (1 without liquor): the first int(n * fraction).

    Columns are ranked in classes of equal score: counts of each score come first, and only ties
    at the edge are ranked row by row.
    """
    score = F.col(target).cast("double") if mode == "absolute" else F.when(F.col("li") != 0, F.col(target) / F.col("li")).otherwise(1.0)
    scored = counts.withColumn("score", score)
    per = scored.groupBy("score").agg(F.count("*").alias("n"))
    per = running_sum(per, [F.desc("score")], F.col("n"), "before").select("score", "before").crossJoin(F.broadcast(counts.agg(F.count("*").alias("total"))))
    tie = F.row_number().over(Window.partitionBy("score").orderBy("z", "x"))
    ranked = scored.withColumn("tie", tie).join(per, "score")
    return ranked.where(F.col("before") + F.col("tie") <= F.floor(F.col("total") * fraction)).drop("tie", "before", "total")


def at_pixels(columns: DataFrame, img: DataFrame, shift: tuple[int, int] = (0, 0)) -> DataFrame:
    """Columns with the intensity seen at their shifted place; columns off the image go."""
    seen = img.select((F.col("y") - shift[0]).alias("z"), (F.col("x") - shift[1]).alias("x"), F.col("value").alias("intensity"))
    return columns.join(seen, ["z", "x"])


def coef_single(columns: DataFrame, target: str, pixel: float) -> DataFrame:
    return columns.where((F.col(target) > 0) & (F.col("intensity") > 0)).withColumn("coef", -F.ln("intensity") / (F.col(target) * pixel))


def coef_multi(columns: DataFrame, target: str, pixel: float, known: dict[str, float | Column]) -> DataFrame:
    """The target's coefficient given those of the other classes."""
    others = sum((F.col(c) * known.get(c, 0.0) for c in CLASSES if c != target), F.lit(0.0))
    return columns.where((F.col(target) > 0) & (F.col("intensity") > 0)).withColumn("coef", -(others * pixel + F.ln("intensity")) / (F.col(target) * pixel))


def coef_sequence(columns: dict[str, DataFrame], pixel: float, base: str = "li", given: dict[str, float] | None = None, fractions: tuple[float, ...] = (1.0, 0.75, 0.5, 0.25)) -> DataFrame:
    """For each fraction the base class first, then the others in order, each with the latest means; given ones stay. One small aggregate a class and fraction."""
    spark = columns[base].sparkSession
    given, rows, known = given or {}, [], {}
    for fraction in fractions:
        known = dict(given)
        for target in [base, *(c for c in CLASSES if c != base and c in columns)]:
            if target not in given:
                top = rank_columns(columns[target], target, fraction, "absolute" if target == base else "proportion")
                found = coef_single(top, target, pixel) if target == base else coef_multi(top, target, pixel, known)
                known[target] = found.agg(F.avg("coef")).first()[0] or 0.0
            rows.append((fraction, target, float(known[target])))
    return spark.createDataFrame(rows, "fraction double, label string, mu double")


def coef_stats(rows: DataFrame, *by: str, column: str = "coef") -> DataFrame:
    c = F.col(column)
    stats = rows.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.percentile(c, F.lit(0.5)).alias("median"), F.stddev_pop(c).alias("std"), F.skewness(c).alias("skew"), F.kurtosis(c).alias("kurtosis"), F.min(c).alias("lowest"), F.max(c).alias("highest"))
    sides = {f"{n}{k}": F.col("mean") + s * k * F.col("std") for k in (1, 2, 3) for n, s in (("minus", -1), ("plus", 1))}
    return stats.withColumns({**sides, "high_limit": F.col("mean") * 1.2, "low_limit": F.col("mean") * 0.8})


def histogram(rows: DataFrame, bins: int, column: str = "coef", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, bin, n): equal bins between the least and largest value; the last bin holds its upper end."""
    key = list(by) or [F.lit(0).alias("all")]
    ends = rows.groupBy(*key).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    both = rows.join(ends, list(by)) if by else rows.crossJoin(F.broadcast(ends))
    at = F.least(F.floor((F.col(column) - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    return both.groupBy(*by, F.coalesce(at, F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))


def split_two_peaks(rows: DataFrame, column: str = "coef", bins: int = 50, prominence: float = 100, lower: bool = True) -> DataFrame:
    """The rows on one side of the middle between the first two peaks of the histogram; all rows if there are fewer peaks.

    A peak's prominence is its height above the higher of the two lowest bins between it and a
    higher bin, or the end, on either side. All of it happens on `bins` rows.
    """
    counts = histogram(rows, bins, column)
    spine = rows.sparkSession.range(bins).select(F.col("id").alias("bin")).join(counts, "bin", "left").fillna(0, ["n"])
    order = Window.orderBy("bin")
    peaks = spine.withColumns({"l": F.lag("n").over(order), "r": F.lead("n").over(order)}).where("n > l and n > r").select("bin", "n")
    o = spine.select(F.col("bin").alias("b2"), F.col("n").alias("n2"))
    higher = peaks.join(o, F.col("n2") > F.col("n"), "left").groupBy("bin", "n").agg(F.max(F.when(F.col("b2") < F.col("bin"), F.col("b2"))).alias("left"), F.min(F.when(F.col("b2") > F.col("bin"), F.col("b2"))).alias("right"))
    lows = higher.join(o, (F.col("b2") > F.coalesce("left", F.lit(-1))) & (F.col("b2") < F.coalesce("right", F.lit(bins)))).groupBy("bin", "n").agg(F.min(F.when(F.col("b2") <= F.col("bin"), F.col("n2"))).alias("lmin"), F.min(F.when(F.col("b2") >= F.col("bin"), F.col("n2"))).alias("rmin"))
    strong = lows.where(F.col("n") - F.greatest("lmin", "rmin") >= prominence).withColumn("k", F.row_number().over(order)).where("k <= 2")
    ends = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    middle = strong.agg(F.avg("bin").alias("at"), F.count("*").alias("peaks")).crossJoin(ends)
    border = F.when(F.col("peaks") == 2, F.col("lo") + F.col("at") * (F.col("hi") - F.col("lo")) / bins)
    cut = F.broadcast(middle.select(border.alias("border")))
    side = F.col(column) < F.col("border") if lower else F.col(column) > F.col("border")
    return rows.crossJoin(cut).where(F.col("border").isNull() | side).drop("border")


def pick_coefficients(stats: DataFrame, fraction: float = 0.5) -> DataFrame:
    return stats.where(F.col("fraction") == fraction).select("label", F.col("median").alias("mu"))


def tabulate_orientations(long: DataFrame, centre: str, labels: tuple[str, ...] = tuple(CLASSES)) -> DataFrame:
    """(orientation, label, mean) to one row an orientation, with per cent differences from the centre's row."""
    wide = long.groupBy("orientation").pivot("label", list(labels)).agg(F.first("mean"))
    middle = F.broadcast(wide.where(F.col("orientation") == centre).select(*(F.col(c).alias(f"centre_{c}") for c in labels)))
    both = wide.crossJoin(middle)
    return both.select("orientation", *labels, *(((F.col(f"centre_{c}") - F.col(c)) / F.col(f"centre_{c}") * 100).alias(f"{c}_diff") for c in labels))
