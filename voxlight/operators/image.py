"""Projection images and regions as tables of pixels: (y, x, value) or (image_id, y, x, value)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch


def mask_below(img: DataFrame, t: float | Column) -> DataFrame:
    return img.withColumn("mask", (F.col("value") < t).cast("int"))


def mask_above(img: DataFrame, t: float | Column) -> DataFrame:
    return img.withColumn("mask", (F.col("value") > t).cast("int"))


def minmax_u8(img: DataFrame, invert: bool = False, by: str = "image_id") -> DataFrame:
    """Each image's values to 0..255, cut to whole numbers; an even image is 0."""
    ends = img.groupBy(by).agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
    u8 = F.coalesce((255 * (F.col("value") - F.col("mn")) / F.when(F.col("mx") > F.col("mn"), F.col("mx") - F.col("mn"))).cast("int"), F.lit(0))
    return img.join(ends, by).withColumn("u8", 255 - u8 if invert else u8).drop("mn", "mx")


def range_mask(pixels: DataFrame, ranges: DataFrame) -> DataFrame:
    """(.., h, s, v) by class table (class, h0, h1, s0, s1, v0, v1, inverted): 1 inside a class's box, or outside if inverted."""
    inside = F.col("h").between(F.col("h0"), F.col("h1")) & F.col("s").between(F.col("s0"), F.col("s1")) & F.col("v").between(F.col("v0"), F.col("v1"))
    rows = pixels.crossJoin(F.broadcast(ranges))
    return rows.withColumn("mask", F.when(F.col("inverted"), ~inside).otherwise(inside).cast("int")).select(*pixels.columns, "class", "mask")


def crop(img: DataFrame, x: tuple[int | None, int | None], y: tuple[int | None, int | None]) -> DataFrame:
    """Columns x[0]..x[1]-1 and rows alike, None for open ends; coordinates start at 0 again."""
    for c, (a, b) in (("x", x), ("y", y)):
        low = a or 0
        img = img.where((F.col(c) >= low) & (F.lit(b is None) | (F.col(c) < (b if b is not None else 0)))).withColumn(c, (F.col(c) - low).cast("int"))
    return img


def center_fit(img: DataFrame, old: tuple[int, int], new: tuple[int, int]) -> DataFrame:
    """An image of old (rows, columns) in the middle of new ones: shifted by half the difference, what falls outside goes."""
    for c, a, b in (("y", old[0], new[0]), ("x", old[1], new[1])):
        img = img.withColumn(c, (F.col(c) + (b - a) // 2).cast("int")).where(F.col(c).between(0, b - 1))
    return img


def erode(region: DataFrame, shape: tuple[int, int], k: int = 3, iterations: int = 3, margin: float = 0.1) -> DataFrame:
    """(y, x) of a region eroded by a k x k square, iterations composed, less a border. Cells off the image count as set."""
    h, (ny, nx) = iterations * (k - 1) // 2, shape
    rows = region.select("y", "x").distinct()
    for axis, other, n in (("x", "y", nx), ("y", "x", ny)):
        near = F.count("*").over(Window.partitionBy(other).orderBy(axis).rangeBetween(-h, h))
        width = F.least(F.col(axis) + h, F.lit(n - 1)) - F.greatest(F.col(axis) - h, F.lit(0)) + 1
        rows = rows.withColumn("near", near).where(F.col("near") == width).drop("near")
    inner = lambda c, n: (F.col(c) >= int(n * margin)) & (F.col(c) < int(n * (1 - margin)))
    return rows.where(inner("y", ny) & inner("x", nx))


def fill_gaps(mask: DataFrame, threshold: int = 10) -> DataFrame:
    """(y, x) of set pixels, gaps shorter than the threshold filled along rows and then along columns."""
    rows = mask.select("y", "x").distinct()
    for axis, other in (("x", "y"), ("y", "x")):
        after = F.lead(axis).over(Window.partitionBy(other).orderBy(axis))
        last = F.when(after - F.col(axis) < threshold, after - 1).otherwise(F.col(axis))
        rows = rows.withColumn("to", last).select(other, F.explode(F.sequence(F.col(axis), F.col("to"))).alias(axis)).select("y", "x")
    return rows


BINS = 256
#: Pixels on a side of a tile in which masks are laid on each other, at least.
TILE = 256
#: Shifts of bins that registration tries at once, at most.
MOST_TRIED = 1024


def histogram(img: DataFrame, by: str = "image_id", column: str = "u8") -> DataFrame:
    return img.groupBy(by, F.col(column).alias("bin")).agg(F.count("*").alias("n"))


def threshold(img: DataFrame, method: str = "mean", by: str = "image_id", column: str = "u8") -> DataFrame:
    """(image, threshold) by mean, otsu, isodata, yen or triangle, from histograms of at most 256 bins an image."""
    if method == "mean":
        return img.groupBy(by).agg(F.avg(column).alias("threshold"))
    h = histogram(img, by, column)
    up, whole = Window.partitionBy(by).orderBy("bin"), Window.partitionBy(by)
    h = h.withColumns({"w": F.sum("n").over(up), "m": F.sum(F.col("n") * F.col("bin")).over(up), "q": F.sum(F.col("n") * F.col("n")).over(up), "w_all": F.sum("n").over(whole), "m_all": F.sum(F.col("n") * F.col("bin")).over(whole), "q_all": F.sum(F.col("n") * F.col("n")).over(whole)})
    rest = F.col("w_all") - F.col("w")
    low, high = F.col("m") / F.col("w"), (F.col("m_all") - F.col("m")) / F.when(rest > 0, rest)
    if method == "otsu":
        score = F.col("w").cast("double") * rest * (low - high) * (low - high)
    elif method == "isodata":
        score = -F.abs((low + high) / 2 - F.col("bin"))
    elif method == "yen":
        p, all_n = F.col("w") / F.col("w_all"), F.col("w_all").cast("double")
        q1, q2 = F.col("q") / (all_n * all_n), (F.col("q_all") - F.col("q")) / (all_n * all_n)
        score = F.ln(p * p * (1 - p) * (1 - p) / (q1 * F.when(q2 > 0, q2)))
    elif method == "triangle":
        peak = F.max_by("bin", F.struct("n", -F.col("bin"))).over(whole)
        ends = [F.min("bin").over(whole), F.max("bin").over(whole)]
        h = h.withColumns({"peak": peak, "top": F.max("n").over(whole), "first": ends[0], "last": ends[1]})
        far = F.when(F.col("last") - F.col("peak") >= F.col("peak") - F.col("first"), F.col("last")).otherwise(F.col("first"))
        h = h.withColumn("far", far)
        between = F.col("bin").between(F.least("peak", "far"), F.greatest("peak", "far"))
        # Distance from the line between the peak and the far end, up to a constant factor.
        score = F.when(between & (F.col("far") != F.col("peak")), F.col("top") * F.abs(F.col("bin") - F.col("far")) - F.col("n") * F.abs(F.col("peak") - F.col("far")))
    else:
        raise ValueError(f"no threshold method {method!r}")
    scored = h.withColumn("score", score).where("score is not null")
    return scored.groupBy(by).agg(F.max_by("bin", F.struct("score", -F.col("bin"))).cast("double").alias("threshold"))


def threshold_iterative(img: DataFrame, method: str, by: str = "image_id", column: str = "u8") -> DataFrame:
    """(image, threshold) by 'li' (least cross entropy, found by repeated means) or 'minimum' (the valley once smoothing leaves two peaks).

    Works on histograms, at most 256 rows an image; null where no threshold is found.
    """
    if method not in ("li", "minimum"):
        raise ValueError(f"no threshold method {method!r}")

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(BINS)
        counts[pdf["bin"]] = pdf["n"]
        t = least_cross_entropy(counts) if method == "li" else valley(counts)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "threshold": [t]})

    kind = dict(img.dtypes)[by]
    return histogram(img, by, column).groupBy(by).applyInPandas(found, f"{by} {kind}, threshold double")


def least_cross_entropy(counts: np.ndarray, rounds: int = 1000) -> float | None:
    """The fixed point t = (m1 - m0) / (ln m1 - ln m0) of the means below and above t; bins count from 1 so that logarithms exist."""
    level = np.arange(1, len(counts) + 1, dtype=float)
    t = float((counts * level).sum() / counts.sum())
    for _ in range(rounds):
        low = level <= t
        if not counts[low].sum() or not counts[~low].sum():
            return None
        m0, m1 = (float((counts[s] * level[s]).sum() / counts[s].sum()) for s in (low, ~low))
        new = (m1 - m0) / (np.log(m1) - np.log(m0))
        if abs(new - t) < 1e-6:
            return new - 1
        t = new
    return t - 1


def valley(counts: np.ndarray, rounds: int = 10000) -> float | None:
    """The lowest bin between two peaks, after as many three-bin means as leave two."""
    h = counts.astype(float)
    for _ in range(rounds):
        slope = np.sign(np.diff(h))
        turns = np.flatnonzero(slope)
        before = np.concatenate([[1.0], slope[turns][:-1]])
        peaks = turns[(slope[turns] < 0) & (before > 0)]
        if len(peaks) < 2:
            return None
        if len(peaks) == 2:
            return float(peaks[0] + h[peaks[0] : peaks[1] + 1].argmin())
        h = np.convolve(np.concatenate([h[:1], h, h[-1:]]), np.ones(3) / 3, mode="valid")
    return None


def local_mean(img: DataFrame, k: int, by: str = "image_id") -> DataFrame:
    """`local`: the mean of the pixels in the k x k window around each one, those that are there: holes and places beyond the edge count as none.

    Each pixel adds to the k places of its row that see it, holes included; a window along the
    column adds these up. So k rows a pixel are summed and not k * k.
    """
    h = k // 2
    seen = img.select(by, "y", F.explode(F.sequence(F.col("x") - h, F.col("x") + h)).alias("x"), "value")
    rows = seen.groupBy(by, "y", "x").agg(F.sum("value").alias("s"), F.count("value").alias("c"))
    column = Window.partitionBy(by, "x").orderBy("y").rangeBetween(-h, h)
    means = rows.select(by, "y", "x", (F.sum("s").over(column) / F.sum("c").over(column)).alias("local"))
    return img.join(means, [by, "y", "x"])


def register_shift(a: DataFrame, b: DataFrame, reach: int) -> DataFrame:
    """The shift (dy, dx) up to `reach` that lays most set pixels of b on those of a, the smallest of equals. (y, x) tables."""
    edge = max(TILE, 2 * reach)

    def counted(here: pa.Table, moved: pa.Table) -> pa.Table:
        """A tile of a against the pixels of b within reach of it, shift by shift."""
        found = []
        if here.num_rows and moved.num_rows:
            low = [here[c][0].as_py() * edge for c in ("ty", "tx")]
            fixed, near = np.zeros((edge, edge), np.int64), np.zeros((edge + 2 * reach,) * 2, np.int64)
            for mask, rows, by in ((fixed, here, 0), (near, moved, reach)):
                mask[rows["y"].to_numpy() - low[0] + by, rows["x"].to_numpy() - low[1] + by] = rows["n"].to_numpy()
            for dy in range(-reach, reach + 1):
                for dx in range(-reach, reach + 1):
                    found.append((dy, dx, int((fixed * near[reach - dy : reach - dy + edge, reach - dx : reach - dx + edge]).sum())))
        dy, dx, overlap = zip(*(f for f in found if f[2]), strict=True) if any(f[2] for f in found) else ((), (), ())
        return pa.table([pa.array(dy, pa.int32()), pa.array(dx, pa.int32()), pa.array(overlap, pa.int64())], names=["dy", "dx", "overlap"])

    # A pixel of b goes to the tiles in its reach, mostly one, and not once for each shift.
    pixels = lambda df: df.groupBy(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).agg(F.count("*").alias("n"))
    tile = lambda c: F.floor(c / edge)
    near = lambda c: F.explode(F.array_distinct(F.array(tile(F.col(c) - reach), tile(F.col(c) + reach))))
    here = pixels(a).select(tile(F.col("y")).alias("ty"), tile(F.col("x")).alias("tx"), "y", "x", "n")
    moved = pixels(b).withColumn("ty", near("y")).withColumn("tx", near("x"))
    hits = here.groupBy("ty", "tx").cogroup(moved.groupBy("ty", "tx")).applyInArrow(counted, "dy int, dx int, overlap long").groupBy("dy", "dx").agg(F.sum("overlap").alias("overlap"))
    return hits.orderBy(F.desc("overlap"), F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx"), "dy", "dx").limit(1)


def register_coarse_to_fine(a: DataFrame, b: DataFrame, reach: int, bin_size: int = 4) -> DataFrame:
    """register_shift over a long reach, exact, by branch and bound.

    Pixels are counted in bins. Under a shift by whole bins and less than one more, the pixels of a
    bin of b fall in four bins of a, so the smaller of the two counts, summed, bounds the overlap
    of bin_size^2 shifts. These are tried from the largest bound on, more at a time, until no
    bound left reaches the best overlap. Only the shifts being tried, MOST_TRIED of bins at most, pass the driver.
    """
    spark = a.sparkSession
    binned = lambda df, n: df.groupBy(F.floor(F.col("y") / bin_size).alias("y"), F.floor(F.col("x") / bin_size).alias("x")).agg(F.count("*").alias(n))
    every = lambda low, high: F.explode(F.sequence(F.lit(low), F.lit(high)))
    low, high = -reach // bin_size, reach // bin_size
    four = binned(a, "na").withColumn("oy", every(0, 1)).withColumn("ox", every(0, 1)).groupBy((F.col("y") - F.col("oy")).alias("y"), (F.col("x") - F.col("ox")).alias("x")).agg(F.sum("na").alias("na"))
    moved = binned(b, "nb").withColumn("by", every(low, high)).withColumn("bx", every(low, high)).select("by", "bx", "nb", (F.col("y") + F.col("by")).alias("y"), (F.col("x") + F.col("bx")).alias("x"))
    path = scratch(spark, "bounds")
    moved.join(four, ["y", "x"]).groupBy("by", "bx").agg(F.sum(F.least("na", "nb")).alias("bound")).write.parquet(path)
    left = spark.read.parquet(path)
    best, tried = None, 16
    while cells := left.orderBy(F.desc("bound"), "by", "bx").limit(tried).collect():
        if best and cells[0]["bound"] < best["overlap"]:
            break
        fine = [(c["by"] * bin_size + i, c["bx"] * bin_size + j) for c in cells for i in range(bin_size) for j in range(bin_size)]
        shifts = spark.createDataFrame([(dy, dx) for dy, dx in fine if max(abs(dy), abs(dx)) <= reach] or [(0, 0)], "dy int, dx int")
        spots = b.select("y", "x").crossJoin(F.broadcast(shifts)).select("dy", "dx", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"))
        hits = spots.join(a.select("y", "x"), ["y", "x"]).groupBy("dy", "dx").agg(F.count("*").alias("overlap"))
        found = hits.orderBy(F.desc("overlap"), F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx"), "dy", "dx").first()
        rank = lambda r: (-r["overlap"], r["dy"] ** 2 + r["dx"] ** 2, r["dy"], r["dx"])
        best = min((r for r in (best, found) if r), key=rank, default=None)
        end = cells[-1]
        after = (F.col("bound") < end["bound"]) | ((F.col("bound") == end["bound"]) & (F.struct("by", "bx") > F.struct(F.lit(end["by"]).alias("by"), F.lit(end["bx"]).alias("bx"))))
        left, tried = spark.read.parquet(path).where(after), min(MOST_TRIED, 2 * tried)
    return spark.createDataFrame([tuple(best)] if best else [], "dy int, dx int, overlap long")


def scan_angles(masks: DataFrame, model: DataFrame) -> DataFrame:
    """masks (angle, y, x, mask) against a model's mask (y, x, mask): per angle the mean absolute difference and the mask's area."""
    both = masks.join(model.select("y", "x", F.col("mask").alias("other")), ["y", "x"], "left")
    return both.groupBy("angle").agg(F.avg(F.abs(F.col("mask") - F.coalesce("other", F.lit(0)))).alias("difference"), F.sum("mask").alias("area"))


def pick_angles(scan: DataFrame) -> DataFrame:
    """The angle of least difference and the one of largest area."""
    return scan.agg(F.min_by("angle", F.struct("difference", "angle")).alias("offset"), F.max_by("angle", F.struct("area", -F.col("angle"))).alias("viewing"))


def two_pass_angles(masks: DataFrame, model: DataFrame, coarse: int = 10) -> DataFrame:
    """pick_angles over every `coarse` degrees, then over single degrees up to `coarse` from each pick."""
    first = F.broadcast(pick_angles(scan_angles(masks.where(F.col("angle") % coarse == 0), model)))  # one row
    near = masks.crossJoin(first)
    pick = lambda c: pick_angles(scan_angles(near.where(F.abs(F.col("angle") - F.col(c)) <= coarse).select("angle", "y", "x", "mask"), model)).select(c)
    return pick("offset").crossJoin(pick("viewing"))
