"""Embedding near-duplicates by an epsilon grid order join.

Vectors of length 1 with cosine >= t lie within eps = sqrt(2 - 2t) of each other, also after
projection on principal directions. All vectors are sorted by label and then by their grid
cells (of width eps) on the leading directions: one sequence, range-partitioned by Spark, in
which a crowded cell goes on over as many partitions as it needs. The sequence is cut into
intervals of bounded size. Two intervals meet only if the boxes around them come within eps;
a task that joins two intervals halves them recursively, skips halves that are provably
apart, and compares what is left exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .components import components, forest

COSINE = 0.98
#: Leading directions of the grid, vectors in an interval, and vectors below which no more halving is done.
DIRECTIONS, INTERVAL, LEAF = 8, 1024, 64
#: Slack on distances for rounding, so that the exact comparison alone decides.
ROUNDING = 1e-9


def principal(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Leading directions of (array) vectors by their second moments, summed per partition, for each length of vector."""

    def moments(batches):
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for d, part in pdf.groupby(pdf["x"].map(len))["x"]:
                rows = np.stack(part.to_numpy())
                sums[d] = sums.get(d, 0) + rows.T @ rows
        for d, m in sums.items():
            yield pd.DataFrame({"d": d, "i": np.repeat(np.arange(d), d), "j": np.tile(np.arange(d), d), "m": m.ravel()})

    got = vectors.mapInPandas(moments, "d int, i int, j int, m double").groupBy("d", "i", "j").agg(F.sum("m").alias("m")).toPandas()
    out = {}
    for d, part in got.groupby("d"):
        m = np.zeros((d, d))
        m[part["i"], part["j"]] = part["m"]
        out[d] = np.linalg.eigh(m)[1][:, ::-1][:, : min(DIRECTIONS, d)]
    return out


def apart(lo1, hi1, lo2, hi2, eps: float) -> bool:
    gap = np.maximum(0, np.maximum(lo1 - hi2, lo2 - hi1))
    return bool((gap * gap).sum() > eps * eps)


def join_intervals(x: np.ndarray, px: np.ndarray, y: np.ndarray, py: np.ndarray, same: bool, least: float, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of x and y, rows of length 1, with cosine at least `least`; i < j if both are the same interval."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d or (same and d <= a) or apart(px[a:b].min(0), px[a:b].max(0), py[c:d].min(0), py[c:d].max(0), eps):
            continue
        if max(b - a, d - c) > LEAF:
            m, n = (a + b) // 2, (c + d) // 2
            todo += [(a, m, c, n), (a, m, n, d), (m, b, c, n), (m, b, n, d)]
            continue
        i, j = np.nonzero(x[a:b] @ y[c:d].T >= least)
        i, j = i + a, j + c
        if same:
            i, j = i[i < j], j[i < j]
        found.append((i, j))
    return tuple(np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row for each row of df: id, n_links, component_id, kept. Links join rows of equal, non-null labels with cosine >= `cosine` in double precision.

    Rows whose vector is null, zero, empty, or holds null or non-finite components, and
    rows without label, have no links and are components of their own. Vectors of
    different lengths have no links. Equal vectors are joined as one with a count, so
    copies cost nothing. Classes of equal vectors have numbers of their own, so rows that
    repeat an id with another vector are told apart: each has the links and the component of
    its own vector. Null ids come back unlinked with a null component; an empty table gives an
    empty result.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.col("v").isNotNull() & F.col("label").isNotNull() & F.col("id").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    sum_sq = F.aggregate("v", F.lit(0.0), lambda acc, c: acc + c * c)
    usable = rows.where(F.coalesce(finite & (sum_sq > 0), F.lit(False)))
    classes = materialize(usable.groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("copies")).withColumn("home", F.monotonically_increasing_id()), "classes")

    def unit(batches):
        for pdf in batches:
            pdf["x"] = [v / np.sqrt(v @ v) for v in pdf["v"]]
            yield pdf[["label", "home", "copies", "x"]]

    kind = dict(rows.dtypes)["label"]
    units = classes.mapInPandas(unit, f"label {kind}, home long, copies long, x array<double>")
    directions = spark.sparkContext.broadcast(principal(units.select("x")))
    eps = float(np.sqrt(2 - 2 * cosine)) + ROUNDING

    def project(batches):
        for pdf in batches:
            pdf["p"] = [directions.value[len(x)].T @ x for x in pdf["x"]]
            pdf["cells"] = [np.floor(p / eps).astype(np.int32) for p in pdf["p"]]
            yield pdf[["label", "home", "copies", "x", "p", "cells"]]

    placed = units.mapInPandas(project, f"label {kind}, home long, copies long, x array<double>, p array<double>, cells array<int>")
    order = ["label", "d", "cells", "p", "home"]
    sequence = materialize(placed.withColumn("d", F.size("x")), "grid").repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches):
        """Interval numbers along the sequence: a new one after INTERVAL vectors, and where the label or one of the two leading cells changes."""
        from pyspark import TaskContext

        at, strip, number = 0, None, TaskContext.get().partitionId() << 32
        for pdf in batches:
            out = np.empty(len(pdf), np.int64)
            for k, (label, d, cells) in enumerate(zip(pdf["label"], pdf["d"], pdf["cells"], strict=True)):
                own = (label, d, *cells[:2])
                if own != strip or at == INTERVAL:
                    at, strip, number = 0, own, number + 1
                out[k], at = number, at + 1
            pdf["interval"] = out
            yield pdf[["label", "d", "interval", "home", "copies", "x", "p", "cells"]]

    members = sequence.mapInPandas(cut, f"label {kind}, d int, interval long, home long, copies long, x array<double>, p array<double>, cells array<int>")
    members = materialize(members, "intervals")

    side = lambda f, k: F.coalesce(f(F.try_element_at("p", F.lit(k + 1))), F.lit(0.0))
    cell = lambda k: F.coalesce(F.first(F.try_element_at("cells", F.lit(k))), F.lit(0))
    box = [F.struct(side(F.min, k).alias("lo"), side(F.max, k).alias("hi")) for k in range(DIRECTIONS)]
    boxes = members.groupBy("interval").agg(F.first("label").alias("label"), F.first("d").alias("d"), cell(1).alias("c1"), cell(2).alias("c2"), F.array(*box).alias("box"))
    boxes = materialize(boxes, "boxes")
    near = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)).alias(c)
    left = boxes.select("label", "d", near("c1"), "c2", F.col("interval").alias("left"), F.col("box").alias("lbox")).select("label", "d", "c1", near("c2"), "left", "lbox")
    right = boxes.select("label", "d", "c1", "c2", F.col("interval").alias("right"), F.col("box").alias("rbox"))
    gap = F.aggregate(F.zip_with("lbox", "rbox", lambda a, b: F.greatest(F.lit(0.0), a["lo"] - b["hi"], b["lo"] - a["hi"])), F.lit(0.0), lambda acc, g: acc + g * g)
    meet = left.join(right, ["label", "d", "c1", "c2"]).where((F.col("left") <= F.col("right")) & (gap <= eps * eps)).select("left", "right")
    meet = materialize(meet.withColumn("pair", F.xxhash64("left", "right")), "meetings")

    sides = meet.select("pair", F.col("left").alias("interval"), F.lit(0).alias("side")).union(meet.where("left <> right").select("pair", F.col("right"), F.lit(1)))
    work = sides.join(members.select("interval", "home", "copies", "x", "p"), "interval").select("pair", "side", "home", "copies", "x", "p")

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "home"], ignore_index=True)
        grid = np.stack(pdf["p"].to_numpy())
        pdf = pdf.iloc[np.lexsort([*np.floor(grid.T[::-1] / eps), pdf["side"]])].reset_index(drop=True)
        x, p, home, copies = np.stack(pdf["x"].to_numpy()), np.stack(pdf["p"].to_numpy()), pdf["home"].to_numpy(), pdf["copies"].to_numpy()
        n = int((pdf["side"] == 0).sum())
        same = n == len(pdf)
        second = slice(0, n) if same else slice(n, None)
        i, j = join_intervals(x[:n], p[:n], x[second], p[second], same, cosine, eps)
        j = j + (0 if same else n)
        links = np.bincount(i, weights=copies[j], minlength=len(pdf)) + np.bincount(j, weights=copies[i], minlength=len(pdf))
        order = np.argsort(home)
        place = np.empty(len(home), np.int64)
        place[order] = np.arange(len(home))
        root = home[order][forest(place[i], place[j], len(home))[place]]
        some = links > 0
        return pd.DataFrame({"home": home[some], "links": links[some].astype(np.int64), "root": root[some]})

    links = materialize(work.groupBy("pair").applyInPandas(joined, "home long, links long, root long"), "vector-links")
    discard(members, boxes, meet)
    counts = links.groupBy("home").agg(F.sum("links").alias("links"))
    groups = components(links.select(F.col("home").alias("a"), F.col("root").alias("b")))
    groups = groups.withColumnRenamed("node", "home")
    least = groups.join(classes.select("home", "least"), "home").groupBy("component").agg(F.min("least").alias("smallest"))
    summary = classes.select("home", "label", "v", "copies", "least").join(counts, "home", "left").join(groups, "home", "left").join(least, "component", "left")
    summary = summary.select("label", "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("smallest", "least").alias("component"))
    found = rows.join(summary, ["label", "v"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return found.select(F.col("id").alias(id_col), F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
