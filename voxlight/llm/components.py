"""Connected components of a link table, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b): component is the smallest node that it is connected to.

    Each round points every node at its smallest neighbour, hands a node's other
    neighbours on to that smallest one, and lets pointers skip a step. Every round is
    written out, so lineage stays short. Nodes with very many links are no trouble:
    minima are summed before the shuffle, and the joins are plain equi-joins that Spark
    can split. Nulls and links of a node with itself say nothing.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    written = edges = materialize(edges, "edges")
    for _ in range(most_rounds):
        least = edges.groupBy("u").agg(F.min("v").alias("p"))
        if not edges.groupBy("u").count().where("count > 1").limit(1).count():
            # One pointer a node: follow pointers until all end at a root.
            up = least.select(F.col("u").alias("p"), F.col("p").alias("q"))
            stepped = least.join(up, "p", "left").select("u", F.coalesce("q", "p").alias("v"), F.col("q").isNotNull().alias("moved"))
            stepped = materialize(stepped, "pointers")
            discard(written)
            written, edges = stepped, stepped.select("u", "v")
            if stepped.where("moved").limit(1).count() == 0:
                break
            continue
        handed = edges.join(least, "u").where("v <> p").select(F.col("v").alias("u"), F.col("p").alias("v"))
        edges = materialize(least.select("u", F.col("p").alias("v")).union(handed).distinct(), "edges")
        discard(written)
        written = edges
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    out.written_to = written.written_to  # discard(result) deletes what it is read from
    return out


def forest(a, b, n: int):
    """For links between 0..n-1 in one task: the smallest member of each one's component."""
    import numpy as np

    label = np.arange(n)
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            return label
        label = new
