"""A Merkle manifest of a dataset, with nodes labelled by the intervals of leaf ranks that they cover.

Every row is a leaf, the digest of its columns. The leaves of a group ascend by id and have
ranks; a node at level k covers an interval of FANOUT ** k ranks, and its digest is that of
its children's. The roots of the groups are the leaves of one tree above them.

Trees grow a band of levels at a time: a block is the nodes of one band under one node, kept
as one row with an array of digests for each level. Ancestors are attached from the top: a
block finds the block above it by an equi-join on the bucket of its level and the containment
of its interval. The siblings at a level are what is left of the parent's interval without
the node's own. So rows of many levels never meet rows of single leaves: joins see a row for
FANOUT ** BAND leaves, and a leaf takes its path from the row of its block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, partitions

FANOUT, BAND = 3, 5
SPAN = FANOUT**BAND
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of digests that one range of the sort holds, about.
RANGE_ROWS = 1_000_000


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def encoded(value: Column) -> Column:
    """'-' for null, else the number of UTF-8 bytes, ':' and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(F.concat(*(encoded(v) for v in values)))


def group_key(group: Column) -> Column:
    """Never null, in the order of the groups' bytes, null first."""
    return F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `rank` inside their `group`, from 0, and `n`, the number of rows of the group.

    Ranges of (group, order) are cut from a sample and written, so that a group that holds most
    rows spreads over tasks and no lost task moves a border; only counts are added up
    across ranges.
    """
    spark = rows.sparkSession
    ranges = max(partitions(spark), -(-rows.count() // RANGE_ROWS))
    placed = materialize(rows.repartitionByRange(ranges, "group", *order).withColumn("part", F.spark_partition_id()), "merkle-ranges")
    counts = placed.groupBy("group", "part").agg(F.count("*").alias("k"))
    mine = Window.partitionBy("group")
    sums = counts.select("group", "part", (F.sum("k").over(mine.orderBy("part")) - F.col("k")).alias("before"), F.sum("k").over(mine).alias("n"))
    row = F.row_number().over(Window.partitionBy("part", "group").orderBy(*order)) - 1
    return placed.repartitionById(ranges, F.col("part")).withColumn("row", row).join(sums, ["group", "part"]).withColumn("rank", F.col("row") + F.col("before")).drop("part", "row", "before")


def parents(digests: Column) -> Column:
    """The level above: each run of FANOUT digests, the last of fewer, becomes its digest."""
    runs = F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(digests, i * FANOUT + 1, F.lit(FANOUT)), "")))


def climb(nodes: DataFrame, most: int) -> list[DataFrame]:
    """nodes (group, rank, n, digest, more columns) to the bands above them, from the bottom.

    A band's rows are blocks: group, leaves (of the group), [lo, hi) in leaf ranks, members
    (rank, digest, more), levels (digests of each level, the last has one) and root. The last
    band has one row a group; a group that has ended at a lower band goes on as one node.
    `most` is the largest n.
    """
    carried = [c for c in nodes.columns if c not in ("group", "rank", "n", "digest")]
    nodes = nodes.withColumn("leaves", F.col("n"))
    bands, width = [], 1
    while True:
        block = nodes.withColumn("block", F.floor(F.col("rank") / SPAN)).groupBy("group", "block")
        rows = block.agg(F.max("n").alias("n"), F.max("leaves").alias("leaves"), F.sort_array(F.collect_list(F.struct("rank", "digest", *(carried if not bands else [])))).alias("members"))
        depth = sum(((F.col("n") > FANOUT**k).cast("int") for k in range(BAND)), F.lit(0))
        steps = F.slice(F.array(*(F.lit(k) for k in range(BAND))), F.lit(1), depth)
        base = F.array(F.transform("members", lambda m: m["digest"]))
        levels = F.aggregate(steps, base, lambda made, _: F.concat(made, F.array(parents(F.element_at(made, -1)))))
        rows = rows.withColumn("levels", levels).withColumn("root", F.element_at(F.element_at("levels", -1), -1))
        lo = F.col("block") * SPAN * width
        bands.append(materialize(rows.select("group", "n", "leaves", lo.alias("lo"), F.least(lo + SPAN * width, F.col("leaves")).alias("hi"), "members", "levels", "root"), "merkle-band"))
        most, width = -(-most // SPAN), width * SPAN
        if most <= 1:
            return bands
        nodes = bands[-1].select("group", (F.col("lo") / width).cast("long").alias("rank"), F.ceil(F.col("n") / SPAN).alias("n"), "leaves", F.col("root").alias("digest"))


def siblings(levels: Column, block_lo: Column, width: int, lo: Column) -> Column:
    """Level by level the digests left and right of the node over rank lo, inside its parent.

    The parent's interval without the node's own is what comes before and what comes after;
    the nodes that cover either are neighbours in the level's array.
    """

    def beside(digests: Column, w: Column) -> Column:
        covering = lambda a, b: F.array_join(F.slice(digests, ((a - block_lo) / w).cast("int") + 1, ((b - a) / w).cast("int")), "")
        own, parent = lo - lo % w, lo - lo % (w * FANOUT)
        return F.struct(covering(parent, own).alias("left"), covering(own + w, parent + w * FANOUT).alias("right"))

    widths = F.array(*(F.lit(width * FANOUT**k).cast("long") for k in range(BAND)))
    return F.transform(F.slice(widths, F.lit(1), F.size(levels) - 1), lambda w, k: beside(F.get(levels, k), w))


def descend(bands: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The members of the lowest band with their paths: tops has for each group the path above its root, and more columns for all its rows."""
    given = [c for c in tops.columns if c not in ("group", "path")]
    above = None
    for k in range(len(bands) - 1, -1, -1):
        own = bands[k].select("group", "lo", "hi", "members", "levels")
        if above is None:
            here = own.join(tops, "group")
        else:
            w = SPAN ** (k + 2)
            up = above.select(F.col("group").alias("g"), F.floor(F.col("lo") / w).alias("bucket"), F.col("lo").alias("from"), F.col("hi").alias("to"), F.col("levels").alias("above"), F.col("path").alias("upper"), *given)
            inside = (F.col("group") == F.col("g")) & (F.floor(F.col("lo") / w) == F.col("bucket")) & (F.col("from") <= F.col("lo")) & (F.col("hi") <= F.col("to"))
            here = own.join(up, inside).withColumn("path", F.concat(siblings(F.col("above"), F.col("from"), SPAN ** (k + 1), F.col("lo")), "upper"))
            here = here.select("group", "lo", "hi", "members", "levels", "path", *given)
        above = here
    rows = above.select("group", "lo", "levels", "path", *given, F.explode("members").alias("m"))
    return rows.select("group", "m.*", F.concat(siblings(F.col("levels"), F.col("lo"), 1, F.col("m.rank")), "path").alias("path"), *given)


def node_table(bands: list[DataFrame]) -> DataFrame:
    """All nodes of climbed bands: group, level, [lo, hi) in leaf ranks, digest."""
    out = None
    for k, band in enumerate(bands):
        rows = band.select("group", "leaves", F.col("lo").alias("first"), F.posexplode("levels").alias("up", "digests"))
        rows = rows.select("group", "leaves", "first", (F.col("up") + k * BAND).alias("level"), F.posexplode("digests").alias("at", "digest")).where("level > 0" if not k else f"level > {k * BAND}")
        w = F.pow(F.lit(float(FANOUT)), F.col("level")).cast("long")
        lo = F.col("first") + F.col("at") * w
        rows = rows.select("group", "level", lo.alias("lo"), F.least(lo + w, "leaves").alias("hi"), "digest")
        out = rows if out is None else out.union(rows)
    leaves = bands[0].select("group", F.explode("members").alias("m")).select("group", F.lit(0).alias("level"), F.col("m.rank").alias("lo"), (F.col("m.rank") + 1).alias("hi"), "m.digest")
    return leaves.union(out)


def folded(own: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, own, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))


def proof(path: Column) -> Column:
    """All siblings, from the leaf's level to the root's."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(df: DataFrame, id_col: str = "doc_id", group_col: str = "source", columns: Sequence[str] = COLUMNS, more: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of df: id, leaf, rank, subroot, root, path (left and right siblings of each level), and the columns of `more`.

    Groups go by their bytes, a null group first and apart from an empty one. A null id comes
    first in its group; rows of one id go by their digests, and equal rows are leaves of
    their own. Null and empty values differ ('-' and '0:'). A single leaf of a single group
    is the root and has no siblings; an empty table gives an empty result. Columns that are not named
    are not read.
    """
    more = more or {}
    rows = df.select(F.col(id_col).cast("long").alias("id"), group_key(F.col(group_col)).alias("group"), leaf(*(F.col(c) for c in columns)).alias("digest"), *(c.alias(n) for n, c in more.items()))
    leaves = materialize(rows, "merkle-leaves")
    rows = ranked(leaves, "id", "digest")
    most = rows.agg(F.max("n")).first()[0] or 1
    bands = climb(rows, most)
    discard(leaves)
    subroots = bands[-1].select("group", "root")
    tree = ranked(subroots.select(F.lit("").alias("group"), F.col("group").alias("key"), F.col("root").alias("digest")), "key")
    upper = climb(tree, tree.count() or 1)
    top = upper[-1].select("group", F.array().cast("array<struct<left:string,right:string>>").alias("path"), "root")
    tops = descend(upper, top).select(F.col("key").alias("group"), F.col("digest").alias("subroot"), "root", "path")
    out = descend(bands, tops)
    return out.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "rank", "subroot", "root", "path", *more)


def audit(df: DataFrame, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", columns: Sequence[str] = COLUMNS) -> DataFrame:
    """The manifest folded again from rows of which some are tampered with: those whose id has an even CRC-32 lose their line feeds.

    Returns id, leaf, subroot, root, proof_sha256, folded_root and verified. Rows with a null id or a null text stay as they are.
    """
    cut = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    changed = leaf(*(F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == text_col else F.col(c) for c in columns))
    rows = manifest(df, id_col, group_col, columns, {"tampered": F.when(cut & F.contains(F.col(text_col), F.lit("\n")), changed)})
    rows = rows.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return rows.select(id_col, "leaf", "subroot", "root", digest(proof(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
