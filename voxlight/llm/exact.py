"""Exact deduplication by content sort.

Texts are compared after deleting the characters [\x20\x09-\x0D]. Splitters taken from a
bounded sample range-partition the rows by (first characters of the normalised text, hash of
all of it, id): of sampled texts only the first HEAD characters and the hash reach the driver,
and the id is part of the order, so a text that a third of all rows share still spreads over
many buckets. Spark sorts each bucket externally; equal texts are then neighbours, and one
full comparison with the row before tells where a run of equal texts begins. A run that
crosses a bucket border is joined by comparing the last text of a bucket with the first of
the next.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_not_above, from_json_literal, materialize, partitions

SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: Bytes of text for a bucket, about, the most buckets, sampled rows for each, and characters of a sampled text:
#: the sample is 2 * MOST_BUCKETS * SAMPLES rows of HEAD characters at most, whatever the size of the data.
BUCKET_BYTES, MOST_BUCKETS, SAMPLES, HEAD = 16_000_000, 32_768, 4, 256
LEAST = -(2**63)


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def splitters(sample: list[tuple[str, int, int]], buckets: int) -> list[dict]:
    """Ascending (head, hash, id) borders, as short as they can be: each is cut where it first differs from its predecessor."""
    sample = sorted(sample)
    out: list[tuple[str, int, int]] = []
    for b in range(1, buckets):
        if not 0 < (i := b * len(sample) // buckets) < len(sample):
            continue
        (before, old, _), (head, new, at) = sample[i - 1], sample[i]
        border = (head[: len(commonprefix([before, head])) + 1], LEAST, LEAST) if head != before else (head, new, LEAST) if new != old else (head, new, at)
        if not out or border > out[-1]:
            out.append(border)
    return [{"t": t, "h": h, "i": i} for t, h, i in out]


def content_sort(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", payload: Sequence[str] = ()) -> DataFrame:
    """One row for each row of df: id, keep_id, group_size, kept, text_sha256, and the payload columns under `row`.

    Of equal texts the row with the most code points in the original text stays, then
    the smallest id. A null text counts as empty; all empty texts are one group. A null
    id sorts after all others; of rows that tie in everything one stays. An empty table
    gives an empty result; columns not named are ignored.
    """
    spark = df.sparkSession
    source = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([F.struct(*payload).alias("row")] if payload else []))
    source = source.withColumn("i", F.coalesce("id", F.lit(2**63 - 1)))
    total = source.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    buckets = min(MOST_BUCKETS, max(partitions(spark), (total["bytes"] or 0) // BUCKET_BYTES))
    every = max(1, total["rows"] // (buckets * SAMPLES))
    norm, head, digest = F.col("norm"), F.substring("norm", 1, HEAD), F.xxhash64("norm")
    sampled = source.where(F.pmod(F.xxhash64("id", F.length("text")), F.lit(every)) == 0).select(normalised(F.col("text")).alias("norm"), "i")
    sample = sampled.select(head.alias("t"), digest.alias("h"), "i").limit(2 * buckets * SAMPLES).collect()
    borders = splitters([(r["t"], r["h"], r["i"]) for r in sample], buckets)

    literal = from_json_literal(json.dumps(borders), "array<struct<t:string,h:bigint,i:bigint>>")
    carried = [F.col("row")] if payload else []
    at = F.struct(head.alias("t"), digest.alias("h"), F.col("i").alias("i"))
    placed = source.select("id", "text", "i", *carried, normalised(F.col("text")).alias("norm")).withColumn("at", at)
    placed = placed.withColumn("bucket", count_not_above(literal, len(borders), lambda b: b <= F.col("at")))
    # A payload that holds the text brings it along; the normalised text is then made again beyond the shuffle.
    again = text_col in payload
    placed = placed.select("id", "i", F.length("text").alias("n"), *([] if again else ["norm"]), *carried, "bucket").repartitionById(len(borders) + 1, F.col("bucket"))
    if again:
        placed = placed.withColumn("norm", normalised(F.col("row")[text_col]))
    dealt = placed.withColumns({"head": head, "digest": digest})

    w = Window.partitionBy("bucket").orderBy("head", "digest", "norm", "i")
    runs = dealt.withColumns({"before": F.lag("norm").over(w), "first": F.row_number().over(w) == 1, "last": F.lead(F.lit(1)).over(w).isNull()})
    runs = runs.withColumn("run", F.sum((F.col("first") | (F.col("before") != norm)).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.select(
        "id", "n", "i", "bucket", "run", "first", "last", *carried, F.sha2(norm.cast("binary"), 256).alias("text_sha256"), F.when(F.col("first") | F.col("last"), norm).alias("edge")
    )
    best = F.struct(F.col("n").alias("n"), (-F.col("i")).alias("minus"))
    mine = Window.partitionBy("bucket", "run")
    tie = F.row_number().over(mine.orderBy(F.col("n").desc(), "i"))
    runs = runs.withColumns({"size": F.count("*").over(mine), "best": F.max(best).over(mine), "place": tie})
    runs = materialize(runs, "content-sort")

    # Runs that go on in the next bucket. Numbers of buckets go through one task, MOST_BUCKETS at most; the texts beside a border meet by joins.
    ends = runs.where("first or last").groupBy("bucket").agg(
        F.max(F.when(F.col("first"), F.col("edge"))).alias("head"), F.max(F.when(F.col("last"), F.col("edge"))).alias("tail"), F.max("run").alias("runs")
    )
    along = Window.orderBy("bucket")
    beside = ends.select("bucket").withColumn("left", F.lag("bucket").over(along))
    beside = beside.join(ends.select(F.col("bucket").alias("left"), "tail", "runs"), "left", "left").join(ends.select("bucket", "head"), "bucket")
    beside = beside.select("bucket", "left", "runs", F.coalesce(F.col("tail") == F.col("head"), F.lit(False)).alias("goes_on"))
    anchor = F.when(~F.col("goes_on"), F.struct(F.col("bucket"), F.lit(1).cast("long").alias("run"))).when(F.col("runs") > 1, F.struct(F.col("left").alias("bucket"), F.col("runs").alias("run")))
    chains = beside.select("bucket", F.last(anchor, ignorenulls=True).over(along).alias("to"), "goes_on")
    joined = chains.where("goes_on").select("bucket", F.lit(1).cast("long").alias("run"), "to")
    members = joined.union(joined.select("to.bucket", "to.run", "to")).distinct()
    heads = runs.where("place = 1").select("bucket", "run", "size", "best")
    whole = members.join(heads, ["bucket", "run"]).groupBy("to").agg(F.sum("size").alias("all_size"), F.max("best").alias("all_best"))
    whole = members.join(whole, "to").select("bucket", "run", F.col("to.bucket").alias("home"), "all_size", "all_best")

    out = runs.join(F.broadcast(whole), ["bucket", "run"], "left")
    chosen = F.coalesce("all_best", "best")
    keep = -chosen["minus"]
    # Of rows that repeat the kept id with equal length, the first of the run that comes first stays.
    kept = (F.col("i") == keep) & (F.col("n") == chosen["n"]) & (F.col("place") == 1)
    keep_id = F.when(keep != 2**63 - 1, keep)
    return out.select(F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("all_size", "size").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256", *carried)
