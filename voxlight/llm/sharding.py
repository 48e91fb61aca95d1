"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns `vnodes` points of a ring of 2^63 positions. A row belongs to the arc
that ends at the first point clockwise of its hash. Arcs are dealt in ring order: the
rows of an arc go to the arc's own shard while it has room, and what a full shard
cannot take continues clockwise to the next shard with room. All rows of an arc walk
the same way, so the walk needs only the number of rows of each arc: shards * vnodes
numbers, whatever the size of the data. A row's rank in its arc follows from its position on
the ring and never from how the input is split: rows that are equal in all that counts are
one row with a count, and the others are ranked in slices of the ring, of which one that
holds very many rows is cut further by checksums.
"""

from __future__ import annotations

import bisect
import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import count_not_above, from_json_literal, materialize

SHARDS = 40
VNODES = 128
#: Slices of the ring for each point, and rows of a slice from which it is cut further, in 16.
SLICES, CROWDED = 16, 1_000_000


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard), ascending."""
    at = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest()) >> 1
    return sorted((at(s, v), s) for s in range(shards) for v in range(vnodes))


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Room of each shard. Without slack the room equals the rows, so all shards fill up and differ by one at most."""
    if slack:
        return [-(-int(rows * (1 + slack)) // shards) + 1] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def deal(points: list[tuple[int, int]], counts: dict[int, int], room: list[int]) -> list[dict]:
    """For each arc the segments of its ranks: from which rank on rows go to which shard, from which slot on."""
    room, filled, segments = list(room), [0] * len(room), []
    for arc in range(len(points)):
        done, at = 0, arc
        while done < counts.get(arc, 0):
            shard = points[at % len(points)][1]
            if take := min(room[shard], counts[arc] - done):
                segments.append({"arc": arc, "start": done, "shard": shard, "base": filled[shard]})
                room[shard] -= take
                filled[shard] += take
                done += take
            at += 1
    return segments


def ring_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """One row for each row of df: id, size, text_crc32, shard, slot.

    slack is how far a shard may exceed the mean (0.1: by a tenth); at 0 the counts of
    any two shards differ by one at most. Slots of a shard run from 0 without gaps.
    A null text has no bytes and checksum 0; a null id is placed by the text's
    checksum; repeated ids and rows are rows of their own; an empty table gives an
    empty result; other columns are ignored. Neither the order of rows nor their
    partitioning changes the result.
    """
    points = ring(shards, vnodes)
    positions = from_json_literal(json.dumps([p for p, _ in points]), "array<bigint>")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.groupBy("id", "size", "text_crc32").agg(F.count("*").alias("n"))
    hashed = F.shiftrightunsigned(F.when(F.col("id").isNull(), F.xxhash64("text_crc32")).otherwise(F.xxhash64("id")), 1)
    rows = rows.withColumn("at", hashed)
    arc = count_not_above(positions, len(points), lambda p: p < F.col("at")) % len(points)
    part = F.shiftright("at", 63 - (SLICES * len(points)).bit_length())
    rows = materialize(rows.select("id", "size", "text_crc32", "n", arc.cast("int").alias("arc"), "at", part.alias("part")), "ring")
    # Crowded parts are as few as the rows divided by CROWDED, arcs and parts a number that the ring sets.
    crowded = rows.groupBy("arc", "part").agg(F.sum("n").alias("all")).where(F.col("all") > CROWDED).select("arc", "part", F.lit(True).alias("crowded"))
    cut = F.when(F.col("crowded"), F.shiftright("text_crc32", 28)).otherwise(0)
    rows = rows.join(F.broadcast(crowded), ["arc", "part"], "left").withColumn("slice", F.struct("part", cut.alias("cut"))).drop("crowded")

    by_slice = rows.groupBy("arc", "slice").agg(F.sum("n").alias("n"))
    counts = {r["arc"]: r["n"] for r in by_slice.groupBy("arc").agg(F.sum("n").alias("n")).collect()}  # shards * vnodes rows at most
    dealt: dict[int, list] = {}
    for s in deal(points, counts, capacities(sum(counts.values()), shards, slack)):
        dealt.setdefault(s.pop("arc"), []).append(s)
    plan = df.sparkSession.createDataFrame([(a, [(s["start"], s["shard"], s["base"]) for s in x]) for a, x in dealt.items()], "arc int, segments array<struct<start:bigint,shard:int,base:bigint>>")

    before = by_slice.select("arc", "slice", (F.sum("n").over(Window.partitionBy("arc").orderBy("slice")) - F.col("n")).alias("before"))
    order = Window.partitionBy("arc", "slice").orderBy("at", "id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("first", F.sum("n").over(order) - F.col("n")).join(before, ["arc", "slice"])
    ranked = ranked.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).join(F.broadcast(plan), "arc")
    rank = F.col("before") + F.col("first") + F.col("copy")
    segment = F.element_at(F.filter("segments", lambda s: s["start"] <= rank), -1)
    ranked = ranked.withColumn("segment", segment)
    return ranked.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.col("segment.shard").alias("shard"), (F.col("segment.base") + rank - F.col("segment.start")).cast("long").alias("slot")
    )


def moved(before: list[int], after: list[int]) -> float:
    """Share of places that differ."""
    return sum(a != b for a, b in zip(before, after, strict=True)) / max(1, len(before))


def place_counts(points: list[tuple[int, int]], keys: list[int], room: list[int]) -> list[int]:
    """The same walk over plain positions, one by one: what the tests compare the jobs with."""
    arcs = [bisect.bisect_left([p for p, _ in points], k) % len(points) for k in keys]
    room, out = list(room), [0] * len(keys)
    for i in sorted(range(len(keys)), key=lambda i: (arcs[i], keys[i])):
        at = arcs[i]
        while not room[points[at % len(points)][1]]:
            at += 1
        out[i] = points[at % len(points)][1]
        room[out[i]] -= 1
    return out


__all__ = ["capacities", "deal", "moved", "place_counts", "ring", "ring_shards"]
