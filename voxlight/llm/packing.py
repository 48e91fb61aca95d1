"""Packing token sequences by shortest-pack-first over the length histogram.

Documents become pieces of at most `width` tokens. Only the histogram of piece lengths,
`width` numbers, reaches the driver: lengths are placed longest first, each on the pack
with the fewest tokens that has room, and packs of equal content are one pattern with a
count. A piece then finds its place by its rank among the pieces of its length: patterns
take ranges of ranks.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize, partitions

WIDTH = 1024
END_ID = 0
#: How the byte-level pre-tokenizer of `tokenizers` splits a text (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLICE = 1024



class ByteBpe:
    """The ids of a byte-level BPE file of `tokenizers`, by the faster `tiktoken` where both agree: in texts without added tokens."""

    def __init__(self, content: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_str(content)
        model = json.loads(content)
        self.added = [t["content"] for t in model["added_tokens"]]
        plain = {chr(b): b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
        plain |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain.values()))}
        vocabulary = {t: i for t, i in model["model"]["vocab"].items() if t not in self.added}
        ranks = {bytes(plain[c] for c in token): i for token, i in vocabulary.items()}
        self.fast = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if any(t in text for t in self.added):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def tokenize(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """A row for each piece of each row of df: id, start, length, ids_crc32, doc_tokens. Every document ends with END_ID, so an empty or null text has one token."""
    content = open(tokenizer, encoding="utf-8").read()
    shared = df.sparkSession.sparkContext.broadcast(content)  # the tokenizer's file, a fixed size

    def pieces(batches):
        bpe = ByteBpe(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                doc, start, length, crc, total = [], [], [], [], []
                for key, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    own = np.array([*bpe.ids(text or ""), END_ID], dtype="<u4")
                    for begin in range(0, len(own), width):
                        cut = own[begin : begin + width]
                        doc.append(key), start.append(begin), length.append(len(cut)), crc.append(zlib.crc32(cut.tobytes())), total.append(len(own))
                arrays = [pa.array(x, pa.int64()) for x in (doc, start, length, crc, total)]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"))
    return rows.mapInArrow(lean(pieces), "id long, start long, length long, ids_crc32 long, doc_tokens long")


def patterns(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many packs hold them): longest lengths first, each to the least filled pack with room."""
    open_packs: list[tuple[int, tuple[int, ...]]] = []
    counts: dict[tuple[int, ...], int] = defaultdict(int)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            used, lengths = open_packs[0] if open_packs else (width, ())
            if used + length > width:
                used, lengths, taken = 0, (), left
            else:
                taken = min(left, counts[lengths])
                counts[lengths] -= taken
                if not counts[lengths]:
                    heapq.heappop(open_packs)
            grown = (*lengths, length)
            if not counts[grown]:
                heapq.heappush(open_packs, (used + length, grown))
            counts[grown] += taken
            left -= taken
    return sorted((p, n) for p, n in counts.items() if n)


def places(found: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Ranges of ranks by length: from `start` on, ranks go round `packs` packs from `sequence` on, one offset after the other."""
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, packs in found:
        offset = 0
        for length in lengths:
            rows.append((length, taken[length], packs, sequence, offset))
            taken[length] += packs
            offset += length
        sequence += packs
    rows.sort()
    return dict(zip(("length", "start", "packs", "sequence", "offset"), np.array(rows, dtype=np.int64).reshape(-1, 5).T, strict=True))


def pack(pieces: DataFrame, width: int = WIDTH) -> DataFrame:
    """pieces (id, start, length, ...) with sequence_id and offset. Ranks inside a length are found in slices, so a length that most pieces share spreads over tasks."""
    spark = pieces.sparkSession
    slices = 4 * partitions(spark)
    pieces = materialize(pieces.withColumn("slice", F.pmod(F.xxhash64("id", "start"), F.lit(slices)).cast("int")), "pieces")
    by_slice = pieces.groupBy("length", "slice").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_slice.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # width rows at most
    shared = spark.sparkContext.broadcast(places(patterns(histogram, width)))

    before = by_slice.select("length", "slice", (F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "slice").orderBy("id", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(order) - 1).join(before, ["length", "slice"])
    ranked = ranked.select(*[c for c in pieces.columns if c != "slice"], (F.col("rank") + F.col("before")).cast("long").alias("rank"))

    def placed(batches):
        p, wide = shared.value, np.int64(1) << 44
        keys = p["length"] * wide + p["start"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * wide + rank, side="right") - 1
            sequence = p["sequence"][at] + rank - p["start"][at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(p["offset"][at])], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(lean(placed), f"{schema}, sequence_id long, offset long")


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """A row for each piece of each row of df: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document longer than width is cut every width tokens. A null text is empty and has
    the end token alone; rows with equal or null ids are documents of their own; an
    empty table gives an empty result.
    """
    return pack(tokenize(df, tokenizer, id_col, text_col, width), width).withColumnRenamed("id", id_col)
