"""Best-fit packing of token sequences, improved by a local search.

Only documents of more than `width` tokens are cut. What reaches the driver is the histogram
of piece lengths, `width` numbers. Best fit places lengths longest first, each in the fullest
sequence with room; sequences of equal content are one pattern with a count. Then sequences
that are not full exchange documents: the emptiest hands one over, or swaps one for a
smaller one, two for one or one for two, always so that the sum of squared fills grows,
until it is empty and goes, or no exchange is left. Exchanges act on as many sequences of
two patterns as there are of both, so their number follows the patterns and not the rows.
A piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions
from .packing import END_ID, SLICE, ByteBpe

WIDTH = 2048
#: Patterns that a pass of the search tries to empty, and exchanges it makes at most.
DONORS, EXCHANGES = 2_000, 20_000

#: (length, how often) from the longest on.
Pattern = tuple[tuple[int, int], ...]


def fill_of(pattern: Pattern) -> int:
    return sum(length * k for length, k in pattern)


def lower_bound(histogram: dict[int, int], width: int = WIDTH) -> int:
    """Sequences that any packing needs: pieces of more than half a sequence never share one, and pieces of at least `small` do not fit beside those of more than width - small."""
    counts = np.zeros(width + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    number, size = np.cumsum(counts), np.cumsum(counts * np.arange(width + 1))
    best = -(-int(size[-1]) // width)
    for small in range(1, width // 2 + 1):
        alone = int(number[width] - number[width - small])
        half = int(number[width - small] - number[width // 2])
        room = half * width - int(size[width - small] - size[width // 2])
        rest = int(size[width // 2] - size[small - 1])
        best = max(best, alone + half + max(0, -(-(rest - room) // width)))
    return best


def best_fit(histogram: dict[int, int], width: int = WIDTH) -> Counter[Pattern]:
    """Patterns and how many sequences hold them: longest pieces first, each to the fullest sequence with room."""
    done: Counter[Pattern] = Counter()
    rooms: list[int] = []
    having: dict[int, Counter[Pattern]] = {}

    def put(pattern: Pattern, room: int, n: int) -> None:
        if not room:
            done[pattern] += n
            return
        if room not in having:
            insort(rooms, room)
            having[room] = Counter()
        having[room][pattern] += n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = width // length
                if left // each:
                    put(((length, each),), width - each * length, left // each)
                if left % each:
                    put(((length, left % each),), width - left % each * length, 1)
                break
            room = rooms[at]
            pattern, n = next(iter(having[room].items()))
            each = min(room // length, left)
            taken = min(n, left // each)
            having[room][pattern] -= taken
            if not having[room][pattern]:
                del having[room][pattern]
                if not having[room]:
                    del having[room], rooms[at]
            put((*pattern, (length, each)), room - each * length, taken)
            left -= taken * each
    for kinds in having.values():
        done.update(kinds)
    return done


class Search:
    """Local search among the sequences that are not full."""

    def __init__(self, bins: Counter[Pattern], width: int = WIDTH):
        self.width, self.bins, self.total = width, Counter(), 0
        # For a sum of one or two pieces: patterns that hold them, and the most room that one of these has.
        self.one: dict[int, dict[Pattern, int]] = defaultdict(dict)
        self.two: dict[int, dict[Pattern, int]] = defaultdict(dict)
        self.most_one, self.most_two = np.zeros(width + 1, np.int64), np.zeros(width + 1, np.int64)
        self.by_fill: list[tuple[int, Pattern]] = []
        for pattern, n in bins.items():
            self.change(pattern, n)

    @staticmethod
    def pairs(pattern: Pattern) -> dict[int, tuple[int, int]]:
        """A pair of pieces for each sum of two."""
        out = {a + b: (a, b) for (a, _), (b, _) in combinations(pattern, 2)}
        return out | {2 * a: (a, a) for a, k in pattern if k > 1}

    def change(self, pattern: Pattern, n: int) -> None:
        """n more sequences of a pattern, or fewer."""
        before = self.bins[pattern]
        self.bins[pattern] += n
        self.total += n
        room = self.width - fill_of(pattern)
        if not self.bins[pattern]:
            del self.bins[pattern]
        if not room or (before > 0) == (before + n > 0):
            return
        tables = ((self.one, self.most_one, [a for a, _ in pattern]), (self.two, self.most_two, [s for s in self.pairs(pattern) if s <= self.width]))
        if not before:
            insort(self.by_fill, (self.width - room, pattern))
            for index, most, sums in tables:
                for s in sums:
                    index[s][pattern] = room
                    most[s] = max(most[s], room)
        else:
            del self.by_fill[bisect_left(self.by_fill, (self.width - room, pattern))]
            for index, most, sums in tables:
                for s in sums:
                    del index[s][pattern]
                    if most[s] == room:
                        most[s] = max(index[s].values(), default=0)

    @staticmethod
    def swapped(pattern: Pattern, out: tuple[int, ...], into: tuple[int, ...]) -> Pattern:
        held = Counter(dict(pattern))
        held.subtract(out)
        held.update(into)
        return tuple(sorted(((a, k) for a, k in held.items() if k), reverse=True))

    def partner(self, donor: Pattern, index: dict[int, dict[Pattern, int]], most: np.ndarray, given: int) -> tuple[int, Pattern] | None:
        """(sum, pattern): the smallest sum of pieces below `given` that a pattern would give for it, with room for the difference and full enough for the squared fills to grow."""
        room_here = self.width - fill_of(donor)
        sums = np.arange(given)
        for s in np.flatnonzero((most[:given] >= given - sums) & (most[:given] > 0)).tolist():
            gain = given - s
            for pattern, room in index[s].items():
                if gain <= room < room_here + gain and (pattern != donor or self.bins[donor] > 1):
                    return s, pattern
        return None

    def exchange(self, donor: Pattern) -> bool:
        """One improving exchange of the donor with a pattern at least as full: a move, else the swap that takes most from the donor."""
        fill = fill_of(donor)
        best: tuple[int, tuple[int, ...], tuple[int, ...], Pattern] | None = None
        for piece, _ in donor:
            # Move: to the fullest pattern with room; the room of the donor's own kind counts if there are two of it.
            at = bisect_left(self.by_fill, (self.width - piece + 1,)) - 1
            if at >= 0 and self.by_fill[at] == (fill, donor) and self.bins[donor] < 2:
                at -= 1
            if at >= 0 and self.by_fill[at][0] >= fill:
                best = (piece, (piece,), (), self.by_fill[at][1])
                break
        if not best:
            singles = [((a,), a) for a, _ in donor]
            doubles = [(pair, s) for s, pair in self.pairs(donor).items() if s < self.width]
            for out, given in (*singles, *doubles):
                if (found := self.partner(donor, self.one, self.most_one, given)) and (not best or given - found[0] > best[0]):
                    best = (given - found[0], out, (found[0],), found[1])
            for out, given in singles:
                if (found := self.partner(donor, self.two, self.most_two, given)) and (not best or given - found[0] > best[0]):
                    best = (given - found[0], out, self.pairs(found[1])[found[0]], found[1])
        if not best:
            return False
        _, out, into, other = best
        n = self.bins[donor] // 2 if other == donor else min(self.bins[donor], self.bins[other])
        smaller, larger = self.swapped(donor, out, into), self.swapped(other, into, out)
        self.change(donor, -n)
        self.change(other, -n)
        if smaller:
            self.change(smaller, n)
        self.change(larger, n)
        return True

    def run(self, least: int) -> Counter[Pattern]:
        """Passes over the DONORS emptiest patterns until one changes nothing or `least` sequences are left."""
        made, before = 0, -1
        while made != before:
            before, at = made, 0
            while at < min(DONORS, len(self.by_fill)) and made < EXCHANGES and self.total > least:
                if self.exchange(self.by_fill[at][1]):
                    made += 1
                else:
                    at += 1
        return self.bins


def patterns(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[Pattern, int]]:
    """The packing of a histogram of lengths: patterns and how many sequences hold them."""
    bins, least = best_fit(histogram, width), lower_bound(histogram, width)
    if sum(bins.values()) > least:
        bins = Search(bins, width).run(least)
    return sorted(bins.items())


def places(found: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """Ranges of ranks by length: from `start` on, `each` ranks in a row share a sequence, from `sequence` and `offset` on."""
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, n in found:
        offset = 0
        for length, each in pattern:
            rows.append((length, taken[length], each, sequence, offset))
            taken[length] += n * each
            offset += length * each
        sequence += n
    rows.sort()
    return dict(zip(("length", "start", "each", "sequence", "offset"), np.array(rows, dtype=np.int64).reshape(-1, 5).T, strict=True))


def cut(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """A row for each piece of each row of df: id, piece, start, length, ids_crc32. Only documents of more than width tokens, the end token included, are cut, and only their first piece may be shorter than width."""
    content = open(tokenizer, encoding="utf-8").read()
    shared = df.sparkSession.sparkContext.broadcast(content)  # the tokenizer's file, a fixed size

    def pieces(batches):
        bpe = ByteBpe(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = []
                for key, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    own = np.array([*bpe.ids(text or ""), END_ID], dtype="<u4")
                    ends = range((len(own) - 1) % width + 1, len(own) + 1, width)
                    for k, end in enumerate(ends):
                        begin = max(0, end - width)
                        rows.append((key, k, begin, end - begin, zlib.crc32(own[begin:end].tobytes())))
                key, k, begin, length, crc = zip(*rows, strict=True) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (begin, length, crc))], names=["id", "piece", "start", "length", "ids_crc32"])

    rows = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"))
    return rows.mapInArrow(pieces, "id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, width: int = WIDTH) -> DataFrame:
    """pieces (id, start, length, ids_crc32, ...) with sequence_id and offset. Ranks inside a length are found in slices, so a length that most pieces share spreads over tasks."""
    spark = pieces.sparkSession
    slices = 4 * partitions(spark)
    pieces = materialize(pieces.withColumn("slice", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(slices)).cast("int")), "bestfit-pieces")
    by_slice = pieces.groupBy("length", "slice").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_slice.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # width rows at most
    shared = spark.sparkContext.broadcast(places(patterns(histogram, width)))

    before = by_slice.select("length", "slice", (F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "slice").orderBy("id", "start", "ids_crc32")
    ranked = pieces.withColumn("row", F.row_number().over(order) - 1).join(before, ["length", "slice"])
    ranked = ranked.select(*[c for c in pieces.columns if c != "slice"], (F.col("row") + F.col("before")).cast("long").alias("rank"))

    def placed(batches):
        p, wide = shared.value, np.int64(1) << 44
        keys = p["length"] * wide + p["start"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * wide + rank, side="right") - 1
            turn, among = np.divmod(rank - p["start"][at], p["each"][at])
            sequence, offset = p["sequence"][at] + turn, p["offset"][at] + among * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(placed, f"{schema}, sequence_id long, offset long")


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """A row for each piece of each row of df: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty and has the end token alone; rows with equal or null ids are
    documents of their own; an empty table gives an empty result. Columns that are not named are
    not read.
    """
    return pack(cut(df, tokenizer, id_col, text_col, width), width).withColumnRenamed("id", id_col)
