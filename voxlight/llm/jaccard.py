"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Texts are sets of five-word shingles. Texts of equal word sequences are one class from the
start, so copies cost a count. Each tree of the forest is a trie over signatures of DEPTH
minimal hashes, kept as a table sorted by signature: the classes that share a prefix are an
interval of it.

Matching starts at whole signatures and shortens the matched prefix hash by hash. At each
depth the classes that share a prefix in some tree are tied into groups, and the pairs that
a group newly brings together are compared exactly. What the links found so far say of the
recall decides whether the prefix is shortened again: a link of similarity s is met at depth
k with probability p = 1 - (1 - s^k)^TREES, so it stands for (1 - p) / p links that were
missed, and one more link exactly at the threshold counts as seen. Shortening ends when the
recall so estimated reaches RECALL. With few links that one decides, so no depth below
the one that gives RECALL at the threshold is ever needed, and the tries begin there.

Shingle sets are read again from the texts, for candidates alone. A group too large for one
task is dealt as pairs of its blocks; one larger still as pairs of blocks of the trie nodes
that hold it together. What leaves a task is a number of links for each class and a spanning
tree, never the pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, lean, materialize, partitions
from .components import components, forest
from .features import Words

WORDS, THRESHOLD = 5, Fraction(4, 5)
TREES, DEPTH, RECALL = 24, 7, 0.9999  # DEPTH is 7 at most
#: A class is a load of 1 for every LOAD shingles or part of them, so that long texts count for many.
LOAD = 16_384
#: Loads that are compared in one go at most; a larger group is dealt in blocks of half as much.
GROUP = 512
#: Groups of up to so many times GROUP are dealt as blocks of their own, larger ones by their prefixes.
SPREAD = 64
#: Loads of classes whose small groups go to one task together, about.
TOGETHER = 1500
SLICE = 512
#: Shingles that more members share than this are compared by matrix products.
COMMON = 12
#: The filter that tells which texts to read again has about BITS_EACH bits a candidate, FILTER_BITS at most (32 MB);
#: of more candidates than fill it, texts are found by a join.
BITS_EACH, FILTER_BITS = 16, 1 << 28

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def met(similarity, depth: int, trees: int):
    """How likely a pair shares a prefix of `depth` hashes in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def least_depth(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The depth at which even a pair at the threshold is met with probability `recall`; 1 at least."""
    return next((k for k in range(depth, 1, -1) if met(threshold, k, trees) >= recall), 1)


def estimated_recall(found: int, missed: float, threshold: float, depth: int, trees: int = TREES) -> float:
    """Of all links, where the found ones stand for `missed` others; one link at the threshold is added as seen."""
    p = met(threshold, depth, trees)
    return (found + 1) / (found + 1 + missed + (1 - p) / p)


@dataclass
class Shingles:
    """Of a batch of texts: shingle hashes, those of text i from starts[i] to starts[i + 1], and a digest of each word sequence."""

    starts: np.ndarray
    hashes: np.ndarray
    digests: list[tuple[int, int]]

    @classmethod
    def of(cls, texts: pa.Array, width: int) -> Shingles:
        words = Words(texts)
        of_word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.vocabulary.cast(pa.large_binary()).to_pylist()), np.uint64, len(words.vocabulary))
        flat = of_word[words.ids]
        sizes = np.where(words.lengths == 0, 0, np.maximum(1, words.lengths - width + 1))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        row = np.repeat(np.arange(len(sizes)), sizes)
        first = np.arange(len(row)) - starts[row] + words.starts[row]
        padded = np.concatenate([flat, np.zeros(width, np.uint64)])
        short = words.lengths[row] < width
        h = np.zeros(len(row), np.uint64)
        for j in range(width):
            part = padded[first + j] * ODD[j % len(ODD)]
            if short.any():  # a text of fewer words is one shingle of all of them
                part[short & (first + j >= words.starts[row + 1])] = 0
            h += part
        digests = []
        for a, b in zip(words.starts[:-1], words.starts[1:], strict=True):
            d = xxhash.xxh3_128_digest(flat[a:b].tobytes())
            digests.append((int.from_bytes(d[:8], signed=True), int.from_bytes(d[8:], signed=True)))
        return cls(starts, mix(h), digests)

    def signatures(self, trees: int, root: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows by trees each: a hash of the first `root` minimal hashes, and the rest up to `depth` as the digits of one number, the first ones highest. Texts without shingles have zeros."""
        some = np.flatnonzero(np.diff(self.starts) > 0)
        roots, paths = (np.zeros((len(self.starts) - 1, trees), np.uint64) for _ in range(2))
        if not len(some):
            return roots, paths
        low = (self.hashes >> np.uint64(32)).astype(np.uint32)
        rng = np.random.Generator(np.random.PCG64(20))
        at, digit = self.starts[some], np.uint64(digit_bits(root, depth))
        for t in range(trees):
            for j in range(depth):
                a, b = (int(x) for x in rng.integers(0, 1 << 32, 2))
                least = np.minimum.reduceat(low * np.uint32(a | 1) + np.uint32(b), at).astype(np.uint64)
                if j < root:
                    roots[some, t] = mix(roots[some, t] * np.uint64(31) + least + np.uint64(1))
                else:
                    paths[some, t] = (paths[some, t] << digit) | (mix(least + np.uint64(j)) >> (np.uint64(64) - digit))
        return roots, paths


def digit_bits(root: int, depth: int) -> int:
    """Bits of each hash of a path; the path of all fits a non-negative long."""
    return min(32, 62 // max(1, depth - root))


def linked(sets: list[np.ndarray], threshold: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs i < j of sets (sorted, distinct) whose Jaccard similarity is at least the threshold, counted exactly, and the similarity."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    begins = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    shared = np.diff(np.concatenate([begins, [len(flat)]]))
    common = np.zeros((n, n), np.int64)
    for d in range(2, COMMON + 1):
        at = begins[shared == d]
        for a in range(d if len(at) else 0):
            for b in range(a + 1, d):
                pairs, times = np.unique(owner[at + a] * n + owner[at + b], return_counts=True)
                common.ravel()[pairs] += times
    at, many = begins[shared > COMMON], shared[shared > COMMON]
    for c in range(0, len(at), 2048):
        width = many[c : c + 2048]
        column = np.repeat(np.arange(len(width)), width)
        inside = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width) + np.repeat(at[c : c + 2048], width)
        m = np.zeros((n, len(width)), np.float32)
        m[owner[inside], column] = 1
        common += np.rint(m @ m.T).astype(np.int64)
    i, j = np.triu_indices(n, 1)
    meets = (threshold.numerator + threshold.denominator) * common[i, j] >= threshold.numerator * (sizes[i] + sizes[j])
    i, j = i[meets], j[meets]
    return i, j, common[i, j] / (sizes[i] + sizes[j] - common[i, j])


def bitmap_of(ids: DataFrame, column: str, bits: int) -> np.ndarray:
    """So many bits, eight to a byte and the lowest first, set at the hash of each id; a row for every 32,768 reaches the driver."""
    place = F.pmod(F.xxhash64(column), F.lit(bits)) + 1  # bits are numbered from 1
    rows = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)[:4096]
    return out


def is_set(packed: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (packed[places >> 3] >> (places & 7).astype(np.uint8)) & 1 > 0


def signatures(rows: DataFrame, width: int, root: int) -> DataFrame:
    """(id, text_hash, d1, d2, load, roots, paths) of rows (id, text, text_hash); no roots for texts without words."""

    def signed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                s = Shingles.of(part.column("text"), width)
                some = np.diff(s.starts) > 0
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(some, TREES, 0))]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.view(np.int64)[some].ravel())) for x in s.signatures(TREES, root, DEPTH)]
                digests = [pa.array([d[k] for d in s.digests], pa.int64()) for k in (0, 1)]
                load = pa.array(np.maximum(1, -(-np.diff(s.starts) // LOAD)), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_hash"), *digests, load, *lists], names=["id", "text_hash", "d1", "d2", "load", "roots", "paths"])

    return rows.mapInArrow(lean(signed), "id long, text_hash long, d1 long, d2 long, load long, roots array<long>, paths array<long>")


def shingle_sets(rows: DataFrame, candidates: DataFrame, width: int) -> DataFrame:
    """(d1, d2, shingles) of the rows (id, text) that bear a candidate's id, and of a few others; shingles are sorted 64-bit hashes."""
    count = candidates.count()
    bits = min(FILTER_BITS, 1 << max(15, (BITS_EACH * count).bit_length()))
    placed = rows.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(bits)).cast("long").alias("place"))
    if BITS_EACH * count > 2 * FILTER_BITS:
        placed, wanted = placed.join(candidates.select("id"), "id", "left_semi"), None
    else:
        wanted = bitmap_of(candidates, "id", bits)
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def listed(batches):
        for batch in batches:
            if shared.value is not None:
                batch = batch.filter(pa.array(is_set(shared.value, batch.column("place").to_numpy())))
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                s = Shingles.of(part.column("text"), width)
                sets = [np.unique(s.hashes[a:b]).tobytes() for a, b in zip(s.starts[:-1], s.starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array([d[k] for d in s.digests], pa.int64()) for k in (0, 1)), pa.array(sets, pa.binary())], names=["d1", "d2", "shingles"])

    return placed.where("id is not null").mapInArrow(lean(listed), "d1 long, d2 long, shingles binary")


LINKS = "home long, links long, root long, pairs long, missed array<double>"


def compare(threshold: Fraction, depth: int, root: int):
    """Links of the pairs that a part newly brings together, as sums for each class."""
    digit = digit_bits(root, DEPTH)

    def shares(part: pd.DataFrame, i: np.ndarray, j: np.ndarray, k: int) -> np.ndarray:
        """Pairs by trees: whether they share a prefix of k hashes."""
        roots, paths = (np.stack(part[c].to_numpy()) for c in ("roots", "paths"))
        return (roots[i] == roots[j]) & ((paths[i] ^ paths[j]) >> (digit * (DEPTH - k)) == 0)

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: [] for c in ("home", "links", "root", "pairs", "missed")}).astype({"home": "int64", "links": "int64", "root": "int64", "pairs": "int64", "missed": "object"})]
        for (tree, _), part in pdf.groupby(["tree", "part"], sort=False):
            home, copies, block, seen = (part[c].to_numpy() for c in ("home", "copies", "block", "seen"))
            i, j, similarity = linked([np.frombuffer(s, np.uint64) for s in part["shingles"]], threshold)
            # Of a pair of blocks only links across them count, so that each counts once.
            mine = (block[i] != block[j]) == part["cross"].iloc[0]
            before = seen[i] == seen[j]
            if tree >= 0 and len(i):
                # A link counts in the tree where its members first share a prefix. In groups dealt by prefixes only pairs that shared one have been compared.
                mine &= shares(part, i, j, depth).argmax(axis=1) == tree
                if depth < DEPTH:
                    before &= ~part["wide"].to_numpy()[i] | shares(part, i, j, depth + 1).any(axis=1)
            mine &= ~before
            i, j, similarity = i[mine], j[mine], similarity[mine]
            if not len(i):
                continue
            n = len(home)
            links = np.bincount(i, weights=copies[j], minlength=n) + np.bincount(j, weights=copies[i], minlength=n)
            missed = np.stack([np.bincount(i, weights=1 / met(similarity, k, TREES) - 1, minlength=n) for k in range(root, DEPTH + 1)], axis=1)
            order = np.argsort(home)
            place = np.empty(n, np.int64)
            place[order] = np.arange(n)
            top = home[order][forest(place[i], place[j], n)[place]]
            some = links > 0
            out.append(pd.DataFrame({"home": home[some], "links": links[some].astype(np.int64), "root": top[some], "pairs": np.bincount(i, minlength=n)[some], "missed": list(missed[some])}))
        return pd.concat(out)

    def lean_compared(pdf: pd.DataFrame) -> pd.DataFrame:
        out = compared(pdf)
        give_back()
        return out

    return lean_compared


def parts_of(groups: DataFrame, members: DataFrame, before: DataFrame | None, together: int) -> DataFrame:
    """(task, tree, part, block, cross, home, seen, wide): which classes of groups (home, component, load) are compared with each other.

    `seen` is the group that a class was in at the depth before, `wide` whether that one was dealt by prefixes.
    Groups that are as they were are left out.
    """
    rows = groups
    if before is None:
        rows = rows.withColumns({"seen": F.col("home"), "wide": F.lit(False)})
    else:
        rows = rows.join(before, "home", "left").withColumns({"seen": F.coalesce("seen", "home"), "wide": F.coalesce("wide", F.lit(False))})
    sizes = rows.groupBy("component").agg(F.sum("load").alias("size"), (F.min("seen") != F.max("seen")).alias("new"))
    huge = F.col("size") > GROUP * SPREAD
    rows = rows.join(sizes.where(huge | F.col("new")), "component")
    no = F.lit(-1)
    alone = rows.where(F.col("size") <= GROUP).select(F.pmod(F.xxhash64("component"), F.lit(together)).alias("task"), no.alias("tree"), F.col("component").alias("part"), F.lit(0).alias("block"), F.lit(False).alias("cross"), "home", "seen", "wide")

    def block_pairs(df: DataFrame, size: str, tree: Column, *of: str) -> DataFrame:
        """Every member once for each block of its group: with it, it is one side of a pair of blocks, or both."""
        blocks = F.ceil(F.col(size) / (GROUP // 2)).cast("int")
        df = df.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("home"), blocks).cast("int")})
        df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        part = F.xxhash64(*of, F.least("block", "other"), F.greatest("block", "other"))
        return df.select(part.alias("task"), tree.cast("int").alias("tree"), part.alias("part"), "block", (F.col("block") != F.col("other")).alias("cross"), "home", "seen", "wide")

    dealt = block_pairs(rows.where((F.col("size") > GROUP) & ~huge), "size", no, "component")
    large = members.join(rows.where((F.col("size") > GROUP) & huge).select("home", "seen", "wide"), "home")
    return alone.union(dealt).union(block_pairs(large, "n", F.col("tree"), "tree", "node"))


def near_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, threshold: Fraction = THRESHOLD) -> DataFrame:
    """One row for each row of df: id, class_id, n_links, component_id, kept, text_hash (xxhash64 of the text).

    A class is the texts of one word sequence (lower case, parted by white space), named
    by its smallest id; n_links counts the other rows linked directly, those of the own
    class included; component_id is the smallest id reachable by links and kept marks the
    row that bears it. Texts of fewer than `width` words are one shingle. Null and empty
    texts, and rows without id, have no links and are classes of their own. Rows that
    repeat an id and its text are rows of one class; rows that repeat an id with another
    text are linked each by its own text, and classes or components of one name are not
    the same for that. An empty table gives an empty result.
    """
    spark, least = df.sparkSession, float(threshold)
    root = least_depth(least)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    signed = materialize(signatures(rows, width, root), "signatures")
    usable: Column = F.col("id").isNotNull() & (F.size("roots") > 0)
    classes = signed.where(usable).groupBy("d1", "d2").agg(F.min("id").alias("name"), F.count("*").alias("copies"), F.first("load").alias("load"), F.first("roots").alias("roots"), F.first("paths").alias("paths"))
    # Ids may repeat with other texts, so classes get numbers of their own.
    classes = materialize(classes.withColumn("home", F.monotonically_increasing_id()), "classes")

    entries = classes.select("home", "load", F.posexplode(F.arrays_zip("roots", "paths")).alias("tree", "at")).select("tree", "at.roots", "at.paths", "home", "load")
    entries = entries.withColumnsRenamed({"roots": "root", "paths": "path"})
    crowded = entries.groupBy("tree", "root").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    tries = entries.join(crowded, ["tree", "root"]).repartitionByRange("tree", "root", "path", "home").sortWithinPartitions("tree", "root", "path", "home")
    tries = materialize(tries, "tries")

    candidates = materialize(tries.select("home").distinct().join(classes, "home").select("home", F.col("name").alias("id"), "d1", "d2", "copies", "load", "roots", "paths"), "candidates")
    sets = shingle_sets(rows, candidates, width)
    sets = candidates.join(sets, ["d1", "d2"]).dropDuplicates(["home"]).select("home", "copies", "roots", "paths", "shingles")
    sets = materialize(sets, "shingles")
    together = max(partitions(spark), (candidates.agg(F.sum("load")).first()[0] or 0) // TOGETHER)

    # The groups of every depth at once: a class has a node for each depth.
    digits, levels = digit_bits(root, DEPTH), range(DEPTH, root - 1, -1)
    prefixes = F.array(*(F.struct(F.lit(k).alias("depth"), F.shiftright("path", digits * (DEPTH - k)).alias("prefix")) for k in levels))
    nodes = tries.select("tree", "root", "home", "load", F.inline(prefixes))
    shared = nodes.groupBy("tree", "root", "depth", "prefix").agg(F.sum("load").alias("n"), F.min("home").alias("least"), F.max("home").alias("most")).where("least < most")
    members = nodes.join(shared, ["tree", "root", "depth", "prefix"]).select("depth", "tree", F.xxhash64("root", "prefix").alias("node"), "n", "least", "home")
    members = materialize(members, "nodes")
    at_depth = lambda c: F.shiftleft(c, 3) + F.col("depth")
    tied = components(members.select(at_depth("home").alias("a"), at_depth("least").alias("b")))
    groups = tied.select(F.col("node").bitwiseAND(7).alias("depth"), F.shiftright("node", 3).alias("home"), F.shiftright("component", 3).alias("component"))
    groups = materialize(groups.join(candidates.select("home", "load"), "home"), "groups")
    discard(tied, tries)

    found, before = [], None
    pairs, missed = 0, [0.0] * len(levels)
    for depth in levels:
        mine = groups.where(F.col("depth") == depth).select("home", "component", "load")
        work = parts_of(mine, members.where(F.col("depth") == depth), before, together).join(sets, "home")
        links = materialize(work.groupBy("task").applyInPandas(compare(threshold, depth, root), LINKS), "links")
        found.append(links)
        sums = links.agg(F.sum("pairs").alias("pairs"), *(F.sum(F.col("missed")[k]).alias(f"m{k}") for k in range(len(missed)))).first()
        pairs, missed = pairs + (sums["pairs"] or 0), [m + (sums[f"m{k}"] or 0.0) for k, m in enumerate(missed)]
        if estimated_recall(pairs, missed[depth - root], least, depth) >= RECALL:
            break
        sizes = mine.groupBy("component").agg((F.sum("load") > GROUP * SPREAD).alias("wide"))
        before = mine.join(sizes, "component").select("home", F.col("component").alias("seen"), "wide")
    discard(groups, members, candidates, sets)

    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    counts = links.groupBy("home").agg(F.sum("links").alias("links"))
    tied = components(links.select(F.col("home").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "home")
    named = tied.join(classes.select("home", "name"), "home")
    named = named.join(named.groupBy("component").agg(F.min("name").alias("first")), "component").select("home", "first")
    summary = classes.select("d1", "d2", "home", "name", "copies").join(counts, "home", "left").join(named, "home", "left")
    summary = summary.select("d1", "d2", "name", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("first", "name").alias("component"))
    out = signed.select("id", "text_hash", "d1", "d2", usable.alias("usable")).join(summary, ["d1", "d2"], "left")
    pick = lambda c, other: F.when(F.col("usable"), F.col(c)).otherwise(other)
    component = pick("component", F.col("id"))
    kept = F.coalesce(component == F.col("id"), F.lit(True))
    return out.select(F.col("id").alias(id_col), pick("name", F.col("id")).alias("class_id"), pick("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"), "text_hash")
