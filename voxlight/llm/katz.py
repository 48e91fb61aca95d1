"""Language-model scores by Katz backoff over word bigrams.

Counts are Good-Turing discounted. A bigram seen in training has its discounted relative
frequency; any other falls back to the unigram, times a weight that makes each context's
probabilities sum to 1 exactly; a word never seen falls back to the unknown word, which
holds what the unigrams' discounts leave.

No table of n-grams is ever held whole. Documents become blocks of bounded size. A block
asks for the counts of its distinct n-grams: sorted 64-bit keys, dealt over key ranges.
The task of a range is one partition of the model's tables: it adds up the training
counts of each key, answers every block in the order it asked, and names one block as the
key's owner. Owners add up, per context, what the exact backoff weight needs, and a second
round of asking returns the weights. Scores of a block's documents are sums over its own
tokens, evaluated from the bigram down.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions

#: A block holds this many bytes of text, or one text.
BLOCK_BYTES = 8_000_000
#: Tokens for each key range and task: however many there are in all, a range is asked for about as many n-grams.
RANGE_TOKENS = 500_000
#: Counts up to here take Turing's estimate where it is sound, larger ones the log-linear fit's.
TURING = 5
#: Counts of counts up to here shape the fit.
FIT = 1000
END, START = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949C7DEFEC15EB5)
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
UNIGRAM, BIGRAM, CONTEXT, BLOCK, SPECTRUM = 1, 2, 3, 0, 9


def squeeze(x: np.ndarray) -> bytes:
    """Any array of numbers, byte planes apart so that equal high bytes compress."""
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def unsqueeze(raw: bytes, kind) -> np.ndarray:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(data.reshape(size, -1).T).view(kind).ravel()


def squeeze_keys(sorted_keys: np.ndarray) -> bytes:
    return squeeze(np.diff(sorted_keys, prepend=np.uint64(0)))


def unsqueeze_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(raw, np.uint64), dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Ascending with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


@dataclass
class Block:
    """Documents as token ids into the block's own vocabulary of word hashes; each ends with the end token."""

    docs: np.ndarray
    no_id: np.ndarray
    train: np.ndarray
    sizes: np.ndarray
    tokens: np.ndarray
    vocabulary: np.ndarray

    @classmethod
    def of(cls, docs: np.ndarray, no_id: np.ndarray, train: np.ndarray, texts: pa.Array) -> Block:
        # Lower-cased before the cast: on slices of large strings ascii_lower misreads offsets.
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string()))
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        rows = np.repeat(np.arange(len(lengths)), lengths)
        if b"" in words:  # white space at either end
            keep = ids != words.index(b"")
            ids, rows = ids[keep], rows[keep]
            lengths = np.bincount(rows, minlength=len(lengths))
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
        ends = np.cumsum(lengths + 1)
        tokens = np.full(int(ends[-1]) if len(ends) else 0, len(words), np.int64)
        tokens[np.arange(len(ids)) + rows] = ids
        # Frequent words get small ids, which compress; words that do not occur go.
        counts = np.bincount(tokens, minlength=len(words) + 1)
        order = np.argsort(-counts, kind="stable")[: int((counts > 0).sum())]
        rank = np.empty(len(counts), np.uint32)
        rank[order] = np.arange(len(order))
        return cls(docs, no_id, train, (lengths + 1).astype(np.int32), rank[tokens], np.append(hashes, END)[order])

    def row(self, block: int) -> dict:
        return {"kind": BLOCK, "part": len(self.tokens), "block": block, "a": squeeze(self.tokens), "b": self.vocabulary.tobytes(), "c": squeeze(self.sizes), "d": self.docs.tobytes() + self.no_id.tobytes() + self.train.tobytes()}

    @classmethod
    def read(cls, row) -> Block:
        sizes = unsqueeze(row.c, np.int32)
        docs, no_id, train = row.d[: 8 * len(sizes)], row.d[8 * len(sizes) : 9 * len(sizes)], row.d[9 * len(sizes) :]
        return cls(np.frombuffer(docs, np.int64), np.frombuffer(no_id, bool), np.frombuffer(train, bool), sizes, unsqueeze(row.a, np.uint32), np.frombuffer(row.b, np.uint64))

    def ngrams(self):
        """Of unigrams and bigrams each: (sorted keys, training counts, for every token the place of its n-gram, and the distinct n-grams' own parts)."""
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        weight = self.train[doc].astype(np.int64)
        n = len(self.vocabulary)
        token = self.tokens.astype(np.int64)
        context = np.concatenate([[n], token[:-1]])
        context[np.cumsum(self.sizes) - self.sizes] = n  # the start
        place = np.argsort(self.vocabulary)
        rank = np.empty(n, np.int64)
        rank[place] = np.arange(n)
        one = (self.vocabulary[place], np.bincount(rank[token], weights=weight, minlength=n).astype(np.int64), rank[token])
        pairs, at = np.unique(context * n + token, return_inverse=True)
        hashes = np.append(self.vocabulary, START)
        keys = mixed(hashes[pairs // n] * A + mixed(hashes[pairs % n] * B))
        order = np.argsort(keys)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        at = back[at]
        two = (keys[order], np.bincount(at, weights=weight, minlength=len(keys)).astype(np.int64), at)
        return doc, place, one, two, pairs[order] // n, pairs[order] % n


SCHEMA = "kind int, part int, block long, a binary, b binary, c binary, d binary"
COLUMNS = ["kind", "part", "block", "a", "b", "c", "d"]


def frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS).astype({"kind": "int32", "part": "int32", "block": "int64"})


def dealt(kind: int, block: int, keys: np.ndarray, parts: int, **columns) -> list[dict]:
    """A row for each range of sorted keys that has some."""
    part = part_of(keys, parts)
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(keys) else []
    ends = [*at[1:], len(keys)]
    rows = []
    for a, b in zip(at, ends, strict=False):
        rows.append({"kind": kind, "part": int(part[a]), "block": block, "a": squeeze_keys(keys[a:b]), **{c: squeeze(v[a:b]) for c, v in columns.items()}})
    return rows


def blocks_of(rows: DataFrame) -> DataFrame:
    """rows: (id, train, text)."""

    def made(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = [0, *(np.flatnonzero(np.diff(size // BLOCK_BYTES)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                no_id = pc.is_null(part.column("id")).to_numpy(zero_copy_only=False)
                block = Block.of(pc.fill_null(part.column("id"), 0).to_numpy().astype(np.int64), no_id, part.column("train").to_numpy(zero_copy_only=False).astype(bool), part.column("text"))
                row = block.row(number)
                number += 1
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in "abcd")]))

    return rows.mapInArrow(made, SCHEMA)


def counted(pdf: pd.DataFrame) -> pd.DataFrame:
    """One key range: the training count of every key asked for, in the order asked, and whether the block that asks owns the key."""
    kind, part = int(pdf["kind"].iloc[0]), int(pdf["part"].iloc[0])
    lists = [unsqueeze_keys(a) for a in pdf["a"]]
    keys, counts = np.concatenate(lists), np.concatenate([unsqueeze(b, np.int64) for b in pdf["b"]])
    order = np.argsort(keys, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    totals = np.add.reduceat(counts[order], begins)
    every, owner = np.empty(len(keys), np.int64), np.zeros(len(keys), bool)
    every[order] = np.repeat(totals, np.diff(np.append(begins, len(keys))))
    owner[order[begins]] = totals > 0
    rows, at = [], 0
    for block, own in zip(pdf["block"], lists, strict=True):
        rows.append({"kind": kind, "part": part, "block": block, "a": squeeze(every[at : at + len(own)]), "b": squeeze(owner[at : at + len(own)])})
        at += len(own)
    spectrum = np.unique(totals[totals > 0], return_counts=True)
    rows.append({"kind": SPECTRUM, "part": kind, "block": part, "a": spectrum[0].astype(np.int64).tobytes(), "b": spectrum[1].astype(np.int64).tobytes()})
    return frame(rows)


@dataclass
class Discount:
    """Good-Turing: what a count is worth."""

    turing: np.ndarray  # of counts 1..TURING, 0 where not sound
    slope: float

    @classmethod
    def fit(cls, counts: np.ndarray, times: np.ndarray) -> Discount:
        """From counts of counts, ascending. The fit is of log Z over log r, Z the counts of counts averaged over gaps."""
        n = dict(zip(counts.tolist(), times.tolist(), strict=True))
        near = counts[counts <= FIT].astype(float)
        slope = -2.0
        if len(near) > 2:
            before, after = np.concatenate([[0], near[:-1]]), np.concatenate([near[1:], [2 * near[-1] - near[-2]]])
            z = times[: len(near)] / (0.5 * (after - before))
            slope = min(-1.1, float(np.polyfit(np.log(near), np.log(z), 1)[0]))
        turing = np.zeros(TURING + 1)
        for r in range(1, TURING + 1):
            worth = (r + 1) * n.get(r + 1, 0) / n[r] if n.get(r) else 0.0
            # Sound while worth lies between the smaller count's and its own.
            turing[r] = worth if turing[r - 1] < worth < r and (r == 1 or turing[r - 1]) else 0.0
        return cls(turing, slope)

    def worth(self, counts: np.ndarray) -> np.ndarray:
        r = np.maximum(counts, 1).astype(float)
        smooth = r * (1 + 1 / r) ** (self.slope + 1)
        low = np.minimum(counts, TURING)
        exact = np.where(counts <= TURING, self.turing[low], 0.0)
        return np.where(counts > 0, np.where(exact > 0, exact, smooth), 0.0)


@dataclass
class Spectrum:
    tokens: int
    words: int
    one: Discount
    two: Discount
    unknown: float

    @classmethod
    def of(cls, spectra: dict[int, tuple[np.ndarray, np.ndarray]]) -> Spectrum:
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        r, n = spectra.get(UNIGRAM, none)
        one = Discount.fit(r, n)
        tokens = int((r * n).sum())
        return cls(tokens, int(n.sum()), one, Discount.fit(*spectra.get(BIGRAM, none)), 1 - float((one.worth(r) * n).sum()) / tokens if tokens else 1.0)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """Sums to 1 over all words and the unknown one."""
        return np.where(counts > 0, self.one.worth(counts) / max(1, self.tokens), self.unknown)


def resolve(shared, parts: int):
    """A block and the answers to it: scores but for the weights of contexts, and what it adds to them."""

    def resolved(pdf: pd.DataFrame) -> pd.DataFrame:
        s: Spectrum = shared.value
        block = Block.read(next(pdf[pdf["kind"] == BLOCK].itertuples()))
        number = int(pdf["block"].iloc[0])
        answers = pdf[pdf["kind"] != BLOCK].sort_values(["kind", "part"])
        get = lambda kind, c, t: np.concatenate([np.zeros(0, t), *(unsqueeze(x, t) for x in answers.loc[answers["kind"] == kind, c])])
        doc, place, (_, _, one_at), (_, _, two_at), head, word = block.ngrams()
        n = len(block.vocabulary)
        known = get(UNIGRAM, "a", np.int64)
        count = np.zeros(n + 1, np.int64)
        count[place] = known
        count[n] = count[:n][block.vocabulary == END].sum()  # the start is a context once a document
        together, owner = get(BIGRAM, "a", np.int64), get(BIGRAM, "b", bool)

        docs = len(block.sizes)
        add = lambda values: np.bincount(doc, weights=values, minlength=docs)
        c = known[one_at]
        base = add(np.log10((c + 1) / (s.tokens + s.words + 1)))
        uni = s.unigram(count[:n])
        share = s.two.worth(together) / np.maximum(1, count[head])
        seen = together > 0
        log_p = np.log10(np.where(seen, share, uni[word]))
        part = add(log_p[two_at])

        # What the weights of contexts need, from this block's own bigrams.
        mine = owner & seen
        s1 = np.bincount(head[mine], weights=share[mine], minlength=n + 1)
        s2 = np.bincount(head[mine], weights=uni[word[mine]], minlength=n + 1)
        back = ~seen[two_at]
        pairs, times = np.unique(doc[back] * (n + 1) + head[two_at[back]], return_counts=True)
        asked = np.zeros(n + 1, bool)
        asked[pairs % (n + 1)] = True
        asked |= s1 > 0
        ctx = np.flatnonzero(asked)
        hashes = np.append(block.vocabulary, START)[ctx]
        order = np.argsort(hashes)
        spot = np.empty(n + 1, np.int64)
        spot[ctx[order]] = np.arange(len(order))
        keys = hashes[order]
        rows = dealt(CONTEXT, number, keys, parts, b=s1[ctx][order], c=s2[ctx][order])
        per_doc = np.stack([block.docs, block.no_id.astype(np.int64), (~block.train).astype(np.int64), block.sizes.astype(np.int64), add(c > 0).astype(np.int64)]).tobytes()
        rows.append({"kind": BLOCK, "part": docs, "block": number, "a": per_doc, "b": np.stack([base, part]).tobytes(), "c": squeeze((pairs // (n + 1)).astype(np.int32)) if len(pairs) else b"", "d": squeeze(spot[pairs % (n + 1)].astype(np.int32)) if len(pairs) else b""})
        rows.append({"kind": SPECTRUM, "part": 0, "block": number, "a": squeeze(times.astype(np.int32)) if len(pairs) else b""})
        return frame(rows)

    return resolved


def weighed(pdf: pd.DataFrame) -> pd.DataFrame:
    """One key range of contexts: log10 of each one's backoff weight, in the order asked."""
    part = int(pdf["part"].iloc[0])
    lists = [unsqueeze_keys(a) for a in pdf["a"]]
    keys = np.concatenate(lists)
    _, at = np.unique(keys, return_inverse=True)
    s1, s2 = (np.bincount(at, weights=np.concatenate([unsqueeze(x, np.float64) for x in pdf[c]])) for c in "bc")
    log_weight = np.log10((1 - s1) / (1 - s2))[at]
    rows, begin = [], 0
    for block, own in zip(pdf["block"], lists, strict=True):
        rows.append({"kind": CONTEXT, "part": part, "block": block, "a": squeeze(log_weight[begin : begin + len(own)])})
        begin += len(own)
    return frame(rows)


def finish(shared):
    def finished(pdf: pd.DataFrame) -> pd.DataFrame:
        s: Spectrum = shared.value
        own = next(pdf[pdf["kind"] == BLOCK].itertuples())
        times = next(pdf[pdf["kind"] == SPECTRUM].itertuples())
        docs, no_id, held, tokens, known = np.frombuffer(own.a, np.int64).reshape(5, -1)
        base, score = np.frombuffer(own.b, np.float64).reshape(2, -1)
        answers = pdf[pdf["kind"] == CONTEXT].sort_values("part")
        if own.d:
            weight = np.concatenate([unsqueeze(x, np.float64) for x in answers["a"]])
            score = score + np.bincount(unsqueeze(own.c, np.int32), weights=weight[unsqueeze(own.d, np.int32)] * unsqueeze(times.a, np.int32), minlength=len(docs))
        return pd.DataFrame({"id": pd.arrays.IntegerArray(docs.copy(), no_id > 0), "held_out": held > 0, "n_tokens": tokens, "n_known": known, "train_tokens": s.tokens, "base_score": base, "score": score})

    return finished


def scores(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows for which `train` holds and scores all. Words are parted by
    [\\x20\\x09-\\x0D] and lower-cased in A-Z; each text has an end token. base_score adds one
    to every count; score is log10 of the model's probability of the text. A null text is
    empty: its end token alone. A null id stays null; repeated rows count and are
    scored each. An empty table gives an empty result. Without training rows every word is
    the unknown one.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    blocks = materialize(blocks_of(rows), "blocks")
    tokens = blocks.agg(F.sum(F.col("part").cast("long"))).first()[0] or 0
    parts = max(partitions(spark), -(-tokens // RANGE_TOKENS))

    def asked(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                _, _, one, two, _, _ = Block.read(row).ngrams()
                for kind, (keys, counts, _) in ((UNIGRAM, one), (BIGRAM, two)):
                    yield frame(dealt(kind, row.block, keys, parts, b=counts))

    answers = materialize(blocks.mapInPandas(asked, SCHEMA).repartition(parts, "kind", "part").groupBy("kind", "part").applyInPandas(counted, SCHEMA), "counts")

    def spread(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                yield pd.DataFrame({"kind": row.part, "r": np.frombuffer(row.a, np.int64), "n": np.frombuffer(row.b, np.int64)})

    spectra = answers.where(F.col("kind") == SPECTRUM).mapInPandas(spread, "kind int, r long, n long").groupBy("kind", "r").agg(F.sum("n").alias("n"))
    found = spectra.toPandas().sort_values(["kind", "r"])  # distinct counts: at most about the square root of twice the tokens
    shared = spark.sparkContext.broadcast(Spectrum.of({k: (p["r"].to_numpy(np.int64), p["n"].to_numpy(np.int64)) for k, p in found.groupby("kind")}))

    both = blocks.union(answers.where(F.col("kind") != SPECTRUM))
    partial = materialize(both.repartition(parts, "block").groupBy("block").applyInPandas(resolve(shared, parts), SCHEMA), "partial-scores")
    weights = partial.where(F.col("kind") == CONTEXT).repartition(parts, "part").groupBy("part").applyInPandas(weighed, SCHEMA)
    whole = partial.where(F.col("kind") != CONTEXT).union(weights).repartition(parts, "block").groupBy("block")
    out = whole.applyInPandas(finish(shared), "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))
