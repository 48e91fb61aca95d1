"""How far the sources of a language differ in their words.

Texts are cut into terms by one `bytes.translate`, which lowers A-Z and blanks all bytes that
are no letter and no part of a character beyond ASCII, and by `bytes.split`; a Counter for
each document gives its counts and the terms it holds. A task adds these up by language and
source before any row leaves it, so a hot source or a common term is a few rows a task.
From there on all is sparse: only counts above 0 are rows, and what a term without
occurrences adds is the same for all of them and is added once.

All arithmetic is exact: scaled integers, with decimals where a product may pass 64 bits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: What each byte of a text becomes: A-Z in lower case, other letters and bytes beyond ASCII as they are, a blank for the rest.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LEAST_DOCUMENTS, TOP = 10, 10
#: Entries and bytes of text after which a task hands on its counts, and bytes of a text that are split at once.
HELD, HELD_BYTES, CHUNK = 300_000, 1 << 28, 1 << 23
#: Sources of one side of a tile, and rows of a tile at least; rows of a table that is broadcast.
SIDE, TILE_ROWS, BROADCAST_ROWS = 256, 4096, 100_000
#: Terms of a tile that are laid out as a dense block at once.
DENSE_TERMS = 2048
SCALE = 1_000_000_000


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, CHUNK bytes or one term more at a time."""
    text, at = text.translate(TABLE), 0
    while at < len(text):
        end = text.find(b" ", at + CHUNK)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, docs), added up within the task; a group's row without a term says that it is there."""
    names = ["lang", "source", "term", "n", "docs"]
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    read = 0

    def handed_on():
        for (lang, source), (n, docs) in held.items():
            words = [None, *n]
            for at in range(0, len(words), 1 << 16):
                part = words[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[w] for w in part], pa.int64()), pa.array([docs[w] for w in part], pa.int64())], names
                )
        held.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            own = Counter()
            raw = text.as_py()
            for words in terms(raw):
                own.update(words)
            n.update(own)
            docs.update(own.keys())
            read += len(raw)
            if read > HELD_BYTES:
                yield from handed_on()
                read = 0
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from handed_on()
            read = 0
    yield from handed_on()


def term_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n occurrences, docs documents that hold it); a null text, language or source is ''. Every group has a row without a term."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    found = rows.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)); null where nothing is kept."""
    over = (total + 2 * kept).cast("decimal(20,0)")
    part = F.call_function("div", (n + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), over)
    return F.when(kept > 0, 1 + part)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)), of shares up to SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def checked(table: DataFrame, rows: int) -> DataFrame:
    """table for a join: broadcast where it has few rows, else dealt by keys, where Spark splits what is hot."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def tile_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each pair of sources in a tile, by how much the gaps of the terms in it exceed those of absent terms."""
    lang, same = pdf["lang"].iloc[0], pdf["a"].iloc[0] == pdf["b"].iloc[0]
    term = pd.factorize(pdf["term"])[0]  # -1: only says that the source is there
    index, source = np.unique(pdf["i"].to_numpy(), return_inverse=True)
    share_of = pdf["p"].to_numpy()
    absent = np.zeros(len(index), np.int64)
    absent[source] = pdf["absent"].to_numpy()
    side = np.zeros(len(index), np.int64)
    side[source] = pdf["mine"].to_numpy()
    more = np.zeros((len(index), len(index)), np.int64)
    for begin in range(0, term.max() + 1, DENSE_TERMS):
        here = np.flatnonzero((term >= begin) & (term < begin + DENSE_TERMS))
        n = min(DENSE_TERMS, term.max() + 1 - begin)
        p = np.tile(absent, (n, 1))
        p[term[here] - begin, source[here]] = share_of[here]
        for k in range(len(index) - 1):
            q, q0 = p[:, k + 1 :], absent[k + 1 :]
            d, d0 = q - p[:, [k]], q0 - absent[k]
            more[k, k + 1 :] += (d * d // (q + p[:, [k]])).sum(axis=0) - n * (d0 * d0 // (q0 + absent[k]))
    i, j = np.triu_indices(len(index), 1)
    if not same:
        apart = side[i] != side[j]
        i, j = i[apart], j[apart]
    return pd.DataFrame({"lang": lang, "i": index[i], "j": index[j], "more": more[i, j]})


def pair_gaps(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, i, j, more) for pairs of sources i < j of a language: the gaps of terms that occur in either, above those of as many absent ones.

    A tile holds the rows of two blocks of SIDE sources for a range of term hashes, so its
    size is bounded whatever the language, and a pair of sources is a row a tile, not a row a
    term. Each tile has a row without a term for every source of its blocks, so that sources
    without a term there are met too.
    """
    sides = F.ceil(F.col("sources") / SIDE)
    tiles = F.greatest(F.lit(1), F.ceil(F.col("rows") / F.greatest(F.lit(TILE_ROWS), F.least("sources", F.lit(SIDE)) * F.least("sources", F.lit(SIDE)))))
    mine = F.floor(F.col("i") / SIDE)
    columns = ["lang", "i", "sources", "absent", "term", "p", "block"]
    present = groups.where("rows > 0").withColumns({"term": F.lit(None).cast("string"), "p": F.col("absent"), "block": F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1))})
    rows = kept.withColumn("block", F.pmod(F.xxhash64("term"), tiles)).select(columns).union(present.select(columns)).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), sides - 1)))
    rows = rows.select("lang", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "block", "mine", "term", "i", "p", "absent")
    sums = rows.groupBy("lang", "a", "b", "block").applyInPandas(tile_sums, "lang string, i long, j long, more long")
    return sums.groupBy("lang", "i", "j").agg(F.sum("more").alias("more"))


def divergence(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others of its language, and by which terms.

    A language keeps the terms in at least `least` of its documents. Part `pair` has the
    distance to each other source, part `term` the `top` terms that the source uses more
    than the language does. Null texts, languages and sources are ''; a document counts
    once for each row it is, repeated or not; a group without terms, or in a language that
    keeps none, still has its pairs (of value 0 where none is kept). A language with one
    source has no rows; an empty table gives an empty result. Ties go by the bytes of the item.
    """
    counts = materialize(term_counts(df, text_col, lang_col, source_col), "term-counts")
    here = Window.partitionBy("lang", "term")
    found = counts.where("term is not null").withColumns({"all_docs": F.sum("docs").over(here), "all_n": F.sum("n").over(here), "first": F.row_number().over(here.orderBy("source")) == 1})
    kept = materialize(found.where(F.col("all_docs") >= least).select("lang", "source", "term", "n", "all_n", "first"), "kept-terms")

    langs = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("lang_total"), F.count("*").alias("rows"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["total", "v", "lang_total", "rows"]).withColumn("absent", share(F.lit(0), F.col("total"), F.col("v")))
    of_lang = Window.partitionBy("lang")
    groups = groups.withColumns({"i": (F.row_number().over(of_lang.orderBy("source")) - 1).cast("long"), "sources": F.count("*").over(of_lang)})
    groups = materialize(groups, "source-groups")
    n = groups.count()

    full = kept.join(checked(groups, n), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
    gaps = pair_gaps(full, groups)
    first = groups.select("lang", "source", "i", "absent", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sources") - 1)).alias("j")).where("i < j")
    second = groups.select("lang", F.col("i").alias("j"), F.col("source").alias("item"), F.col("absent").alias("q"))
    pairs = first.join(checked(second, n), ["lang", "j"]).join(gaps, ["lang", "i", "j"], "left")
    pairs = pairs.select("lang", "source", "item", F.coalesce(F.col("v") * gap(F.col("absent"), F.col("q")) + F.coalesce("more", F.lit(0)), F.lit(0)).alias("value"))
    pairs = pairs.select("lang", F.explode(F.array(F.struct("source", "item", "value"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), "value"))).alias("r")).select("lang", "r.*")

    q = share(F.col("all_n"), F.col("lang_total"), F.col("v"))
    best = full.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda rows, part: rows.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(pairs, "pair").union(ranked(best, "term").where(F.col("rank") <= top))
