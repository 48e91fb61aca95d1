"""Language identification by the nearest of several centroids per language.

A text is a TF-IDF vector over hashed character n-grams: 1 + log count, times the inverse
document frequency over all training rows, scaled to length 1. Spherical k-means on a
bounded sample of each language gives several centroids for it. A text takes the language of
the centroid with the largest cosine, and is rejected when that cosine lies below what
nearly all texts of that language and with as many different n-grams reach: each half of
the language's sample is measured by centroids of the other half, and a line is fitted to
the cosines by the logarithm of the number of n-grams. A text that is hardly letters is
far from every language too, however well its few letters fit one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean
from .features import Words, ngrams, spread

SIZES = (1, 2, 3)
DIMS = 16384
CENTROIDS = 4
#: The k-means runs on about this many labelled rows, dealt by a hash in equal shares to the
#: languages; a share is LEAST_ROWS at least, and a language with fewer rows gives them all.
FIT_ROWS, LEAST_ROWS = 6000, 200
#: A cosine more than Z standard deviations below its language's line is a rejection. PRIOR
#: rows of deviation LOOSE count as seen, so that a language with few rows rejects little.
Z, PRIOR, LOOSE = 8.0, 20, 0.1
#: Least share of letters among the characters that are no white space.
LEAST_LETTERS = 0.15
SLICE, BLOCK = 256, 32
UNKNOWN = "und"


def slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


@dataclass
class Vectors:
    """Sparse rows of DIMS numbers: `value` of `feature` in `row`, by row."""

    n: int
    row: np.ndarray
    feature: np.ndarray
    value: np.ndarray

    def sizes(self) -> np.ndarray:
        """Features of each row."""
        return np.bincount(self.row, minlength=self.n)

    def dot(self, others: np.ndarray) -> np.ndarray:
        """Rows by others: each row meets all of them at once."""
        columns, ends = np.ascontiguousarray(np.asarray(others, float).T), np.searchsorted(self.row, np.arange(self.n + 1))
        out = np.zeros((self.n, len(others)))
        for r, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
            out[r] = self.value[a:b] @ columns[self.feature[a:b]]
        return out

    def total(self, rows: np.ndarray) -> np.ndarray:
        """The sum of the rows that are marked."""
        return np.bincount(self.feature, weights=self.value * rows[self.row], minlength=DIMS)

    def pick(self, rows: np.ndarray) -> Vectors:
        """The rows that are marked."""
        used = rows[self.row]
        return Vectors(int(rows.sum()), (np.cumsum(rows) - 1)[self.row[used]], self.feature[used], self.value[used])


def letters_of(texts: pa.Array) -> pa.Array:
    """A space for all between: digits, signs and decorations say nothing of a language, and would gather texts of several."""
    return pc.replace_substring_regex(pc.fill_null(texts, ""), r"[^\pL\pM]+", " ")


def term_counts(letters: pa.Array) -> Vectors:
    """Of what letters_of gives."""
    words = Words(letters)
    starts, features = ngrams(words.vocabulary, SIZES, DIMS)
    row, word, times = words.distinct()
    found = []
    for at in range(0, len(letters), BLOCK):
        part = slice(*np.searchsorted(row, (at, at + BLOCK)))
        which, index = spread(starts, word[part])
        flat = np.bincount((row[part][which] - at) * DIMS + features[index], weights=times[part][which], minlength=1)
        key = np.flatnonzero(flat)
        found.append((key // DIMS + at, key % DIMS, flat[key]))
    return Vectors(len(letters), *(np.concatenate([np.zeros(0, t), *x]) for t, x in zip((np.int64, np.int64, float), zip(*found, strict=True) if found else [()] * 3, strict=True)))


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def tfidf(counts: Vectors, idf: np.ndarray) -> Vectors:
    value = np.log1p(counts.value) * idf[counts.feature]
    norm = np.sqrt(np.bincount(counts.row, weights=value * value, minlength=counts.n))
    return Vectors(counts.n, counts.row, counts.feature, value / np.maximum(norm, 1e-12)[counts.row])


def has_letters(letters: pa.Array) -> np.ndarray:
    """Marks alone are no letters."""
    return pc.match_substring_regex(letters, r"\pL").to_numpy(zero_copy_only=False)


def hardly_letters(texts: pa.Array, letters: pa.Array) -> np.ndarray:
    texts = pc.fill_null(texts, "")
    length_without = lambda x, blanks: (pc.utf8_length(x).to_numpy(zero_copy_only=False).astype(np.int64) - sum(pc.count_substring(x, b).to_numpy(zero_copy_only=False) for b in blanks))
    return length_without(letters, " ") < LEAST_LETTERS * length_without(texts, " \t\n\f\r")


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # rows of length 1
    owner: np.ndarray  # of each centroid, into languages
    lines: np.ndarray  # of each language: the least cosine is lines[0] + lines[1] * size, where size, the logarithm of the number of features, counts as lines[2] at most

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(languages, best cosines, rejected)."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        plain = letters_of(texts)
        letters = has_letters(plain)
        vectors = tfidf(term_counts(plain), self.idf)
        cosines = vectors.dot(self.centroids)
        best = cosines.argmax(axis=1)
        score = np.where(letters, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0.0)
        base, slope, most = self.lines[self.owner[best]].T
        least = base + slope * np.minimum(log_size(vectors), most)
        return [self.languages[self.owner[b]] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], score, ~letters | (score < least) | hardly_letters(texts, plain)


def log_size(vectors: Vectors) -> np.ndarray:
    return np.log(np.maximum(vectors.sizes(), 1))


def k_means(rows: Vectors, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical; starts from rows that lie far from each other."""
    one = lambda r: rows.total(np.arange(rows.n) == r)
    centres = [one(0)]
    near = rows.dot(centres)[:, 0]
    for _ in range(min(k, rows.n) - 1):
        centres.append(one(int(near.argmin())))
        near = np.maximum(near, rows.dot(centres[-1:])[:, 0])
    centres = np.stack(centres)
    for _ in range(rounds):
        mine = rows.dot(centres).argmax(axis=1)
        centres = unit(np.stack([rows.total(mine == c) if (mine == c).any() else centres[c] for c in range(len(centres))]))
    return centres


def least_line(rows: Vectors) -> tuple[float, float, float]:
    """The line of Model for the rows of one language. A single row tells nothing of others, so nothing is rejected by it."""
    if rows.n < 2:
        return 0.0, 0.0, 0.0
    size, half = log_size(rows), np.arange(rows.n) % 2 == 0
    cosine = np.zeros(rows.n)
    for part in (half, ~half):
        cosine[part] = rows.pick(part).dot(k_means(rows.pick(~part), CENTROIDS)).max(axis=1)
    spread_of = size - size.mean()
    slope = max(0.0, float(spread_of @ cosine / (spread_of @ spread_of + PRIOR * LOOSE)))
    rest = cosine - cosine.mean() - slope * spread_of
    deviation = np.sqrt((rest @ rest + PRIOR * LOOSE**2) / rows.n)
    return float(cosine.mean() - slope * size.mean() - Z * deviation), slope, float(size.max())


def fit(labelled: DataFrame) -> Model:
    """labelled: (id, text, lang), no null languages, all texts with letters. Without rows, nothing is learned and every text is unknown."""

    def frequencies(batches):
        total, rows = np.zeros(DIMS), 0
        for batch in slices(batches):
            total += np.bincount(term_counts(letters_of(batch.column("text"))).feature, minlength=DIMS)
            rows += batch.num_rows
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["rows", "df"])

    parts = labelled.select("text").mapInArrow(lean(frequencies), "rows long, df array<double>")
    summed = parts.select("rows", F.posexplode("df")).groupBy("pos").agg(F.sum("col").alias("df"), F.sum("rows").alias("rows")).toPandas()  # DIMS rows
    if not len(summed):
        return Model([], np.zeros(DIMS), np.zeros((0, DIMS)), np.zeros(0, int), np.zeros((0, 3)))
    df = np.zeros(DIMS)
    df[summed["pos"]] = summed["df"]
    n = int(summed["rows"].iloc[0])
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def vectors(batches):
        for batch in slices(batches):
            rows = tfidf(term_counts(letters_of(batch.column("text"))), idf)
            ends = np.searchsorted(rows.row, np.arange(rows.n + 1))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((rows.feature, pa.int32()), (rows.value, pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("key"), *lists], names=["lang", "key", "feature", "value"])

    def clustered(batches):
        got = pa.Table.from_batches(list(batches), schema=pa.schema([("lang", pa.string()), ("key", pa.int64()), ("feature", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))]))
        got = got.sort_by([("lang", "ascending"), ("key", "ascending")])  # the same centroids in whatever order rows come
        for lang in sorted(set(got.column("lang").to_pylist())):
            part = got.filter(pc.equal(got.column("lang"), lang))
            lists = [part.column(c).combine_chunks() for c in ("feature", "value")]
            feature, value = (x.flatten().to_numpy() for x in lists)
            rows = Vectors(part.num_rows, np.repeat(np.arange(part.num_rows), pc.list_value_length(lists[0]).to_numpy()), feature, value)
            centres, line = k_means(rows, CENTROIDS), least_line(rows)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(centres)), pa.array([c.astype(np.float32).tobytes() for c in centres], pa.binary()), pa.array([list(line)] * len(centres), pa.list_(pa.float64()))], names=["lang", "vector", "line"])

    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a number for each language
    share = max(LEAST_ROWS, FIT_ROWS // len(counts))
    every = labelled.sparkSession.createDataFrame([(lang, max(1, -(-rows // share))) for lang, rows in counts.items()], "lang string, every long")
    # Equal ids (or none) still get different hashes by their texts.
    drawn = labelled.join(F.broadcast(every), "lang").where(F.pmod(F.xxhash64("id", "text"), "every") == 0)
    sample = drawn.select("text", "lang", F.xxhash64("id", "text").alias("key")).mapInArrow(lean(vectors), "lang string, key long, feature array<int>, value array<float>")
    # Vectors in sparse form: about FIT_ROWS may meet in one task, and more languages take more tasks.
    tasks = -(-share * len(counts) // FIT_ROWS)
    found = (sample.repartition(tasks, "lang") if tasks > 1 else sample.repartition(1)).mapInArrow(lean(clustered), "lang string, vector binary, line array<double>").toPandas()
    languages = sorted(set(found["lang"]))
    centroids = np.stack([np.frombuffer(v, dtype=np.float32) for v in found["vector"]])
    owner = np.array([languages.index(x) for x in found["lang"]])
    lines = np.zeros((len(languages), 3))
    lines[owner] = np.stack(found["line"])
    return Model(languages, idf, centroids, owner, lines)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_on(documents: DataFrame) -> Model:
    """The model of all documents that are not held out and have a language and letters."""
    rows = documents.where(~held_out("doc_id") & F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull())
    return fit(rows.select(F.col("doc_id").alias("id"), "text", "lang"))


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, lang_pred, score (the best cosine, 0 to 1) and rejected.

    A null text and one without letters are `und`, score 0, and rejected; a text that
    lies far from every centroid is rejected too, but keeps its nearest language. Repeated
    rows and null ids come back as they are; an empty table gives an empty result; other
    columns are ignored. A model without languages calls every text `und`.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages * CENTROIDS * DIMS numbers

    def predicted(batches):
        for batch in slices(batches):
            names, score, rejected = shared.value.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], names=["id", "lang_pred", "score", "rejected"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(predicted), "id long, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def keep_known(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, that the model does not reject; null texts are. Texts go through once and are not shuffled."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def kept(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array(~shared.value.predict(batch.column(text_col))[2]))

    return df.mapInArrow(lean(kept), df.schema)
