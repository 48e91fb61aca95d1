"""Hashed character n-grams of words, whole Arrow batches at a time.

N-grams are taken inside white-space separated words, with a mark before and after
each word, over lower-cased UTF-8 bytes. A batch's distinct words are looked at once,
so the work on n-grams follows the vocabulary of a batch and not its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multipliers that mix the bytes of an n-gram, and the final mix.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)
FINAL = np.uint64(0xFF51AFD7ED558CCD)


class Words:
    """The words of a batch of texts: `starts` of each text in `ids`, which point into `vocabulary`."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.utf8_split_whitespace(pc.utf8_lower(texts) if lower else texts)
        coded = lists.flatten().dictionary_encode()
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        vocabulary = coded.dictionary
        # A text that is empty or begins or ends with white space has empty words.
        empty = np.flatnonzero(pc.equal(pc.binary_length(vocabulary), 0).to_numpy(zero_copy_only=False))
        if len(empty):
            keep = ids != empty[0]
            rows = np.repeat(np.arange(len(lengths)), lengths)[keep]
            ids, lengths = ids[keep], np.bincount(rows, minlength=len(lengths))
        self.vocabulary, self.ids, self.lengths = vocabulary, ids, lengths
        self.starts = np.concatenate([[0], np.cumsum(lengths)])

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, word, times) of each row's distinct words, by row and word."""
        pairs, times = np.unique(self.rows * max(1, len(self.vocabulary)) + self.ids, return_counts=True)
        return pairs // max(1, len(self.vocabulary)), pairs % max(1, len(self.vocabulary)), times


def ngrams(vocabulary: pa.Array, sizes: tuple[int, ...], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, features): the features of word w are features[starts[w]:starts[w + 1]], each in 0..dims-1."""
    n = len(vocabulary)
    offsets = np.frombuffer(vocabulary.buffers()[1], dtype=np.int64)[vocabulary.offset : vocabulary.offset + n + 1]
    raw = np.frombuffer(vocabulary.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    # Each word with a mark on either side.
    marked = np.ones(len(raw) + 2 * n, dtype=np.uint64)
    marked[np.arange(len(raw)) + np.repeat(2 * np.arange(n) + 1, lengths)] = raw
    ends = np.cumsum(lengths + 2)
    left = np.repeat(ends, lengths + 2) - np.arange(len(marked))  # bytes up to the word's end
    word = np.repeat(np.arange(n), lengths + 2)
    found, owners = [], []
    with np.errstate(over="ignore"):
        for size in sizes:
            if len(marked) < size:
                continue
            h = np.full(len(marked) - size + 1, size, dtype=np.uint64)
            for k in range(size):
                h = (h ^ marked[k : len(marked) - size + 1 + k]) * MULTIPLIERS[k % len(MULTIPLIERS)]
            inside = left[: len(h)] >= size
            h = h[inside]
            h ^= h >> np.uint64(32)
            found.append(((h * FINAL) >> np.uint64(33)) % np.uint64(dims))
            owners.append(word[: len(inside)][inside])
    owner = np.concatenate([np.zeros(0, np.int64), *owners])
    order = np.argsort(owner, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    return starts, np.concatenate([np.zeros(0, np.uint64), *found]).astype(np.int64)[order]


def spread(starts: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ragged lists picked in order: (which pick, index into the values) of every value."""
    sizes = starts[picks + 1] - starts[picks]
    which = np.repeat(np.arange(len(picks)), sizes)
    before = np.cumsum(sizes) - sizes
    return which, np.arange(int(sizes.sum())) - before[which] + starts[picks][which]
