"""Texts cut at single spaces into units, each distinct unit of a batch encoded once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .features import spread

#: Units whose ids a worker remembers between batches; it starts afresh when they are full.
REMEMBERED = 600_000


class Encoder:
    """Encodes batches of texts by way of their units.

    `encode` gives the ids of a unit, which begins with `lead`; texts that the regular
    expression `unsafe` finds cannot be cut and are encoded by `whole`.
    """

    def __init__(self, encode: Callable[[str], list[int]], whole: Callable[[str], list[int]], lead: str, unsafe: str):
        self.encode, self.whole, self.lead, self.unsafe = encode, whole, lead, unsafe
        self.memory: dict[str, bytes] = {}

    def ids_of(self, units: list[str]) -> list[bytes]:
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        memory = self.memory
        for u in units:
            if u not in memory:
                memory[u] = np.array(self.encode(self.lead + u), dtype=np.uint32).tobytes()
        return [memory[u] for u in units]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ids): the ids of text i are ids[starts[i]:starts[i + 1]]; a null text has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.flatnonzero(pc.match_substring_regex(texts, self.unsafe).to_numpy(zero_copy_only=False))
        lists = pc.split_pattern(texts, " ")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        encoded = self.ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(encoded), dtype=np.uint32)
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4)])
        counts = starts[ids + 1] - starts[ids]
        row = np.repeat(np.arange(len(texts)), sizes)
        lengths = np.bincount(row, weights=counts, minlength=len(texts)).astype(np.int64)
        _, at = spread(starts, ids)
        out = flat[at]
        odd = np.union1d(odd, np.flatnonzero(pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        if len(odd):
            again = {i: self.whole(texts[i].as_py()) for i in odd.tolist()}
            parts = [np.array(again[i], dtype=np.uint32) if i in again else out[ends[i] : ends[i + 1]] for i in range(len(texts))]
            ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            out = np.concatenate([np.zeros(0, np.uint32), *parts])
        return ends, out
