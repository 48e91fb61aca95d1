import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from odd_rows import ODD

from voxlight.llm import bestfit
from voxlight.llm.queries import QUERIES, tokenizer

BPE = "byte_bpe_50k.json"


def check(rows, documents, width=2048):
    """Pieces are those of the contract, and sequences are gapless and no longer than width. Returns their number and their fill."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer(BPE))
    want = Counter()
    for i, text in documents:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % width or width
        edges = [0, *range(first, len(ids) + 1, width)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            want[(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= width
    return len(held), sum(r["length"] for r in rows)


def histograms():
    rng = np.random.default_rng(5)
    shapes = {"exponential": np.clip(rng.exponential(400, 4000).astype(int) + 1, 1, 2048), "thirds": rng.integers(600, 760, 3000), "halves": rng.integers(400, 1500, 3000), "pairs": np.concatenate([rng.integers(500, 530, 1000), rng.integers(1000, 1030, 500)])}
    return {k: dict(Counter(v.tolist())) for k, v in shapes.items()}


def pieces_of(bins):
    out = Counter()
    for pattern, n in bins:
        assert bestfit.fill_of(pattern) <= bestfit.WIDTH and n > 0
        for length, k in pattern:
            out[length] += k * n
    return out


@pytest.mark.parametrize("shape", sorted(histograms()))
def test_search_loses_nothing_and_saves_sequences(shape):
    h = histograms()[shape]
    first, found, least = bestfit.best_fit(h), bestfit.patterns(h), bestfit.lower_bound(h)
    assert pieces_of(first.items()) == pieces_of(found) == Counter(h)
    n, before = sum(n for _, n in found), sum(first.values())
    assert least <= n <= before and n <= 1.03 * least
    assert n < before or n == least


def test_every_exchange_grows_the_squared_fills():
    search = bestfit.Search(bestfit.best_fit(histograms()["thirds"]))
    squares = lambda: sum(n * bestfit.fill_of(p) ** 2 for p, n in search.bins.items())
    before, made = squares(), 0
    while made < 200 and any(search.exchange(p) for _, p in search.by_fill[:50]):
        assert squares() > before
        before, made = squares(), made + 1
    assert made


def test_bound_and_packing_against_all_packings():
    """On small cases: no packing beats the bound, and the search is at most one off the best."""

    def best(items, width):
        out = len(items)
        for choice in product(range(len(items)), repeat=len(items)):
            fills = Counter()
            for b, x in zip(choice, items, strict=True):
                fills[b] += x
            if max(fills.values()) <= width:
                out = min(out, len(fills))
        return out

    rng = np.random.default_rng(2)
    for _ in range(20):
        items = rng.integers(1, 11, 6).tolist()
        h, right = dict(Counter(items)), best(items, 10)
        n = sum(n for _, n in bestfit.patterns(h, 10))
        assert bestfit.lower_bound(h, 10) <= right <= n <= right + 1


def test_odd_rows(spark, frame):
    n, tokens = check(bestfit.pack_documents(frame(ODD), tokenizer(BPE)).collect(), ODD)
    assert n <= tokens // 2048 + 2
    assert bestfit.pack_documents(frame([]), tokenizer(BPE)).count() == 0


def test_hot_length(frame):
    """Most documents have one length, some are equal rows."""
    rows = [(i % 50, "w " * 399) for i in range(300)] + [(i, "b") for i in range(1000, 1200)]
    check(bestfit.pack_documents(frame(rows), tokenizer(BPE)).collect(), rows)


@pytest.mark.parametrize("n", [2047, 2048, 2049, 4095, 4096])
def test_borders(frame, n):
    rows = [(1, " a" * (n - 1))]
    assert check(bestfit.pack_documents(frame(rows), tokenizer(BPE)).collect(), rows) == (-(-n // 2048), n)


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    n, tokens = check(QUERIES["op13_best_fit"](spark, d).collect(), docs)
    assert n <= 1.02 * -(-tokens // 2048)
