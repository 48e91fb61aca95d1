from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxlight.llm import jaccard

from odd_rows import ODD


def brute(rows):
    sets = []
    for _, t in rows:
        w = tuple((t or "").lower().split())
        sets.append((w, frozenset(w[k : k + 5] for k in range(max(1, len(w) - 4))) if w else frozenset()))
    links, parent = defaultdict(int), {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            (wa, sa), (wb, sb) = sets[a], sets[b]
            if sa and sb and (wa == wb or 9 * len(sa & sb) >= 4 * (len(sa) + len(sb))):
                i, j = rows[a][0], rows[b][0]
                links[i] += 1
                links[j] += 1
                i, j = find(i), find(j)
                parent[max(i, j)] = min(i, j)
    return {i: (links[i], find(i)) for i, _ in rows}


def near_rows():
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for _ in range(12):
        base = [f"w{k}" for k in rng.integers(0, 400, 90)]
        for _ in range(6):
            t = list(base)
            for _ in range(int(rng.integers(0, 4))):
                t[int(rng.integers(0, 90))] = f"n{rng.integers(0, 999)}"
            rows.append((n, " ".join(t)))
            n += 1
    return rows


def result(df):
    return {r["doc_id"]: (r["n_links"], r["component_id"]) for r in jaccard.near_texts(df).collect()}


def test_against_brute_force(frame):
    rows = near_rows() + [(500, "short text"), (501, "Short  TEXT"), (502, "")]
    assert result(frame(rows)) == brute(rows)


@pytest.mark.parametrize("spread", [0, 64])
def test_large_groups_are_dealt_in_blocks(frame, monkeypatch, spread):
    monkeypatch.setattr(jaccard, "GROUP", 4)
    monkeypatch.setattr(jaccard, "SPREAD", spread)
    rows = near_rows()
    assert result(frame(rows)) == brute(rows)


@pytest.mark.parametrize("spread", [0, 2, 64])
def test_groups_of_long_texts_are_dealt_by_shingles(frame, monkeypatch, spread):
    """Texts of 86 shingles load a group as 9 short ones would; blocks get smaller, links stay."""
    monkeypatch.setattr(jaccard, "LOAD", 10)
    monkeypatch.setattr(jaccard, "GROUP", 24)
    monkeypatch.setattr(jaccard, "SPREAD", spread)
    rows = [*near_rows(), (500, "short text"), (501, "Short  TEXT")]
    assert result(frame(rows)) == brute(rows)


def test_filter_has_the_bits_of_the_ids(spark):
    wanted, bits = spark.range(0, 3000, 7), 1 << 16
    packed = jaccard.bitmap_of(wanted, "id", bits)
    places = [r["p"] for r in wanted.select(F.pmod(F.xxhash64("id"), F.lit(bits)).alias("p")).collect()]
    assert len(packed) == bits // 8
    assert np.flatnonzero(jaccard.is_set(packed, np.arange(bits))).tolist() == sorted(set(places))


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert result(df) == brute(rows)


def test_odd_rows(frame):
    got = jaccard.near_texts(frame(ODD)).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[4]["component_id"] == by[5]["component_id"] == 4 and by[8]["component_id"] == 6 and by[6]["n_links"] == 3
    assert all(by[i]["n_links"] == 0 and by[i]["kept"] for i in (1, 2, 3, 9, 10, 11))
    assert all(r["class_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    assert jaccard.near_texts(frame([])).count() == 0


def test_depth_follows_the_links_found():
    """Few links: the threshold decides. Links far above it end the shortening early, links near it do not."""
    root = jaccard.least_depth(0.8)
    assert jaccard.met(0.8, root, jaccard.TREES) >= jaccard.RECALL > jaccard.met(0.8, root + 1, jaccard.TREES)
    missed = lambda s, n, k: n * (1 / jaccard.met(s, k, jaccard.TREES) - 1)
    first = lambda s, n: next(k for k in range(jaccard.DEPTH, 0, -1) if jaccard.estimated_recall(n, missed(s, n, k), 0.8, k) >= jaccard.RECALL)
    assert first(0.95, 0) == first(0.8, 100_000) == root and first(0.95, 100_000) == jaccard.DEPTH and root < first(0.83, 100_000) < jaccard.DEPTH


def test_sorted_tries_share_prefixes_as_often_as_similar():
    """A digit more is shared with the probability of the similarity."""
    a = [f"w{k}" for k in range(400)]
    texts = [" ".join(a), " ".join(a[40:] + [f"x{k}" for k in range(40)])]
    s = jaccard.Shingles.of(pa.array(texts), 5)
    roots, paths = s.signatures(3000, 1, 3)
    digit = jaccard.digit_bits(1, 3)
    one = roots[0] == roots[1]
    two = one & (paths[0] >> np.uint64(digit) == paths[1] >> np.uint64(digit))
    three = one & (paths[0] == paths[1])
    want = 356 / (396 * 2 - 356)
    assert [x.mean() for x in (one, two, three)] == pytest.approx([want, want**2, want**3], abs=0.03) and int(paths.max()) < 1 << 63


@pytest.mark.parametrize("recall,trees", [(0.5, 24), (0.9999, 3)])
def test_rounds_count_each_link_once(frame, monkeypatch, recall, trees):
    """Whatever the depths that are gone through and however groups are dealt, no link counts twice; a forest of recall 0.9999 loses none here."""
    monkeypatch.setattr(jaccard, "RECALL", recall)
    monkeypatch.setattr(jaccard, "TREES", trees)
    rows = near_rows()
    want = brute(rows)
    for group, spread in ((4, 64), (4, 0)):
        monkeypatch.setattr(jaccard, "GROUP", group)
        monkeypatch.setattr(jaccard, "SPREAD", spread)
        got = result(frame(rows))
        assert all(got[i][0] <= want[i][0] and got[i][1] >= want[i][1] for i in want)
        assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values())


def test_repeated_ids_with_other_texts(frame):
    """Each text is linked by itself; groups that share no text stay apart."""
    one, two = "a b c d e f g h i j", "q r s t u v w x y z"
    got = jaccard.near_texts(frame([(1, one), (1, two), (5, one), (6, two), (7, two)])).collect()
    assert sorted((r["doc_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(1, 1, 1, True), (1, 2, 1, True), (5, 1, 1, False), (6, 2, 1, False), (7, 2, 1, False)]


def test_more_candidates_than_the_filter_holds(frame, monkeypatch):
    monkeypatch.setattr(jaccard, "FILTER_BITS", 1 << 5)
    rows = near_rows()
    assert result(frame(rows)) == brute(rows)


@pytest.mark.parametrize("common", [2, 12])
def test_linked_counts_exactly(common, monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON", common)
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(40)]
    i, j, similarity = jaccard.linked(sets, Fraction(1, 2))
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if 3 * len(np.intersect1d(sets[a], sets[b])) >= len(sets[a]) + len(sets[b])}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
    assert all(s == len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) for a, b, s in zip(i, j, similarity, strict=True))
