import functools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlight.llm import katz

DDL = "doc_id long, text string, lang string"


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), 0]


def good_turing(counter):
    """What a count is worth: (r + 1) n(r + 1) / n(r) for counts up to 5 while that grows and stays below r, else by a line through log n(r), averaged over gaps, on log r."""
    times = Counter(counter.values())
    rs = sorted(r for r in times if r <= 1000)
    slope = -2.0
    if len(rs) > 2:
        ends = [0, *rs, 2 * rs[-1] - rs[-2]]
        xs, ys = [math.log(r) for r in rs], [math.log(2 * times[r] / (ends[k + 2] - ends[k])) for k, r in enumerate(rs)]
        mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
        slope = min(-1.1, sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / sum((x - mx) ** 2 for x in xs))
    exact, last = {}, 0.0
    for r in range(1, 6):
        w = (r + 1) * times[r + 1] / times[r] if times[r] else 0.0
        if not last < w < r:
            break
        exact[r] = last = w
    return functools.cache(lambda r: exact.get(r) or r * (1 + 1 / r) ** (slope + 1))


def brute(rows, train):
    """Katz by dictionaries; rows: (id, text); train: ids."""
    one, two = Counter(), Counter()
    for i, t in rows:
        if i in train:
            w = words_of(t)
            one.update(w)
            two.update(zip([1, *w], w))
    heads = Counter(one)
    heads[1] = one[0]

    n, v = sum(one.values()), len(one)
    worth_one, worth = good_turing(one), good_turing(two)
    unknown = 1 - sum(worth_one(c) for c in one.values()) / n if n else 1.0
    uni = lambda w: worth_one(one[w]) / n if one[w] else unknown
    share = lambda h, w: worth(two[h, w]) / heads[h]
    after = defaultdict(list)
    for h, w in two:
        after[h].append(w)
    weight = functools.cache(lambda h: (1 - sum(share(h, w) for w in after[h])) / (1 - sum(uni(w) for w in after[h])))
    prob = lambda h, w: share(h, w) if two[h, w] else uni(w) * weight(h)
    out = {}
    for i, t in rows:
        w = words_of(t)
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        out[i] = (i not in train, len(w), sum(one[x] > 0 for x in w), n, base, sum(math.log10(prob(h, x)) for h, x in zip([1, *w], w)))
    total = {h: sum(prob(h, w) for w in one) + unknown * weight(h) for h in list(heads)[:20]}
    return out, total


def check(spark, rows):
    df = spark.createDataFrame([(i, t, None) for i, t in rows], DDL)
    train = {i for i, _ in rows if i % 3}
    want, totals = brute(rows, train)
    got = {r["doc_id"]: tuple(r[c] for c in ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")) for r in katz.scores(df, F.col("doc_id") % 3 != 0).collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:4] == want[i][:4]
        assert got[i][4:] == pytest.approx(want[i][4:], rel=1e-9)
    assert all(abs(t - 1) < 1e-9 for t in totals.values())


def test_against_dictionaries(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"W{k}" if k % 2 else f"w{k}" for k in range(60)]
    rows = [(i, " ".join(vocabulary[int(k)] for k in rng.zipf(1.3, rng.integers(0, 80)) % 60)) for i in range(120)]
    check(spark, [*rows, (1000, None), (1001, ""), (1002, " \t a\x0bB \n"), (1003, "unheard of"), (1006, "É é e e")])


def test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def test_blocks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_BYTES", 50)
    check(spark, [(i, f"a b {i % 7} c " * (i % 5)) for i in range(40)])


def test_null_ids_stay_null(spark, monkeypatch):
    monkeypatch.setattr(katz, "RANGE_TOKENS", 3)
    df = spark.createDataFrame([(None, "a b", None), (0, "c", None), (None, None, None)], DDL)
    got = katz.scores(df, F.lit(True)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(False, 0, 2), (True, 0, 1), (True, 0, 3)]


def test_empty_and_untrained(spark):
    none = spark.createDataFrame([], DDL)
    assert katz.scores(none, F.lit(True)).count() == 0
    one = spark.createDataFrame([(3, "a b", None)], DDL)
    row = katz.scores(one, F.lit(False)).first()
    assert row["held_out"] and row["n_known"] == 0 and row["train_tokens"] == 0 and row["score"] <= 0


def test_discounts_shrink_every_count():
    d = katz.Discount.fit(np.arange(1, 40), (1000 / np.arange(1, 40) ** 2).astype(np.int64) + 1)
    counts = np.arange(1, 100)
    assert (d.worth(counts) < counts).all() and (np.diff(d.worth(counts)) > 0).all()
