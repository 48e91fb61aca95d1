import re
from collections import Counter, defaultdict

import duckdb
import pytest
from odd_rows import ODD

from voxlight.llm import divergence
from voxlight.llm.queries import ORACLES, QUERIES

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=10):
    docs = [(lang or "", s or "", [w.translate(LOWER) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for lang, s, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        frequency = Counter(w for d in own for w in set(d[2]))
        kept = [w for w, k in frequency.items() if k >= least]
        counts, everywhere = defaultdict(Counter), Counter()
        for _, s, words in own:
            counts[s].update(w for w in words if frequency[w] >= least)
            everywhere.update(w for w in words if frequency[w] >= least)
        shares = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: shares(c) for s, c in counts.items()}, shares(everywhere)
        for s in p:
            pairs = sorted((-sum(gap(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in p if o != s)
            terms = sorted((-gap(p[s][w], q[w]), w.encode(), w) for w in kept if counts[s][w] and p[s][w] > q[w])[:10]
            out += [(lang, s, part, item, -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


DDL = "lang string, source string, text string, doc_id long, term string, n long, p double, i int"


def compared(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "t", 2, 0.5, 3) for r in rows], DDL)
    got = sorted(map(tuple, divergence.divergence(df, **more).collect()))
    assert got == brute(rows, **more)
    return got


def test_odd_rows(spark):
    rows = [(["en", "EN", None, ""][k % 4], ["a", None, "", "é"][k // 3 % 4], t) for k, (_, t) in enumerate(ODD * 4)]
    assert compared(spark, rows, least=2)
    assert all(r[4] == 0 for r in compared(spark, rows, least=1000) if r[2] == "pair")


def test_letters_case_and_ties(spark):
    texts = ["Éa ÉA éa\u0000b c_d X1y 日本 日本", "x y", "X Y"]
    compared(spark, [("l", f"s{k % 3}", texts[k % 3]) for k in range(30)])
    compared(spark, [("l", f"s{k % 5}", "same same text") for k in range(60)])


def test_hot_source_and_many_sources(spark, monkeypatch):
    """More sources than one side of a tile, several tiles of terms, several handings on."""
    for name, n in (("SIDE", 3), ("TILE_ROWS", 8), ("DENSE_TERMS", 2), ("BROADCAST_ROWS", 2)):
        monkeypatch.setattr(divergence, name, n)
    rows = [("en" if k % 4 else "de", "hot" if k % 3 == 0 else f"s{k % 11}", " ".join(f"w{chr(97 + (k * j) % 17)}" for j in range(k % 9))) for k in range(400)]
    assert len({r[1] for r in compared(spark, rows)}) == 12


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK", 5)
    text = "Aa bb1cc  verylongword é x".encode()
    assert [w for part in divergence.terms(text) for w in part] == text.translate(divergence.TABLE).split()


def test_empty(spark):
    assert divergence.divergence(spark.createDataFrame([], DDL)).count() == 0
    assert compared(spark, [("en", "only", "a b c")] * 12) == []


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_against_sql(spark, size):
    d = f"/root/testdata/{size}"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    names = ["lang", "source", "part", "item", "value", "rank"]
    want = con.sql(f"SELECT {', '.join(names)} FROM ({ORACLES['op11_divergence']})").fetchall()
    assert sorted(tuple(r[n] for n in names) for r in QUERIES["op11_divergence"](spark, d).collect()) == sorted(want)
