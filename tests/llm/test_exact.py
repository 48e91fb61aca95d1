import hashlib
from collections import defaultdict

import duckdb

from voxlight.llm import exact
from voxlight.llm.queries import ORACLES, QUERIES

from odd_rows import ODD


def brute(rows):
    strip = str.maketrans("", "", " \t\n\x0b\x0c\r")
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(strip)].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for norm, members in groups.items():
        members.sort(key=lambda m: m[:3])
        for k, m in enumerate(members):
            out.append((m[3], members[0][3], len(members), k == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()), key=str)


def test_odd_rows(frame):
    assert rows_of(exact.content_sort(frame(ODD))) == brute(ODD)


def test_hot_group_spans_buckets(frame):
    """A text that most rows share is split over buckets by id, and joined again."""
    rows = [(i, f"the same text {'' if i % 3 else 'but ' + str(i)} " + " " * (i % 5)) for i in range(400)]
    assert rows_of(exact.content_sort(frame(rows))) == brute(rows)


def test_shared_beginnings(frame):
    rows = [(i, "p" * 300 + str(i % 50)) for i in range(300)]
    assert rows_of(exact.content_sort(frame(rows))) == brute(rows)


def test_empty_and_payload(frame):
    assert exact.content_sort(frame([])).count() == 0
    df = frame(ODD)
    kept = exact.content_sort(df, payload=df.columns).where("kept").select("row.*")
    assert kept.columns == df.columns and kept.count() == sum(r[3] for r in brute(ODD))


def test_long_shared_heads(frame, monkeypatch):
    """Texts that differ only beyond the sampled characters still spread over buckets."""
    monkeypatch.setattr(exact, "HEAD", 20)
    rows = [(i, "p" * 300 + str(i % 70)) for i in range(300)]
    assert rows_of(exact.content_sort(frame(rows))) == brute(rows)


def test_borders_are_short_and_ascending():
    out = exact.splitters([("abc", 5, 1), ("abd", 2, 2), ("abd", 2, 3), ("abd", 7, 4), ("zzz", 1, 5), ("zzzz", 0, 6)], 6)
    tuples = [(b["t"], b["h"], b["i"]) for b in out]
    assert tuples == [("abd", exact.LEAST, exact.LEAST), ("abd", 2, 3), ("abd", 7, exact.LEAST), ("z", exact.LEAST, exact.LEAST), ("zzzz", exact.LEAST, exact.LEAST)]


def test_against_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = sorted(con.sql("SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM (" + ORACLES["op8_content_sort"] + ")").fetchall(), key=str)
    assert rows_of(QUERIES["op8_content_sort"](spark, d)) == want
