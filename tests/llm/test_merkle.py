import hashlib
import zlib

import duckdb
from odd_rows import ODD

from voxlight.llm import merkle
from voxlight.llm.queries import ORACLES, QUERIES

NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """The root, and each leaf's siblings on the left and right, level by level."""
    paths, place, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, q in enumerate(place):
            s = q - q % 3
            paths[k].append(("".join(level[s:q]), "".join(level[q + 1 : s + 3])))
            place[k] = q // 3
        level = [h("".join(level[k : k + 3])) for k in range(0, len(level), 3)]
    return level[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    below = {}
    for k in keys:
        groups[k].sort(key=lambda x: x[:3])
        below[k] = tree([x[2] for x in groups[k]])
    root, above = tree([below[k][0] for k in keys])
    out = []
    for k, upper in zip(keys, above, strict=True):
        for (_, _, own, r), path in zip(groups[k], below[k][1], strict=True):
            cut = r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            acc, path = leaf(r, r["text"].replace("\n", "")) if cut else own, path + upper
            for left, right in path:
                acc = h(left + acc + right)
            out.append((r["doc_id"], own, below[k][0], root, h("".join(a + b for a, b in path)), acc, acc == root))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=str)


DDL = "doc_id long, text string, lang string, source string, n_chars long, id long, group string, path string, n int, block int"


def made(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, "g", "p", 2, 3) for i, t, lang, s in rows], DDL)


def test_odd_rows(spark):
    rows = [(i, t, None if k % 3 else "de", [None, "", "é", "z", "Z"][k % 5]) for k, (i, t) in enumerate(ODD * 2)]
    df = made(spark, rows)
    assert rows_of(merkle.audit(df)) == brute([r.asDict() for r in df.collect()])


def test_sizes_around_bands(spark):
    """One row, a run and one, a whole band, one more, two bands; tampered rows alone fail."""
    rows = [(k, f"t{k}\n", "en", s) for s, n in (("a", 1), ("b", 4), ("c", 243), ("d", 244), ("e", 1000)) for k in range(n)]
    df = made(spark, [(j, t, lang, s) for j, (_, t, lang, s) in enumerate(rows)])
    got = rows_of(merkle.audit(df))
    assert got == brute([r.asDict() for r in df.collect()])
    assert all(r[-1] == (zlib.crc32(str(r[0]).encode()) % 2 == 1) for r in got)


def test_hot_group_and_deep_bands(spark, monkeypatch):
    """Bands of one level: all is in the joins between bands."""
    monkeypatch.setattr(merkle, "BAND", 1)
    monkeypatch.setattr(merkle, "SPAN", 3)
    df = made(spark, [(k * 7 % 101, f"text {k}" + "\n" * (k % 2), "en", "hot" if k % 3 else f"s{k % 7}") for k in range(100)])
    assert rows_of(merkle.audit(df)) == brute([r.asDict() for r in df.collect()])


def test_few_rows(spark):
    assert merkle.audit(made(spark, [])).count() == 0
    one = made(spark, [(5, "x", None, None)])
    (row,) = merkle.audit(one).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["proof_sha256"] == h("") and row["verified"]


def test_nodes_cover_intervals(spark):
    """Children's intervals make up their parent's, and their digests its digest."""
    df = spark.range(300).selectExpr("'g' AS group", "id AS rank", "300L AS n", "sha2(cast(id AS string), 256) AS digest")
    nodes = {(r["level"], r["lo"]): r for r in merkle.node_table(merkle.climb(df, 300)).collect()}
    assert max(k for k, _ in nodes) == 6 and len(nodes) == 300 + 100 + 34 + 12 + 4 + 2 + 1
    for (level, lo), r in nodes.items():
        if level:
            children = [nodes[level - 1, x] for x in range(lo, r["hi"], 3 ** (level - 1))]
            assert children[-1]["hi"] == r["hi"] and h("".join(c["digest"] for c in children)) == r["digest"]


def test_against_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = con.sql(f"SELECT {', '.join(NAMES)} FROM ({ORACLES['op12_merkle']})").fetchall()
    got = rows_of(QUERIES["op12_merkle"](spark, d))
    assert got == sorted(want, key=str) and {r[-1] for r in got} == {True, False}
