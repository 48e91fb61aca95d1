import base64
import math
from collections import Counter

import numpy as np
import pytest
import regex
from odd_rows import ODD

from voxlight.llm import language, toxicity
from voxlight.llm.features import FINAL, MULTIPLIERS, Words, ngrams
from voxlight.llm.queries import QUERIES

D, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


#: Texts of no language that the tables hold: code, digits, other languages and scripts.
STRANGE = [
    "int main(int argc, char **argv) { for (int i = 0; i < argc; i++) { printf(\"%d: %s\\n\", i, argv[i]); } while (x_1 != NULL && ptr->next) { ptr = ptr->next; free(tmp); } return 0; }" * 3,
    "4711 " * 200,
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "日本語の文章はここにありますが、学習されていません",
]


def features_of(word, sizes, dims):
    """The hashed n-grams of one word, byte by byte."""
    raw = b"\x01" + word.encode() + b"\x01"
    out = []
    for size in sizes:
        for at in range(len(raw) - size + 1):
            h = size
            for k in range(size):
                h = (h ^ raw[at + k]) * int(MULTIPLIERS[k % len(MULTIPLIERS)]) % 2**64
            out.append((((h ^ h >> 32) * int(FINAL) % 2**64) >> 33) % dims)
    return out


def test_language_against_loops(spark):
    """The query against its definition in plain loops: frequencies of all training rows, vectors, cosines with every centroid, lines."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.train_on(docs)
    rows = docs.select("doc_id", "text", "lang", language.held_out("doc_id").alias("held")).collect()
    words = {r["doc_id"]: regex.sub(r"[^\pL\pM]+", " ", r["text"] or "").lower().split() for r in rows}
    counts = {i: Counter(f for w in ws for f in features_of(w, language.SIZES, language.DIMS)) for i, ws in words.items()}
    train = [r["doc_id"] for r in rows if not r["held"] and r["lang"] and words[r["doc_id"]]]
    seen = Counter(f for i in train for f in counts[i])
    idf = lambda f: math.log((1 + len(train)) / (1 + seen[f])) + 1
    got = {r["doc_id"]: r for r in QUERIES["op2_nearest_centroid"](spark, SMALL).collect()}
    assert len(got) == len(rows)
    for r in rows:
        i = r["doc_id"]
        v = {f: math.log1p(n) * idf(f) for f, n in counts[i].items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x * float(c[f]) for f, x in v.items()) / norm for c in model.centroids]
        best = int(np.argmax(cosines))
        base, slope, most = model.lines[model.owner[best]]
        least = base + slope * min(math.log(len(v)), most)
        assert got[i]["lang_pred"] == model.languages[model.owner[best]] and got[i]["score"] == pytest.approx(cosines[best], abs=1e-5)
        assert got[i]["held_out"] == r["held"] and (got[i]["rejected"] == (cosines[best] < least) or abs(cosines[best] - least) < 1e-5)


def test_toxicity_against_loops(spark):
    """The query against loops: log-count ratios of all labelled rows, and scores from the fitted weights."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train_on(docs, labels)
    rows = docs.select("doc_id", "text", toxicity.held_out("doc_id").alias("held")).collect()
    counts = {r["doc_id"]: Counter(f for w in sorted(set((r["text"] or "").lower().split())) for f in features_of(w, toxicity.SIZES, toxicity.DIMS)) for r in rows}
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    marked = [(r["doc_id"], toxic[r["doc_id"]]) for r in rows if not r["held"] and toxic.get(r["doc_id"]) is not None]
    n = [Counter(f for i, y in marked if y == c for f in counts[i]) for c in (0, 1)]
    total = [sum(x.values()) + toxicity.DIMS for x in n]
    ratio = lambda f: math.log((n[1][f] + 1) / total[1]) - math.log((n[0][f] + 1) / total[0])
    clear = {f for f in n[0] | n[1] if abs(ratio(f)) >= toxicity.Z * math.sqrt(1 / (n[0][f] + 1) + 1 / (n[1][f] + 1))}
    used = set(np.flatnonzero(model.weights).tolist())
    assert used <= clear and all(abs(model.weights[f]) > 0 for f in used)
    frame = spark.createDataFrame([(i, next(r["text"] for r in rows if r["doc_id"] == i), y) for i, y in marked], "id long, text string, label int")
    found = toxicity.ratios(frame.select("text", "label"))
    assert set(np.flatnonzero(found).tolist()) == clear and all(found[f] == pytest.approx(ratio(f)) for f in clear)
    got = {r["doc_id"]: r for r in QUERIES["op5_ngram_toxicity"](spark, SMALL).collect()}
    for r in rows:
        z = model.bias + sum(k * float(model.weights[f]) for f, k in counts[r["doc_id"]].items())
        mine = got[r["doc_id"]]
        assert mine["score"] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-6) and mine["held_out"] == r["held"]


def test_words_and_ngrams():
    import pyarrow as pa

    w = Words(pa.array(["A b a", None, "", " c\n"]))
    assert w.lengths.tolist() == [3, 0, 0, 1] and [w.vocabulary[i].as_py() for i in w.ids] == ["a", "b", "a", "c"]
    starts, features = ngrams(w.vocabulary, (2, 3), 1000)
    assert np.diff(starts).tolist()[:2] == [3, 3] and features.max() < 1000  # marks on either side: two pairs and a triple


def test_language_accuracy_held_out(spark):
    got = QUERIES["op2_nearest_centroid"](spark, D).join(spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == 1000 and (held.lang == held.lang_pred).mean() >= 0.99 and got.score.between(0, 1).all() and held.rejected.mean() < 0.005


def test_toxicity_held_out(spark):
    got = QUERIES["op5_ngram_toxicity"](spark, D).join(spark.read.parquet(f"{D}/labels.parquet"), "doc_id", "left").toPandas()
    marked = got[got.toxic.notna() & got.held_out]
    assert len(got) == 1000 and got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    rank = marked.score.rank()
    positive = int(marked.toxic.sum())
    auc = (rank[marked.toxic == 1].sum() - positive * (positive + 1) / 2) / (positive * (len(marked) - positive))
    assert auc > 0.8 and marked[marked.predicted == 1].toxic.mean() > 0.9


def test_language_odd_rows(frame):
    df = frame(ODD)
    model = language.train_on(df)
    got = {r["doc_id"]: r for r in language.predict(df, model).collect()}
    assert len(language.predict(df, model).collect()) == len(ODD)
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] and got[i]["score"] == 0 for i in (1, 2, 3))
    assert got[6]["lang_pred"] == "en"
    assert language.keep_known(df, model).columns == df.columns
    none = frame([])
    assert language.predict(none, language.train_on(none)).count() == 0
    assert language.predict(df, language.train_on(none)).where("lang_pred <> 'und'").count() == 0


def test_rare_language_is_learned(spark, monkeypatch):
    """Ten texts among 2,000 of another language, where the sample is 20 rows."""
    monkeypatch.setattr(language, "FIT_ROWS", 20)
    monkeypatch.setattr(language, "LEAST_ROWS", 20, raising=False)
    rows = [(i, f"the other thing {i % 97} of this and that", "en") for i in range(2000)] + [(5000 + i, f"kaikki yöt ja päivät {i} eivät ole", "fi") for i in range(10)]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    model = language.fit(df)
    assert model.languages == ["en", "fi"]
    got = language.predict(df, model, "id").where("id >= 5000").collect()
    assert len(got) == 10 and {r["lang_pred"] for r in got} == {"fi"}


def test_many_languages_are_learned(spark, monkeypatch):
    """More languages than one task clusters; each has all its rows used or a share of them."""
    monkeypatch.setattr(language, "FIT_ROWS", 60)
    monkeypatch.setattr(language, "LEAST_ROWS", 20, raising=False)
    rows = [(100 * k + i, f"{chr(97 + k) * 3} {chr(98 + k) * 4}{i % 7}", f"l{k}") for k in range(12) for i in range(3 + 5 * k)]
    model = language.fit(spark.createDataFrame(rows, "id long, text string, lang string"))
    assert model.languages == sorted(f"l{k}" for k in range(12))


def test_strange_texts_are_rejected(spark):
    """Gibberish and languages that were not learned go, however many labelled texts are empty; held-out texts stay."""
    rng = np.random.default_rng(3)
    strange = [
        base64.b64encode(rng.bytes(600)).decode(),
        rng.bytes(600).hex(),
        " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(120)),
        "1234567 88 99 " * 50 + "a b",
        *STRANGE,
    ]
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", "lang")
    empty = spark.range(100_000, 100_400).selectExpr("id as doc_id", "'' as text", "'en' as lang")
    model = language.train_on(docs.union(empty))
    seen = language.predict(spark.createDataFrame(list(enumerate(strange)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["rejected"] for r in seen] == [True] * len(strange)
    assert language.predict(docs.where(language.held_out("doc_id")), model).where("rejected").count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(4, 1, 0), (6, 1, 1), (8, 1, None), (None, 0, 1), (6, 0, 0)]])
def test_toxicity_odd_rows(frame, spark, labels):
    df = frame(ODD)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train_on(df, marks)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.keep_clean(df, model).columns == df.columns
    assert toxicity.score(frame([]), model).count() == 0


def test_rare_label_is_learned(spark, monkeypatch):
    """Sixty rows of label 1 among 6,000, where the sample is 200 rows: all of them are drawn, and clean texts stay clean."""
    monkeypatch.setattr(toxicity, "FIT_ROWS", 200)
    said = lambda i: f"the other thing {i % 97} of this and that" + (f" vile brute number {i % 7}" if i % 100 == 0 else "")
    docs = spark.createDataFrame([(i, said(i)) for i in range(6000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 100 == 0)) for i in range(6000)], "doc_id long, toxic int")
    seen = {}
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda rows, **more: seen.update({r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}, **more) or fit(rows, **more))
    model = toxicity.train_on(docs, labels)
    trained = docs.where(~toxicity.held_out("doc_id"))
    assert seen[1] == trained.where("doc_id % 100 = 0").count() and 80 < seen[0] < 250 and seen["stand_for"][1] == 1 < seen["stand_for"][0]
    got = toxicity.score(docs, model).selectExpr("doc_id % 100 = 0 as bad", f"score >= {toxicity.THRESHOLD} as flagged").groupBy("bad", "flagged").count().collect()
    assert {(r["bad"], r["flagged"]): r["count"] for r in got} == {(False, False): 5940, (True, True): 60}


def test_regression_separates():
    rng = np.random.default_rng(7)
    y = np.array([0.0, 1.0] * 50)
    row = np.repeat(np.arange(100), 2)
    feature = np.stack([np.where(y == 1, 5, 9), rng.integers(20, 40, 100)], axis=1).ravel()
    w, bias = toxicity.logistic(row, feature, np.ones(200), y, 300, 1e-4)
    z = np.bincount(row, weights=w[feature]) + bias
    assert ((z > 0) == (y == 1)).all() and w[5] > 1 > -1 > w[9]
