import pyarrow as pa
import test_exact
import test_jaccard
from odd_rows import ODD
from pyspark.sql import functions as F
from test_classifiers import STRANGE
from test_text_tools import check_packs

import corpus_pipeline as pipeline
from voxlight.llm import language, toxicity
from voxlight.llm.common import materialize, table

D = "/root/testdata/sf0.001"


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_against_brute_force(spark):
    """Each stage on what the one before it kept."""
    docs = table(spark, D, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        before, source = pairs(docs), docs
        docs = materialize(stage(spark, docs, D), name)
        assert docs.columns == columns
        kept[name] = {i for i, _ in pairs(docs)}
        texts = pa.array([t for _, t in before])
        if name == "toxicity":
            scores = toxicity.train_on(source, table(spark, D, "labels")).score(texts)
            want = {i for (i, _), s in zip(before, scores, strict=True) if s < toxicity.THRESHOLD}
        elif name == "language":
            rejected = language.train_on(source).predict(texts)[2]
            want = {i for (i, _), r in zip(before, rejected, strict=True) if not r}
        elif name == "exact_dedup":
            want = {r[0] for r in test_exact.brute(before) if r[3]}
        else:
            want = {i for i, (_, root) in test_jaccard.brute(before).items() if i == root}
        assert kept[name] == want
    name, stage = pipeline.STAGES[-1]
    check_packs(stage(spark, docs, D).collect(), pairs(docs))
    assert len(kept["near_dedup"]) < len(kept["exact_dedup"]) <= len(kept["toxicity"]) < 200


def test_clean_documents_stay(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    out = pipeline.clean(spark, docs, "/root/testdata/sf0.01")
    gone = labels.join(out, "doc_id", "left_anti")
    assert gone.where("toxic = 0").count() == 0 and gone.where("toxic = 1").count() > 0


def test_language_stage_drops_what_is_no_language(spark):
    """Code, digits and other languages go; the documents stay."""
    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents")
    strange = spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(STRANGE)], "doc_id long, text string")
    strange = docs.limit(0).unionByName(strange.selectExpr("doc_id", "text", "cast(null as string) lang", "'s' source", "cast(0 as bigint) n_chars").select(*docs.columns))
    out = pipeline.known_language(spark, docs.union(strange), d)
    assert out.where("doc_id >= 1000000").count() == 0 and out.count() >= 0.999 * docs.count()


def test_near_stage_judges_repeated_ids_by_text(spark, frame):
    one, two = "a b c d e f g h i j", "q r s t u v w x y z"
    docs = frame([(0, one), (1, one + " k"), (1, two), (None, one), (2, None), (3, "")])
    out = pipeline.no_near_copies(spark, docs, D)
    assert sorted(map(str, pairs(out))) == sorted(map(str, [(0, one), (1, two), (None, one), (2, None), (3, "")]))


def test_odd_and_empty_documents(spark, tmp_path, frame):
    spark.createDataFrame([(6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = {"toxicity": len(ODD), "language": 10, "exact_dedup": 6, "near_dedup": 5}
    for rows in (ODD, []):
        docs = frame(rows).withColumn("label", F.lit(1)).withColumn("keys", F.array(F.lit("a")))
        columns = docs.columns
        for name, stage in pipeline.STAGES:
            docs = materialize(stage(spark, docs, str(tmp_path)), name)
            if name != "packing":
                assert docs.columns == columns and docs.count() == (left[name] if rows else 0), (name, pairs(docs))
        assert (docs.count() > 0) == bool(rows)
