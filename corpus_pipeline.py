"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before it kept. All but the last return the columns
of documents: toxic texts go, then texts without a language, then exact copies, then all
but one text of each group of near copies; what is left is packed.

Every stage keeps all columns whatever their names, gives an empty table for an empty one,
and takes repeated rows and ids as rows of their own; what it does with null and empty
texts and null ids is stated at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlight.llm import exact, jaccard, language, packing, toxicity
from voxlight.llm.common import materialize, table
from voxlight.llm.queries import tokenizer


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity classifier, trained on the labelled rows of docs, rejects go.

    Null texts teach nothing and score as empty ones do, by the model's bias; ids only tell
    which labels belong to which row. Without labels of both kinds all rows score alike.
    """
    model = toxicity.train_on(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has no letters, hardly any, or is like no language learned go.

    Null and empty texts have no letters, so they go; ids say only which rows teach.
    """
    return language.keep_known(docs, language.train_on(docs))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal up to white space stays.

    Null texts count as empty, and all empty ones are one group. Of rows that tie in length
    and id one stays; a null id comes after all others.
    """
    return exact.content_sort(docs, payload=docs.columns).where("kept").select("row.*")


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts stays, the one with the smallest id.

    Null and empty texts and rows without id have no links and stay. Rows are known by id
    and text, so of rows that repeat an id with another text each is judged by its own.
    """
    dropped = jaccard.near_texts(docs).where("not kept").select(F.col("doc_id").alias("gone"), F.col("text_hash").alias("gone_text")).distinct()
    return docs.join(dropped, (docs["doc_id"] == dropped["gone"]) & (F.xxhash64(docs["text"]) == dropped["gone_text"]), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences. A null text is empty: its end token alone; null ids stay null."""
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", clean),
    ("language", known_language),
    ("exact_dedup", distinct),
    ("near_dedup", no_near_copies),
    ("packing", packed),
]
#: Classifiers and the sketch-based join are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
