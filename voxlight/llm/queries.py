"""The queries of this subpackage and their SQL, as __spark_entry__ registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bestfit, chat, divergence, exact, jaccard, katz, language, merkle, packing, pieces, sharding, toxicity, vectors
from .common import table


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_texts(table(spark, sf_dir, "documents")).drop("text_hash")


def op2_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.predict(docs, language.train_on(docs))
    return out.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op3_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.ring_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_chats(turns.union(extra)))


def op5_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.train_on(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.content_sort(table(spark, sf_dir, "documents"))


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scores(table(spark, sf_dir, "documents"), ~katz.held_out("doc_id"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), pieces.Vocabulary.load(tokenizer("piece_bpe_32k.model")), keep_ids=False)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


QUERIES = {
    "op1_lsh_forest": op1_lsh_forest,
    "op2_nearest_centroid": op2_nearest_centroid,
    "op3_ring_shards": op3_ring_shards,
    "op4_chat_parts": op4_chat_parts,
    "op5_ngram_toxicity": op5_ngram_toxicity,
    "op6_pack": op6_pack,
    "op7_grid_order_join": op7_grid_order_join,
    "op8_content_sort": op8_content_sort,
    "op9_katz": op9_katz,
    "op10_pieces": op10_pieces,
    "op11_divergence": op11_divergence,
    "op12_merkle": op12_merkle,
    "op13_best_fit": op13_best_fit,
}

ORACLES = {
    "op1_lsh_forest": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * c >= 4 * (x.n + y.n)
        ), reach AS (
            SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN links ON a = r
        ), components AS (
            SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id
        )
        SELECT w.doc_id, CASE WHEN len(w) = 0 THEN w.doc_id ELSE min(w.doc_id) OVER (PARTITION BY w) END AS class_id,
               coalesce(k, 0) AS n_links, component_id, component_id = w.doc_id AS kept
        FROM w JOIN components USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS k FROM links GROUP BY a) USING (doc_id)
    """,
    "op7_grid_order_join": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
        ), usable AS (
            SELECT * FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
            WHERE list_inner_product(a.x, b.x) / sqrt(list_inner_product(a.x, a.x)) / sqrt(list_inner_product(b.x, b.x)) >= 0.98e0
        ), reach AS (
            SELECT vec_id, vec_id AS r FROM v UNION SELECT vec_id, b FROM reach JOIN links ON a = r
        ), components AS (
            SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id
        )
        SELECT v.vec_id, coalesce(k, 0) AS n_links, component_id, component_id = v.vec_id AS kept
        FROM v JOIN components USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS k FROM links GROUP BY a) USING (vec_id)
    """,
    "op4_chat_parts": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL
            SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)
        ), u AS (
            SELECT *, len(regexp_extract_all(text, '\\|<\||</?s>|\[/?INST\]|<</?SYS>>')) AS escapes,
                   len(regexp_extract_all(role, '\\|<\||</?s>|\[/?INST\]|<</?SYS>>')) AS role_escapes
            FROM t
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length('<|turn|><|says|><|end|>') + length(role) + role_escapes + length(text) + escapes) AS BIGINT) AS formatted_chars
        FROM u GROUP BY conv_id
    """,
    "op8_content_sort": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS n
            FROM documents
        ), g AS (
            SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size
            FROM t
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
    """,
    "op11_divergence": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
            FROM documents
        ), said AS (
            SELECT d, lang, source, translate(unnest(words), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs
        ), kept AS (
            SELECT lang, term, count(*) AS n FROM said GROUP BY ALL HAVING count(DISTINCT d) >= 10
        ), counts AS (
            SELECT lang, source, term, count(*) AS n FROM said GROUP BY ALL
        ), dense AS (
            SELECT g.lang, g.source, k.term, CAST(coalesce(c.n, 0) AS HUGEINT) AS n, CAST(k.n AS HUGEINT) AS all_n
            FROM (SELECT DISTINCT lang, source FROM docs) g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), shares AS (
            SELECT *, 1 + 1000000000 * (n + 2) // (sum(n) OVER g + 2 * count(*) OVER g) AS p, 1 + 1000000000 * (all_n + 2) // (sum(all_n) OVER g + 2 * count(*) OVER g) AS q
            FROM dense WINDOW g AS (PARTITION BY lang, source)
        ), gaps AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), pairs AS (
            SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
            FROM (SELECT DISTINCT lang, source FROM docs) a JOIN (SELECT DISTINCT lang, source FROM docs) b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN gaps g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source
        ), found AS (
            SELECT lang, source, 'pair' AS part, item, value FROM pairs
            UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place FROM found
        )
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(place AS INTEGER) AS rank FROM placed WHERE part = 'pair' OR place <= 10
    """,
    "op12_merkle": r"""
        WITH RECURSIVE coded AS (
            SELECT doc_id, coalesce('1' || source, '0') AS g,
                   list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)], lambda v: coalesce(strlen(v) || ':' || v, '-')) AS head,
                   coalesce(strlen(text) || ':' || text, '-') AS whole,
                   list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
                       lambda c, b: list_reduce(list_concat([xor(c, b)], CAST(range(8) AS BIGINT[])), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))) % 2 = 1 AS even,
                   replace(text, chr(10), '') AS less
            FROM documents
        ), leaves AS (
            SELECT doc_id, g, leaf, tampered, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i
            FROM (SELECT doc_id, g, sha256(array_to_string(head, '') || whole) AS leaf, CASE WHEN even THEN sha256(array_to_string(head, '') || coalesce(strlen(less) || ':' || less, '-')) ELSE sha256(array_to_string(head, '') || whole) END AS tampered FROM coded)
        ), levels AS (
            SELECT g, 0 AS level, list(leaf ORDER BY i) AS nodes FROM leaves GROUP BY g
            UNION ALL
            SELECT g, level + 1, list_transform(range(0, len(nodes), 3), lambda k: sha256(array_to_string(nodes[k + 1:k + 3], ''))) FROM levels WHERE len(nodes) > 1
        ), subroots AS (
            SELECT g, nodes[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS i FROM levels WHERE len(nodes) = 1
        ), upper AS (
            SELECT 0 AS level, list(subroot ORDER BY i) AS nodes FROM subroots
            UNION ALL
            SELECT level + 1, list_transform(range(0, len(nodes), 3), lambda k: sha256(array_to_string(nodes[k + 1:k + 3], ''))) FROM upper WHERE len(nodes) > 1
        ), lower_walk AS (
            SELECT doc_id, g, 0 AS level, i, tampered AS own, '' AS proof FROM leaves
            UNION ALL
            SELECT doc_id, w.g, w.level + 1, i // 3, sha256(array_to_string(nodes[i - i % 3 + 1:i], '') || own || array_to_string(nodes[i + 2:i - i % 3 + 3], '')),
                   proof || array_to_string(nodes[i - i % 3 + 1:i], '') || array_to_string(nodes[i + 2:i - i % 3 + 3], '')
            FROM lower_walk w JOIN levels l ON l.g = w.g AND l.level = w.level WHERE len(nodes) > 1
        ), ends AS (
            SELECT doc_id, g, own, proof FROM lower_walk QUALIFY level = max(level) OVER (PARTITION BY doc_id)
        ), upper_walk AS (
            SELECT doc_id, 0 AS level, s.i, own, proof FROM ends JOIN subroots s USING (g)
            UNION ALL
            SELECT doc_id, w.level + 1, i // 3, sha256(array_to_string(nodes[i - i % 3 + 1:i], '') || own || array_to_string(nodes[i + 2:i - i % 3 + 3], '')),
                   proof || array_to_string(nodes[i - i % 3 + 1:i], '') || array_to_string(nodes[i + 2:i - i % 3 + 3], '')
            FROM upper_walk w JOIN upper l ON l.level = w.level WHERE len(nodes) > 1
        ), tops AS (
            SELECT doc_id, own, proof FROM upper_walk QUALIFY level = max(level) OVER (PARTITION BY doc_id)
        )
        SELECT doc_id, leaf, subroot, nodes[1] AS root, sha256(proof) AS proof_sha256, own AS folded_root, own = nodes[1] AS verified
        FROM leaves JOIN subroots USING (g) JOIN tops USING (doc_id), upper WHERE len(nodes) = 1
    """,
}
