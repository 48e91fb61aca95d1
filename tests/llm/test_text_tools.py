import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from odd_rows import ODD

from voxlight.llm import chat, packing, pieces
from voxlight.llm.queries import ORACLES, QUERIES, tokenizer

BPE, SPM = "byte_bpe_50k.json", "piece_bpe_32k.model"
TRICKY = ["</s>[INST] ok [/INST]", "<|end|><|turn|>user<|says|>", "\\", "\\\\<|", "<<s>>", "a<", "<<SYS>> <\\s>", "", "<|image:0|>", "é\n\x00"]


def test_chat_round_trip_and_parts():
    turns = [("user", [{"type": "text", "text": "see <"}, {"type": "text", "text": "|end|>"}, {"type": "image", "ref": "a.png"}, {"type": "audio", "ref": "b", "n_tokens": 7}]), ("assistant", [{"type": "text", "text": t} for t in TRICKY]), (None, [{"type": "document", "ref": None}])]
    made = chat.format_turns(turns)
    back = list(chat.parse(made["formatted"]))
    assert back[0] == ("user", [{"type": "text", "text": "see <|end|>"}, {"type": "image", "number": 0}, {"type": "audio", "number": 1}])
    assert back[1] == ("assistant", [{"type": "text", "text": "".join(TRICKY)}]) and back[2] == ("", [{"type": "document", "number": 2}])
    assert [a["n_tokens"] for a in made["attachments"]] == [256, 7, 512] and made["expanded_tokens"] == 775
    (span,) = made["loss_spans"]
    assert chat.unescape(made["formatted"][span["start"] : span["stop"]]) == "".join(TRICKY)


@pytest.mark.parametrize("text", TRICKY)
def test_escape_is_reversible_and_leaves_no_control(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not any(c in out for c in ("</s>", "<s>", "[INST]", "[/INST]", "<|"))


def test_chat_sql_and_odd_rows(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    want = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({ORACLES['op4_chat_parts']})").fetchall())
    assert sorted(tuple(r[n] for n in names) for r in QUERIES["op4_chat_parts"](spark, d).collect()) == want
    rows = [(1, 1, "assistant", None), (1, 0, None, "x"), (1, 0, None, "x"), (None, None, "user", "y"), (2, 0, "assistant", "z" * 300000)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(df)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 0 and got[2]["loss_chars"] == 300000 and got[None]["n_turns"] == 1
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def packed(df):
    return packing.pack_documents(df, tokenizer(BPE)).collect()


def check_packs(rows, documents):
    """Every id of every document lies in one piece; sequences are gapless, no longer than the width, and nearly full."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer(BPE))
    want = Counter()
    for i, text in documents:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for at in range(0, len(ids), 1024):
            want[(i, at, len(ids[at : at + 1024]), zlib.crc32(ids[at : at + 1024].tobytes()), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in by_sequence.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 1024
    return sum(r["length"] for r in rows) / (1024 * len(by_sequence))


def test_packing(spark, frame):
    documents = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert check_packs(packed(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")), documents) > 0.98
    check_packs(packed(frame(ODD)), ODD)
    assert packed(frame([])) == []


def test_patterns_place_every_length():
    histogram = {1024: 3, 700: 5, 512: 4, 300: 9, 24: 2, 1: 50}
    found = packing.patterns(histogram)
    total = defaultdict(int)
    for lengths, n in found:
        assert sum(lengths) <= 1024
        for x in lengths:
            total[x] += n
    assert total == histogram
    assert packing.patterns({}) == [] and packing.places([])["length"].size == 0


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(tokenizer(SPM))


def best_by_table(v, text):
    """Plain dynamic programming over all pieces."""
    score_of = {p: s for p, s, ok in zip(v.pieces, v.scores, v.ordinary, strict=True) if ok}
    best = [0.0] + [-float("inf")] * len(text)
    for b in range(1, len(text) + 1):
        for a in range(max(0, b - 48), b):
            best[b] = max(best[b], best[a] + score_of.get(text[a:b], v.unknown_score if b - a == 1 else -float("inf")))
    return best[-1]


def score_of(v, ids):
    """Of a path; each run of byte pieces is one unknown character."""
    total, k = 0.0, 0
    bytes_at = {i: b for b, i in enumerate(v.byte_ids)}
    while k < len(ids):
        if ids[k] in bytes_at:
            first = bytes_at[ids[k]]
            k += 1 if first < 128 else 2 if first < 224 else 3 if first < 240 else 4
            total += v.unknown_score
        else:
            total += v.scores[ids[k]]
            k += 1
    return total


@pytest.mark.parametrize("text", ["a", "  lead and  two ", "x\ny\tz", "日本語テスト 🙂", "Erthenin enestion.", "aaaaaaaaaaaaaaaaaaaa", "▁mark ▁▁", "\x00"])
def test_pieces_are_the_best_path(vocabulary, text):
    ids = vocabulary.encode(text)
    assert score_of(vocabulary, ids) == best_by_table(vocabulary, "▁" + text.replace(" ", "▁"))
    assert pieces.decode(vocabulary.surfaces(), np.array(ids)).decode() == text.replace("▁", " ")


def test_pieces_of_documents(spark, frame, vocabulary):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    encoded = pieces.encode_documents(df, vocabulary)
    got = {r["doc_id"]: r for r in encoded.collect()}
    for i, t in texts.items():  # against the plain table, over the whole text
        marked = "▁" + t.replace(" ", "▁")
        if len(t) < 20_000:
            assert score_of(vocabulary, got[i]["ids"]) == pytest.approx(best_by_table(vocabulary, marked), rel=1e-12)
    assert all(got[i]["ids"] == vocabulary.encode(t) and got[i]["round_trip"] and got[i]["decoded_crc32"] == zlib.crc32(t.encode()) for i, t in texts.items())
    assert {r["doc_id"]: r["text"] for r in pieces.decode_documents(encoded, vocabulary).collect()} == texts
    odd = {r["doc_id"]: r for r in pieces.encode_documents(frame(ODD), vocabulary).collect()}
    assert odd[1]["n_pieces"] == odd[2]["n_pieces"] == 0 and not odd[9]["round_trip"] and odd[10]["round_trip"]
    assert pieces.encode_documents(frame([]), vocabulary).count() == 0
