"""SentencePiece encoding and decoding by an Aho-Corasick automaton and one Viterbi pass.

The automaton over all pieces reads a string once; at every position it yields the pieces
that end there, longest first, by following its output links. Each relaxes the best score
of its end. A character that no piece covers falls back to its bytes. As no piece has a
space after another character, a text can be cut before spaces without changing the best
path; distinct units of a batch are then encoded once.

The path found has the largest sum of the model's own scores. For a unigram model that is
what `sentencepiece` finds; a merge model's scores are ranks, which that library applies in
order instead, so for such a model ids differ, while both decode to the same text.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .features import spread
from .units import Encoder

SPACE = "▁"
#: How far an unknown character scores below the worst piece.
UNKNOWN_PENALTY = 10.0
SLICE = 4096


@dataclass
class Vocabulary:
    """Pieces by id, their scores, and which are ordinary, bytes, or unknown."""

    pieces: list[str]
    scores: list[float]
    ordinary: list[bool]
    byte_ids: list[int]
    unknown: int
    _automaton: ahocorasick.Automaton | None = field(default=None, repr=False)

    def __post_init__(self):
        own = [(p, s) for p, s, ok in zip(self.pieces, self.scores, self.ordinary, strict=True) if ok]
        self.singles = {p for p, _ in own if len(p) == 1}
        self.unknown_score = min((s for _, s in own), default=0.0) - UNKNOWN_PENALTY

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        pieces = [m.id_to_piece(i) for i in ids]
        ordinary = [not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i)) for i in ids]
        at = {p: i for i, p in enumerate(pieces) if m.is_byte(i)}
        byte_ids = [at[f"<0x{b:02X}>"] for b in range(256)] if at else []
        return cls(pieces, [m.get_score(i) for i in ids], ordinary, byte_ids, m.unk_id())

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    @property
    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for i, piece in enumerate(self.pieces):
                if self.ordinary[i]:
                    self._automaton.add_word(piece, (len(piece), self.scores[i], i))
            self._automaton.make_automaton()
        return self._automaton

    @property
    def separable(self) -> bool:
        """No piece has a space after another character."""
        return not any(ok and SPACE in p.lstrip(SPACE) for p, ok in zip(self.pieces, self.ordinary, strict=True))

    def best(self, text: str) -> list[int]:
        """The ids of the path with the largest sum of scores through text, spaces already marked; of equal paths the longer last piece wins."""
        n = len(text)
        score, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        done = 0  # ends up to here are final
        for end, (size, s, i) in self.automaton.iter(text):
            while done < end:
                done += 1
                if text[done - 1] not in self.singles:
                    self.relax_unknown(score, back, done)
            if (new := score[end + 1 - size] + s) > score[end + 1]:
                score[end + 1], back[end + 1] = new, (size, i)
        for done in range(done + 1, n + 1):
            if text[done - 1] not in self.singles:
                self.relax_unknown(score, back, done)
        ids, at = [], n
        while at:
            size, i = back[at]
            if i >= 0:
                ids.append(i)
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in reversed(text[at - 1].encode())]
            else:
                ids.append(self.unknown)
            at -= size
        return ids[::-1]

    def relax_unknown(self, score: list[float], back: list[tuple[int, int]], at: int) -> None:
        """One character that is no piece by itself."""
        if (new := score[at - 1] + self.unknown_score) > score[at]:
            score[at], back[at] = new, (1, -1)

    def encode(self, text: str) -> list[int]:
        """Spaces become marks, and a mark is put before the text; an empty text has no ids."""
        return self.best(SPACE + text.replace(" ", SPACE)) if text else []

    def encoder(self) -> Encoder:
        if not self.separable:
            return Encoder(self.best, self.encode, SPACE, "(?s).")
        unit = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        whole = lambda t: [i for u in unit.findall(SPACE + t.replace(" ", SPACE)) for i in self.best(u)] if t else []
        # Runs of spaces are one unit with what follows, and a mark in the text itself is a space too.
        return Encoder(self.best, whole, SPACE, f"^ |  | $|{SPACE}")

    def surfaces(self) -> tuple[np.ndarray, np.ndarray]:
        """(starts, bytes) of what each id stands for."""
        of_byte = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        made = [of_byte.get(i, p.replace(SPACE, " ").encode() if self.ordinary[i] else b"") for i, p in enumerate(self.pieces)]
        return np.concatenate([[0], np.cumsum([len(m) for m in made])]), np.frombuffer(b"".join(made), dtype=np.uint8)


def decode(surfaces: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> bytes:
    """The text's bytes, without the space that encoding put before it."""
    _, at = spread(surfaces[0], ids.astype(np.int64))
    return surfaces[1][at].tobytes()[1:]


def encode_documents(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row for each row of df: id, n_pieces, ids_crc32 (of little-endian unsigned 32-bit ids), decoded_crc32 and round_trip; with keep_ids also ids.

    decoded_crc32 is of the UTF-8 text that the ids decode to, and round_trip says
    whether it is the text. A null text counts as empty and has no ids; a text that
    holds the space mark itself decodes to a space there and is no round trip.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)  # the pieces, a fixed number

    def encoded(batches):
        encoder, surfaces = shared.value.encoder(), shared.value.surfaces()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ends, ids = encoder.batch(part.column("text"))
                texts = part.column("text").cast(pa.large_binary()).to_pylist()
                rows = [ids[ends[i] : ends[i + 1]] for i in range(part.num_rows)]
                back = [decode(surfaces, r) for r in rows]
                arrays = [part.column("id"), pa.array(np.diff(ends)), pa.array([zlib.crc32(r.tobytes()) for r in rows], pa.int64()), pa.array([zlib.crc32(b) for b in back], pa.int64()), pa.array([b == (t or b"") for b, t in zip(back, texts, strict=True)], pa.bool_())]
                names = ["id", "n_pieces", "ids_crc32", "decoded_crc32", "round_trip"]
                if keep_ids:
                    arrays.append(pa.LargeListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"))
    out = rows.mapInArrow(encoded, "id long, n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean" + ", ids array<int>" * keep_ids)
    return out.withColumnRenamed("id", id_col)


def decode_documents(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row for each row of df: id and text, from ids; null or no ids are an empty text, bytes that are no UTF-8 become U+FFFD."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def decoded(batches):
        surfaces = shared.value.surfaces()
        for batch in batches:
            texts = [decode(surfaces, np.array(x or [], dtype=np.int64)).decode(errors="replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    return df.select(df[id_col].cast("long").alias("id"), df[ids_col].alias("ids")).mapInArrow(decoded, "id long, text string").withColumnRenamed("id", id_col)
