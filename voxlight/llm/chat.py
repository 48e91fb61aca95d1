"""Chat formatting: typed content parts flattened by a visitor into marked, maskable text.

A turn is a list of parts. The visitor turns a text part into its text with control
strings escaped, and an image, audio or document part into a numbered placeholder; it
records the attachment's reference, the number of tokens that the placeholder stands
for, and the spans that a loss is taken over. `parse` reads all of it back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, HEAD, CLOSE = "<|turn|>", "<|says|>", "<|end|>"
#: Strings that this template or others give a meaning; inside a text a backslash follows their first character.
CONTROL = re.compile(r"\\|<\||</?s>|\[/?INST\]|<</?SYS>>")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
PLACEHOLDER = re.compile(r"<\|(image|audio|document):(\d+)\|>")
#: Tokens that a placeholder expands to where the part does not say.
DEFAULT_TOKENS = {"image": 256, "audio": 128, "document": 512}
KINDS = tuple(DEFAULT_TOKENS)
LEARNED_ROLE = "assistant"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


@dataclass
class Visitor:
    out: list[str] = field(default_factory=list)
    length: int = 0
    attachments: list[dict] = field(default_factory=list)
    loss: list[tuple[int, int]] = field(default_factory=list)
    expanded_tokens: int = 0
    pending: str = ""

    def put(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def turn(self, role: str | None, parts: Iterable[dict]) -> None:
        self.put(OPEN + escape(role or "") + HEAD)
        began = self.length
        for part in parts:
            kind = part.get("type") or "text"
            getattr(self, f"visit_{kind}", self.visit_text)(part)
        self.flush()
        if role == LEARNED_ROLE and self.length > began:
            self.loss.append((began, self.length))
        self.put(CLOSE)

    def visit_text(self, part: dict) -> None:
        self.pending += part.get("text") or ""

    def flush(self) -> None:
        """Texts that follow each other are escaped as one: a control string may begin in one and end in the next."""
        self.put(escape(self.pending))
        self.pending = ""

    def attach(self, part: dict, kind: str) -> None:
        self.flush()
        tokens = part.get("n_tokens")
        tokens = DEFAULT_TOKENS[kind] if tokens is None else tokens
        self.put(f"<|{kind}:{len(self.attachments)}|>")
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "n_tokens": tokens})
        self.expanded_tokens += tokens

    def visit_image(self, part: dict) -> None:
        self.attach(part, "image")

    def visit_audio(self, part: dict) -> None:
        self.attach(part, "audio")

    def visit_document(self, part: dict) -> None:
        self.attach(part, "document")


def format_turns(turns: Iterable[tuple[str | None, Iterable[dict]]]) -> dict:
    v = Visitor()
    for role, parts in turns:
        v.turn(role, parts)
    return {"formatted": "".join(v.out), "attachments": v.attachments, "loss_spans": [{"start": a, "stop": b} for a, b in v.loss], "expanded_tokens": v.expanded_tokens}


def parse(formatted: str) -> Iterator[tuple[str, list[dict]]]:
    """(role, parts) of each turn; an attachment comes back as its kind and number."""
    for turn in formatted.split(OPEN)[1:]:
        role, _, body = turn.removesuffix(CLOSE).partition(HEAD)
        parts, at = [], 0
        for m in PLACEHOLDER.finditer(body):
            if m.start() > at:
                parts.append({"type": "text", "text": unescape(body[at : m.start()])})
            parts.append({"type": m[1], "number": int(m[2])})
            at = m.end()
        if at < len(body) or not parts:
            parts.append({"type": "text", "text": unescape(body[at:])})
        yield unescape(role), parts


PARTS = "array<struct<type:string,text:string,ref:string,n_tokens:int>>"
FORMATTED = "formatted string, attachments array<struct<kind:string,ref:string,n_tokens:int>>, loss_spans array<struct<start:int,stop:int>>, expanded_tokens long"


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """One row for each conversation: id, formatted, attachments, loss_spans (code points), expanded_tokens.

    Turns are ordered by turn, then role and content. Content is the typed parts of
    parts_col, or the text as one part. A null text is empty, a null role is '', a null
    turn comes first, null ids are one conversation, repeated rows are turns of their
    own; an unknown part type is read as text. An empty table gives an empty result.
    """
    parts = F.col(parts_col) if parts_col else F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text_col, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("n_tokens")))
    rows = turns.select(F.col(id_col).cast("long").alias("id"), F.struct(F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), parts.cast(PARTS).alias("parts")).alias("turn"))
    grouped = rows.groupBy("id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    def formatted(batches):
        for batch in batches:
            made = [format_turns((t["role"], t["parts"] or []) for t in turns) for turns in batch.column("turns").to_pylist()]
            arrays = [batch.column("id"), pa.array([m["formatted"] for m in made], pa.string())]
            arrays.append(pa.array([m["attachments"] for m in made], pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("n_tokens", pa.int32())]))))
            arrays.append(pa.array([m["loss_spans"] for m in made], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))))
            arrays.append(pa.array([m["expanded_tokens"] for m in made], pa.int64()))
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "formatted", "attachments", "loss_spans", "expanded_tokens"])

    return grouped.mapInArrow(formatted, f"id long, {FORMATTED}").withColumnRenamed("id", id_col)


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the formatted output says, read back from it alone: counts and SHA-256 digests of its turns and of its loss mask."""

    def read(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                turns = [(role, "".join(p.get("text", "") for p in parts)) for role, parts in parse(text)]
                learned = "".join(unescape(PLACEHOLDER.sub("", text[s["start"] : s["stop"]])) for s in spans)
                whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                rows.append((len(turns), whole.hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    rows = formatted.select(F.col(id_col).cast("long").alias("id"), "formatted", "loss_spans")
    return rows.mapInArrow(read, "id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("id", id_col)
