"""Chat formatting with typed content parts.

A message holds parts: text, image, audio or document. A visitor flattens them in
order: text is escaped, any other part becomes its placeholder, once, with the
attachment's reference and the number of tokens it stands for recorded beside
the output. A turn is written as ``<|turn|>role``, a line feed, its content and
``<|end|>`` with a line feed; the loss mask covers the content of assistant
turns.

Escaping: where a text holds a control string (this template's or a common
template's), a backslash goes in after its first character; a text that already
has backslashes there gets one more, so unescaping, which removes one, is exact.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
#: What may follow "<" or "[" in a control string; the same in RE2.
TAIL = r"\|[A-Za-z0-9_]*\|>|/?s>|/?SYS>>|/?INST\]"
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={TAIL})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={TAIL})")
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def escape_role(role: str) -> str:
    """A role ends at its line feed, so it can hold none."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), unescape(role))


class PartVisitor:
    """Flattens the parts of one message. ``patch`` pixels, ``hop`` seconds and ``page``
    tokens say what an image, audio and document stand for."""

    def __init__(self, patch: int = 28, hop: float = 0.08, page: int = 256):
        self.patch, self.hop, self.page = patch, hop, page
        self.out: list[str] = []
        self.attachments: list[dict] = []
        self.tokens = 0

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_other(self, part: dict) -> None:
        raise ValueError(f"unknown content part: {part.get('type')}")

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "at": sum(map(len, self.out)), "tokens": tokens})
        self.tokens += tokens
        self.out.append(f"<|{kind}|>")

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil((part.get(k) or self.patch) / self.patch) for k in ("width", "height"))
        self._attach("image", part, across * down)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0) / self.hop))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, self.page * (part.get("pages") or 1))


def format_turn(role: str | None, parts: Iterable[dict] | None) -> tuple[str, int, int, list[dict], int]:
    """Formatted turn, start and end of its loss (equal: none), attachments (placed in
    the formatted turn) and expanded tokens of the attachments."""
    visitor = PartVisitor()
    for part in parts or ():
        visitor.visit(part or {})
    head, body = f"{TURN}{escape_role(role or '')}\n", "".join(visitor.out)
    for a in visitor.attachments:
        a["at"] += len(head)
    loss = len(head) + (len(body) if role == "assistant" else 0)
    return head + body + END, len(head), loss, visitor.attachments, visitor.tokens


def format_messages(messages: DataFrame) -> DataFrame:
    """One row per message of (conv_id, turn, role, parts: array of PART): ``formatted``,
    ``loss_start``, ``loss_end`` (code points in it), ``attachments`` and
    ``attachment_tokens``. Joined in the order of turns, the rows of a conversation
    are its formatted text.

    Messages are formatted where they lie, so a long conversation needs no task
    of its own. Null roles and parts are empty. An empty table gives an empty
    result; other columns are dropped; rows that repeat are repeated turns.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct(
            [("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())])), pa.int64())
        for batch in batches:
            rows = [format_turn(r, p) for r, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, cols, kinds)], names=names)

    names = ["conv_id", "turn", "role", "formatted", "loss_start", "loss_end", "attachments", "attachment_tokens"]
    own = messages.select("conv_id", "turn", "role", F.col("parts").cast(f"array<{PART}>"))
    t = dict(own.dtypes)
    return own.mapInArrow(run, f"conv_id {t['conv_id']}, turn {t['turn']}, role {t['role']}, formatted string, "
                               "loss_start long, loss_end long, "
                               "attachments array<struct<kind:string,ref:string,at:long,tokens:long>>, attachment_tokens long")


def text_messages(rows: DataFrame) -> DataFrame:
    """Messages of one text part from (conv_id, turn, role, text)."""
    part = F.struct(F.lit("text").alias("type"), F.col("text").cast("string").alias("text"), *[
        F.lit(None).cast(k).alias(n) for n, k in (("ref", "string"), ("width", "int"), ("height", "int"),
                                                  ("seconds", "double"), ("pages", "int"))])
    return rows.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.array(part).alias("parts"))


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text, unescaped."""
    out = []
    for turn in formatted.split(TURN)[1:]:
        role, _, body = turn.partition("\n")
        out.append((unescape_role(role), unescape(body.removesuffix(END))))
    return out


def digests(formatted: DataFrame) -> DataFrame:
    """Reads the output back: per conversation ``n_turns``, ``turns_sha256``,
    ``loss_chars``, ``loss_sha256``, ``formatted_chars``.

    A digest runs over a conversation's turns in order. They are brought together
    sorted and stream through the hash, so a conversation of any length needs the
    memory of one batch. Turns that tie are ordered by role and content.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now, state = None, None

        def close() -> None:
            if state:
                rows.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows)) or [[]] * 6
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        for batch in batches:
            for conv, text, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (conv,):
                    close()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, content in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{content}\n".encode())
                loss = unescape(text[lo:hi])
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(text)
            yield flush()
        close()
        yield flush()

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    own = (formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
           .select(F.col("conv_id").cast("long"), "formatted", "loss_start", "loss_end"))
    return own.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                               "formatted_chars long")
