"""Packing: shortest pack first over the histogram of piece lengths.

Documents are tokenised, closed by an end id and cut into full pieces of
``most`` ids and a remainder. Only the histogram of piece lengths, at most
``most`` rows, comes to the driver. Lengths are placed longest first, each on
the shortest open pack it fits on; packs with equal contents are one pattern
with a count, so the work doesn't grow with the documents. Each slot of a
pattern then owns a range of ranks among the pieces of its length, and a piece
finds its sequence by its rank.

Ranks are counted without sorting: a piece is numbered within its task and
length while it is written, and gets the count of that length in earlier tasks
as offset, so a frequent length is never gathered.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspark.session import cut_lineage

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
CACHED_WORDS = 600_000  # of a task's word cache, about 130 MB
BATCH_CHARS = 2_000_000  # text whose ids are held at a time


def tokenizer_paths() -> tuple[str, str]:
    """The tokenizer's file and the same vocabulary as ranks."""
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS)


class Words(dict):
    """Ids of the parts of a text; a new part is encoded when it is first asked for, and all
    are forgotten when there are too many. A part stands for a space and itself; it is taken
    as it is if it starts with a line feed, and without its mark if that is a NUL."""

    def __init__(self, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.ordinary = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens={}).encode_ordinary

    def __missing__(self, part: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = self.ordinary(part[1:] if part[0] == "\0" else part if part[0] == "\n" else " " + part)
        self[part] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer never joins two words over a single space or line feed, so a text
    whose only white space is of that kind is encoded word by word from the
    vocabulary's ranks, most words from ``Words``. Any other text, and one in which
    a special token may occur, goes through the tokenizer as a whole.
    """

    def __init__(self, paths: tuple[str, str]):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(paths[0])
        self.words = Words(paths[1])
        self.other_blank = re.compile(r"[^\S \n]").search

    def odd(self, text: str) -> bool:
        return (not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text
                or "\n\n" in text or "<|" in text or "\0" in text or self.other_blank(text) is not None)

    def encode(self, text: str) -> bytes:
        if self.odd(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.words.__getitem__, ("\0" + text.replace("\n", " \n")).split(" ")))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(paths: tuple[str, str]) -> Encoder:
    """One per Python worker."""
    if paths not in _ENCODERS:
        _ENCODERS[paths] = Encoder(paths)
    return _ENCODERS[paths]


def slices(texts: list[str], chars: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``chars`` characters, of one text at least."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def cut_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 1024, end_id: int = 0,
               paths: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``most`` ids: the identifier, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``ids`` (with ``with_ids``), and for ``pack`` ``task`` and ``nth``
    (number among the task's pieces of that length).

    A null text is empty; an empty text is one piece, the end id; a very long one is cut
    whole, its ids held as bytes. Rows that repeat are packed as often as they come, null
    identifiers are kept. Other columns are not read, so names can't clash. An empty table
    gives an empty result.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type)] + [T.StructField(n, T.LongType()) for n in (
        "start", "length", "ids_crc32", "doc_tokens", "task", "nth")])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.LongType()))
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(most + 1, dtype=np.int64)
        encode = encoder(paths or tokenizer_paths()).encode
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in slices(texts):
                row, start, length, crc, total, nth, ids = [], [], [], [], [], [], []
                for i in range(lo, hi):
                    own = encode(texts[i]) + end
                    n = len(own) // 4
                    for s in range(0, n, most):
                        piece = own[4 * s:4 * (s + most)]
                        size = len(piece) // 4
                        row.append(i)
                        start.append(s)
                        length.append(size)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        nth.append(seen[size])
                        seen[size] += 1
                        if with_ids:
                            ids.append(np.frombuffer(piece, dtype="<u4").astype(np.int64))
                cols = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (
                    start, length, crc, total, [task] * len(row), nth))]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


@dataclass
class Slot:
    """The ``count`` pieces of ``length`` with ranks from ``rank`` lie in the sequences from ``sequence``, at ``offset``."""
    length: int
    rank: int
    count: int
    sequence: int
    offset: int


def pack_histogram(histogram: dict[int, int], most: int) -> list[Slot]:
    """Shortest pack first: pattern counts for a histogram of lengths, as slots."""
    room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(most + 1)]  # open patterns by free space
    done: list[tuple[tuple[int, ...], int]] = []
    widest = 0

    def put(pattern: tuple[int, ...], count: int, free: int) -> None:
        nonlocal widest
        if free:
            room[free].append((pattern, count))
            widest = max(widest, free)
        else:
            done.append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            while widest and not room[widest]:
                widest -= 1
            if widest < length:  # no open pack has room
                put((length,), left, most - length)
                break
            free = widest
            pattern, count = room[free].pop()
            used = min(count, left)
            if count > used:
                room[free].append((pattern, count - used))
            put((*pattern, length), used, free - length)
            left -= used
    done += [x for patterns in room for x in patterns]
    slots, ranks, sequence = [], dict.fromkeys(histogram, 0), 0
    for pattern, count in done:
        offset = 0
        for length in pattern:
            slots.append(Slot(length, ranks[length], count, sequence, offset))
            ranks[length] += count
            offset += length
        sequence += count
    return slots


def pack(pieces: DataFrame, most: int = 1024) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the pieces of ``cut_pieces``: each sequence holds
    at most ``most`` ids, without gaps from 0. Pieces of equal length (ties) are taken in the order of
    their tasks and places. Columns of the pieces are kept; an empty table gives an empty
    result."""
    pieces = cut_lineage(pieces, "pieces")  # a task's numbers must not change
    counts = cut_lineage(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = sorted(pack_histogram(histogram, most), key=lambda s: (s.length, s.rank))
    lengths, ranks, sequences, offsets = (np.array([getattr(s, k) for s in slots], dtype=np.int64)
                                          for k in ("length", "rank", "sequence", "offset"))
    first = np.searchsorted(lengths, np.arange(most + 2))  # of each length's slots
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank, at = length.to_numpy(), rank.to_numpy(), np.zeros(len(length), dtype=np.int64)
        for n in np.unique(length):
            own, lo, hi = length == n, first[n], first[n + 1]
            at[own] = lo + np.searchsorted(ranks[lo:hi], rank[own], side="right") - 1
        return pd.DataFrame({"sequence_id": sequences[at] + rank - ranks[at], "offset": offsets[at]})

    keep = [c for c in pieces.columns if c not in ("task", "nth")]
    return (pieces.join(before, ["length", "task"])
            .withColumn("_place", place("length", F.col("before") + F.col("nth")))
            .select(*keep, "_place.sequence_id", "_place.offset"))
