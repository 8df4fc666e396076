"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into words as the tokenizer cuts it (special strings first, then
composed form, lower case, words). A word starts as one symbol a byte, held in a
linked list, the last one marked as the word's end; all neighbouring pairs that
can merge lie in a heap by rank and place. The lowest is popped again and again
and its two symbols merged, which makes at most two new pairs; an entry whose
symbols have changed since is skipped. A word of n bytes takes n log n steps, so
a word that is a whole long text is fine. The count is the initial symbols minus
the merges; no identifier is looked up.

The tokenizer's file gives the merges. Common words are counted once per task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "word_bpe_49k.json"
CACHED_WORDS = 300_000  # of a task's word cache, about 40 MB
CACHED_CHARS = 40  # longer words are counted anew
# The tokenizer's pattern of words, for ASCII texts and for any others.
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r 0-9a-z]+"
ANY_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(other)) for b in range(256)]


def unassigned() -> str:
    """A character class of the code points that Python's tables don't know."""
    import unicodedata

    cps = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]
    starts = [c for i, c in enumerate(cps) if not i or cps[i - 1] != c - 1]
    ends = [c for i, c in enumerate(cps) if i + 1 == len(cps) or cps[i + 1] != c + 1]
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends)) + "]"


class Counter(dict):
    """Words and their token counts; a new word is counted when it is first asked for, and
    all are forgotten when there are too many."""

    def __init__(self, path: str):
        import unicodedata

        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(spec["model"]["merges"])}
        self.end = spec["model"]["end_of_word_suffix"]
        special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))).split
        self.letters = byte_letters()
        self.ascii_words = re.compile(ASCII_WORDS).findall
        self.any_words = regex.compile(ANY_WORDS).findall
        self.unknown = re.compile(unassigned()).search
        self.composed = lambda text: unicodedata.normalize("NFC", text)
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer

    def __missing__(self, word: str) -> int:
        n = self.merged([self.letters[b] for b in word.encode()])
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = n
        return n

    def merged(self, symbols: list[str]) -> int:
        """Symbols that are left of a word after all merges."""
        rank_of, n = self.ranks.get, len(symbols)
        symbols[-1] += self.end
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        heap = [(rank, i) for i, pair in enumerate(zip(symbols, symbols[1:])) if (rank := rank_of(pair)) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if symbols[i] is None or j >= n or rank_of((symbols[i], symbols[j])) != rank:
                continue  # one of the two has merged with another symbol since
            symbols[i] += symbols[j]
            symbols[j] = None
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (new := rank_of((symbols[i], symbols[k]))) is not None:
                    heappush(heap, (new, i))
            h = before[i]
            if h >= 0 and (new := rank_of((symbols[h], symbols[i]))) is not None:
                heappush(heap, (new, h))
        return left

    def count(self, text: str) -> int:
        """Tokens of a whole text; a special string in it is one token."""
        parts = self.split_special(text) if "<|" in text else [text]
        total = len(parts) - 1
        for part in parts:
            if part.isascii():
                total += sum(map(self.__getitem__, self.ascii_words(part.lower())))
            elif self.unknown(part):  # letters newer than Python's tables: the library's own cut
                total += sum(self.merged(list(word)) for word, _ in
                             self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part)))
            else:  # the tokenizer lowers each letter by itself, so a last sigma too
                low = self.composed(part).replace("Σ", "σ").lower()
                total += sum(map(self.__getitem__, self.any_words(low)))
        return total


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One per Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def counted(docs: DataFrame, carry: list[str] | None = None, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``row`` (struct of the carried columns, all by default, so no name clashes),
    ``n_bytes`` (of the text in UTF-8) and ``n_tokens``.

    A null or empty text, or one of white space only, has 0 tokens. Texts are
    counted whole, however long. Rows that repeat are counted as often as they
    come; an empty table gives an empty result. ``path`` is the tokenizer's
    file on every executor.
    """
    carry = docs.columns if carry is None else carry
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
                      F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([own.schema["row"], T.StructField("n_bytes", T.LongType(), False),
                           T.StructField("n_tokens", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path or tokenizer_path()).count
        for batch in batches:
            texts = batch.column(1)
            n = pa.array([count(t.as_py()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(texts).cast(pa.int64()), n], names=schema.names)

    return own.mapInArrow(run, schema)


def over_limit(limit: int = 2048) -> Column:
    return F.col("n_tokens") > limit
