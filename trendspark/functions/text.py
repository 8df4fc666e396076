"""Text scalar functions as built-in Column expressions (JVM-side, codegen).

The whitespace class below is the set Python's ``\\s`` matches on str, written
with ``\\x{..}`` escapes that Java regex and RE2 read alike; this keeps the
cleaning identical to the reference and to the SQL oracle.
"""

from __future__ import annotations

import string

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Python str whitespace: \t \n \v \f \r, space, \x1c-\x1f, \x85, \xa0,  ,
#  - ,  ,  ,  ,  , 　.
WS = (r"\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_text(c) -> Column:
    """``str(x).lower()``: null becomes 'none'."""
    return F.lower(F.coalesce(_c(c).cast("string"), F.lit("None")))


def _cleaner(kept: str):
    """Of lower-case texts only the characters ``kept`` and single spaces; by Arrow batches, as the JVM's
    regular expressions take ten times as long. Nested, so that tasks needn't import this module."""
    def clean(texts: pa.Array) -> pa.Array:
        import re

        import pyarrow

        gone = bytes(b for b in range(128) if chr(b) not in kept and not chr(b).isspace())
        spaces = bytes(32 if b < 128 and chr(b).isspace() else b for b in range(256))
        other = re.compile(rf"[^{kept}\s]+")  # \s and split() take exactly the characters of WS

        def one(t: str) -> str:
            if t.isascii():
                return b" ".join(t.encode().translate(spaces, gone).split()).decode()
            return " ".join(other.sub("", t).split())

        return pyarrow.array([None if t is None else one(t) for t in texts.to_pylist()], pyarrow.string())

    return F.arrow_udf(clean, "string")


def clean_alpha(c) -> Column:
    """Lower, keep a-z and whitespace, collapse whitespace, strip."""
    return _cleaner(string.ascii_lowercase)(as_text(c))


def clean_alnum(c) -> Column:
    """As T1 but digits are kept."""
    return _cleaner(string.ascii_lowercase + string.digits)(as_text(c))


def tokens(clean) -> Column:
    """Whitespace tokens of cleaned text; '' gives an empty list."""
    return F.filter(F.split(_c(clean), " "), lambda x: x != "")


def raw_word_count(c) -> Column:
    """T4 on raw text: ``len(str.split())``."""
    return F.size(F.filter(F.split(_c(c), f"[{WS}]+"), lambda x: x != ""))


def richness(tok) -> Column:
    """T5: distinct tokens / (tokens + 1)."""
    t = _c(tok)
    return F.size(F.array_distinct(t)) / (F.size(t) + F.lit(1))


def once(value, fn) -> Column:
    """``fn`` of a costly ``value`` that it uses several times: the value is bound to a variable, as the
    plan would otherwise compute it anew at each use."""
    return F.get(F.transform(F.array(_c(value)), fn), F.lit(0))


def _bigrams(t: Column) -> Column:
    n = F.size(t)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(
        F.zip_with(F.slice(t, 1, n - 1), F.slice(t, 2, n - 1),
                   lambda a, b: F.concat_ws(" ", a, b)))


def bigrams(tok) -> Column:
    """Adjacent pairs joined by one space (empty for fewer than 2 tokens)."""
    return once(tok, _bigrams)


def query_vocab(tok) -> Column:
    """Set of tokens and bigrams."""
    return once(tok, lambda t: F.array_union(F.array_distinct(t), _bigrams(t)))


def vectorizer_terms(clean, stop_col) -> Column:
    """Tokens of 2+ word characters, stop words removed, then 1-2 grams
    over the filtered list. ``stop_col`` is the filtered-token column."""
    return once(stop_col, lambda t: F.concat(t, _bigrams(t)))


def word_tokens(clean) -> Column:
    """``\\b\\w\\w+\\b`` tokens (on cleaned text only a-z0-9 remain)."""
    return F.regexp_extract_all(_c(clean), F.lit(r"\b\w\w+\b"), 0)


def contains_any(c, words: list[str]) -> Column:
    """T16 / J5 style: any keyword occurs as a substring."""
    col = _c(c)
    out = F.lit(False)
    for w in words:
        out = out | F.contains(col, F.lit(w))
    return out


def title_case_words(c) -> Column:
    """Python ``str.title`` on a single lowercase word-like token."""
    return F.initcap(_c(c))


def shorten(c, limit: int, keep: int | None = None, ellipsis: str = "...") -> Column:
    """Texts longer than ``limit`` become their first ``keep`` characters
    plus the ellipsis (labels: 55 -> 52 + '...'; plot forms 28 + '...', 18 + '…')."""
    col = _c(c)
    keep = limit - len(ellipsis) if keep is None else keep
    return F.when(F.length(col) > limit, F.concat(F.substring(col, 1, keep), F.lit(ellipsis))).otherwise(col)


def percent_text(x) -> Column:
    """min(x, 1) * 100 with one decimal and a percent sign."""
    return F.format_string("%.1f%%", F.least(_c(x), F.lit(1.0)) * 100)
