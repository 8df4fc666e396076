"""Quality rules with adaptive thresholds.

Each text is measured; a mergeable quantile sketch of every measure is kept per
language and source: counts of values per logarithmic bucket, so that a quantile is
off by ``ERROR`` of its value at most. A sketch is a pure function of the rows it
stands for, in any order and partitioning, so reruns agree; sketches are merged by
adding counts. The fences of a group come from its quantiles,
``q3 + reach * (q3 - q1)`` and the same below ``q1`` where a measure can be too
low, and are joined to its documents, which pass or fail. A group of fewer than
``enough`` documents merges its sketches with those of its whole language, and
a small language with those of all documents, so that a fence never rests on a
handful of texts.

Most clean texts have none of what the rates measure (symbols, repeated lines,
repeated passages), so their quartiles can be equal; ``slack`` is what a value
may exceed its fence by, so that one symbol in such a group is no outlier. Such
a rate must also stay within ``TAIL`` of its group's 0.99 quantile, so that what a
source never has isn't let through up to the slack. A
short text's average strays further by chance: ``noise / sqrt(words)`` more is
allowed.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspark.session import cut_lineage

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutter")
#: name: (value as SQL, slack, noise, whether it can be too low); any can be too high.
MEASURES = {
    "symbols": ("n_symbols / greatest(n_words, 1)", 0.10, 0.0, False),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", 0.45, 1.0, False),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", 0.20, 0.0, False),
    "stutter": ("n_stutter / greatest(n_words, 1)", 0.15, 0.5, False),
    "word_length": ("word_chars / greatest(n_words, 1)", 1.0, 8.0, True),
}
#: What a rate may exceed the 0.99 quantile of its group by: slack, noise.
TAIL = {"symbols": (0.05, 0.0), "dup_lines": (0.15, 1.0), "repeats": (0.05, 1.0)}
ERROR = 0.005  # relative error of a quantile
_GROWTH = math.log((1 + ERROR) / (1 - ERROR))  # from one bucket to the next


def measure(text: str | None) -> tuple[int, ...]:
    """COUNTS of a whole text; a null text has no words.

    ``n_repeat_words`` counts the words inside any five-word window that occurs
    twice or more in the text, all occurrences included; ``n_stutter`` the words
    that equal the one before.
    """
    if not text:
        return (0,) * len(COUNTS)
    words = _WORD.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) < len(windows):
        often, upto = Counter(windows), 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + 5 - max(upto, i)
                upto = i + 5
    stutter = sum(map(str.__eq__, words, words[1:]))
    return n, sum(map(len, words)), len(_SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated, len(lines), stutter


def measured(docs: DataFrame, carry: list[str] | None = None, text_col: str = "text", lang_col: str = "lang",
             source_col: str = "source") -> DataFrame:
    """``row`` (struct of the carried columns), ``lang``, ``source`` and the COUNTS."""
    carry = docs.columns if carry is None else carry
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(lang_col).cast("string").alias("lang"),
                      F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([own.schema["row"], own.schema["lang"], own.schema["source"],
                           *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*map(measure, (t.as_py() for t in batch.column(3))))) or [[]] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x, pa.int64()) for x in found)],
                                             names=schema.names)

    return own.mapInArrow(run, schema)


def bucket(value: Column) -> Column:
    """Bucket of a value: null for 0, else k with growth^(k-1) < value <= growth^k."""
    return F.when(value > 0, F.ceil(F.log(value) / _GROWTH))


def bucket_value(k: Column) -> Column:
    """The value that is within ``ERROR`` of all values of a bucket."""
    return F.coalesce((1 - ERROR) * F.exp(k * _GROWTH), F.lit(0.0))


def sketches(rows: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``measure``, ``bucket``, ``n``: some hundred rows a group and measure, however
    many its texts. Tables of other days or corpora are merged with this one by ``merged``."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.expr(value)).alias("bucket"))
                               for m, (value, *_) in MEASURES.items()])).alias("of")
    return rows.select("lang", "source", each).groupBy("lang", "source", "of.measure", "of.bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(table: DataFrame, *keys: str) -> DataFrame:
    """Sketches of all rows of a table that share ``keys``."""
    return table.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def base_fails():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def quantiles(table: DataFrame, keys: list[str], ranks: dict[str, float]) -> DataFrame:
    """``keys``, ``measure``, ``total`` and a column for each of ``ranks``: the value of the bucket that
    holds the row of that rank. A window orders the buckets of one sketch."""
    within = Window.partitionBy(*keys, "measure")
    upto = table.select("*", F.sum("n").over(within.orderBy(F.asc_nulls_first("bucket")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)).alias("upto"), F.sum("n").over(within).alias("total"))
    return upto.groupBy(*keys, "measure").agg(F.max("total").alias("total"), *[
        F.min(F.when(F.col("upto") >= F.ceil(F.lit(p) * F.col("total")), bucket_value(F.col("bucket")))).alias(name)
        for name, p in ranks.items()])


def _fences(table: DataFrame, keys: list[str], reach: float, prefix: str) -> DataFrame:
    found = quantiles(table, keys, {"q1": 0.25, "q3": 0.75, "q99": 0.99})
    of = lambda m, value: F.max(F.when(F.col("measure") == m, value))  # noqa: E731  (one row a measure)
    out = [F.max("total").alias(f"{prefix}n")]
    for m, (_, slack, _, low) in MEASURES.items():
        spread = reach * (F.col("q3") - F.col("q1")) + slack
        out += [of(m, F.col("q3") + spread).alias(f"{prefix}hi_{m}"),
                (of(m, F.col("q1") - spread) if low else F.lit(float("-inf"))).alias(f"{prefix}lo_{m}")]
    out += [of(m, F.col("q99") + slack).alias(f"{prefix}tail_{m}") for m, (slack, _) in TAIL.items()]
    return found.groupBy(*keys).agg(*out)


def thresholds(table: DataFrame, reach: float = 3.0, enough: int = 100) -> DataFrame:
    """``hi_*``, ``lo_*`` and ``tail_*`` of every language and source of a sketch table."""
    own, lang, whole = (_fences(merged(table, *keys), keys, reach, p) for keys, p in (
        (["lang", "source"], "s_"), (["lang"], "l_"), ([], "w_")))
    lang = lang.withColumnRenamed("lang", "l_lang")
    all_ = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang"))).crossJoin(F.broadcast(whole))  # one row
    return all_.select("lang", "source", *[
        F.when(F.col("s_n") >= enough, F.col(f"s_{c}")).when(F.col("l_n") >= enough, F.col(f"l_{c}"))
        .otherwise(F.col(f"w_{c}")).alias(c) for c in [f"{side}_{m}" for m in MEASURES for side in ("hi", "lo")] + [f"tail_{m}" for m in TAIL]])


def fences_of(rows: DataFrame, reach: float = 3.0, enough: int = 100) -> DataFrame:
    """``thresholds`` from those rows of ``measured`` that pass the base."""
    table = cut_lineage(sketches(rows.where(~base_fails())), "sketches")
    return cut_lineage(thresholds(table, reach, enough), "fences")


def judge(rows: DataFrame, fences: DataFrame | None = None) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to the rows of ``measured``; without ``fences``
    they are read twice.

    Base: fewer than 10 words, or more than a fifth of the words repeated. Rows
    of a null language or source form groups of their own. The fences rest on
    documents that pass the base. Rows that repeat count, and are judged, as often
    as they come; a tied value passes a fence it equals. Very long texts are measured
    whole. Carried columns lie in ``row``, so names don't clash. An empty table gives an
    empty result.
    """
    fences = fences_of(rows) if fences is None else fences
    rows = rows.withColumn("base_failed", base_fails())
    fences = fences.withColumnRenamed("lang", "f_lang").withColumnRenamed("source", "f_source")
    inside = F.lit(True)
    for m, (value, _, noise, _) in MEASURES.items():
        value, stray = F.expr(value), noise / F.sqrt(F.greatest("n_words", F.lit(1)))
        inside = inside & (value - stray <= F.coalesce(F.col(f"hi_{m}"), F.lit(float("inf")))) & (
            value + stray >= F.coalesce(F.col(f"lo_{m}"), F.lit(float("-inf"))))
    for m, (_, noise) in TAIL.items():
        stray = noise / F.sqrt(F.greatest("n_words", F.lit(1)))
        inside = inside & (F.expr(MEASURES[m][0]) - stray <= F.coalesce(F.col(f"tail_{m}"), F.lit(float("inf"))))
    joined = rows.join(fences, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    return joined.select(*rows.columns, (~F.col("base_failed") & inside).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of ``docs``. Texts are measured twice, for
    the fences and for the verdicts, rather than written once more."""
    counts = cut_lineage(measured(docs, carry=["lang"]).drop("row"), "measured")
    return judge(measured(docs), fences_of(counts)).where("kept").select("row.*")
