"""Source divergence audit: how far the sources of a language differ in their words.

Each task runs its texts through Arrow's own kernels: ``ascii_lower``,
``split_pattern_regex``, ``dictionary_encode`` and two hash ``group_by``s (by text
and term, then by language, source and term), and sends partial counts only. They
are summed by key, the terms of a language that too few of its texts hold go, and
the rest is dealt by the terms' hash into shards of a bounded number of cells. A
shard is one columnar table: a matrix of its sources and terms, zeros included,
from which it computes its share of every divergence. Shares are added up.

All arithmetic is on integers. With ``count`` occurrences of a term in a group, N
of all kept terms there, and V kept terms of the language,

    p = 1 + floor(10^9 * (count + 2) / (N + 2 * V))
    f = floor((p - q)^2 / (p + q))

where q is the other source's p (part ``pair``, summed over all kept terms) or
that of the whole language (part ``term``). N + 2 * V may reach 9 * 10^15.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendspark.session import cut_lineage

#: What lies between terms: ASCII characters that are no letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
BATCH_BYTES = 8_000_000  # text that is split at a time, one text at least
HELD_ROWS = 400_000  # partial counts that a task holds, about 40 MB
CELLS = 1_000_000  # of a shard: sources x terms
PARTIAL = "lang string, source string, term string, n long, docs long"
SHARE = "lang string, source string, part string, item string, value long"


# ---------------------------------------------------------------- partial counts

def pieces(batch: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes of text."""
    upto = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(upto):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def term_counts(batch: pa.RecordBatch) -> pa.Table:
    """``PARTIAL`` of a slice; every language and source has a row of a null term, which holds
    its number of texts, so that groups without terms occur too."""
    words = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), pattern=BETWEEN)
    flat, text = pc.list_flatten(words), pc.list_parent_indices(words)
    filled = pc.greater(pc.binary_length(flat), 0)
    terms = flat.filter(filled).dictionary_encode()
    by_text = pa.table({"text": text.filter(filled), "term": terms.indices}).group_by(
        ["text", "term"], use_threads=False).aggregate([([], "count_all")])
    lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    found = pa.table({"lang": lang.indices.take(by_text["text"]), "source": source.indices.take(by_text["text"]),
                      "term": by_text["term"], "n": by_text["count_all"]}).group_by(
        ["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ([], "count_all")])
    counts = pa.table({"lang": lang.dictionary.take(found["lang"]), "source": source.dictionary.take(found["source"]),
                       "term": terms.dictionary.take(found["term"]), "n": found["n_sum"], "docs": found["count_all"]})
    groups = pa.table({"lang": batch.column("lang"), "source": batch.column("source")}).group_by(
        ["lang", "source"], use_threads=False).aggregate([([], "count_all")])
    empty = pa.table({"lang": groups["lang"], "source": groups["source"], "term": pa.nulls(len(groups), flat.type),
                      "n": pa.array(np.zeros(len(groups), dtype=np.int64)), "docs": groups["count_all"]})
    return pa.concat_tables([counts, empty])


def added(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return out.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])


def partial_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts by language, source and term as the tasks found them: to be summed by key, also
    with those of other tables. Nulls count as ''."""
    own = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in (
        (lang_col, "lang"), (source_col, "source"), (text_col, "text"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for piece in pieces(batch):
                held.append(term_counts(piece))
                rows += len(held[-1])
                if rows > HELD_ROWS:
                    held = [added(held)]
                    rows = len(held[0])
                    if rows > HELD_ROWS // 2:
                        yield from held[0].combine_chunks().to_batches(max_chunksize=50_000)
                        held, rows = [], 0
        if held:
            yield from added(held).combine_chunks().to_batches(max_chunksize=50_000)

    return own.mapInArrow(run, PARTIAL)


# ---------------------------------------------------------------- counts of kept terms

def merged_counts(partials: DataFrame) -> DataFrame:
    return partials.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_counts(counts: DataFrame, least_docs: int = 10) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` of the terms that ``least_docs`` texts of the language
    hold; ``first`` marks one row of each of the language's terms. A window holds one term's
    sources."""
    term = Window.partitionBy("lang", "term")
    return counts.where("term is not null").select("*", F.sum("docs").over(term).alias("held_by"),
                                                   F.row_number().over(term.orderBy("source")).alias("nth")) \
        .where(F.col("held_by") >= least_docs).select("lang", "source", "term", "n", (F.col("nth") == 1).alias("first"))


def group_totals(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """Every occurring language and source with ``total`` (N) and ``vocabulary`` (V)."""
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("first").cast("long")).alias("firsts"))
    groups = counts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left")
    return groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"),
                         F.sum(F.coalesce("firsts", F.lit(0))).over(Window.partitionBy("lang")).alias("vocabulary"))


# ---------------------------------------------------------------- shards

def scaled(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / total), three digits at a time so that nothing overflows."""
    rest, out = count + 2, np.zeros(np.broadcast(count, total).shape, dtype=np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def shares(lang: str, shard: int, counts: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """A shard's part of every pair of sources, and its best ``top`` terms of each source. Pairs
    of a language without kept terms come from shard 0, as zeros."""
    groups = groups.sort_by("source")
    sources, k = groups["source"].to_pylist(), len(groups)
    if not len(counts) and shard:
        return pa.Table.from_batches([], pa.schema([(c, pa.string()) for c in ("lang", "source", "part", "item")] + [("value", pa.int64())]))
    a, b = np.nonzero(~np.eye(k, dtype=bool))
    value, best = np.zeros(len(a), dtype=np.int64), []
    if len(counts):
        place = {s: i for i, s in enumerate(sources)}
        terms, owner = (counts[c].combine_chunks().dictionary_encode() for c in ("term", "source"))
        of = np.array([place[s] for s in owner.dictionary.to_pylist()])[owner.indices.to_numpy()]
        n = np.zeros((k, len(terms.dictionary)), dtype=np.int64)
        n[of, terms.indices.to_numpy()] = counts["n"].to_numpy()
        total, vocabulary = groups["total"].to_numpy(), int(groups["vocabulary"][0].as_py())
        p = scaled(n, (total + 2 * vocabulary)[:, None])
        q = scaled(n.sum(axis=0), np.int64(total.sum() + 2 * vocabulary))
        apart = np.zeros((k, k), dtype=np.int64)
        for i in range(k - 1):
            apart[i, i + 1:] = distance(p[i], p[i + 1:]).sum(axis=1)
        value = (apart + apart.T)[a, b]
        names = terms.dictionary.to_pylist()
        for i in range(k):
            over = np.nonzero((n[i] > 0) & (p[i] > q))[0]
            f = distance(p[i][over], q[over])
            if len(over) > top:  # none below the top-th value can be among the best; ties are sorted by name
                over, f = over[f >= (cut := np.partition(f, -top)[-top])], f[f >= cut]
            ranked = sorted(zip((-f).tolist(), (names[t] for t in over.tolist())))[:top]
            best += [(sources[i], name, -v) for v, name in ranked]
    at = [sources[i] for i in a] + [s for s, _, _ in best]
    return pa.table({"lang": pa.array([lang] * len(at), pa.string()), "source": pa.array(at, pa.string()),
                     "part": pa.array(["pair"] * len(a) + ["term"] * len(best), pa.string()),
                     "item": pa.array([sources[i] for i in b] + [t for _, t, _ in best], pa.string()),
                     "value": pa.array(np.concatenate([value, np.array([v for *_, v in best], dtype=np.int64)]), pa.int64())})


def divergences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                least_docs: int = 10, top: int = 10, cells: int = CELLS) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: every other source of the language
    by falling divergence (``pair``), and the ``top`` terms that a source uses more than its
    language does (``term``); equal values by the item's UTF-8 bytes.

    Null texts, languages and sources count as ''. Texts are read whole, however
    long; rows that repeat count as often as they come; other columns are not
    looked at, so names can't clash. A language with no kept term has pairs of
    value 0 and no terms, a language of one source no pairs, an empty table an
    empty result. The result holds all pairs of a language's sources by definition,
    so sources are meant to be some thousands at most; terms have no such bound.
    """
    counts = cut_lineage(merged_counts(partial_counts(docs, text_col, lang_col, source_col)), "term-counts")
    kept = cut_lineage(kept_counts(counts, least_docs), "kept-terms")
    groups = cut_lineage(group_totals(counts, kept), "groups")
    size = groups.groupBy("lang").agg((F.max("vocabulary") * F.count(F.lit(1))).alias("cells")).agg(F.max("cells")).first()[0]
    shards = max(1, math.ceil((size or 0) / cells))
    dealt = kept.select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"))
    copies = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return shares(key[0].as_py(), key[1].as_py(), left, right, top)

    parts = dealt.groupBy("lang", "shard").cogroup(copies.groupBy("lang", "shard")).applyInArrow(run, SHARE)
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")) \
        .select("*", F.row_number().over(order).alias("rank")).where((F.col("part") == "pair") | (F.col("rank") <= top))
