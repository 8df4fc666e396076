"""Near-duplicate classes by BagMinHash.

A text is the multiset of its five-word shingles. Each shingle owns Poisson
processes in time, one for every level of its weight: [0, 1), [1, 2), [2, 4),
[4, 8), ... with the level's width as rate. A point has a time, a slot of the
signature and a place in its level; it counts if the place is below the
shingle's weight, so equal shingles of two texts share exactly the points below
the smaller weight. A slot keeps its earliest point, and two texts agree in a
slot with the probability of their weighted Jaccard similarity, without bias.
Points come in order of time, so a process stops as soon as it is later than
every slot: about ``m ln m`` points a text beyond the first of each shingle.

Bands of the signature put texts into buckets. Candidates are compared by
signature and those that may reach the threshold are verified on their texts.

1. Texts of equal words collapse to one node, so copies never meet each other.
2. Each node is compared with the smallest node of its buckets (linear work);
   the verified links give components.
3. In a bucket that still holds several components the members outside its
   largest component are compared with all other members, in blocks of a bounded
   size. Only members that have a candidate go on, each once per block, to be
   verified there, until they are linked: a large group is one component by now
   and its members never meet each other.

Texts to verify are fetched by a join; a bitmap of 2^26 hashed names, 8 MB at any
size, keeps most other texts out of its shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.llm.common import text_or_empty
from trendspark.operators.components import components
from trendspark.session import cut_lineage

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 30, 6  # a pair at 0.8 shares a bucket with probability 0.9999
SLOTS = BANDS * ROWS
#: Estimates below are not verified: 5 standard errors (0.03) under the threshold.
ESTIMATE = 0.65
BLOCK = 1024  # members of a bucket that one task compares with as many others
LINK = "a long, b long, similarity double"
HOT_KEYS = 1000
BITMAP = 1 << 26
CACHED_WORDS = 250_000
BATCH_WORDS = 250_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_U = np.uint64


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text or "")


def shingles(words: list[str]) -> Counter:
    """Shingles with their counts; fewer than five words are one shingle, none is none."""
    if len(words) < SHINGLE:
        return Counter([tuple(words)] if words else [])
    return Counter(zip(*(words[i:] for i in range(SHINGLE))))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of two multisets; 1 for two empty ones."""
    if len(b) < len(a):
        a, b = b, a
    shared = sum(min(n, b[s]) for s, n in a.items() if s in b)
    total = a.total() + b.total() - shared
    return shared / total if total else 1.0


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """``similarity`` of two multisets as sorted shingle hashes with weights."""
    if len(b[0]) < len(a[0]):
        a, b = b, a
    total = int(a[1].sum() + b[1].sum())
    if not len(a[0]):
        return float(not total)
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    shared = int(np.minimum(a[1][both], b[1][at[both]]).sum())
    return shared / (total - shared)


def node_of(words: list[str]) -> int:
    """64-bit name of a sequence of words."""
    return int.from_bytes(hashlib.blake2b(" ".join(words).encode(), digest_size=8).digest(), "little", signed=True)


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Signer:
    """Signatures of texts; keeps hashes of words (cleared when there are too many)."""

    def __init__(self) -> None:
        from xxhash import xxh3_64_intdigest
        self.hash, self.known = xxh3_64_intdigest, {}
        self.place = _mix(np.arange(1, SHINGLE + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)

    def _hashes(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), dtype=_U, count=len(words))
        except KeyError:
            for w in set(words):
                if w not in known:
                    known[w] = self.hash(w)
            return np.fromiter(map(known.__getitem__, words), dtype=_U, count=len(words))

    def shingle_weights(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        h = self._hashes(words)
        n = max(len(h) - SHINGLE + 1, 1 if len(h) else 0)
        width = min(len(h), SHINGLE)
        out = np.zeros(n, dtype=_U)
        for i in range(width):
            out = _mix(out + h[i:i + n] * self.place[i])
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        return np.unique(out, return_counts=True)

    def sign(self, sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """One row of SLOTS point names per set of (shingle, weight)."""
        doc = np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets])
        shingle = np.concatenate([s for s, _ in sets]) if sets else np.zeros(0, dtype=_U)
        weight = np.concatenate([w for _, w in sets]).astype(np.int64) if sets else np.zeros(0, dtype=np.int64)
        parts, level, lower = [], 0, 0
        while True:  # the processes of each level that reaches below the weight
            own = np.flatnonzero(weight > lower)
            if not len(own):
                break
            width = max(lower, 1)
            parts.append((doc[own], _mix(shingle[own] + _U(level * 0xD1B54A32D192ED03 % 2 ** 64)), weight[own],
                          np.full(len(own), lower), np.full(len(own), width)))
            level, lower = level + 1, lower + width
        earliest = np.full(len(sets) * SLOTS, np.inf)
        name = np.zeros(len(sets) * SLOTS, dtype=_U)
        if not parts:
            return name.reshape(len(sets), SLOTS)
        doc, seed, weight, lower, width = map(np.concatenate, zip(*parts))
        time, latest, point = np.zeros(len(doc)), np.full(len(sets), np.inf), 0
        active = np.arange(len(doc))
        while len(active):
            point += 1
            draw = _mix(seed[active] + _U(point * 0x9E3779B97F4A7C15 % 2 ** 64))
            time[active] -= np.log(((draw >> _U(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / width[active]
            early = time[active] < latest[doc[active]]
            active, draw = active[early], draw[early]
            which = _mix(draw ^ _U(0xA0761D6478BD642F))
            spot = lower[active] + ((which & _U(0xFFFFFFFF)) * width[active].astype(_U) >> _U(32)).astype(np.int64)
            below = spot < weight[active]
            hit, which = active[below], which[below]
            slot = doc[hit] * SLOTS + ((which >> _U(32)) % _U(SLOTS)).astype(np.int64)
            better = time[hit] < earliest[slot]
            hit, which, slot = hit[better], which[better], slot[better]
            np.minimum.at(earliest, slot, time[hit])
            won = time[hit] == earliest[slot]
            name[slot[won]] = which[won]
            changed = np.unique(doc[hit[won]])
            latest[changed] = earliest.reshape(-1, SLOTS)[changed].max(axis=1)
        return name.reshape(len(sets), SLOTS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key per band."""
    keys = np.tile(_mix(np.arange(1, BANDS + 1, dtype=_U)), (len(signature), 1))
    cells = signature.reshape(len(signature), BANDS, ROWS)
    for i in range(ROWS):
        keys = _mix(keys + cells[:, :, i] * _U(0x9E3779B97F4A7C15))
    return keys.view(np.int64)


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``text_key``, ``node``, ``size`` (shingles), ``bands`` (a key per band; empty for a
    text without words) and ``sig`` (a byte per slot)."""
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(F.col(text_col))).alias("text_key"),
                      F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            at = 0
            while at < len(texts):
                nodes, sets, size, lo = [], [], 0, at
                while at < len(texts) and size < BATCH_WORDS:
                    words = words_of(texts[at])
                    nodes.append(node_of(words))
                    sets.append(signer.shingle_weights(words))
                    size += len(words)
                    at += 1
                signature = signer.sign(sets)
                keys, short = band_keys(signature), (signature & _U(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, at - lo), batch.column(1).slice(lo, at - lo), pa.array(nodes, pa.int64()),
                    pa.array([int(w.sum()) for _, w in sets], pa.int64()),
                    pa.array([k if len(s[0]) else [] for k, s in zip(keys, sets)], pa.list_(pa.int64())),
                    pa.array([s.tobytes() for s in short], pa.binary())], names=names)

    names = ["id", "text_key", "node", "size", "bands", "sig"]
    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, text_key long, node long, size long, "
                               "bands array<long>, sig binary")


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), SLOTS)


def _estimate(agree: np.ndarray) -> np.ndarray:
    """Similarity from the share of equal bytes, which agree by chance in 1 of 256."""
    return (agree - 1 / 256) / (1 - 1 / 256)


def likely(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, sig_a, sig_b) whose estimate reaches ESTIMATE, as (a, b)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_bytes(batch.column(2)) == _bytes(batch.column(3))).mean(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(_estimate(same) >= ESTIMATE))

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def bucket_cells(mates: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (cell, band, side, node, comp) of the buckets with several components. In each, the
    members outside the largest component (others) meet its members (cells with sides 0
    and 1) and each other (sides 0 and 1, or 2 in a block's own cell)."""
    own = mates.join(labels, "node", "left").select("bucket", "band", "node", F.coalesce("label", "node").alias("comp"))
    own = cut_lineage(own, "mates-by-component")
    parts = own.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"))
    parts = parts.where(F.col("n") > F.col("main.n")).select(
        "bucket", F.col("main.comp").alias("main"), F.ceil(F.col("main.n") / BLOCK).cast("int").alias("mains"),
        F.ceil((F.col("n") - F.col("main.n")) / BLOCK).cast("int").alias("others"))
    own = own.join(parts, "bucket").withColumn("in_main", F.col("comp") == F.col("main"))
    own = own.withColumn("block", F.pmod(F.hash("node"), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("others"))))

    def meet(count: str):
        return F.sequence(F.lit(0), F.col(count) - 1)

    def spot(kind: int, x, y, side):
        return F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), side.cast("int").alias("side"))

    block = F.col("block")
    main = F.transform(meet("others"), lambda o: spot(0, block, o, F.lit(0)))
    other = F.concat(
        F.transform(meet("mains"), lambda m: spot(0, m, block, F.lit(1))),
        F.transform(meet("others"), lambda o: spot(1, F.least(block, o), F.greatest(block, o), F.when(o == block, 2).when(
            block < o, 0).otherwise(1))))
    own = own.select("bucket", "band", "node", "comp", F.explode(F.when(F.col("in_main"), main).otherwise(other)).alias("s"))
    return own.select(F.xxhash64("bucket", "s.kind", "s.x", "s.y").alias("cell"), "band", "s.side", "node", "comp")


class Cell:
    """The members of one cell, as arrays; ``candidates`` are the pairs of different components
    that may reach the threshold and share no earlier band, whose cell has them."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows
        self.band, side = rows[0][1], np.array([r[2] for r in rows])
        self.node, self.comp, self.size = (np.array([r[i] for r in rows]) for i in (3, 4, 5))
        self.sig = np.frombuffer(b"".join(r[6] for r in rows), dtype=np.uint8).reshape(len(rows), SLOTS)
        self.bands = np.array([r[7] for r in rows], dtype=np.int64)
        self.alone = bool((side == 2).all())
        self.left, self.right = (np.arange(len(rows)),) * 2 if self.alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))

    def candidates(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [(np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),)]
        for lo in range(0, len(self.left), 64):  # 64 rows x 1,024 bounds what is held
            i, j = np.nonzero(self.comp[self.left[lo:lo + 64]][:, None] != self.comp[self.right][None, :])
            i, j = self.left[lo:lo + 64][i], self.right[j]
            near = np.minimum(self.size[i], self.size[j]) >= THRESHOLD * np.maximum(self.size[i], self.size[j])
            if self.alone:
                near &= self.node[i] < self.node[j]
            i, j = i[near], j[near]
            estimate = _estimate((self.sig[i] == self.sig[j]).mean(axis=1))
            near = estimate >= ESTIMATE
            i, j, estimate = i[near], j[near], estimate[near]
            new = ~(self.bands[i, :self.band] == self.bands[j, :self.band]).any(axis=1)
            found.append((i[new], j[new], estimate[new]))
        return tuple(map(np.concatenate, zip(*found)))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each cell of a sorted partition."""
    cell: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if cell and row[0] != cell[0][0]:
                yield cell
                cell = []
            cell.append(row)
    if cell:
        yield cell


def _batches(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Whole-number rows as batches of a few thousand."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], names=names)


_CELL = ("cell", "band", "side", "node", "comp")


def with_candidates(cells: DataFrame, sigs: DataFrame) -> DataFrame:
    """The rows of ``bucket_cells`` whose node has a candidate in their cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for rows in _cells(batches):
                i, j, _ = Cell(rows).candidates()
                for k in np.union1d(i, j):
                    yield rows[k][:5]

        yield from _batches(found(), list(_CELL))

    rows = cells.join(sigs.select("node", "size", "sig", "bands"), "node").select(*_CELL, "size", "sig", "bands")
    return (rows.repartition("cell").sortWithinPartitions("cell")
            .mapInArrow(run, ", ".join(f"{c} long" for c in _CELL)))


def links_in_cells(rows: DataFrame, sigs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Verified pairs (a, b, similarity) that connect the components in each cell of ``with_candidates``:
    candidates are tried from the highest estimate, and not if already connected."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()

        def found() -> Iterator[tuple]:
            for rows in _cells(batches):
                cell, sets, root = Cell(rows), {}, {}

                def of(k: int):
                    if k not in sets:
                        sets[k] = signer.shingle_weights(words_of(rows[k][8]))
                    return sets[k]

                def top(x: int) -> int:
                    while x in root:
                        x = root[x]
                    return x

                i, j, estimate = cell.candidates()
                for k in np.argsort(-estimate, kind="stable"):
                    a, b = int(i[k]), int(j[k])
                    x, y = top(rows[a][4]), top(rows[b][4])
                    if x != y and (similar := overlap(of(a), of(b))) >= THRESHOLD:
                        root[max(x, y)] = min(x, y)
                        yield rows[a][3], rows[b][3], similar

        columns = list(zip(*found())) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                                          pa.array(columns[2], pa.float64())], names=["a", "b", "similarity"])

    rows = cut_lineage(rows, "cells")
    texts = texts_of(rows.select("node").distinct(), sigs, docs, id_col, text_col)
    full = (rows.join(sigs.select("node", "size", "sig", "bands"), "node").join(texts, "node")
            .select(*_CELL, "size", "sig", "bands", "text"))
    return cut_lineage(full.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, LINK), "cell-links")


def texts_of(nodes: DataFrame, sigs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) for the distinct ``nodes``; ``sigs`` has the identifier and text key of a row of each."""
    need = cut_lineage(sigs.select("node", "id", "text_key").join(nodes, "node"), "needed-texts")
    place = F.pmod(F.col("text_key"), F.lit(BITMAP))
    bits = need.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))  # at most 2,049 rows of 4 KB
    text = text_or_empty(F.col(text_col))
    own = docs.select(F.col(id_col).alias("d_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    own = (own.withColumn("bit", F.bitmap_bit_position(place))
           .join(F.broadcast(bits), F.bitmap_bucket_number(place) == F.col("part"))
           .where(F.expr("shiftright({}, cast(bit % 8 as int)) & 1 = 1".format(
               "cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int)")))
           .select("d_id", F.col("text_key").alias("d_key"), "text"))
    found = own.join(need, F.col("d_id").eqNullSafe(F.col("id")) & (F.col("d_key") == F.col("text_key")))
    return cut_lineage(found.dropDuplicates(["node"]).select("node", "text"), "texts")


def verified(pairs: DataFrame, sigs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of nodes whose texts' weighted Jaccard reaches THRESHOLD, and that ``similarity``."""
    pairs = cut_lineage(pairs, "candidates")
    texts = texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), sigs, docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        sets = lru_cache(maxsize=16)(lambda text: signer.shingle_weights(words_of(text)))
        for batch in batches:
            similar = np.array([overlap(sets(x), sets(y)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], dtype=float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similar)],
                                             names=["a", "b", "similarity"]).filter(pa.array(similar >= THRESHOLD))

    joined = (pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
              .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a"))
    return cut_lineage(joined.select("a", "b", "text_a", "text_b").mapInArrow(run, LINK), "links")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id``, ``text_key``, ``class_id`` (smallest identifier of
    the class), ``class_size`` (rows), ``link_id`` and ``link_similarity`` (a row of the class that this one
    was verified against, of the tried ones the most similar, and their weighted
    Jaccard; null for a row alone, and for the first of rows linked by equal words only).

    Rows of equal words (so all texts without words, null ones too) are one class;
    so are rows linked by similarities of THRESHOLD or more, over any number of
    steps. Null identifiers are allowed; a class of such rows only has a null
    class_id. Rows that repeat get equal rows. An empty table gives an empty
    result. Other columns are not read.
    """
    rows = cut_lineage(signed(docs, id_col, text_col), "signed")
    sigs = rows.groupBy("node").agg(F.min(F.struct("id", "text_key")).alias("first"), F.first("size").alias("size"),
                                    F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    sigs = cut_lineage(sigs.select("node", "first.id", "first.text_key", "size", "bands", "sig"), "nodes")
    placed = sigs.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = (placed.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("last"))
              .where(F.col("lead") < F.col("last")))
    mates = cut_lineage(placed.join(shared.select("bucket", "lead"), "bucket"), "bucket-mates")
    star = mates.where(F.col("node") != F.col("lead")).select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    sig = sigs.select("node", "sig")
    star = (star.join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
            .join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a"))
    links = verified(likely(star), sigs, docs, id_col, text_col)
    labels = components(links)
    rest = with_candidates(bucket_cells(mates, labels), sigs)
    more = links_in_cells(rest, sigs, docs, id_col, text_col)
    labels = components(more, labels)

    both = links.unionByName(more)
    both = both.select(F.col("a").alias("node"), F.col("b").alias("other"), "similarity").unionByName(
        both.select(F.col("b").alias("node"), F.col("a").alias("other"), "similarity"))
    best = both.groupBy("node").agg(F.max(F.struct("similarity", "other")).alias("best")).select("node", "best.*")
    first = sigs.select("node", F.col("id").alias("first_id"), F.col("text_key").alias("first_key"))
    best = best.join(first.select(F.col("node").alias("other"), F.col("first_id").alias("other_id")), "other")
    nodes = first.join(labels, "node", "left").join(best.select("node", "other_id", "similarity"), "node", "left").select(
        "node", "first_id", "first_key", F.coalesce("label", "node").alias("class"), "other_id", "similarity")
    # Rows of equal words are linked to the first of them, which has the link of its words.
    copy = ~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key")))
    member = keyed_join(rows.select("id", "text_key", "node"), nodes, "node").select(
        "id", "text_key", "class", F.when(copy, F.col("first_id")).otherwise(F.col("other_id")).alias("link_id"),
        F.when(copy, 1.0).otherwise(F.col("similarity")).alias("link_similarity"))
    member = cut_lineage(member, "members")
    classes = member.groupBy("class").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"),
                                          F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key")).alias("kept"))
    return keyed_join(member, classes, "class").select("id", "text_key", "class_id", "class_size", "link_id", "link_similarity", "kept")


def keyed_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with the one row that ``table`` has for their ``key``. Keys that hold more than a
    thousandth of all rows, at most ``HOT_KEYS``, are joined by broadcast, where the rows lie."""
    sizes = cut_lineage(rows.groupBy(key).agg(F.count(F.lit(1)).alias("key_rows")).where(F.col("key_rows") > 1), "key-sizes")
    hot = sizes.where(F.col("key_rows") * HOT_KEYS > rows.count()).select(key)
    near = table.join(F.broadcast(hot), key, "left_semi")
    return rows.join(F.broadcast(near), key).unionByName(
        rows.join(F.broadcast(hot), key, "left_anti").join(table.join(F.broadcast(hot), key, "left_anti"), key))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, the one with the smallest identifier, with the columns of ``docs``.

    Null texts count as empty, and all texts without words are one class. Of rows with the smallest
    identifier (ties, repeated rows) one stays; a null identifier comes last. Very long texts are
    compared whole. All columns travel in a struct, so names can't clash. An empty table gives an
    empty result."""
    found = near_classes(docs, id_col, text_col)
    kept = cut_lineage(found.select("kept.id", "kept.text_key").distinct(), "kept").select(
        F.col("id").alias("k_id"), F.col("text_key").alias("k_key"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"),
                      F.xxhash64(text_or_empty(F.col(text_col))).alias("text_key"))
    return (own.join(kept, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("text_key") == F.col("k_key")))
            .dropDuplicates(["id", "text_key"]).select("row.*"))
