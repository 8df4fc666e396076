"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child draws
``-ln(u) / weight`` with ``u`` a hash of (key, child's name) in (0, 1), and the
smallest draw wins, so a child wins in proportion to its weight. Draws depend
on names, never on positions: where a weight changes, only rows whose winner
changes move, and they move inside, into or out of that subtree.

A shard added to an old rack would raise the rack's and region's weights and so
pull rows from other regions into the rack's old shards. ``shard_tree`` gives
every shard beyond the base layout a region of its own instead: rows then move
into the new shard only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendspark.llm.common import text_or_empty
from trendspark.session import cut_lineage


@dataclass(frozen=True)
class Leaf:
    """A shard with its place in the tree and its weight."""
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def shard_tree(shards: int, regions: int = 2, racks: int = 4, per_rack: int = 5) -> list[Leaf]:
    """``regions * racks * per_rack`` shards in the base layout; each further one
    opens a region of its own."""
    out = []
    for s in range(shards):
        region, rest = divmod(s, racks * per_rack)
        if region < regions:
            out.append(Leaf(f"region{region}", f"rack{rest // per_rack}", s))
        else:
            out.append(Leaf(f"region-of-{s}", "rack0", s))
    return out


def _winner(key: Column, children: Column) -> Column:
    """Name of the child with the smallest draw; ``children`` is an array of (name, weight)."""
    def draw(child: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, child["name"]), 11).cast("double") + 0.5) * F.lit(2.0 ** -53)
        return F.struct((-F.log(u) / child["weight"]).alias("draw"), child["name"].alias("name"))

    return F.array_min(F.transform(children, draw))["name"]


def _children(level: dict[str, dict[str, float]]) -> Column:
    """Literal map from a node's name to its children."""
    cells = []
    for name, below in sorted(level.items()):
        cells += [F.lit(name), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"))
                                         for n, w in sorted(below.items())])]
    return F.create_map(*cells)


def place(key: Column, tree: list[Leaf]) -> Column:
    """Shard of ``key``: one expression of built-in functions that draws among the
    children of the three nodes on the row's path only."""
    regions: dict[str, float] = {}
    racks: dict[str, dict[str, float]] = {}
    shards: dict[str, dict[str, float]] = {}
    number = []
    for leaf in tree:
        if leaf.weight <= 0:
            continue
        region, rack, name = f"/{leaf.region}", f"/{leaf.region}/{leaf.rack}", f"/{leaf.region}/{leaf.rack}/{leaf.shard}"
        regions[region] = regions.get(region, 0) + leaf.weight
        racks.setdefault(region, {}).setdefault(rack, 0)
        racks[region][rack] += leaf.weight
        shards.setdefault(rack, {})[name] = leaf.weight
        number += [F.lit(name), F.lit(leaf.shard)]
    region = _winner(key, _children({"/": regions})["/"])
    rack = _winner(key, _children(racks)[region])
    return F.create_map(*number)[_winner(key, _children(shards)[rack])].cast("int")


def number_in_shard(rows: DataFrame) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each ``shard``, to rows with ``shard``.

    Rows are tagged with their partition and written once, so a retried task
    can't renumber them. They are ranked inside (shard, partition), cells that no
    key can make larger than a partition, and get the count of the shard's
    earlier cells as offset.
    """
    rows = cut_lineage(rows.withColumn("_mid", F.monotonically_increasing_id()), "placed")
    rows = rows.withColumn("_pid", F.shiftright("_mid", 33))
    cell = Window.partitionBy("shard", "_pid")
    ranked = rows.withColumn("_at", F.row_number().over(cell.orderBy("_mid")) - 1)
    before = Window.partitionBy("shard").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("shard", "_pid").agg(F.count(F.lit(1)).alias("_n"))
               .select("shard", "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return (ranked.join(offsets, ["shard", "_pid"])
            .withColumn("slot", (F.col("_before") + F.col("_at")).cast("long"))
            .drop("_mid", "_pid", "_at", "_before"))


def assign_shards(docs: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the identifier, ``size`` (UTF-8 bytes of the text, null:
    none, plus 16), ``text_crc32``, ``law``, ``shard``, ``grown_shard`` (place in
    ``grown``; null without it) and ``slot``.

    A null identifier is a key of its own: all such rows share a shard. Rows
    that repeat share a shard and have slots of their own. Other columns of
    ``docs`` are not read. An empty table gives an empty result.
    """
    text = text_or_empty(F.col(text_col))
    key = F.col(id_col)
    # Placing a row reads its identifier alone; it comes after the texts are reduced to a size and a checksum.
    narrow = docs.select(key.alias(id_col), (F.octet_length(text) + 16).cast("long").alias("size"),
                         F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    placed = narrow.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), place(key, tree).alias("shard"),
                           (place(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"))
    return number_in_shard(placed)
