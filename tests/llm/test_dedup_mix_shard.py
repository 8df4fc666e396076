import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from llm_fixtures import docs, empty  # noqa: F401
from trendspark.llm import exact_dedup, mixing, sharding


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i, norm(t)))
    return {k: (min(v)[2], len(v)) for k, v in groups.items()}


def check_groups(found, rows):
    want = brute_groups(rows)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    assert len(found) == len(rows)
    kept = defaultdict(int)
    for r in found:
        assert (r["keep_id"], r["group_size"]) == by_hash[r["text_sha256"]]
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["row"]["doc_id"] == r["keep_id"]
    assert set(kept.values()) <= {1}


def test_exact_groups_match_brute_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check_groups(exact_dedup.exact_groups(docs).collect(), rows)


def test_a_text_with_many_copies_is_salted(spark):
    rows = [(i, "the same " + " " * (i % 7) + "text") for i in range(3000)] + [(i, f"text {i}") for i in range(3000, 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    check_groups(exact_dedup.exact_groups(docs).collect(), rows)


def test_exact_dedup_keeps_columns_and_empty_tables(docs, empty):
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 5, 7, 8, 9, 10]
    assert exact_dedup.drop_exact_copies(empty).count() == 0


def test_shards_obey_the_key_law(spark, docs, empty):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    out = sharding.assign_shards(many, sharding.shard_tree(40), sharding.shard_tree(41)).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40)
    assert sorted(slots) == list(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(60 < len(s) < 145 for s in slots.values())
    again = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(many.repartition(3), sharding.shard_tree(40)).collect()}
    assert again == {r["doc_id"]: r["shard"] for r in out}
    own = sharding.assign_shards(docs, sharding.shard_tree(40)).collect()
    for r, (i, t) in zip(sorted(own, key=lambda r: (r["doc_id"] or 0, r["size"])),
                         sorted(((x["doc_id"], x["text"] or "") for x in docs.collect()),
                                key=lambda x: (x[0] or 0, len(x[1].encode())))):
        assert (r["doc_id"], r["size"], r["text_crc32"]) == (i, len(t.encode()) + 16, zlib.crc32(t.encode()))
    assert sharding.assign_shards(empty, sharding.shard_tree(40)).count() == 0


def test_a_heavier_shard_moves_rows_only_through_its_own_subtree(spark):
    tree = sharding.shard_tree(40)
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 7 else 1.0) for x in tree]
    rows = spark.range(6000).select(sharding.place(F.col("id"), tree).alias("a"),
                                    sharding.place(F.col("id"), heavier).alias("b")).collect()
    place = {x.shard: x for x in tree}
    moved = [(place[r["a"]], place[r["b"]]) for r in rows if r["a"] != r["b"]]
    assert moved
    # Between regions only into the grown one; between racks of a region only into the grown one.
    assert all(b.region == "region0" for a, b in moved if a.region != b.region)
    assert all((b.region, b.rack) == ("region0", "rack1") for a, b in moved if a.region == b.region and a.rack != b.rack)
    assert all(b.shard == 7 for a, b in moved if (a.region, a.rack) == (b.region, b.rack))


def brute_targets(sizes, weights, most=3):
    capped, total = {}, sum(sizes.values())
    while True:
        free = {s: w for s, w in weights.items() if s not in capped}
        left = total - sum(capped.values())
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in share if share[s] >= most * sizes[s]]
        if not over:
            return {**share, **capped}
        capped.update({s: most * sizes[s] for s in over})
        if len(capped) == len(sizes):
            return capped


def test_mix_reaches_its_targets(spark):
    rows, i = [], 0
    for s, (n, length) in {"a": (900, 30), "b": (40, 12), "c": (10, 5), None: (300, 50), "é": (200, 9)}.items():
        for k in range(n):
            rows.append((i, " ".join(["w"] * (length + k % 11)), s))
            i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    out = mixing.mix(mixing.sized_rows(docs)).select("row.doc_id", "source", "size", "source_size", "target", "copies", "taken")
    found = out.collect()
    assert len(found) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in found:
        assert r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    want = brute_targets(sizes, {"a": 1, "b": 2, "c": 3, "é": 1, None: 2})
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert taken[s] == pytest.approx(target[s], rel=0.02, abs=6)
    again = mixing.mix(mixing.sized_rows(docs.repartition(3))).select("row.doc_id", "copies").collect()
    assert {(r["doc_id"], r["copies"]) for r in again} == {(r["doc_id"], r["copies"]) for r in found}


def test_inclusion_is_unequal_and_near_its_probability(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w w w w "), F.col("id")).alias("text"),
                                    F.when(F.col("id") < 4000, "a").otherwise("b").alias("source"),
                                    (F.col("id") % 2).cast("double").alias("good"))
    sized = mixing.sized_rows(docs, prefer=F.col("good"))
    rate = mixing.mix(sized).where("source = 'a'").groupBy("row.good").agg(F.avg("copies").alias("p")).collect()
    p = {r["good"]: r["p"] for r in rate}  # a: half of its words; probability 0.5 +- 0.5 * 0.5
    assert p[1.0] == pytest.approx(0.75, abs=0.04) and p[0.0] == pytest.approx(0.25, abs=0.04)


def test_mix_edge_cases(docs, empty):
    out = mixing.take_copies(docs)
    assert out.columns == docs.columns
    assert mixing.take_copies(empty).count() == 0
    mixed = mixing.mix(mixing.sized_rows(docs)).collect()
    assert len(mixed) == docs.count() and all(r["taken"] <= 3 * r["size"] for r in mixed)


def test_shards_equal_a_plain_descent(spark):
    """The winner of every level by the reference xxHash, in Python."""
    import math

    import xxhash

    def draw(key, name, weight):
        first = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
        h = xxhash.xxh64_intdigest(name.encode(), first)
        return -math.log(((h >> 11) + 0.5) * 2.0 ** -53) / weight, name

    def shard(key, leaves):
        path = ""
        for parts in (lambda x: x.region, lambda x: x.rack, lambda x: str(x.shard)):
            children = {}
            for leaf in leaves:
                children[f"{path}/{parts(leaf)}"] = children.get(f"{path}/{parts(leaf)}", 0) + leaf.weight
            path = min(draw(key, n, w) for n, w in children.items())[1]
            leaves = [x for x in leaves if f"{path.rsplit('/', 1)[0]}/{parts(x)}" == path]
        return leaves[0].shard

    from trendspark.llm import sharding
    trees = [sharding.shard_tree(40), sharding.shard_tree(41),
             [sharding.Leaf("a", "r", 0, 3.0), sharding.Leaf("a", "q", 1, 0.5), sharding.Leaf("b", "r", 2, 2.0)]]
    keys = [0, -1, 7, 2 ** 62, *range(1000, 1400)]
    df = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    for tree in trees:
        got = {r["doc_id"]: r["shard"] for r in df.select("doc_id", sharding.place(F.col("doc_id"), tree).alias("shard")).collect()}
        assert got == {k: shard(k, tree) for k in keys}
