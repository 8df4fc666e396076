import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import SF, docs, empty  # noqa: F401
from trendspark.llm import near_dedup
from trendspark.llm.near_dedup import Signer, near_classes, shingles, similarity, words_of


def brute_classes(rows):
    sets = [shingles(words_of(t)) for _, t in rows]
    words = [tuple(words_of(t)) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if words[i] == words[j] or (sets[i] and sets[j] and similarity(sets[i], sets[j]) >= near_dedup.THRESHOLD):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return {i: (min((rows[k][0] for k in own if rows[k][0] is not None), default=None), len(own))
            for own in groups.values() for i in own}


def corpus(seed=3, n=30):
    rng, rows = random.Random(seed), []
    for base in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 40, 120, 300]))]
        for _ in range(rng.randrange(1, 7)):
            own = list(words)
            for _ in range(int(len(own) * rng.choice([0, 0, 0.01, 0.03, 0.2]))):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(own)))
    # A chain: neighbours are similar, its ends are not.
    chain = [f"c{k}" for k in range(200)]
    for _ in range(12):
        rows.append((len(rows), " ".join(chain)))
        chain = chain[6:] + [f"c{rng.randrange(10 ** 6)}" for _ in range(6)]
    return rows


def test_signatures_estimate_weighted_jaccard():
    a = " ".join(f"a{i}" for i in range(300)) + " p q r s t" * 20
    b = " ".join(f"a{i}" for i in range(40, 300)) + " p q r s t" * 9
    signer, agree = Signer(), []
    for k in range(12):
        pair = [signer.shingle_weights(words_of(t.replace("a", f"k{k}"))) for t in (a, b)]
        x, y = signer.sign(pair)
        agree.append((x == y).mean())
    want = similarity(shingles(words_of(a)), shingles(words_of(b)))
    assert np.mean(agree) == pytest.approx(want, abs=0.03)
    single = signer.sign([signer.shingle_weights(["one"]), signer.shingle_weights([])])
    assert (single[0] != 0).all() and (single[1] == 0).all()


def test_classes_match_brute_force(spark, docs):
    rows = corpus() + [(900, None), (901, ""), (902, " "), (903, "one two"), (904, "one  two"), (None, "one two"), (900, None)]
    data = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, node string").repartition(5)
    want, by_row = brute_classes(rows), defaultdict(set)
    for i, (d, t) in enumerate(rows):
        by_row[(d, t if t else "")].add(want[i])
    got = near_classes(data).collect()
    text_key = {r["k"]: (r["doc_id"], r["t"]) for r in data.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("t"), F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).alias("k")).collect()}
    assert len(got) == len(rows)
    for r in got:
        d, t = text_key[(r["id"], r["text_key"])]
        assert by_row[(d, t)] == {(r["class_id"], r["class_size"])}, (d, t)
    assert near_classes(docs).count() == docs.count()


def test_blocks_find_links_between_members_of_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    rows = corpus(seed=9, n=12)
    data = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    assert {r["id"]: (r["class_id"], r["class_size"]) for r in near_classes(data).collect()} == dict(enumerate(want[i] for i in range(len(rows))))


def test_one_document_of_each_class_stays(spark, docs, empty):
    rows = corpus(seed=5, n=10)
    data = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_dedup.drop_near_copies(data)
    assert kept.columns == data.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c, _ in brute_classes(rows).values()})
    assert near_dedup.drop_near_copies(docs).columns == docs.columns
    assert near_dedup.drop_near_copies(empty).count() == 0


def test_pipeline_keeps_what_its_stages_decide(spark):
    import corpus_pipeline
    from trendspark.llm import exact_dedup, mixing, quality

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "exact dedup", "near dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.good(spark, docs, SF)
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    out = corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "doc_tokens").collect()
    once = exact_dedup.drop_exact_copies(quality.keep_good(docs))
    rows = [(r["doc_id"], r["text"]) for r in once.collect()]
    classes = brute_classes(rows)
    stay = {c for c, _ in classes.values()}
    mixed = mixing.take_copies(once.where(F.col("doc_id").isin(*stay)))
    copies = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    tokens, total = defaultdict(int), {}
    for r in out:
        tokens[r["doc_id"]] += r["length"]
        total[r["doc_id"]] = r["doc_tokens"]
    assert {d: t / total[d] for d, t in tokens.items()} == copies


def test_every_row_names_a_row_it_was_verified_against(spark):
    rows = corpus(seed=4, n=14) + [(700, "same words here"), (701, "same  words here"), (702, "alone")]
    text = dict(rows)
    got = {r["id"]: r for r in near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, r in got.items():
        if r["class_size"] == 1:
            assert r["link_id"] is None and r["link_similarity"] is None
            continue
        other = r["link_id"]
        if other is None:  # the first of rows that only have equal words
            assert words_of(text[d]) in [words_of(t) for e, t in rows if e != d]
            continue
        assert got[other]["class_id"] == r["class_id"] and other != d
        a, b = words_of(text[d]), words_of(text[other])
        assert r["link_similarity"] == pytest.approx(1.0 if a == b else similarity(shingles(a), shingles(b)), abs=1e-9)
        assert r["link_similarity"] >= near_dedup.THRESHOLD


def test_hot_keys_are_joined_where_they_lie(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HOT_KEYS", 10)
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("key"))
    table = spark.range(1000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value"))
    got = near_dedup.keyed_join(rows, table, "key").collect()
    assert len(got) == 1000 and all(r["value"] == 2 * r["key"] for r in got)


def test_stages_equal_plain_versions(spark):
    """What stays after each filtering stage, by plain Python from the texts; what packing returns, by the tokenizer."""
    import re
    from collections import Counter

    import corpus_pipeline
    from test_texts import brute_measure, plain_kept, tokenizer_once
    from trendspark.llm import quality

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    for r in rows:
        r.update(zip(quality.COUNTS, brute_measure(r["text"]) if len(r["text"] or "") < 20_000 else quality.measure(r["text"])))
    good = [r for r, kept in zip(rows, plain_kept(rows, quality.ERROR)) if kept]
    after = corpus_pipeline.good(spark, docs, SF)
    assert Counter(r["doc_id"] for r in after.collect()) == Counter(r["doc_id"] for r in good)
    by_text = defaultdict(list)
    for r in good:
        by_text[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append(r)
    once = [min(same, key=lambda r: (-len(r["text"] or ""), r["doc_id"])) for same in by_text.values()]
    after = corpus_pipeline.exact(spark, after, SF)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(r["doc_id"] for r in once)
    stay = {c for c, _ in brute_classes([(r["doc_id"], r["text"]) for r in once]).values()}
    after = corpus_pipeline.near(spark, after, SF)
    assert {r["doc_id"] for r in after.collect()} == stay
    # mixing: words by source near the targets, no document more than 3 times
    size = {r["doc_id"]: r["n_words"] for r in once if r["doc_id"] in stay}
    source, total = {r["doc_id"]: r["source"] for r in once}, Counter()
    for d in stay:
        total[source[d]] += size[d]
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(total))}
    target, rest = {}, dict(total)
    while rest:
        left = sum(total.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * total[s]
            del rest[s]
    mixed = corpus_pipeline.mixed(spark, after, SF)
    copies = Counter(r["doc_id"] for r in mixed.select("doc_id").collect())
    taken = Counter()
    for d, n in copies.items():
        assert d in stay and n <= 3
        taken[source[d]] += n * size[d]
    longest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= min(longest, max(size[d] for d in stay if source[d] == s)) for s in target)
    # packing: every id of every copy once, sequences without gaps
    tokens = {r["doc_id"]: len(tokenizer_once().encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in once if r["doc_id"] in copies}
    pieces = corpus_pipeline.packed(spark, mixed, SF).collect()
    starts, sequences = defaultdict(Counter), defaultdict(list)
    for r in pieces:
        assert r["doc_tokens"] == tokens[r["doc_id"]]
        starts[r["doc_id"]][(r["start"], r["length"])] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, n in copies.items():
        assert sum(length * k for (_, length), k in starts[d].items()) == n * tokens[d]
        assert sorted(starts[d]) == [(a, min(1024, tokens[d] - a)) for a in range(0, tokens[d], 1024)] and set(starts[d].values()) == {n}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_stages_take_odd_and_empty_tables(spark, docs, empty):
    import corpus_pipeline
    for table in (docs, empty, docs.withColumn("text", F.lit(None).cast("string"))):
        now = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == table.columns
            now.collect()
        corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
        corpus_pipeline.STAGES[-1][1](spark, table, SF).collect()
