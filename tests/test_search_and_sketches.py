"""Text search, interval join, sketches, keyword automaton and learnt encoder against plain versions."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendspark.operators import keywords, ml, ranges, sketches, textindex
from trendspark.plans.registry import QUERIES, load_all

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- text search

def documents(rng, n, words=300):
    """Documents of very different lengths over words of very different frequency, with near copies."""
    out = []
    for d in range(n):
        counts = {}
        for _ in range(rng.choice([3, 10, 60, 200])):
            w = f"w{min(int(rng.paretovariate(0.7)), words)}"
            counts[w] = counts.get(w, 0) + 1
        out.append(counts)
    return out + [dict(out[i], extra=1) for i in range(0, n, 10)]


def unit(counts):
    norm = sum(c * c for c in counts.values()) ** 0.5
    return {t: c / norm for t, c in counts.items()}


def test_text_search_equals_scoring_all_documents(spark):
    rng = random.Random(3)
    docs = [unit(c) for c in documents(rng, 300)]
    queries = [unit(c) for c in documents(rng, 20)[:20]] + [docs[5], unit({"unknown": 1})]
    rows = spark.createDataFrame([(i, t, u) for i, d in enumerate(docs) for t, u in d.items()], "doc_id long, term string, u double")
    asked = spark.createDataFrame([(q, t, u) for q, d in enumerate(queries) for t, u in d.items()], "query_id long, term string, qu double")
    index = textindex.build_text_index(rows)
    got = {(r["query_id"], r["rank"]): (r["doc_id"], round(r["score"], 9)) for r in textindex.text_search(index, asked, 5).collect()}
    want = {}
    for q, own in enumerate(queries):
        scores = sorted(((-round(sum(u * d.get(t, 0) for t, u in own.items()), 9), i) for i, d in enumerate(docs)))
        want |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(s for s in scores[:5] if s[0])}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-8) for k in want)


def test_text_search_forms_few_pairs_where_documents_have_topics(spark):
    """600 documents of 30 topics, most words of their own topic and some that all share: a query opens
    few documents beyond its topic, though nearly all pairs share a word."""
    rng, docs = random.Random(8), []
    for i in range(600):
        counts = {}
        for _ in range(60):
            w = f"t{i % 30}w{rng.randrange(40)}" if rng.random() < 0.8 else f"common{rng.randrange(20)}"
            counts[w] = counts.get(w, 0) + 1
        docs.append(unit(counts))
    rows = spark.createDataFrame([(i, t, u) for i, d in enumerate(docs) for t, u in d.items()], "doc_id long, term string, u double")
    asked = rows.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "term", F.col("u").alias("qu"))
    index = textindex.build_text_index(rows)
    sharing = asked.join(rows, "term").select("query_id", "doc_id").distinct().count()
    opened = textindex.candidates(index, asked, 5).count()
    assert sharing > 0.9 * 12 * 600 and opened < 0.1 * sharing


def test_text_search_hands_on_k_rows_a_block_and_query(spark, monkeypatch):
    """Words that all documents share, so that nearly every pair is one: blocks of few documents and queries, scored
    few documents at a time, give what plain scoring gives, and no pair of a document and a query becomes a row."""
    for name, few in (("POSTINGS", 400), ("QUERIES", 5), ("PRODUCTS", 300)):
        monkeypatch.setattr(textindex, name, few)
    rng = random.Random(4)
    docs = [unit({f"w{rng.randrange(12)}": rng.randrange(1, 9) for _ in range(10)}) for _ in range(400)] + [unit({"w1": 1})] * 30
    queries = [unit({f"w{rng.randrange(14)}": 1 for _ in range(6)}) for _ in range(17)]
    rows = spark.createDataFrame([(i, t, u) for i, d in enumerate(docs) for t, u in d.items()] + [(None, "w1", 1.0)], "doc_id long, term string, u double")
    asked = spark.createDataFrame([(q, t, u) for q, d in enumerate(queries) for t, u in d.items()], "query_id long, term string, qu double")
    index = textindex.build_text_index(rows)
    assert index.blocks.count() > 5
    found = textindex.text_search(index, asked, 3)
    assert "candidates" not in vars(index) and "postings" not in vars(index) and "CartesianProduct" in found._jdf.queryExecution().toString()
    got = {(r["query_id"], r["rank"]): (r["doc_id"], pytest.approx(r["score"], abs=1e-8)) for r in found.collect()}
    want = {}
    for q, own in enumerate(queries):
        scores = sorted(((-round(sum(u * d.get(t, 0) for t, u in own.items()), 9), i) for i, d in enumerate(docs)))
        want |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(s for s in scores[:3] if s[0])}
    assert got == want


# ---------------------------------------------------------------- interval join

@pytest.mark.parametrize("bins", [1, 30, 5000])
def test_interval_join_equals_all_pairs(spark, bins):
    rng, day = random.Random(1), lambda i: dt.date(1969, 6, 1) + dt.timedelta(days=i)
    windows = [(i, 0 if i % 2 else i % 5, day(a := rng.randrange(600)), day(a + rng.randrange(-2, 90))) for i in range(80)]
    points = [(i, 0 if i % 2 else i % 5, day(rng.randrange(700))) for i in range(150)] + [(900, 0, None), (901, None, day(5))]
    w = spark.createDataFrame(windows, "w int, k int, lo date, hi date")
    p = spark.createDataFrame(points, "p int, k int, at date")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = ranges.interval_join(w, p, ["k"], "lo", "hi", "at", bins)
        assert "Broadcast" not in got._jdf.queryExecution().toString()
        pairs = sorted((r["w"], r["p"]) for r in got.collect())
        some = sorted(r["w"] for r in ranges.interval_join(w, p, ["k"], "lo", "hi", "at", bins, "left_semi").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = sorted((i, j) for i, k, lo, hi in windows for j, key, at in points if at and k == key and lo <= at < hi)
    assert pairs == want and some == sorted({i for i, _ in want})


# ---------------------------------------------------------------- sketches

def test_quantile_sketches_add_up(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.lognormal(3, 2, 5000), -rng.lognormal(0, 1, 500), np.zeros(300)])
    df = spark.createDataFrame([(int(i % 7), float(v)) for i, v in enumerate(values)] + [(0, None)], "day int, v double")
    by_day = sketches.quantile_sketch(df, ["day"], "v")
    ranks = {"a": 0.0, "b": 0.05, "c": 0.25, "d": 0.5, "e": 0.99, "f": 1.0}
    whole = sketches.quantiles_of(sketches.quantile_sketch(df, [], "v"), [], ranks).first()
    added = sketches.quantiles_of(sketches.merged_quantiles(by_day.repartition(5), []), [], ranks).first()
    assert whole == added and whole["total"] == len(values)
    ordered = np.sort(values)
    for name, p in ranks.items():
        exact = ordered[max(int(np.ceil(p * len(values))), 1) - 1]
        assert abs(whole[name] - exact) <= sketches.ERROR * abs(exact) * 1.000001


@pytest.mark.parametrize("n", [0, 1, 50, 4000, 200_000])
def test_distinct_sketches_add_up(spark, n):
    df = spark.range(2 * n).select((F.col("id") % 5).alias("day"), F.when(F.col("id") >= 0, F.concat(F.lit("v"), F.col("id") % max(n, 1))).alias("v"))
    df = df.unionByName(spark.createDataFrame([(0, None)], "day long, v string"))
    days = sketches.distinct_sketch(df, ["day"], "v")
    whole = sorted(map(tuple, sketches.distinct_sketch(df, [], "v").collect()))
    assert sorted(map(tuple, sketches.merged_distinct(days.repartition(3), []).collect())) == whole
    found = sketches.distinct_of(days, []).collect()
    assert abs((found[0]["distinct"] if n else 0) - n) <= 4 * 0.0163 * n


def test_registered_sketches_over_all_years_equal_one_pass(spark):
    load_all()
    rows = {r["period"]: r for r in QUERIES["period_distinct_words"](spark, SF).collect()}
    assert rows["all"]["n"] == sum(r["n"] for p, r in rows.items() if p != "all") == spark.read.parquet(f"{SF}/documents.parquet").count()
    words = {w for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for w in __import__("re").sub("[^a-z0-9\\s]", "", r["text"].lower()).split()}
    assert abs(rows["all"]["words"] - len(words)) <= 0.07 * len(words)


# ---------------------------------------------------------------- keyword automaton

def test_five_thousand_rules_equal_plain_search(spark):
    rng = random.Random(6)
    rules = [("".join(rng.choice("abcd") for _ in range(rng.randrange(2, 7)))) for _ in range(5000)] + ["", "aab", "aab"]
    texts = [None, "", "AABB", "zzz"] + ["".join(rng.choice("abcde ") for _ in range(rng.randrange(60))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    table = spark.createDataFrame(list(enumerate(rules)), "rule_idx int, keyword string")
    got = {}
    for r in keywords.matched_rules(df, ["id"], F.col("text"), table).collect():
        got.setdefault(r["id"], set()).add(r["rule_idx"])
    assert got == {i: {k for k, w in enumerate(rules) if w in t.lower()} for i, t in enumerate(texts) if t is not None}
    grouped = [([w for w in rules[k:k + 10] if w], f"label{k}") for k in range(0, 5000, 10)]
    labelled = {r["id"]: r["l"] for r in keywords.first_rule(df, F.col("text"), grouped, "l").collect()}
    for i, t in enumerate(texts):
        assert labelled[i] == next((label for words, label in grouped if t and any(w in t.lower() for w in words)), None)


def test_automaton_gives_the_present_rules(spark):
    from trendspark.operators.topics import rule_label
    from trendspark.rules import SEMANTIC_RULES

    words = [k for keys, _ in SEMANTIC_RULES for k in keys]
    rng = random.Random(2)
    df = spark.createDataFrame([(i, " ".join(rng.sample(words, 2)).upper() if i % 3 else "nothing") for i in range(60)], "id int, text string")
    out = keywords.first_rule(df, F.col("text"), SEMANTIC_RULES, "label").withColumn("present", rule_label(F.col("text"), SEMANTIC_RULES))
    assert all(r["label"] == r["present"] for r in out.collect())


# ---------------------------------------------------------------- learnt encoder

def test_learnt_encoder_finds_topics_that_share_few_words(spark):
    """Texts of a topic draw a few of its many words, and common words besides: held-out texts are given the
    label of the nearest mean of the others."""
    rng, rows = random.Random(9), []
    for i in range(900):
        topic = i % 3
        rows.append((i, topic, [f"t{topic}w{rng.randrange(150)}" for _ in range(5)] + [f"common{rng.randrange(12)}" for _ in range(10)]))
        rng.shuffle(rows[-1][2])
    df = spark.createDataFrame(rows, "id int, topic int, tokens array<string>")

    def agreement(encoded):
        got = encoded.orderBy("id").collect()
        x, y = np.array([r["embedding"] for r in got]), np.array([r["topic"] for r in got])
        assert np.allclose(np.linalg.norm(x, axis=1), 1)
        held = np.arange(len(x)) % 5 == 0
        means = np.stack([x[~held & (y == t)].mean(axis=0) for t in range(3)])
        return (np.argmax(x[held] @ (means / np.linalg.norm(means, axis=1, keepdims=True)).T, axis=1) == y[held]).mean()

    learnt = agreement(ml.learnt_encoder(df, "tokens", 16, min_count=2, rounds=8, train=df.where("id % 5 != 0")))
    hashed = agreement(ml.hashed_encoder(df, "tokens", 16))
    assert learnt > hashed + 0.2
    odd = spark.createDataFrame([(1, []), (2, None), (3, ["never seen"])], "id int, tokens array<string>")
    assert all(not any(r["embedding"]) for r in ml.learnt_encoder(odd, "tokens", 16, min_count=2, train=df).collect())
