"""The derived views keep every row and character of their tables."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK, SF_SMALL
from trendspark.operators import vecops
from trendspark.plans import views
from trendspark.plans.registry import QUERIES, load_all
from trendspark.streaming.stream import _latest_state


def test_views_are_whole(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    chars = docs.agg(F.sum(F.length("text")), F.count(F.lit(1))).first()
    art = views.articles(spark, SF_SMALL)
    assert art.agg(F.sum(F.length("headline") + F.length("short_description")), F.count(F.lit(1))).first() == chars
    assert views.topic_docs(spark, SF_SMALL).count() == chars[1]
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet").count()
    assert views.topic_orders(spark, SF_SMALL).count() == orders


def test_topic_orders_has_gaps(spark):
    cells = views.topic_orders(spark, SF_SMALL).select("topic", "year").distinct().count()
    assert cells < 56


def test_block_search_equals_numpy(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(70, 8))
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "id long, v array<double>, g int")
    q, c = df.selectExpr("id AS qid", "v AS qv", "g"), df.selectExpr("id AS cid", "v AS cv", "g")
    for group in (None, "g"):
        got = vecops.top_k_blocks(q, c, 3, exclude_self=True, block=16, group=group).collect()
        sims = x @ x.T
        np.fill_diagonal(sims, -np.inf)
        if group:
            sims[(np.arange(70)[:, None] + np.arange(70)[None]) % 2 == 1] = -np.inf
        want = {(i, r + 1): j for i in range(70) for r, j in enumerate(np.argsort(-sims[i])[:3])}
        assert {(r["qid"], r["rank"]): r["cid"] for r in got} == want
    few = vecops.nearest_few(q, c.where("cid < 5"), 2).collect()
    best = np.argsort(-(x @ x[:5].T), axis=1)[:, :2]
    assert {(r["qid"], r["rank"]): r["cid"] for r in few} == {(i, k + 1): best[i, k] for i in range(70) for k in (0, 1)}


def test_a_broken_stream_state_raises(spark, tmp_path):
    (tmp_path / "state" / "epoch=0").mkdir(parents=True)
    (tmp_path / "state" / "epoch=0" / "part-0.parquet").write_text("not parquet")
    assert _latest_state(spark, str(tmp_path / "none"), 5) is None
    with pytest.raises(Exception):
        _latest_state(spark, str(tmp_path / "state"), 5)


def test_sparse_svd_equals_numpy(spark):
    import numpy as np

    from trendspark.operators.ml import sparse_svd

    rng = np.random.default_rng(1)
    a = (rng.normal(size=(40, 3)) @ rng.normal(size=(3, 30))) + 0.01 * rng.normal(size=(40, 30))
    u = spark.createDataFrame([(i, f"t{j}", float(a[i, j])) for i in range(40) for j in range(30)], "doc_id long, term string, u double")
    got = np.array([r["reduced"] for r in sparse_svd(u, 3).orderBy("doc_id").collect()])
    s = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(np.linalg.norm(got, axis=0), s[:3], rtol=1e-3)
    assert np.allclose(got @ got.T, a @ a.T, atol=0.05 * s[0])


def test_counts_without_vectors_take_all_articles(spark):
    load_all()
    d = views.topic_docs(spark, SF_CHECK).where("topic <> -1")
    sizes = {r["topic"]: r["count"] for r in d.groupBy("topic").count().collect()}
    assert sum(sizes.values()) > d.where("embedding IS NOT NULL").count()
    assert {r["topic"]: r["size"] for r in QUERIES["topic_purity"](spark, SF_CHECK).collect()} == sizes
    assert {r["topic_id"]: r["log_size"] for r in QUERIES["topic_features"](spark, SF_CHECK).collect()} == {
        t: pytest.approx(math.log(max(n, 2)), abs=1e-6) for t, n in sizes.items()}
    big = set(sorted(sizes, key=lambda t: (-sizes[t], t))[:3])
    assert {r["topic"] for r in QUERIES["attribution_top_tokens"](spark, SF_CHECK).collect()} == big


def test_model_verifies_events_without_a_timeline(spark):
    from trendspark.operators import events as E

    events = spark.createDataFrame([(t, 2019, "Quiet", "quiet / word") for t in range(4)],
                                   "topic_id int, year int, topic_label string, raw_label string")
    none = spark.createDataFrame([], "topic_id int, payload string")
    probs = spark.createDataFrame([(0, 2019, 0.8), (1, 2019, 0.5), (2, 2019, 0.2), (3, 2018, 0.9)],
                                  "topic_id int, year int, prob double")
    got = {r["topic_id"]: (r["verification_status"], r["gdelt_peak_value"], r["gdelt_peak_date"])
           for r in E.verify_events(events, none, E.ground_truth_rules(spark), probs).collect()}
    assert got == {0: ("VERIFIED_GROUNDTRUTH", 0.8, "20190701000000"), 1: ("LIKELY_REAL", 0.5, "20190701000000"),
                   2: ("GDELT_UNAVAILABLE", 0.0, ""), 3: ("GDELT_UNAVAILABLE", 0.0, "")}


def test_registered_queries_run_the_model_branch(spark):
    load_all()
    assert {"timeline_verify_model", "layered_verdict_model"} <= set(QUERIES)
    given = QUERIES["timeline_verify_given"](spark, SF_SMALL).collect()
    assert "LIKELY_REAL" in {r["verification_status"] for r in given}


def test_topic_model_moves_lists_and_seed_words_only(spark, monkeypatch):
    from trendspark.operators import topics as TP
    from trendspark.plans import q_topics
    docs = spark.createDataFrame([(1, "apple pear apple"), (1, "apple pear apple"), (2, "plum apple"), (3, None)], "doc_id long, text string")
    assign = spark.createDataFrame([(1, 0), (1, 0), (2, 1), (3, -1)], "doc_id long, topic int")
    lists = TP.doc_term_lists(docs)
    want = TP.class_term_counts(TP.doc_terms_12(docs), assign)
    got = TP.class_list_counts(lists, assign)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    words = spark.createDataFrame([(0, 1, "pear", 2.0), (1, 1, "plum", 1.0)], "topic int, rank int, term string, score double")
    model = {"words": words, "terms": TP.listed_terms(lists), "td": docs}
    monkeypatch.setattr(q_topics, "pipeline", lambda *a: model)
    out = q_topics.seeded_assignment(spark, "")
    assert {(r["doc_id"], r["seed_topic"], r["seed_score"]) for r in out.collect()} == {(1, 0, 2.0), (2, 1, 1.0), (3, -1, 0.0)}
    # seed words are picked before the rows are told apart
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    at = {name: min(i for i, line in enumerate(plan.splitlines()) if name in line) for name in ("Aggregate [doc_id", "LeftSemi")}
    assert plan.count("LeftSemi") == 1 and at["Aggregate [doc_id"] < at["LeftSemi"]
