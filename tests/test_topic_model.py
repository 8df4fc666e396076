"""The topic model's counts by term against the plain forms."""

import os

from trendspark.operators import topics as TP
from trendspark.plans import q_topics


def _model(spark, folder):
    docs = [(i, f"river{i % 5} stone{i % 3} cloud{i % 2} river{i % 5} field{i}", "en", "s") for i in range(40)]
    docs += [(3, "cloud1 stone2 lake", "en", "s"), (4, "", "en", "s"), (None, "river1 stone1", "en", "s"), (41, None, "en", "s")]
    vecs = [(i, [1.0, 0.5], 9 if i % 4 == 0 else i % 3) for i in range(24)] + [(3, [1.0, 0.0], 9), (8, [0.0, 1.0], 9), (8, [0.0, 1.0], 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(os.path.join(folder, "documents.parquet"))
    spark.createDataFrame(vecs, "vec_id long, embedding array<double>, label int").write.parquet(os.path.join(folder, "embeddings.parquet"))
    return q_topics.Fitted(spark, folder)


def _rounded(ct):
    return sorted((r["topic"], r["term"], r["tf"], r["tf_t"], r["tot"], round(r["w"], 9)) for r in ct.collect())


def test_model_equals_the_plain_counts_with_repeated_ids(spark, tmp_path):
    p = _model(spark, str(tmp_path))
    terms = TP.doc_terms_12(p["td"])
    ct0 = TP.class_tfidf(TP.class_term_counts(terms, p["a0"]))
    assert _rounded(p["ct0"]) == _rounded(ct0)
    per, a1 = TP.reassign_outliers(terms, p["a0"], ct0)
    key = lambda d: sorted((r["doc_id"], r["new_topic"], round(r["best_sim"], 9)) for r in d.where("doc_id is not null").collect())
    assert key(p["per"]) == key(per) and any(r[1] != -1 for r in key(per))
    assert _rounded(p["ct1"]) == _rounded(TP.class_tfidf(TP.class_term_counts(terms, a1)))


def test_counts_by_term_take_one_shuffle_of_added_rows(spark):
    rows = spark.createDataFrame([(t % 7, f"w{t % 11}", 1) for t in range(200)] + [(1, "gone", 1), (1, "gone", -1)], "topic int, term string, n int")
    few = TP.counts_by_term(rows, list(range(7)))
    assert few._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") == 2
    assert few._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    many = TP.counts_by_term(rows, list(range(TP.MOST_COLUMNS + 1)))
    plain = lambda d: sorted((r["term"], sorted(map(tuple, r["by"]))) for r in d.collect())
    assert plain(few) == plain(many) and "gone" not in dict(plain(few))
