"""Property tests: closed forms equal brute force, results do not depend on
partitioning, streams equal batch, planted clusters are recovered."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from trendspark.functions import vectors as V
from trendspark.operators import sampling, vecops
from trendspark.plans.registry import QUERIES, load_all

load_all()


def test_coherence_closed_form_equals_pairs(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "label", "embedding")
    got = {r["label"]: r["coherence"] for r in vecops.group_coherence(e, "label", "embedding").collect()}
    pdf = e.toPandas()
    for lab, g in pdf.groupby("label"):
        if len(g) < 2:
            continue
        x = np.stack([np.asarray(v, dtype=float) for v in g["embedding"]])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        assert abs((x @ x.T).mean() - got[lab]) < 1e-9


def test_separation_closed_form_equals_pairs(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select(
        F.when(F.col("label") < 5, "A").otherwise("B").alias("grp"), "embedding")
    r = vecops.vector_separation(e, "grp", "embedding").first()
    pdf = e.toPandas()
    u = {g: np.stack([np.asarray(v, float) / np.linalg.norm(v) for v in d["embedding"]]) for g, d in pdf.groupby("grp")}
    assert abs((u["A"] @ u["B"].T).mean() - r["cross"]) < 1e-9
    assert abs((u["A"] @ u["A"].T).mean() - r["intra_a"]) < 1e-9


def test_sampling_independent_of_partitioning(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey", F.year("o_orderdate").alias("year"))
    a = sampling.balanced_sample(o, "year", "o_orderkey", 50, 42)
    b = sampling.balanced_sample(o.repartition(7), "year", "o_orderkey", 50, 42)
    assert sorted(r[0] for r in a.select("o_orderkey").collect()) == sorted(r[0] for r in b.select("o_orderkey").collect())


def test_exact_hash_sample_sizes(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id")
    rep = e.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("_k", F.lit(17))
    s = sampling.exact_hash_sample(rep, "r", "vec_id", "r", "_k")
    assert {r["r"]: r["count"] for r in s.groupBy("r").count().collect()} == {1: 17, 2: 17, 3: 17}


def test_global_rank_is_a_permutation(spark):
    from trendspark.operators import ordering
    d = spark.range(0, 1000).withColumn("v", (F.col("id") * 7919) % 101)
    r = ordering.global_rank(d.repartition(5), [F.desc("v"), F.col("id")], "rk")
    rows = r.orderBy("rk").collect()
    assert [x["rk"] for x in rows] == list(range(1, 1001))
    assert all((a["v"], -a["id"]) >= (b["v"], -b["id"]) for a, b in zip(rows, rows[1:]))


def test_knn_matches_brute_force(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    g = vecops.knn_graph(e, "vec_id", "embedding", 3).where("rank = 1").select("src", "dst").collect()
    pdf = e.toPandas()
    x = np.stack([np.asarray(v, float) for v in pdf["embedding"]])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    ids = pdf["vec_id"].to_numpy()
    best = {ids[i]: ids[int(np.argmax(s[i]))] for i in range(len(ids))}
    assert all(best[r["src"]] == r["dst"] for r in g)


def test_fuzzy_weights_sum_to_log2k(spark):
    w = QUERIES["fuzzy_weights"](spark, SF_SMALL)
    sums = [r["s"] for r in w.groupBy("src").agg(F.sum("weight").alias("s")).collect()]
    assert all(abs(s - np.log2(15)) < 1e-3 for s in sums)


def test_stream_equals_batch_hybrid(spark):
    b = QUERIES["hybrid_velocity"](spark, SF_SMALL).collect()
    s = QUERIES["stream_hybrid_velocity"](spark, SF_SMALL).collect()
    key = lambda r: (r["window_start"], r["topic"])
    assert sorted(map(tuple, b), key=str) == sorted(map(tuple, s), key=str)


def test_stream_state_velocity_equals_batch(spark):
    b = {(r["topic"], r["year"]): (r["n_kt"], r["velocity"]) for r in QUERIES["eps_velocity"](spark, SF_SMALL).collect()}
    s = {(r["topic"], r["year"]): (r["n_kt"], r["velocity"]) for r in
         QUERIES["stream_state_velocity"](spark, SF_SMALL).collect()}
    assert b == s


def test_density_clusters_recover_planted_labels(spark):
    c = QUERIES["density_clusters"](spark, "/root/testdata/sf0.01")
    pdf = c.toPandas()
    pdf = pdf[pdf["label"] != 9]
    rec = 0
    for lab, g in pdf.groupby("label"):
        g = g[g["cluster"] != -1]
        if len(g) and g["cluster"].value_counts().iloc[0] > 0.5 * len(g):
            rec += 1
    assert rec >= 7


def test_svd_basis_orthonormal(spark):
    from trendspark.operators import ml
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select(V.unit("embedding").alias("u"))
    comps, _ = ml.truncated_svd(e, "u", 8)
    b = np.array([r["basis"] for r in comps.orderBy("component").collect()])
    assert np.allclose(b @ b.T, np.eye(8), atol=1e-8)
