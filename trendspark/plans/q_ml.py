"""Model queries (rows-only checks plus pytest properties): LDA, SVD,
encoder, density clusters, topic merge, MMR / re-ranked words, noise
robustness, bootstrap stability, ablation, state round trip."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Window
from pyspark.sql import functions as F

from trendspark.functions import text as T
from trendspark.functions import timefn as D
from trendspark.functions import vectors as V
from trendspark.operators import bow, cluster, ml, sampling, textops, vecops
from trendspark.plans.registry import register
from trendspark.session import cut_lineage, scratch_path, spread
from trendspark.sources.tables import table

LDA_K, LDA_ITER = 10, 20


def _lda_input(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = d.select("doc_id", T.word_tokens(T.clean_alpha("text")).alias("wt"))
    d = textops.remove_stops(d, "wt", "tokens", bow.english_stops())
    d = cut_lineage(d.select("doc_id", "tokens"), "lda-tokens")  # read by the fit and by its transform
    # max_df as a number of documents: for a share the fit would keep all tokens as objects in memory to count them
    cv = CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=5000, minDF=2.0, maxDF=0.95 * d.count())
    m = cv.fit(d)
    feats = m.transform(d).select("doc_id", "features")
    # every iteration reads them all: spread over the tasks, whatever the number of files
    return cut_lineage(spread(feats, "doc_id"), "lda-features"), m


@register("lda_topics")
def lda_topics(spark, sf_dir):
    """V4 + A22: LDA with K=10, 20 iterations on letters-only counts
    (vocabulary: min_df 2, max_df 0.95, 5,000 terms); argmax topic and its
    probability per document, with the corpus mean confidence."""
    feats, _ = _lda_input(spark, sf_dir)
    model = ml.lda_fit(feats, LDA_K, LDA_ITER)
    a = ml.lda_assign(model, feats, LDA_K)
    mean = a.agg(F.avg("confidence").alias("mean_confidence"))
    return a.crossJoin(F.broadcast(mean)).select("doc_id", "lda_topic", F.round("confidence", 6).alias("confidence"),
                                                 F.round("mean_confidence", 6).alias("mean_confidence"))


@register("lda_weighted")
def lda_weighted(spark, sf_dir):
    """V5: counts scaled by the temporal weight, refit, mean confidence of both
    models and the percent change. Rows whose weight is 0 (oldest date) get the
    uniform mixture."""
    from trendspark.plans.views import articles
    feats, cvm = _lda_input(spark, sf_dir)
    a = articles(spark, sf_dir).select("doc_id", "date")
    mm = a.agg(F.min("date").alias("d0"), F.max("date").alias("d1"))
    w = a.crossJoin(F.broadcast(mm)).select(
        "doc_id", D.temporal_weight(F.datediff("date", "d0"), F.datediff("d1", "d0")).alias("w"))
    from pyspark.ml.feature import Interaction
    # the product of a number and a vector, in the JVM and sparse
    wf = (Interaction(inputCols=["w", "features"], outputCol="scaled").transform(feats.join(w, "doc_id"))
          .select("doc_id", F.col("scaled").alias("features")))
    wf = cut_lineage(spread(wf, "doc_id"), "lda-weighted")

    def mean_confidence(rows):
        return ml.lda_assign(ml.lda_fit(rows, LDA_K, LDA_ITER), rows, LDA_K).agg(F.avg("confidence").alias("c"))

    # each iteration waits for its last task: the fits, which don't need each other, fill these gaps together
    with ThreadPool(2) as pool:
        plain, weighted = pool.map(inheritable_thread_target(mean_confidence), [feats, wf])
    r = plain.withColumnRenamed("c", "p").crossJoin(weighted.withColumnRenamed("c", "wgt"))
    return r.select(F.round("p", 6).alias("plain_confidence"), F.round("wgt", 6).alias("weighted_confidence"),
                    F.round((F.col("wgt") - F.col("p")) / F.col("p") * 100, 4).alias("pct_change"))


SVD_K = 50


@register("svd_reduce")
def svd_reduce(spark, sf_dir):
    """Truncated SVD (uncentred) of unit embedding rows to 50 dimensions;
    per component the singular value and explained variance ratio
    (variance of the projection / total variance of the input)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.unit("embedding").alias("u"))
    comps, proj = ml.truncated_svd(e, "u", SVD_K)
    proj = cut_lineage(proj.select("vec_id", "u", "reduced"))
    d = proj.select(F.posexplode("u").alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("v")).agg(
        F.sum("v").alias("total"))
    pv = (proj.select(F.posexplode("reduced").alias("component", "y")).groupBy("component")
          .agg(F.var_pop("y").alias("var")))
    return (comps.join(pv, "component").crossJoin(F.broadcast(d))
            .select("component", F.round("singular_value", 6).alias("singular_value"),
                    F.round(F.col("var") / F.col("total"), 6).alias("explained_variance_ratio")))


@register("embed_text")
def embed_text(spark, sf_dir):
    """Every document encoded (whole text) by the default Spark-side
    encoder: hashed token counts x a seeded random projection, unit length."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = d.select("doc_id", T.tokens(T.clean_alnum("text")).alias("tokens"))
    e = ml.hashed_encoder(d, "tokens", 64)
    return e.select("doc_id", F.size("embedding").alias("dim"),
                    F.round(V.norm("embedding"), 6).alias("norm"), "embedding")


@register("embed_text_learnt")
def embed_text_learnt(spark, sf_dir):
    """V10 with word vectors learnt from the articles (whole texts)."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.tokens(T.clean_alnum("text")).alias("tokens"))
    d = cut_lineage(spread(d, "doc_id"), "tokens")  # read by every round of training
    e = ml.learnt_encoder(d, "tokens", 32)
    return e.select("doc_id", F.size("embedding").alias("dim"), F.round(V.norm("embedding"), 6).alias("norm"), "embedding")


# ------------------------------------------------------------------ clusters

BLOB_STRENGTH = 3.0


def planted(spark, sf_dir):
    """Vectors with planted cluster geometry derived from the embeddings
    table: each row is pulled towards a seeded direction of its label
    (label 9 rows stay as they are: the noise)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", V.as_double("embedding").alias("v"), F.size("embedding").alias("_d"))
    centre = F.transform(F.sequence(F.lit(0), F.col("_d") - 1), lambda i: V.gaussian("centre", F.col("label"), i))
    centres = e.select("label", "_d").distinct().select(F.col("label").alias("_of"), F.col("_d").alias("_long"), V.unit(centre).alias("_centre"))
    e = e.join(F.broadcast(centres), F.col("label").eqNullSafe(F.col("_of")) & F.col("_d").eqNullSafe(F.col("_long")))  # a row a label, drawn once
    pulled = F.when(F.col("label") == 9, F.col("v")).otherwise(V.add("v", V.scale("_centre", F.lit(BLOB_STRENGTH))))
    return e.select("vec_id", "label", V.unit(pulled).alias("v"))


@register("density_clusters")
def density_clusters(spark, sf_dir):
    """V14 on planted blobs: kNN (15) -> core distance (10) -> mutual
    reachability -> components per level -> clusters of >= 20 members."""
    p = planted(spark, sf_dir)
    c = cluster.density_clusters(p, "vec_id", "v", min_cluster_size=20)
    return c.join(p.select("vec_id", "label"), "vec_id")


@register("topic_merge")
def topic_merge(spark, sf_dir):
    """Greedy centroid merge of the embedding topics down to 5 topics
    (the K x K table is the only driver-side data); the map is broadcast back."""
    from trendspark.plans.q_vectors import tdv
    d = tdv(spark, sf_dir)
    mp = cluster.merge_topics(vecops.mean_vectors(d.where(F.col("topic") != -1), "topic", "v"), 5)
    m = spark.createDataFrame(list(mp.items()), "topic int, merged_topic int")
    return d.select("doc_id", "topic").join(F.broadcast(m), "topic", "left").select(
        "doc_id", "topic", F.coalesce("merged_topic", F.col("topic")).alias("merged_topic"))


@register("noise_robustness")
def noise_robustness(spark, sf_dir):
    """O7 + V27: planted vectors with seeded Gaussian noise (sigma 0.01, 0.05,
    0.10) re-clustered (one grouped job for all levels); a planted label is
    recovered when one noisy cluster holds more than half of its non-noise
    members; rate, outlier rate and cluster count per sigma."""
    from trendspark.plans.q_quality import SIGMAS, noise
    p = cut_lineage(planted(spark, sf_dir).withColumn("z", noise("vec_id", "v")), "planted")  # drawn once, not once a sigma
    n = p.withColumn("sigma", F.explode(F.array(*[F.lit(s) for s in SIGMAS]))).withColumn(
        "noisy", F.zip_with(V.as_double("v"), "z", lambda x, z: x + F.col("sigma") * z))
    c = cluster.density_clusters(n.select("sigma", "vec_id", V.unit("noisy").alias("nv")), "vec_id", "nv",
                                 group="sigma", min_cluster_size=20)
    j = c.join(p.select("vec_id", "label"), "vec_id").where(F.col("label") != 9)
    cov = (j.where(F.col("cluster") != -1).groupBy("sigma", "label", "cluster")
           .agg(F.count(F.lit(1)).alias("k")))
    tot = cov.groupBy("sigma", "label").agg(F.sum("k").alias("tot"), F.max("k").alias("best"))
    rec = tot.groupBy("sigma").agg(F.count_if(F.col("best") > 0.5 * F.col("tot")).alias("recovered"))
    stats = c.groupBy("sigma").agg(F.avg((F.col("cluster") == -1).cast("double")).alias("outlier_rate"),
                                   F.countDistinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("clusters"))
    labels = p.where(F.col("label") != 9).agg(F.countDistinct("label").alias("n_labels"))
    return (stats.join(rec, "sigma", "left").crossJoin(F.broadcast(labels))
            .select("sigma", "clusters", F.round("outlier_rate", 6).alias("outlier_rate"),
                    F.coalesce("recovered", F.lit(0)).alias("recovered"),
                    F.round(F.coalesce("recovered", F.lit(0)) / F.col("n_labels"), 6).alias("recovery_rate")))


@register("bootstrap_stability")
def bootstrap_stability(spark, sf_dir):
    """20 exact 80% resamples of the planted vectors, all re-clustered in
    one grouped job; per replicate the cluster count and mean coherence
    (all members, closed form); then mean and population std."""
    p = cut_lineage(planted(spark, sf_dir), "planted")  # drawn once, not once a replicate
    n = p.agg(F.count(F.lit(1)).alias("_n"))
    rep = (p.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(20))))
           .crossJoin(F.broadcast(n)).withColumn("_k", F.floor(F.col("_n") * 0.8)))
    smp = cut_lineage(sampling.exact_hash_sample(rep, "replicate", "vec_id", "replicate", "_k")
                      .select("replicate", "vec_id", "v"))
    c = cluster.density_clusters(smp, "vec_id", "v", group="replicate", min_cluster_size=16)
    j = c.where(F.col("cluster") != -1).join(smp, ["replicate", "vec_id"])
    key = F.concat_ws("|", F.col("replicate").cast("string"), F.col("cluster").cast("string"))
    coh = vecops.group_coherence(j.select(key.alias("key"), "v"), "key", "v")
    coh = coh.withColumn("replicate", F.split("key", "\\|")[0].cast("int"))
    r = coh.groupBy("replicate").agg(F.count(F.lit(1)).alias("n_clusters"), F.avg("coherence").alias("mc"))
    return r.agg(F.round(F.avg("n_clusters"), 6).alias("clusters_mean"),
                 F.round(F.stddev_pop("n_clusters"), 6).alias("clusters_std"),
                 F.round(F.avg("mc"), 6).alias("coherence_mean"), F.round(F.stddev_pop("mc"), 6).alias("coherence_std"),
                 F.count(F.lit(1)).alias("n_replicates"))


# ------------------------------------------------------------------ words

def _word_vectors(spark, sf_dir, words):
    """Word vector = mean unit embedding of the documents that hold the word
    (candidates only are joined, so the term table is filtered first)."""
    from trendspark.plans.q_topics import pipeline
    from trendspark.plans.q_vectors import tdv
    p = pipeline(spark, sf_dir)
    d = tdv(spark, sf_dir).select("doc_id", V.unit("v").alias("u"))
    occ = p["terms"].join(F.broadcast(words.select("term").distinct()), "term").select("doc_id", "term").distinct()
    wv = vecops.mean_vectors(occ.join(d, "doc_id").select("term", "u"), "term", "u")
    return p, wv.select("term", F.col("mean").alias("wv"))


def _rerank_sql() -> str:
    from trendspark.plans.q_topics import BASE_SQL
    from trendspark.plans.q_vectors import _dot_sql, _mean_sql, _unit_sql
    tdv = "tdv AS (SELECT doc_id, topic, CAST(embedding AS DOUBLE[]) AS v FROM topic_docs WHERE embedding IS NOT NULL)"
    return BASE_SQL + ",\n" + tdv + ",\n" + _mean_sql("(SELECT * FROM tdv WHERE topic <> -1)", "topic", "v", "cm") + f""",
cent AS (SELECT topic, {_unit_sql('mean')} AS c FROM cm),
occ AS (SELECT DISTINCT t.doc_id, t.term FROM dterms t WHERE t.term IN (SELECT term FROM words)),
ou AS (SELECT o.term, {_unit_sql('tdv.v')} AS u FROM occ o JOIN tdv ON tdv.doc_id = o.doc_id),
""" + _mean_sql("ou", "term", "u", "wv") + f""",
ws AS (SELECT w.topic, w.term, w.rank AS ctfidf_rank, {_dot_sql(_unit_sql('wv.mean'), 'cent.c')} AS sim
       FROM words w JOIN wv ON wv.term = w.term JOIN cent ON cent.topic = w.topic)
SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY sim DESC, term) AS INTEGER) AS rank, term,
       CAST(ctfidf_rank AS INTEGER) AS ctfidf_rank, round(sim, 6) AS sim FROM ws"""


@register("word_rerank", _rerank_sql())
def word_rerank(spark, sf_dir):
    """Each topic's top 10 c-TF-IDF words re-ranked by the cosine of the
    word vector (mean embedding of the documents holding it) to the topic
    centroid."""
    from trendspark.plans.q_topics import pipeline
    from trendspark.plans.q_vectors import topic_centroids
    words = pipeline(spark, sf_dir)["words"]
    _, wv = _word_vectors(spark, sf_dir, words)
    cent = topic_centroids(spark, sf_dir).select("topic", F.col("centroid").alias("tv"))
    s = words.join(wv, "term").join(F.broadcast(cent), "topic").select(
        "topic", "term", F.col("rank").alias("ctfidf_rank"), V.cosine("wv", "tv").alias("sim"))
    w = Window.partitionBy("topic").orderBy(F.desc("sim"), "term")
    return s.withColumn("rank", F.row_number().over(w)).select(
        "topic", "rank", "term", "ctfidf_rank", F.round("sim", 6).alias("sim"))


@register("mmr_words")
def mmr_words(spark, sf_dir):
    """Maximal marginal relevance (diversity 0.3) over each topic's top
    30 c-TF-IDF candidates with word vectors; groups are bounded (30 rows)."""
    from trendspark.operators import topics as TP
    from trendspark.plans.q_topics import pipeline
    from trendspark.plans.q_vectors import topic_centroids
    cands = TP.top_words(pipeline(spark, sf_dir)["ct1"].where(F.col("topic") != -1), 30)
    _, wv = _word_vectors(spark, sf_dir, cands)
    cent = topic_centroids(spark, sf_dir).select("topic", F.col("centroid").alias("tv"))
    c = cands.join(wv, "term").join(F.broadcast(cent), "topic").select("topic", "term", "wv", "tv")
    return ml.mmr_words(c, 10, 0.3).withColumn("relevance", F.round("relevance", 6))


@register("ablation")
def ablation(spark, sf_dir):
    """Cross-cohort cosine and separation gap per representation
    (embedding, embedding and bag-of-words reduced by SVD, bag-of-words) with the peak
    growth year of the largest topic computed by W4 (not a constant)."""
    from trendspark.plans.q_quality import group_separation
    from trendspark.plans.q_bow import vocab_for
    from trendspark.plans.q_vectors import cohorts, tdv
    from trendspark.plans.views import topic_docs
    base = group_separation(spark, sf_dir).where(F.col("representation") != "time_augmented")
    c = cut_lineage(cohorts(tdv(spark, sf_dir)).select("doc_id", "grp", "v"), "cohorts")
    _, proj = ml.truncated_svd(c.select("doc_id", "grp", V.unit("v").alias("u")), "u", 16)
    svd = vecops.vector_separation(proj, "grp", "reduced").select(
        F.lit("embedding_svd16").alias("representation"), F.col("n_a").cast("long"), F.col("n_b").cast("long"),
        *[F.round(x, 6).alias(x) for x in ("intra_a", "intra_b", "cross", "gap")])
    _, tc, v = vocab_for(spark, sf_dir)
    unit = bow.unit_rows(tc.join(F.broadcast(v.select("term")), "term", "left_semi"))
    reduced = ml.sparse_svd(unit, 16).join(c.select("doc_id", "grp"), "doc_id")
    svd = svd.unionByName(vecops.vector_separation(reduced, "grp", "reduced").select(
        F.lit("bow_svd16").alias("representation"), F.col("n_a").cast("long"), F.col("n_b").cast("long"),
        *[F.round(x, 6).alias(x) for x in ("intra_a", "intra_b", "cross", "gap")]))
    d = topic_docs(spark, sf_dir).where(F.col("topic") != -1).select("topic", "year")
    big = d.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "topic").limit(1)
    yc = d.join(F.broadcast(big.select("topic")), "topic").groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    g = yc.withColumn("growth", F.try_divide((F.col("n") - F.lag("n").over(Window.orderBy("year"))) * 100.0,
                                             F.lag("n").over(Window.orderBy("year"))))
    peak = g.agg(F.max_by("year", F.struct(F.col("growth"), -F.col("year"))).alias("peak_year"))
    return base.unionByName(svd).crossJoin(F.broadcast(peak))


# ------------------------------------------------------------------ state

@register("state_roundtrip")
def state_roundtrip(spark, sf_dir):
    """S1-S5 + U5: the topic model state written as parquet (assignments,
    words, centroids, features) plus CSV and JSON result tables and a manifest
    into the shared checkpoint folder; read back; parts missing from the
    required list found with EXCEPT. Articles also go through the JSON-lines
    reader (S1) with a declared schema."""
    from trendspark.plans.q_topics import pipeline
    from trendspark.plans.q_vectors import features_df, topic_centroids
    from trendspark.sources import io as IO
    from trendspark.plans.views import articles
    p = pipeline(spark, sf_dir)
    root = scratch_path(spark, f"state-{__import__('uuid').uuid4().hex}")
    parts = {"assignments": p["a1"], "topic_words": p["words"],
             "centroids": topic_centroids(spark, sf_dir), "features": features_df(spark, sf_dir)}
    IO.save_state(root, parts)
    IO.write_csv(p["words"], root + "/csv/topic_words")
    IO.write_json(p["words"], root + "/json/topic_words")
    art = articles(spark, sf_dir).select("headline", "short_description", "category",
                                         F.date_format("date", "yyyy-MM-dd").alias("date"), F.lit(None).cast("string").alias("authors"))
    art.write.mode("overwrite").json(root + "/raw/articles")
    rows = []
    loaded = IO.load_state(spark, root, required=list(parts) + ["labels"])
    for name, df in loaded["parts"].items():
        rows.append((name, "parquet", df.count()))
    rows.append(("topic_words", "csv", IO.read_csv(spark, root + "/csv/topic_words", p["words"].schema).count()))
    rows.append(("topic_words", "json", spark.read.schema(p["words"].schema).json(root + "/json/topic_words").count()))
    rows.append(("articles", "jsonl", IO.read_articles_json(spark, root + "/raw/articles").count()))
    for m in loaded["missing"]:
        rows.append((m, "missing", 0))
    return spark.createDataFrame(rows, "part string, format string, rows long")
