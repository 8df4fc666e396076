"""Classifier features, the calibrated event classifier and the full
prediction record."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Window
from pyspark.sql import functions as F

from trendspark.functions import text as T
from trendspark.functions import vectors as V
from trendspark.operators import bow, events as E, ml, textindex, topics as TP, trend
from trendspark.plans.q_bow import VOCAB_SQL, terms_sql, vocab_for
from trendspark.plans.q_events import (FINAL_SQL, LAYERED_LABELS, NEWS_SIGNALS_SQL, VERIFY_SQL, news_signals, timeline_df,
                                       verdict_columns, verification)
from trendspark.plans.q_quality import _merge
from trendspark.plans.q_topics import pipeline
from trendspark.plans.q_vectors import PURITY_SQL, _mean_sql, _unit_sql, features_df
from trendspark.plans.registry import register
from trendspark.plans.views import TOPIC_DOCS_CTE, topic_docs, with_ctes
from trendspark.rules import GROUND_TRUTH_VERIFIED, MODEL_REASONS, REASON_GATE, VERDICT_FLOOR, VERDICT_LEVELS
from trendspark.session import cut_lineage
from trendspark.sources.tables import table

FEAT_SQL = PURITY_SQL + ",\n" + _mean_sql(
    f"(SELECT topic, {_unit_sql('v')} AS u FROM tdv WHERE topic <> -1)", "topic", "u", "tm") + """,
sz AS (SELECT topic, count(*) AS size FROM topic_docs WHERE topic <> -1 GROUP BY topic),
feat AS (SELECT sz.topic AS topic_id, ln(greatest(sz.size, 2)) AS log_size,
                list_sum(list_transform(tm.mean, lambda x: x * x)) AS coherence, coalesce(pur.purity, 0) AS purity
         FROM sz JOIN tm ON tm.topic = sz.topic LEFT JOIN pur ON pur.topic = sz.topic WHERE tm.n >= 2)"""

GT_KW_SQL = "[" + ", ".join("'" + k + "'" for k, _ in GROUND_TRUTH_VERIFIED) + "]"


@register("classifier_features", _merge(NEWS_SIGNALS_SQL, FEAT_SQL) + f""",
pk AS (SELECT topic_id, max(velocity) AS max_velocity,
              CASE first(signal_class ORDER BY velocity DESC, year) WHEN 'NOISE' THEN 0 WHEN 'WEAK_SIGNAL' THEN 1
                   WHEN 'STRONG_SIGNAL' THEN 2 ELSE 3 END AS peak_class_code,
              max(nonzero_years) AS nonzero_years, first(topic_label) AS topic_label, first(raw_label) AS raw_label
       FROM signals GROUP BY topic_id)
SELECT pk.topic_id, round(pk.max_velocity, 6) AS max_velocity, CAST(pk.peak_class_code AS INTEGER) AS peak_class_code,
       CAST(pk.nonzero_years AS INTEGER) AS nonzero_years, round(f.coherence, 6) AS coherence,
       round(f.purity, 6) AS purity, round(f.log_size, 6) AS log_size,
       len(list_filter({GT_KW_SQL}, lambda k: contains(lower(pk.topic_label), k) OR contains(lower(coalesce(pk.raw_label, '')), k))) > 0 AS label
FROM pk JOIN feat f ON f.topic_id = pk.topic_id""")
def classifier_features(spark, sf_dir):
    """V31 + J7 + V30: per topic the peak velocity, class code at the peak
    (earliest year on ties), non-zero years, joined (inner) to the topic
    features; label = any ground-truth keyword in the label or raw label."""
    return features_table(spark, sf_dir).select(
        "topic_id", F.round("max_velocity", 6).alias("max_velocity"), "peak_class_code", "nonzero_years",
        *[F.round(c, 6).alias(c) for c in ("coherence", "purity", "log_size")], "label")


def features_table(spark, sf_dir):
    s = news_signals(spark, sf_dir)
    pk = s.groupBy("topic_id").agg(
        F.max("velocity").alias("max_velocity"),
        F.max_by(F.col("signal_class"), F.struct(F.col("velocity"), -F.col("year"))).alias("_pc"),
        F.max("nonzero_years").cast("int").alias("nonzero_years"),
        F.first("topic_label").alias("topic_label"), F.first("raw_label").alias("raw_label"))
    kws = F.array(*[F.lit(k) for k, _ in GROUND_TRUTH_VERIFIED])
    lab = F.exists(kws, lambda k: F.contains(F.lower("topic_label"), k)
                   | F.contains(F.lower(F.coalesce("raw_label", F.lit(""))), k))
    pk = pk.select("topic_id", "max_velocity", trend.class_code(F.col("_pc")).alias("peak_class_code"),
                   "nonzero_years", lab.alias("label"))
    return pk.join(features_df(spark, sf_dir), "topic_id")


FEATURES = ["max_velocity", "peak_class_code", "nonzero_years", "coherence", "purity", "log_size"]


def fitted_folds(train, n_folds: int, seed: int = 42) -> list:
    """GBT (100 trees, depth 3, rate 0.1) calibrated by isotonic regression over
    ``n_folds`` hash folds, as (model, calibrator) pairs. The training table is the
    per-topic feature table (one row per topic)."""
    va = VectorAssembler(inputCols=FEATURES, outputCol="features")
    # stratified folds: position within the label class (hash order) modulo k;
    # the window runs over the per-topic table (one row per topic)
    wf = Window.partitionBy("label").orderBy(F.xxhash64("topic_id", F.lit(seed)), "topic_id")
    d = va.transform(train.withColumn("y", F.col("label").cast("double"))
                     .withColumn("fold", F.pmod(F.row_number().over(wf) - 1, F.lit(n_folds))))
    folds = []
    for f in range(n_folds):
        gbt = GBTClassifier(featuresCol="features", labelCol="y", maxIter=100, maxDepth=3, stepSize=0.1,
                            seed=seed)
        m = gbt.fit(d.where(F.col("fold") != f))
        held = m.transform(d.where(F.col("fold") == f)).withColumn("p1", vector_to_array("probability")[1])
        folds.append((m, IsotonicRegression(featuresCol="p1", labelCol="y", predictionCol="cal").fit(held)))
    return folds


def calibrated(folds: list, rows, keys: list[str]):
    """(keys, probability) of ``rows`` (keys, FEATURES): the mean of the fold calibrators applied to
    their fold models."""
    scored = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    for f, (m, iso) in enumerate(folds):
        scored = m.transform(scored).withColumn("p1", vector_to_array("probability")[1])
        scored = iso.transform(scored).withColumn(f"p_{f}", F.col("cal")).drop("p1", "cal", "rawPrediction", "probability", "prediction")
    return scored.select(*keys, (sum((F.col(f"p_{f}") for f in range(1, len(folds))), F.col("p_0")) / len(folds)).alias("probability"))


def trained(spark, sf_dir):
    """The feature table, the fold models with their calibrators (None if there are fewer than 6 topics or
    2 positives) and the written probabilities by topic, fitted once per application and input."""
    model = pipeline(spark, sf_dir)
    if "classifier" not in model:
        ft = cut_lineage(features_table(spark, sf_dir), "classifier-features")  # one row per topic; read by every fold fit
        st = ft.agg(F.count(F.lit(1)).alias("n"), F.count_if("label").alias("pos")).first()
        folds = None if st["n"] < 6 or st["pos"] < 2 else fitted_folds(ft, min(3, int(st["pos"])))
        probs = None if folds is None else cut_lineage(calibrated(folds, ft, ["topic_id"]), "classifier-probs")
        model["classifier"] = ft, folds, probs
    return model["classifier"]


@register("event_classifier")
def event_classifier(spark, sf_dir):
    """Calibrated boosted trees on the topic feature table; refuses fewer
    than 6 rows or 2 positives (returns no rows)."""
    ft, _, p = trained(spark, sf_dir)
    schema = "topic_id int, label boolean, probability double, verdict string"
    if p is None:
        return spark.createDataFrame([], schema)
    return (ft.select("topic_id", "label").join(p, "topic_id")
            .select("topic_id", "label", F.round("probability", 6).alias("probability"),
                    E.verdict(F.col("probability")).alias("verdict")))


# ----------------------------------------------------------------- V35 and V34 with a model

#: Probabilities of the topics for the queries that SQL checks.
GIVEN_PROBS = {0: 0.80, 1: 0.62, 2: 0.75, 3: 0.55, 4: 0.45, 5: 0.30, 6: 0.10, 7: 0.40}
GIVEN_SQL = "mp AS (SELECT * FROM (VALUES " + ", ".join(f"({t}, {p})" for t, p in GIVEN_PROBS.items()) + ") v(topic_id, prob))"


def given_probs(spark):
    return spark.createDataFrame(list(GIVEN_PROBS.items()), "topic_id int, prob double")


def classifier_probs(spark, sf_dir, sig=None):
    """Probabilities of ``event_classifier``'s model, or None where it refuses: by topic, or by topic
    and year from the signals of the year (V35) if ``sig`` is given."""
    ft, folds, probs = trained(spark, sf_dir)
    if folds is None:
        return None
    if sig is None:
        return probs.withColumnRenamed("probability", "prob")
    rows = sig.select(
        "topic_id", "year", F.coalesce("velocity", F.lit(0.0)).alias("max_velocity"),
        trend.class_code(F.col("signal_class")).alias("peak_class_code"), F.col("nonzero_years").cast("int")).join(
        ft.select("topic_id", "coherence", "purity", "log_size"), "topic_id")
    return cut_lineage(calibrated(folds, rows, ["topic_id", "year"]).withColumnRenamed("probability", "prob"), "probs")


def model_verification(spark, sig, probs):
    """V35's model branch on (topic_id, year, prob): events whose timeline is unavailable are
    verified by their probability; one without keeps its status. None: no model, so the
    ground-truth dictionary."""
    return E.verify_events(E.events_to_verify(sig), timeline_df(spark, True), E.ground_truth_rules(spark), probs)


def model_verdicts(spark, sig, ver, probs):
    """V34 with its model step on (topic_id, prob); confidence as in ``layered_verdict``."""
    conf = sig.groupBy("topic_id").agg(F.sum("n_kt").alias("n"))
    tot = conf.agg(F.sum("n").alias("_tot"))
    labels = spark.createDataFrame(list(LAYERED_LABELS.items()), "topic_id int, topic_label string")
    t = labels.join(conf, "topic_id").crossJoin(F.broadcast(tot)).select(
        "topic_id", "topic_label", (F.col("n") / F.col("_tot") * 8 - 0.8).alias("confidence"))
    t = t.withColumn("prob", F.lit(None).cast("double")) if probs is None else t.join(F.broadcast(probs), "topic_id", "left")
    return verdict_columns(E.layered_verdict(t, E.event_dictionary(spark), sig, ver))


@register("timeline_verify_given", VERIFY_SQL + ",\n" + GIVEN_SQL + """
SELECT v.topic_id, v.topic_label, v.spike_year, v.query_terms, v.query_start_year, v.query_end_year,
       CASE WHEN v2.status0 = 'GDELT_UNAVAILABLE' AND mp.prob >= 0.40 THEN CAST(v.spike_year AS VARCHAR) || '0701000000'
            ELSE coalesce(v2.peak_date, '') END AS gdelt_peak_date,
       round(CAST(CASE WHEN v2.status0 = 'GDELT_UNAVAILABLE' AND mp.prob >= 0.40 THEN mp.prob
                       ELSE coalesce(v2.peak_value, 0.0) END AS DOUBLE), 6) AS gdelt_peak_value,
       CASE WHEN v2.status0 <> 'GDELT_UNAVAILABLE' THEN v2.status0 WHEN mp.prob >= 0.75 THEN 'VERIFIED_GROUNDTRUTH'
            WHEN mp.prob >= 0.40 THEN 'LIKELY_REAL' ELSE v2.status0 END AS verification_status
FROM ver v JOIN v2 ON v2.topic_id = v.topic_id AND v2.year = v.spike_year LEFT JOIN mp ON mp.topic_id = v.topic_id""")
def timeline_verify_given(spark, sf_dir):
    """V35's model branch on given probabilities."""
    sig = news_signals(spark, sf_dir)
    probs = sig.select("topic_id", "year").join(F.broadcast(given_probs(spark)), "topic_id")
    return model_verification(spark, sig, probs).withColumn("gdelt_peak_value", F.round("gdelt_peak_value", 6))


@register("timeline_verify_model")
def timeline_verify_model(spark, sf_dir):
    """V35 with ``event_classifier``'s model on the signals of topic and year; where it refuses, the
    ground-truth fallback."""
    sig = news_signals(spark, sf_dir)
    v = model_verification(spark, sig, classifier_probs(spark, sf_dir, sig))
    return v.withColumn("gdelt_peak_value", F.round("gdelt_peak_value", 6))


def scored_events(sig, ver):
    """V37 on a verification, with V36's display score of the first verified year (0.05 where there is none)."""
    w = Window.partitionBy("topic_id").orderBy("spike_year")
    first = (ver.withColumn("_r", F.row_number().over(w)).where("_r = 1")
             .select("topic_id", "verification_status", E.display_score(F.col("verification_status"), F.col("gdelt_peak_value")).alias("display_score")))
    out = E.final_events(sig, ver).join(first, "topic_id", "left")
    return out.withColumn("display_score", F.round(F.coalesce("display_score", F.lit(0.05)).cast("double"), 6))


@register("final_events_given", FINAL_SQL.replace("FROM ver GROUP BY", "FROM verg GROUP BY").replace("""per AS (SELECT topic_id, first(topic_label)""", GIVEN_SQL + """,
verg AS (SELECT v.topic_id, v.spike_year,
       CASE WHEN v2.status0 = 'GDELT_UNAVAILABLE' AND mp.prob >= 0.40 THEN CAST(v.spike_year AS VARCHAR) || '0701000000'
            ELSE coalesce(v2.peak_date, '') END AS gdelt_peak_date,
       CAST(CASE WHEN v2.status0 = 'GDELT_UNAVAILABLE' AND mp.prob >= 0.40 THEN mp.prob ELSE coalesce(v2.peak_value, 0.0) END AS DOUBLE) AS gdelt_peak_value,
       CASE WHEN v2.status0 <> 'GDELT_UNAVAILABLE' THEN v2.status0 WHEN mp.prob >= 0.75 THEN 'VERIFIED_GROUNDTRUTH'
            WHEN mp.prob >= 0.40 THEN 'LIKELY_REAL' ELSE v2.status0 END AS verification_status
     FROM ver v JOIN v2 ON v2.topic_id = v.topic_id AND v2.year = v.spike_year LEFT JOIN mp ON mp.topic_id = v.topic_id),
per AS (SELECT topic_id, first(topic_label)""") + """,
sc AS (SELECT topic_id, verification_status AS status, CASE WHEN verification_status = 'VERIFIED_GROUNDTRUTH' THEN 1.0
              WHEN verification_status = 'VERIFIED' THEN greatest(gdelt_peak_value, 0.5) WHEN verification_status = 'NOISE_UNVERIFIED' THEN 0.15
              ELSE 0.05 END AS s FROM verg QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY spike_year) = 1)
SELECT fin.topic_id, topic_label, raw_label, signal_class, peak_year, peak_velocity, gdelt_verified,
       CASE WHEN gdelt_verified THEN vdate ELSE '' END AS gdelt_peak_date, signal_class = 'EMERGING' AND gdelt_verified AS is_real_event,
       sc.status AS verification_status, CAST(round(coalesce(sc.s, 0.05), 6) AS DOUBLE) AS display_score
FROM fin LEFT JOIN sc ON sc.topic_id = fin.topic_id""")
def final_events_given(spark, sf_dir):
    """V36 + V37 on V35's model branch with given probabilities."""
    sig = news_signals(spark, sf_dir)
    probs = sig.select("topic_id", "year").join(F.broadcast(given_probs(spark)), "topic_id")
    return scored_events(sig, model_verification(spark, sig, probs))


@register("final_events_model")
def final_events_model(spark, sf_dir):
    """V36 + V37 on the verification by ``event_classifier``'s model."""
    sig = news_signals(spark, sf_dir)
    return scored_events(sig, model_verification(spark, sig, classifier_probs(spark, sf_dir, sig)))


@register("layered_verdict_given", NEWS_SIGNALS_SQL + ",\n" + GIVEN_SQL + f""",
ll AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{v}')" for k, v in LAYERED_LABELS.items())}) v(topic_id, label)),
conf AS (SELECT topic_id, sum(n_kt) AS n FROM signals GROUP BY topic_id),
t0 AS (SELECT ll.topic_id, ll.label, mp.prob, CAST(conf.n AS DOUBLE) / (SELECT sum(n) FROM conf) * 8 - 0.8 AS confidence
      FROM ll JOIN conf ON conf.topic_id = ll.topic_id JOIN mp ON mp.topic_id = ll.topic_id),
t AS (SELECT *, confidence < 0.15 AS low FROM t0)
SELECT topic_id, label AS topic_label,
       CASE WHEN low THEN 'UNCERTAIN' WHEN prob >= 0.75 THEN 'VERIFIED_REAL' WHEN prob >= 0.55 THEN 'LIKELY_REAL'
            WHEN prob >= 0.40 THEN 'UNCERTAIN' WHEN prob >= 0.25 THEN 'LIKELY_NOISE' ELSE 'VERIFIED_NOISE' END AS verdict,
       CAST(CASE WHEN low THEN 0.5 ELSE round(prob, 3) END AS DOUBLE) AS event_probability,
       CASE WHEN low THEN NULL WHEN prob >= 0.55 THEN true WHEN prob >= 0.40 THEN NULL ELSE false END AS is_real_event,
       label AS event_name,
       CASE WHEN low OR (prob >= 0.40 AND prob < 0.55) THEN 'unknown' WHEN prob >= 0.55 THEN 'news_event' WHEN prob >= 0.25 THEN 'general'
            ELSE 'lifestyle' END AS event_category,
       CASE WHEN low THEN printf('{REASON_GATE}', confidence * 100)
            {" ".join(f"WHEN prob >= {least} THEN printf('{MODEL_REASONS[name]}', prob)" for least, name in VERDICT_LEVELS)}
            ELSE printf('{MODEL_REASONS[VERDICT_FLOOR]}', prob) END AS reason, '' AS real_years
FROM t""")
def layered_verdict_given(spark, sf_dir):
    """V34's model step on given probabilities."""
    sig = news_signals(spark, sf_dir)
    probs = given_probs(spark)
    ver = model_verification(spark, sig, sig.select("topic_id", "year").join(F.broadcast(probs), "topic_id"))
    return model_verdicts(spark, sig, ver, probs)


@register("layered_verdict_model")
def layered_verdict_model(spark, sf_dir):
    """V34 with ``event_classifier``'s model, and its verification; topics without a probability go
    on to the event dictionary."""
    sig = news_signals(spark, sf_dir)
    ver = model_verification(spark, sig, classifier_probs(spark, sf_dir, sig))
    return model_verdicts(spark, sig, ver, classifier_probs(spark, sf_dir))


def topic_verdicts(spark, sf_dir, words):
    """V34 with its model step per topic. Topics without a classifier probability go on to the
    event dictionary. The gate on confidence is the record's own: it lies before V34."""
    sig, ver = verification(spark, sf_dir)
    probs = event_classifier(spark, sf_dir).select("topic_id", F.col("probability").alias("prob"))
    t = (TP.topic_labels(words).select(F.col("topic").alias("topic_id"), F.col("label").alias("topic_label"))
         .join(probs, "topic_id", "left").withColumn("confidence", F.lit(1.0)))
    return E.layered_verdict(t, E.event_dictionary(spark), sig, ver).withColumnRenamed("topic_id", "topic").withColumnRenamed("topic_label", "label")


def query_vectors(spark, sf_dir):
    """(query_id, term, qu) of the benchmark items within the corpus vocabulary, and (doc_id, term, u)
    of the articles; unit length."""
    _, tc, v = vocab_for(spark, sf_dir)
    terms = F.broadcast(v.select("term"))
    docs = bow.unit_rows(tc.join(terms, "term", "left_semi"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    q = bow.unit_rows(bow.term_counts(bow.doc_terms(b, "query_id", "text")).join(terms, "term", "left_semi"))
    return q.select(F.col("doc_id").alias("query_id"), "term", F.col("u").alias("qu")), docs.select("doc_id", "term", "u")


@register("similar_texts", _merge(with_ctes(TOPIC_DOCS_CTE), VOCAB_SQL) + f""",
bt AS ({terms_sql('benchmark', 'item_id')}),
btc AS (SELECT doc_id, term, count(*) AS tf FROM bt WHERE term IN (SELECT term FROM vocab) GROUP BY 1, 2),
qu AS (SELECT doc_id AS query_id, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)) AS u FROM btc),
du AS (SELECT doc_id, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)) AS u FROM tc WHERE term IN (SELECT term FROM vocab)),
s AS (SELECT query_id, du.doc_id, round(sum(qu.u * du.u), 9) AS score FROM qu JOIN du ON du.term = qu.term GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT r.query_id, CAST(r.rank AS INTEGER) AS rank, r.doc_id, round(r.score, 6) AS bow_cosine, d.topic, d.category,
       CAST(d.date AS VARCHAR) AS date, d.headline
FROM r JOIN topic_docs d ON d.doc_id = r.doc_id WHERE r.rank <= 5""")
def similar_texts(spark, sf_dir):
    """K8 on words: the 5 articles with the highest bag-of-words cosine for every benchmark
    query, through the impact index; with topic, category, date and headline."""
    q, docs = query_vectors(spark, sf_dir)
    found = textindex.text_search(textindex.build_text_index(docs), q, 5)
    art = topic_docs(spark, sf_dir).select("doc_id", "topic", "category", F.col("date").cast("string").alias("date"), "headline")
    return found.join(art, "doc_id").select("query_id", "rank", "doc_id", F.round("score", 6).alias("bow_cosine"), "topic", "category", "date", "headline")


@register("prediction_record")
def prediction_record(spark, sf_dir):
    """For every benchmark query the topic (keyword score, cohort or member
    similarity), gate, label, confidence text, the topic's layered verdict with its event,
    category, reason and years, the top 3 topics by member similarity and the 5 most
    similar articles by bag-of-words cosine, with the cosine of their encodings (V10), topic,
    category and date. A query under the gate has topic -1 and the verdict UNCERTAIN."""
    from trendspark.plans.q_topics import predict_df, topic_similarity
    p = pipeline(spark, sf_dir)
    words = p["words"]
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    verdicts = cut_lineage(topic_verdicts(spark, sf_dir, words), "verdicts")  # one row per topic
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), F.col("topic"))
    top3 = (topic_similarity(p, b).withColumn("r", F.row_number().over(w)).where("r <= 3")
            .join(F.broadcast(verdicts.select("topic", "label")), "topic", "left").groupBy("query_id")
            .agg(F.sort_array(F.collect_list(F.struct("r", "topic", "label", "sim"))).alias("top3")))
    found = cut_lineage(similar_texts(spark, sf_dir), "similar")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(found.select("doc_id").distinct(), "doc_id", "left_semi")

    def encoded(rows, key, name):
        tokens = rows.select(key, T.tokens(T.clean_alnum("text")).alias("tokens"))
        return ml.hashed_encoder(tokens, "tokens", 64).withColumnRenamed("embedding", name)

    similar = (found.join(encoded(docs, "doc_id", "dv"), "doc_id").join(encoded(b, "query_id", "qv"), "query_id")
               .withColumn("embedding_cosine", F.round(V.dot("dv", "qv"), 6)).groupBy("query_id")
               .agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "bow_cosine", "embedding_cosine", "headline", "category", "date", "topic")))
                    .alias("similar")))
    gate = F.col("score") < 0.15
    rec = predict_df(spark, sf_dir).select(
        "query_id", "method", F.when(gate, -1).otherwise(F.col("topic")).cast("int").alias("topic"),
        "score", T.percent_text(F.col("score")).alias("confidence_text"))
    none = F.col("topic") == -1
    rec = rec.join(F.broadcast(verdicts), "topic", "left").withColumns({
        "label": F.when(none, "No Matching Topic Found").otherwise(F.col("label")),
        "verdict": F.when(none, "UNCERTAIN").otherwise(F.col("verdict")),
        "event_name": F.when(none, "Unknown").otherwise(F.col("event_name")),
        "event_category": F.when(none, "unknown").otherwise(F.col("event_category")),
        "event_probability": F.when(none, 0.0).otherwise(F.col("event_probability")),
        "reason": F.when(none, F.format_string(REASON_GATE, F.col("score") * 100)).otherwise(F.col("reason"))})
    return rec.join(top3, "query_id", "left").join(similar, "query_id", "left")
