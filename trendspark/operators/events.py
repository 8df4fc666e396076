"""Event verification: timeline parsing, window test, ground-truth match,
verdicts, display scores and the final event table.

The external volume timeline is an *input table* ``(topic_id, payload)``;
no network client lives here. All rule dictionaries are small broadcast
dimensions; the event side is the (small) signal table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendspark.functions import timefn as D
from trendspark.operators import trend
from trendspark.rules import (MODEL_CATEGORIES, MODEL_REASONS, REASON_DICTIONARY, REASON_DICTIONARY_NOISE, REASON_EMERGING,
                              REASON_GATE, REASON_LIFESTYLE, REASON_NONE, GROUND_TRUTH_EVENT_NAMES, GROUND_TRUTH_EVENTS, GROUND_TRUTH_VERIFIED,
                              LIFESTYLE_KEYWORDS, VERDICT_FLOOR, VERDICT_LEVELS)

DICT_SCHEMA = "struct<timeline:array<struct<data:array<struct<date:string,value:double>>>>>"
LIST_SCHEMA = "array<struct<date:string,value:double>>"

# Fixed values of the verification model.
MODEL_VERIFIED = 0.75
MODEL_LIKELY = 0.40
QUERY_YEAR_MIN = 2017
QUERY_YEAR_MAX = 2023


# ------------------------------------------------------------------ S6 timeline parsing

def timeline_entries(payload: Column) -> Column:
    """Both payload shapes -> array<struct<date, value>> (empty when the
    object has no timeline; series without data are skipped)."""
    is_list = F.ltrim(payload).startswith("[")
    as_list = F.from_json(payload, LIST_SCHEMA)
    series = F.from_json(payload, DICT_SCHEMA)["timeline"]
    as_dict = F.flatten(F.transform(F.filter(F.coalesce(series, F.array()), lambda s: s["data"].isNotNull()),
                                    lambda s: s["data"]))
    empty = F.array().cast(LIST_SCHEMA)
    return F.when(is_list, F.coalesce(as_list, empty)).otherwise(F.coalesce(as_dict, empty))


def parse_timeline(timeline: DataFrame, key: str = "topic_id") -> DataFrame:
    """(key, pos, date, value) rows; a missing value is 0."""
    e = timeline.select(key, F.posexplode(timeline_entries(F.col("payload"))).alias("pos", "e"))
    return e.select(key, F.col("pos").cast("int").alias("pos"), F.col("e.date").alias("date"),
                    F.coalesce(F.col("e.value"), F.lit(0.0)).alias("value"))


def timeline_peaks(timeline: DataFrame, key: str = "topic_id") -> DataFrame:
    """Per key: has_timeline, n_entries, first maximum (date, value)."""
    entries = parse_timeline(timeline, key)
    peaks = entries.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.max_by(F.struct("date", "value"), F.struct(F.col("value"), -F.col("pos"))).alias("_pk"))
    return (timeline.select(key).distinct().join(peaks, key, "left")
            .select(key, F.coalesce("n_entries", F.lit(0)).cast("int").alias("n_entries"),
                    F.col("_pk.date").alias("peak_date"), F.col("_pk.value").alias("peak_value")))


# ------------------------------------------------------------------ dimensions

def ground_truth_rules(spark: SparkSession) -> DataFrame:
    rows = [(i, kw, yrs, GROUND_TRUTH_EVENT_NAMES.get(kw, kw.title()))
            for i, (kw, yrs) in enumerate(GROUND_TRUTH_VERIFIED)]
    return spark.createDataFrame(rows, "rule_idx int, keyword string, years array<int>, event_name string")


def event_dictionary(spark: SparkSession) -> DataFrame:
    rows = [(i, kw, yrs, name, cat, ver) for i, (kw, yrs, name, cat, ver) in enumerate(GROUND_TRUTH_EVENTS)]
    return spark.createDataFrame(rows, "rule_idx int, keyword string, real_years array<int>, event_name string, "
                                       "category string, verified boolean")


def groundtruth_match(df: DataFrame, rules: DataFrame, text_col: str, year_col: str | None,
                      prefix: str = "gt", keys=("topic_id", "year")) -> DataFrame:
    """First rule (dictionary order) whose keyword is a substring of the
    lower-cased text and (when ``year_col`` is given) has a valid year within
    +-1. Theta join against the broadcast rule table, then min by rule index,
    joined back on the row keys. Adds ``{prefix}_keyword`` and
    ``{prefix}_name`` (null when none)."""
    keys = list(keys)
    cond = F.contains(F.lower(F.col(text_col).cast("string")), F.col("keyword"))
    if year_col is not None:
        cond = cond & F.exists("years", lambda y: F.abs(y - F.col(year_col)) <= 1)
    cols = list(dict.fromkeys(keys + [text_col] + ([year_col] if year_col else [])))
    hits = (df.select(*cols).join(F.broadcast(rules), cond)
            .groupBy(*keys).agg(F.min_by(F.struct("keyword", "event_name"), F.col("rule_idx")).alias("_m")))
    return (df.join(hits, keys, "left")
            .withColumn(f"{prefix}_keyword", F.col("_m.keyword"))
            .withColumn(f"{prefix}_name", F.col("_m.event_name")).drop("_m"))


# ------------------------------------------------------------------ events to verify

def events_to_verify(signals: DataFrame) -> DataFrame:
    """The EMERGING rows; when there are none, the 3 STRONG rows with the
    highest velocity (earliest topic/year on ties). The fallback is gated by a
    one-row count, so no branch is evaluated on the driver."""
    em = signals.where(F.col("signal_class") == "EMERGING")
    n_em = em.agg(F.count(F.lit(1)).alias("_n_em"))
    strong = trend_top3_strong(signals).crossJoin(F.broadcast(n_em)).where(F.col("_n_em") == 0).drop("_n_em")
    return em.unionByName(strong)


def trend_top3_strong(signals: DataFrame) -> DataFrame:
    return (signals.where(F.col("signal_class") == "STRONG_SIGNAL")
            .orderBy(F.desc("velocity"), "topic_id", "year").limit(3))


def query_terms(raw_label: Column) -> Column:
    """First token of each of the top 3 words longer than 3 characters,
    at most 2, joined by a space; else the raw label's head."""
    words = F.split(raw_label, " / ")
    firsts = F.transform(F.slice(words, 1, 3), lambda w: F.split(F.trim(w), " ")[0])
    keep = F.slice(F.filter(firsts, lambda w: F.length(w) > 3), 1, 2)
    return F.coalesce(F.nullif(F.array_join(keep, " "), F.lit("")), F.trim(F.split(raw_label, "/")[0]))


# ------------------------------------------------------------------ V35 verification

def verify_events(events: DataFrame, timeline: DataFrame, rules: DataFrame,
                  model_probs: DataFrame | None = None) -> DataFrame:
    """V35 on (topic_id, year, topic_label, raw_label) events.

    timeline: (topic_id, payload) — no row means no response. model_probs:
    optional (topic_id, year, prob); without it the ground-truth dictionary
    is the fallback (label first, then raw label)."""
    ev = events.select("topic_id", "year", "topic_label", "raw_label")
    pk = timeline_peaks(timeline)
    e = ev.join(pk, "topic_id", "left")
    y = F.col("year")
    d8 = F.try_to_date(F.substring("peak_date", 1, 8), "yyyyMMdd")
    y4 = F.expr("try_cast(substring(peak_date, 1, 4) AS INT)")
    in_win = D.spike_window(d8, y)
    status = (F.when(F.col("n_entries").isNull(), "GDELT_UNAVAILABLE")
              .when(F.col("n_entries") == 0, "NOISE_UNVERIFIED")
              .when(d8.isNotNull(), F.when(in_win, "VERIFIED").otherwise("NOISE_UNVERIFIED"))
              .when(y4.isNotNull(), F.when(F.abs(y4 - y) <= 1, "VERIFIED").otherwise("NOISE_UNVERIFIED"))
              .otherwise("GDELT_UNAVAILABLE"))
    e = e.withColumn("status", status).withColumn(
        "peak_date", F.coalesce("peak_date", F.lit(""))).withColumn(
        "peak_value", F.coalesce("peak_value", F.lit(0.0)))
    filled_date = F.concat(y.cast("string"), F.lit("0701000000"))
    unavailable = F.col("status") == "GDELT_UNAVAILABLE"
    if model_probs is not None:
        e = e.join(model_probs.select("topic_id", "year", "prob"), ["topic_id", "year"], "left")
        p = F.col("prob")
        new_status = (F.when(unavailable & (p >= MODEL_VERIFIED), "VERIFIED_GROUNDTRUTH")
                      .when(unavailable & (p >= MODEL_LIKELY), "LIKELY_REAL").otherwise(F.col("status")))
        changed = unavailable & (p >= MODEL_LIKELY)
        e = (e.withColumn("peak_value", F.when(changed, p).otherwise(F.col("peak_value")))
             .withColumn("peak_date", F.when(changed, filled_date).otherwise(F.col("peak_date")))
             .withColumn("status", new_status).drop("prob"))
    else:
        e = groundtruth_match(e, rules, "topic_label", "year", "gl")
        e = groundtruth_match(e, rules, "raw_label", "year", "gr")
        hit = unavailable & (F.col("gl_keyword").isNotNull() | F.col("gr_keyword").isNotNull())
        e = (e.withColumn("peak_value", F.when(hit, F.lit(1.0)).otherwise(F.col("peak_value")))
             .withColumn("peak_date", F.when(hit, filled_date).otherwise(F.col("peak_date")))
             .withColumn("status", F.when(hit, "VERIFIED_GROUNDTRUTH").otherwise(F.col("status")))
             .drop("gl_keyword", "gl_name", "gr_keyword", "gr_name"))
    return e.select("topic_id", "topic_label", F.col("year").alias("spike_year"),
                    query_terms(F.col("raw_label")).alias("query_terms"),
                    F.greatest(F.lit(QUERY_YEAR_MIN), y - 1).alias("query_start_year"),
                    F.least(F.lit(QUERY_YEAR_MAX), y + 1).alias("query_end_year"),
                    F.col("peak_date").alias("gdelt_peak_date"),
                    F.col("peak_value").cast("double").alias("gdelt_peak_value"),
                    F.col("status").alias("verification_status"))


def display_score(status: Column, value: Column) -> Column:
    """V36."""
    return (F.when(status == "VERIFIED_GROUNDTRUTH", 1.0)
            .when(status == "VERIFIED", F.greatest(value, F.lit(0.5)))
            .when(status == "NOISE_UNVERIFIED", 0.15).otherwise(0.05))


def verdict(prob: Column) -> Column:
    """Probability -> five verdicts."""
    out = None
    for thr, name in VERDICT_LEVELS:
        out = F.when(prob >= thr, name) if out is None else out.when(prob >= thr, name)
    return out.otherwise(VERDICT_FLOOR)


# ------------------------------------------------------------------ V37 final events

def final_events(signals: DataFrame, verification: DataFrame) -> DataFrame:
    """V37 + J8 + W8 + W9: per topic best class (priority), peak row (highest
    velocity, earliest year), first verification row (earliest spike year),
    real = EMERGING and verified (VERIFIED, VERIFIED_GROUNDTRUTH, LIKELY_REAL)."""
    per = signals.groupBy("topic_id").agg(
        F.first("topic_label").alias("topic_label"), F.first("raw_label").alias("raw_label"),
        F.max_by("signal_class", trend.class_code(F.col("signal_class"))).alias("best"),
        F.max_by(F.struct("year", "velocity"), F.struct(F.col("velocity"), -F.col("year"))).alias("_pk"))
    w = Window.partitionBy("topic_id").orderBy("spike_year")
    first_ver = (verification.withColumn("_r", F.row_number().over(w)).where("_r = 1")
                 .select("topic_id", "verification_status", "gdelt_peak_date"))
    j = per.join(first_ver, "topic_id", "left")
    verified = F.coalesce(F.col("verification_status").isin("VERIFIED", "VERIFIED_GROUNDTRUTH", "LIKELY_REAL"),
                          F.lit(False))
    noise = F.col("best") == "NOISE"
    return j.select(
        "topic_id", "topic_label", "raw_label", F.col("best").alias("signal_class"),
        F.when(noise, F.lit(None)).otherwise(F.col("_pk.year")).cast("int").alias("peak_year"),
        F.when(noise, F.lit(None)).otherwise(F.round(F.col("_pk.velocity"), 4)).cast("double").alias("peak_velocity"),
        verified.alias("gdelt_verified"),
        F.when(verified, F.col("gdelt_peak_date")).otherwise(F.lit("")).alias("gdelt_peak_date"),
        ((F.col("best") == "EMERGING") & verified).alias("is_real_event"))


def layered_verdict(topics: DataFrame, event_dict: DataFrame, signals: DataFrame,
                    verification: DataFrame) -> DataFrame:
    """V34 + J11 + T16 on (topic_id, topic_label, confidence, prob?) rows:
    gate -> model -> event dictionary -> EMERGING and verified -> lifestyle
    word -> UNCERTAIN. ``prob`` may be null (no model). Adds verdict, probability,
    is_real_event, event name and category, the reason and the dictionary's years."""
    t = topics
    label_l = F.lower(F.col("topic_label"))
    # event dictionary: first keyword contained in the label
    hits = (t.select("topic_id", "topic_label").join(
        F.broadcast(event_dict), F.contains(F.lower(F.col("topic_label")), F.col("keyword")))
        .groupBy("topic_id").agg(F.min_by(F.struct("real_years", "event_name", "category", "verified"),
                                          F.col("rule_idx")).alias("_gt")))
    em = signals.groupBy("topic_id").agg(F.max(F.col("signal_class") == "EMERGING").alias("_em"))
    w = Window.partitionBy("topic_id").orderBy("spike_year")
    fv = (verification.withColumn("_r", F.row_number().over(w)).where("_r = 1")
          .select("topic_id", F.col("verification_status").isin("VERIFIED", "VERIFIED_GROUNDTRUTH").alias("_ver")))
    j = t.join(hits, "topic_id", "left").join(em, "topic_id", "left").join(fv, "topic_id", "left")
    p = F.col("prob")
    gate = F.col("confidence") < 0.15
    model = p.isNotNull()
    gt = F.col("_gt").isNotNull()
    gt_real = gt & F.col("_gt.verified") & (F.size("_gt.real_years") > 0)
    emv = F.coalesce(F.col("_em"), F.lit(False)) & F.coalesce(F.col("_ver"), F.lit(False))
    life = F.lit(False)
    for kw in LIFESTYLE_KEYWORDS:
        life = life | F.contains(label_l, F.lit(kw))
    v = (F.when(gate, "UNCERTAIN").when(model, verdict(p))
         .when(gt_real, "VERIFIED_REAL").when(gt, "VERIFIED_NOISE")
         .when(emv, "VERIFIED_REAL").when(life, "VERIFIED_NOISE").otherwise("UNCERTAIN"))
    prob = (F.when(gate, 0.5).when(model, F.round(p, 3)).when(gt_real, 0.95).when(gt, 0.05)
            .when(emv, 0.85).when(life, 0.1).otherwise(0.5))
    is_real = (F.when(gate, F.lit(None)).when(model, F.when(p >= 0.55, True).when(p >= 0.40, None).otherwise(False))
               .when(gt_real, True).when(gt, False).when(emv, True).when(life, False).otherwise(F.lit(None)))
    name = F.when(~gate & ~model & gt, F.col("_gt.event_name")).otherwise(F.col("topic_label"))
    by_verdict = lambda table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[verdict(p)]
    category = (F.when(gate, "unknown").when(model, by_verdict(MODEL_CATEGORIES)).when(gt, F.col("_gt.category"))
                .when(emv, "news_event").when(life, "lifestyle").otherwise("unknown"))
    model_reason = F.coalesce(*[F.when(verdict(p) == name_, F.format_string(text, p)) for name_, text in MODEL_REASONS.items()])
    years = F.array_join(F.col("_gt.real_years").cast("array<string>"), ", ")
    reason = (F.when(gate, F.format_string(REASON_GATE, F.col("confidence") * 100)).when(model, model_reason)
              .when(gt_real, F.format_string(REASON_DICTIONARY, F.col("_gt.event_name"), years))
              .when(gt, REASON_DICTIONARY_NOISE).when(emv, REASON_EMERGING).when(life, REASON_LIFESTYLE).otherwise(REASON_NONE))
    real_years = F.when(~gate & ~model & gt_real, F.col("_gt.real_years")).otherwise(F.array().cast("array<int>"))
    return j.select("topic_id", "topic_label", v.alias("verdict"), prob.cast("double").alias("event_probability"),
                    is_real.cast("boolean").alias("is_real_event"), name.alias("event_name"), category.alias("event_category"),
                    reason.alias("reason"), real_years.alias("real_years"))
