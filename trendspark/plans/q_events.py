"""Event queries: timeline parsing and verification, ground truth, verdicts,
display scores, final events, classifier features.

Input: topic signals of ``topic_orders`` with its calendar moved onto the
news calendar (1995-2001 + 21 = 2016-2022, where the ground-truth years lie),
an inline label dimension per topic and inline timeline payloads per topic
(the external volume service is a table here, never a network call).
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from trendspark.operators import events as E
from trendspark.operators import trend
from trendspark.plans.q_trend import SIGNAL_SQL_CTES
from trendspark.plans.registry import register
from trendspark.plans.views import topic_orders
from trendspark.rules import REASON_DICTIONARY, REASON_DICTIONARY_NOISE, REASON_EMERGING, REASON_GATE, REASON_LIFESTYLE, REASON_NONE, GROUND_TRUTH_EVENT_NAMES, GROUND_TRUTH_EVENTS, GROUND_TRUTH_VERIFIED, LIFESTYLE_KEYWORDS

YEAR_SHIFT = 21

# Fixture: labels per topic of topic_orders (topic_id, topic_label, raw_label).
TOPIC_LABELS = [
    (0, "Mueller Investigation 2017-19", "mueller / investigation / russia"),
    (1, "COVID-19 Crisis", "covid19 / pandemic / coronavirus"),
    (2, "Russia-Ukraine War 2022", "ukraine / putin / war"),
    (3, "Trump Impeachment Era", "impeachment / trump / house"),
    (4, "Wedding & Beauty", "wedding / bride / beauty"),
    (5, "Fox News & Conservative Media", "fox news / tucker / host"),
    (6, "Parenting & Family Life", "parenting / kids / baby"),
    (7, "Topic 7", "mueller report / barr / doj"),
]

# Fixture: timeline payloads per topic, covering a bare-list payload, a peak
# on the start edge (with a later tie), an unreadable date with a readable
# year, the end edge with a missing value and a series without data, a peak
# outside the window, an object without a timeline, an empty timeline and an
# unreadable date. Topic 7 has no row: the service gave no answer.
TIMELINES = [
    (0, [{"date": "20190315000000", "value": 5.2}, {"date": "20180101000000", "value": 1.0}]),
    (1, {"timeline": [{"data": [{"date": "20160701000000", "value": 9.0},
                                {"date": "20200101000000", "value": 9.0}]}]}),
    (2, {"timeline": [{"data": [{"date": "2022-xx", "value": 3.0}]}]}),
    (3, {"timeline": [{"series": "x", "data": [{"date": "20220630000000", "value": 4.0},
                                              {"date": "20180101000000"}]}, {"series": "y"}]}),
    (4, {"timeline": [{"data": [{"date": "20230101000000", "value": 2.0}]}]}),
    (5, {"status": "ok"}),
    (6, {"timeline": []}),
]
TIMELINE_GARBAGE = (7, {"timeline": [{"data": [{"date": "garbage", "value": 1.5}]}]})


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def labels_df(spark):
    return spark.createDataFrame(TOPIC_LABELS, "topic_id int, topic_label string, raw_label string")


def timeline_df(spark, with_garbage: bool = False):
    rows = [(k, json.dumps(p)) for k, p in TIMELINES + ([TIMELINE_GARBAGE] if with_garbage else [])]
    return spark.createDataFrame(rows, "topic_id int, payload string")


def news_signals(spark, sf_dir):
    """Signals on the news calendar. The finished signal table (topics x years,
    independent of the row count) feeds many branches of every event query,
    so it is written once to the checkpoint folder."""
    from trendspark.session import cut_lineage
    o = topic_orders(spark, sf_dir).withColumn("year", F.col("year") + YEAR_SHIFT)
    return cut_lineage(trend.signal_table(o, labels=labels_df(spark)), "signals")


# ----------------------------------------------------------------- SQL pieces

LABELS_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {_q(a)}, {_q(b)})" for i, a, b in TOPIC_LABELS) + ") v(topic_id, topic_label, raw_label)"


def timeline_sql(with_garbage: bool = False) -> str:
    rows = TIMELINES + ([TIMELINE_GARBAGE] if with_garbage else [])
    return "SELECT * FROM (VALUES " + ", ".join(
        f"({k}, {_q(json.dumps(p))})" for k, p in rows) + ") v(topic_id, payload)"


GT_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {_q(kw)}, {list(yrs)}, {_q(GROUND_TRUTH_EVENT_NAMES.get(kw, kw.title()))})"
    for i, (kw, yrs) in enumerate(GROUND_TRUTH_VERIFIED)) + ") v(rule_idx, keyword, years, event_name)"

NEWS_SIGNALS_SQL = SIGNAL_SQL_CTES.replace(
    "CAST(year(o_orderdate) AS INTEGER) AS year", f"CAST(year(o_orderdate) + {YEAR_SHIFT} AS INTEGER) AS year") + f""",
lab AS ({LABELS_SQL}),
signals AS (SELECT CAST(s.topic AS INTEGER) AS topic_id, s.year, s.n_kt, s.velocity, s.popularity,
                   s.nonzero_years, s.gap, s.decay, s.signal_class,
                   coalesce(lab.topic_label, 'Topic ' || CAST(s.topic AS VARCHAR)) AS topic_label, lab.raw_label
            FROM sig s LEFT JOIN lab ON lab.topic_id = s.topic),
em AS (SELECT * FROM signals WHERE signal_class = 'EMERGING'),
st AS (SELECT * FROM signals WHERE signal_class = 'STRONG_SIGNAL' ORDER BY velocity DESC, topic_id, year LIMIT 3),
events AS (SELECT * FROM em UNION ALL SELECT * FROM st WHERE (SELECT count(*) FROM em) = 0)
"""


def parsed_sql(src: str) -> str:
    return f""",
tl AS ({src}),
ent AS (SELECT topic_id, CASE WHEN json_type(payload) = 'ARRAY' THEN json_extract(payload, '$[*]')
                              ELSE json_extract(payload, '$.timeline[*].data[*]') END AS es FROM tl),
flat AS (SELECT topic_id, generate_subscripts(es, 1) - 1 AS pos, unnest(es) AS e FROM ent),
parsed AS (SELECT topic_id, CAST(pos AS INTEGER) AS pos, json_extract_string(e, '$.date') AS date,
                  coalesce(CAST(json_extract(e, '$.value') AS DOUBLE), 0.0) AS value FROM flat),
peaks AS (SELECT tl.topic_id, CAST(count(p.pos) AS INTEGER) AS n_entries,
                 first(p.date ORDER BY p.value DESC, p.pos) AS peak_date,
                 first(p.value ORDER BY p.value DESC, p.pos) AS peak_value
          FROM tl LEFT JOIN parsed p ON p.topic_id = tl.topic_id GROUP BY tl.topic_id)
"""


VERIFY_SQL = NEWS_SIGNALS_SQL + parsed_sql(timeline_sql(True)) + f""",
gt AS ({GT_SQL}),
v0 AS (SELECT e.topic_id, e.topic_label, e.raw_label, e.year, pk.n_entries, pk.peak_date, pk.peak_value,
              CAST(try_strptime(substr(pk.peak_date, 1, 8), '%Y%m%d') AS DATE) AS d8,
              TRY_CAST(substr(pk.peak_date, 1, 4) AS INTEGER) AS y4
       FROM events e LEFT JOIN peaks pk ON pk.topic_id = e.topic_id),
v1 AS (SELECT *, CASE WHEN n_entries IS NULL THEN 'GDELT_UNAVAILABLE'
                      WHEN n_entries = 0 THEN 'NOISE_UNVERIFIED'
                      WHEN d8 IS NOT NULL THEN CASE WHEN d8 BETWEEN CAST(make_date(year, 1, 1) - INTERVAL 6 MONTH AS DATE)
                                                           AND CAST(make_date(year, 12, 31) + INTERVAL 6 MONTH AS DATE)
                                                    THEN 'VERIFIED' ELSE 'NOISE_UNVERIFIED' END
                      WHEN y4 IS NOT NULL THEN CASE WHEN abs(y4 - year) <= 1 THEN 'VERIFIED' ELSE 'NOISE_UNVERIFIED' END
                      ELSE 'GDELT_UNAVAILABLE' END AS status0 FROM v0),
gl AS (SELECT v1.topic_id, v1.year, min(gt.rule_idx) AS r FROM v1 JOIN gt
         ON contains(lower(v1.topic_label), gt.keyword) AND len(list_filter(gt.years, lambda y: abs(y - v1.year) <= 1)) > 0
       GROUP BY 1, 2),
gr AS (SELECT v1.topic_id, v1.year, min(gt.rule_idx) AS r FROM v1 JOIN gt
         ON contains(lower(v1.raw_label), gt.keyword) AND len(list_filter(gt.years, lambda y: abs(y - v1.year) <= 1)) > 0
       GROUP BY 1, 2),
v2 AS (SELECT v1.*, status0 = 'GDELT_UNAVAILABLE' AND (gl.r IS NOT NULL OR gr.r IS NOT NULL) AS hit
       FROM v1 LEFT JOIN gl ON gl.topic_id = v1.topic_id AND gl.year = v1.year
               LEFT JOIN gr ON gr.topic_id = v1.topic_id AND gr.year = v1.year),
ver AS (SELECT topic_id, topic_label, year AS spike_year,
               coalesce(nullif(array_to_string(list_slice(list_filter(list_transform(
                   list_slice(string_split(raw_label, ' / '), 1, 3), lambda w: string_split(trim(w), ' ')[1]),
                   lambda w: length(w) > 3), 1, 2), ' '), ''), trim(string_split(raw_label, '/')[1])) AS query_terms,
               greatest(2017, year - 1) AS query_start_year, least(2023, year + 1) AS query_end_year,
               CASE WHEN hit THEN CAST(year AS VARCHAR) || '0701000000' ELSE coalesce(peak_date, '') END AS gdelt_peak_date,
               CAST(CASE WHEN hit THEN 1.0 ELSE coalesce(peak_value, 0.0) END AS DOUBLE) AS gdelt_peak_value,
               CASE WHEN hit THEN 'VERIFIED_GROUNDTRUTH' ELSE status0 END AS verification_status
        FROM v2)
"""


def verification(spark, sf_dir):
    sig = news_signals(spark, sf_dir)
    ev = E.events_to_verify(sig)
    return sig, E.verify_events(ev, timeline_df(spark, True), E.ground_truth_rules(spark))


@register("timeline_parse", NEWS_SIGNALS_SQL + parsed_sql(timeline_sql(True)) + """
SELECT e.topic_id, e.year, p.pos, p.date, round(p.value, 6) AS value
FROM events e JOIN parsed p ON p.topic_id = e.topic_id""")
def timeline_parse(spark, sf_dir):
    """Both payload shapes -> (topic_id, pos, date, value), missing value
    0, for every event to verify (events come from the data; payloads from
    the timeline table)."""
    ev = E.events_to_verify(news_signals(spark, sf_dir)).select("topic_id", "year")
    t = E.parse_timeline(timeline_df(spark, True))
    return ev.join(t, "topic_id").select(
        "topic_id", "year", "pos", "date", F.round("value", 6).alias("value"))


@register("events_to_verify", NEWS_SIGNALS_SQL + """
SELECT topic_id, year, n_kt, velocity, signal_class FROM events""")
def events_to_verify(spark, sf_dir):
    """K10."""
    return E.events_to_verify(news_signals(spark, sf_dir)).select(
        "topic_id", "year", "n_kt", "velocity", "signal_class")


@register("timeline_verify", VERIFY_SQL + """
SELECT topic_id, topic_label, spike_year, query_terms, query_start_year, query_end_year,
       gdelt_peak_date, round(gdelt_peak_value, 6) AS gdelt_peak_value, verification_status FROM ver""")
def timeline_verify(spark, sf_dir):
    """J6 + D6 + D7 + T14 + V35 (ground-truth fallback, no model)."""
    _, v = verification(spark, sf_dir)
    return v.withColumn("gdelt_peak_value", F.round("gdelt_peak_value", 6))


@register("display_score", VERIFY_SQL + """,
sc AS (SELECT verification_status, CASE WHEN verification_status = 'VERIFIED_GROUNDTRUTH' THEN 1.0
                                        WHEN verification_status = 'VERIFIED' THEN greatest(gdelt_peak_value, 0.5)
                                        WHEN verification_status = 'NOISE_UNVERIFIED' THEN 0.15 ELSE 0.05 END AS s
       FROM ver)
SELECT k.status AS verification_status, CAST(count(sc.s) AS BIGINT) AS n, round(coalesce(sum(sc.s), 0), 6) AS score_sum
FROM (VALUES ('VERIFIED_GROUNDTRUTH'), ('VERIFIED'), ('NOISE_UNVERIFIED'), ('GDELT_UNAVAILABLE')) k(status)
LEFT JOIN sc ON sc.verification_status = k.status GROUP BY k.status""")
def display_score(spark, sf_dir):
    """V36 + A25: display score per verification row, counts per status over
    the fixed four keys (LIKELY_REAL is not one of them), zeros kept."""
    _, v = verification(spark, sf_dir)
    sc = v.select("verification_status",
                  E.display_score(F.col("verification_status"), F.col("gdelt_peak_value")).alias("s"))
    keys = spark.createDataFrame([(k,) for k in ("VERIFIED_GROUNDTRUTH", "VERIFIED", "NOISE_UNVERIFIED",
                                                 "GDELT_UNAVAILABLE")], "verification_status string")
    return (keys.join(sc, "verification_status", "left").groupBy("verification_status")
            .agg(F.count("s").alias("n"), F.round(F.coalesce(F.sum("s"), F.lit(0.0)), 6).alias("score_sum")))


FINAL_SQL = VERIFY_SQL + """,
per AS (SELECT topic_id, first(topic_label) AS topic_label, first(raw_label) AS raw_label,
               arg_max(signal_class, CASE signal_class WHEN 'NOISE' THEN 0 WHEN 'WEAK_SIGNAL' THEN 1
                                                     WHEN 'STRONG_SIGNAL' THEN 2 ELSE 3 END) AS best,
               first(year ORDER BY velocity DESC, year) AS pk_year,
               first(velocity ORDER BY velocity DESC, year) AS pk_vel
        FROM signals GROUP BY topic_id),
fv AS (SELECT topic_id, first(verification_status ORDER BY spike_year) AS verification_status,
              first(gdelt_peak_date ORDER BY spike_year) AS gdelt_peak_date FROM ver GROUP BY topic_id),
fin AS (SELECT per.topic_id, per.topic_label, per.raw_label, best AS signal_class,
               CASE WHEN best = 'NOISE' THEN NULL ELSE CAST(pk_year AS INTEGER) END AS peak_year,
               CASE WHEN best = 'NOISE' THEN NULL ELSE round(pk_vel, 4) END AS peak_velocity,
               coalesce(fv.verification_status IN ('VERIFIED', 'VERIFIED_GROUNDTRUTH', 'LIKELY_REAL'), false) AS gdelt_verified,
               fv.gdelt_peak_date AS vdate
        FROM per LEFT JOIN fv ON fv.topic_id = per.topic_id)
"""


@register("final_events", FINAL_SQL + """
SELECT topic_id, topic_label, raw_label, signal_class, peak_year, peak_velocity, gdelt_verified,
       CASE WHEN gdelt_verified THEN vdate ELSE '' END AS gdelt_peak_date,
       signal_class = 'EMERGING' AND gdelt_verified AS is_real_event FROM fin""")
def final_events(spark, sf_dir):
    """V37 + J8."""
    sig, v = verification(spark, sf_dir)
    # Events by peak velocity, null as 0, descending (output order only)
    return E.final_events(sig, v).orderBy(F.desc(F.coalesce("peak_velocity", F.lit(0.0))), "topic_id")


@register("final_tallies", FINAL_SQL + """
SELECT CAST(count(*) FILTER (WHERE signal_class = 'EMERGING') AS BIGINT) AS n_emerging,
       CAST(count(*) FILTER (WHERE gdelt_verified) AS BIGINT) AS n_verified,
       CAST(count(*) FILTER (WHERE signal_class = 'EMERGING' AND gdelt_verified) AS BIGINT) AS n_real
FROM fin""")
def final_tallies(spark, sf_dir):
    """A27."""
    f = final_events(spark, sf_dir)
    return f.agg(F.count_if(F.col("signal_class") == "EMERGING").alias("n_emerging"),
                 F.count_if("gdelt_verified").alias("n_verified"),
                 F.count_if("is_real_event").alias("n_real"))


@register("peak_and_best_class", NEWS_SIGNALS_SQL + """,
per AS (SELECT topic_id,
               arg_max(signal_class, CASE signal_class WHEN 'NOISE' THEN 0 WHEN 'WEAK_SIGNAL' THEN 1
                                                     WHEN 'STRONG_SIGNAL' THEN 2 ELSE 3 END) AS best_class,
               CAST(first(year ORDER BY velocity DESC, year) AS INTEGER) AS peak_year,
               first(velocity ORDER BY velocity DESC, year) AS peak_velocity,
               first(signal_class ORDER BY velocity DESC, year) AS peak_class
        FROM signals GROUP BY topic_id)
SELECT *, topic_id IN (SELECT topic_id FROM per ORDER BY peak_velocity DESC, topic_id LIMIT 5) AS top5_velocity FROM per""")
def peak_and_best_class(spark, sf_dir):
    """W8 + W9 + K11: peak row per topic (highest velocity, earliest year),
    class at the peak, best class by priority, 5 topics with highest peak."""
    s = news_signals(spark, sf_dir)
    per = s.groupBy("topic_id").agg(
        F.max_by("signal_class", trend.class_code(F.col("signal_class"))).alias("best_class"),
        F.max_by(F.struct("year", "velocity", "signal_class"),
                 F.struct(F.col("velocity"), -F.col("year"))).alias("_pk"))
    per = per.select("topic_id", "best_class", F.col("_pk.year").alias("peak_year"),
                     F.col("_pk.velocity").alias("peak_velocity"), F.col("_pk.signal_class").alias("peak_class"))
    top = per.orderBy(F.desc("peak_velocity"), "topic_id").limit(5).select("topic_id", F.lit(True).alias("_t"))
    return per.join(F.broadcast(top), "topic_id", "left").withColumn(
        "top5_velocity", F.coalesce("_t", F.lit(False))).drop("_t")


@register("groundtruth_match", NEWS_SIGNALS_SQL + f""",
gt AS ({GT_SQL}),
gy AS (SELECT s.topic_id, s.year, min(gt.rule_idx) AS r FROM signals s JOIN gt
         ON contains(lower(s.topic_label), gt.keyword) AND len(list_filter(gt.years, lambda y: abs(y - s.year) <= 1)) > 0
       GROUP BY 1, 2),
gn AS (SELECT s.topic_id, s.year, min(gt.rule_idx) AS r FROM signals s JOIN gt
         ON contains(lower(s.topic_label), gt.keyword) OR contains(lower(s.raw_label), gt.keyword)
       GROUP BY 1, 2)
SELECT s.topic_id, s.year, g1.keyword AS gt_keyword, g1.event_name AS gt_name, g2.keyword IS NOT NULL AS train_real
FROM signals s
LEFT JOIN gy ON gy.topic_id = s.topic_id AND gy.year = s.year LEFT JOIN gt g1 ON g1.rule_idx = gy.r
LEFT JOIN gn ON gn.topic_id = s.topic_id AND gn.year = s.year LEFT JOIN gt g2 ON g2.rule_idx = gn.r""")
def groundtruth_match(spark, sf_dir):
    """J5 (keyword in label and a valid year within +-1, first in dictionary
    order) and V30 (training label: keyword in label or raw label, no year
    test) on every signal row."""
    s = news_signals(spark, sf_dir).select("topic_id", "year", "topic_label", "raw_label")
    rules = E.ground_truth_rules(spark)
    m = E.groundtruth_match(s, rules, "topic_label", "year", "gt")
    both = s.withColumn("_lr", F.concat_ws("\u0001", F.lower("topic_label"), F.lower("raw_label")))
    t = E.groundtruth_match(both, rules, "_lr", None, "tr")
    return (m.join(t.select("topic_id", "year", "tr_keyword"), ["topic_id", "year"])
            .select("topic_id", "year", "gt_keyword", "gt_name",
                    F.col("tr_keyword").isNotNull().alias("train_real")))


@register("verdict_map", NEWS_SIGNALS_SQL + """,
p AS (SELECT topic_id, year, CAST(n_kt AS DOUBLE) / max(n_kt) OVER () AS prob FROM signals
      UNION ALL SELECT -1, v.y, v.p FROM (VALUES (0, 0.80), (1, 0.62), (2, 0.45), (3, 0.30), (4, 0.10)) v(y, p))
SELECT topic_id, year, round(prob, 6) AS prob,
       CASE WHEN prob >= 0.75 THEN 'VERIFIED_REAL' WHEN prob >= 0.55 THEN 'LIKELY_REAL'
            WHEN prob >= 0.40 THEN 'UNCERTAIN' WHEN prob >= 0.25 THEN 'LIKELY_NOISE' ELSE 'VERIFIED_NOISE' END AS verdict
FROM p""")
def verdict_map(spark, sf_dir):
    """V33 on a probability per signal row (count share of the largest cell)
    plus the five unit-test probabilities."""
    s = news_signals(spark, sf_dir)
    mx = s.agg(F.max("n_kt").alias("_mx"))
    p = s.crossJoin(F.broadcast(mx)).select("topic_id", "year", (F.col("n_kt") / F.col("_mx")).alias("prob"))
    unit = spark.createDataFrame([(-1, y, pr) for y, pr in enumerate([0.80, 0.62, 0.45, 0.30, 0.10])],
                                 "topic_id int, year int, prob double")
    p = p.unionByName(unit)
    return p.select("topic_id", "year", F.round("prob", 6).alias("prob"), E.verdict(F.col("prob")).alias("verdict"))


EVENTS_DICT_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {_q(kw)}, {list(yrs) if yrs else 'CAST([] AS INTEGER[])'}, {_q(n)}, {_q(c)}, {str(v).lower()})"
    for i, (kw, yrs, n, c, v) in enumerate(GROUND_TRUTH_EVENTS)) + ") v(rule_idx, keyword, real_years, event_name, category, verified)"

# Fixture labels for the layered verdict: the topic labels plus names that
# the event dictionary and the lifestyle words recognise.
LAYERED_LABELS = {0: "Trump Impeachment 2019", 1: "COVID-19 Pandemic Coverage", 2: "Wedding & Beauty Trends",
                  3: "Holiday Travel", 4: "Economy Watch", 5: "Fox News & Conservative Media",
                  6: "Parenting & Family Life", 7: "Topic 7"}


@register("layered_verdict", FINAL_SQL + f""",
ed AS ({EVENTS_DICT_SQL}),
ll AS (SELECT * FROM (VALUES {", ".join(f"({k}, {_q(v)})" for k, v in LAYERED_LABELS.items())}) v(topic_id, label)),
conf AS (SELECT topic_id, sum(n_kt) AS n FROM signals GROUP BY topic_id),
t AS (SELECT ll.topic_id, ll.label AS topic_label,
             CAST(conf.n AS DOUBLE) / (SELECT sum(n) FROM conf) * 8 - 0.8 AS confidence
      FROM ll JOIN conf ON conf.topic_id = ll.topic_id),
hit AS (SELECT t.topic_id, min(ed.rule_idx) AS r FROM t JOIN ed ON contains(lower(t.topic_label), ed.keyword) GROUP BY 1),
emg AS (SELECT topic_id, bool_or(signal_class = 'EMERGING') AS em FROM signals GROUP BY 1),
fv2 AS (SELECT topic_id, first(verification_status ORDER BY spike_year) IN ('VERIFIED', 'VERIFIED_GROUNDTRUTH') AS ver
        FROM ver GROUP BY 1),
j AS (SELECT t.*, ed.real_years, ed.event_name AS gt_name, ed.verified AS gt_ver, ed.category AS gt_category, ed.rule_idx IS NOT NULL AS gt,
             coalesce(emg.em, false) AND coalesce(fv2.ver, false) AS emv,
             {" OR ".join(f"contains(lower(t.topic_label), {_q(k)})" for k in LIFESTYLE_KEYWORDS)} AS life
      FROM t LEFT JOIN hit ON hit.topic_id = t.topic_id LEFT JOIN ed ON ed.rule_idx = hit.r
             LEFT JOIN emg ON emg.topic_id = t.topic_id LEFT JOIN fv2 ON fv2.topic_id = t.topic_id)
SELECT topic_id, topic_label,
       CASE WHEN confidence < 0.15 THEN 'UNCERTAIN' WHEN gt AND gt_ver AND len(real_years) > 0 THEN 'VERIFIED_REAL'
            WHEN gt THEN 'VERIFIED_NOISE' WHEN emv THEN 'VERIFIED_REAL' WHEN life THEN 'VERIFIED_NOISE'
            ELSE 'UNCERTAIN' END AS verdict,
       CAST(CASE WHEN confidence < 0.15 THEN 0.5 WHEN gt AND gt_ver AND len(real_years) > 0 THEN 0.95
            WHEN gt THEN 0.05 WHEN emv THEN 0.85 WHEN life THEN 0.1 ELSE 0.5 END AS DOUBLE) AS event_probability,
       CASE WHEN confidence < 0.15 THEN NULL WHEN gt AND gt_ver AND len(real_years) > 0 THEN true
            WHEN gt THEN false WHEN emv THEN true WHEN life THEN false ELSE NULL END AS is_real_event,
       CASE WHEN confidence >= 0.15 AND gt THEN gt_name ELSE topic_label END AS event_name,
       CASE WHEN confidence < 0.15 THEN 'unknown' WHEN gt THEN gt_category WHEN emv THEN 'news_event' WHEN life THEN 'lifestyle'
            ELSE 'unknown' END AS event_category,
       CASE WHEN confidence < 0.15 THEN printf('{REASON_GATE}', confidence * 100)
            WHEN gt AND gt_ver AND len(real_years) > 0 THEN printf('{REASON_DICTIONARY}', gt_name, array_to_string(real_years, ', '))
            WHEN gt THEN '{REASON_DICTIONARY_NOISE}' WHEN emv THEN '{REASON_EMERGING}' WHEN life THEN '{REASON_LIFESTYLE}'
            ELSE '{REASON_NONE}' END AS reason,
       CASE WHEN confidence >= 0.15 AND gt AND gt_ver THEN array_to_string(real_years, ',') ELSE '' END AS real_years
FROM j""")
def layered_verdict(spark, sf_dir):
    """V34 + J11 + T16 without a model (the model step is covered by
    verdict_map): gate on confidence -> event dictionary -> EMERGING and
    verified -> lifestyle words -> UNCERTAIN. Confidence per topic is its
    share of rows, rescaled so that the gate is reached."""
    sig, v = verification(spark, sf_dir)
    conf = sig.groupBy("topic_id").agg(F.sum("n_kt").alias("n"))
    tot = conf.agg(F.sum("n").alias("_tot"))
    ll = spark.createDataFrame(list(LAYERED_LABELS.items()), "topic_id int, topic_label string")
    t = (ll.join(conf, "topic_id").crossJoin(F.broadcast(tot))
         .select("topic_id", "topic_label", (F.col("n") / F.col("_tot") * 8 - 0.8).alias("confidence"),
                 F.lit(None).cast("double").alias("prob")))
    return verdict_columns(E.layered_verdict(t, E.event_dictionary(spark), sig, v))


def verdict_columns(df):
    """V34's record with its years as text."""
    return df.withColumn("real_years", F.array_join(F.col("real_years").cast("array<string>"), ","))
