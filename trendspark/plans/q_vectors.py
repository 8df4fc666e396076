"""Vector queries on embeddings and topic_docs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from trendspark.functions import text as T
from trendspark.functions import timefn as D
from trendspark.functions import vectors as V
from trendspark.operators import sampling, vecindex, vecops
from trendspark.plans import sqlfrag as S
from trendspark.plans.registry import register
from trendspark.plans.views import TOPIC_DOCS_CTE, topic_docs, with_ctes
from trendspark.session import cut_lineage
from trendspark.sources.tables import table

D_MODEL = 32


def _unit_sql(v: str) -> str:
    return (f"(CASE WHEN list_sum(list_transform({v}, lambda y: y * y)) = 0 THEN {v} ELSE "
            f"list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y)))) END)")


def _dot_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"


def _mean_sql(src: str, group: str, vec: str, name: str) -> str:
    """CTE pair: per-(group, i) mean, then the list per group."""
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    return f"""{name}_e AS (SELECT {g}generate_subscripts({vec}, 1) AS i, unnest({vec}) AS x FROM {src}),
{name}_m AS (SELECT {g}i, avg(x) AS m, count(*) AS n FROM {name}_e GROUP BY {g}i),
{name} AS (SELECT {g}list(m ORDER BY i) AS mean, max(n) AS n FROM {name}_m {gb})"""


TD = with_ctes(TOPIC_DOCS_CTE) + """,
tdv AS (SELECT doc_id, topic, year, date, category, text, CAST(embedding AS DOUBLE[]) AS v
        FROM topic_docs WHERE embedding IS NOT NULL)"""


def tdv(spark, sf_dir):
    return (topic_docs(spark, sf_dir).where(F.col("embedding").isNotNull())
            .select("doc_id", "topic", "year", "date", "category", "text", V.as_double("embedding").alias("v")))


# ------------------------------------------------------------------ time features

@register("time_encoding", TD + f""",
d AS (SELECT doc_id, v, date - (SELECT min(date) FROM tdv) AS t FROM tdv),
enc AS (SELECT doc_id, list_concat(v, list_transform(range(0, {D_MODEL}), lambda i:
          CASE WHEN i % 2 = 0 THEN sin(t * exp((i - i % 2) * (-ln(10000.0) / {D_MODEL})))
               ELSE cos(t * exp((i - i % 2) * (-ln(10000.0) / {D_MODEL}))) END)) AS a FROM d)
SELECT doc_id, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS dim, round(unnest(a), 6) AS value FROM enc""")
def time_encoding(spark, sf_dir):
    """D4 + V11: 32-dim sinusoidal encoding of days since the first article,
    appended to the embedding (64 + 32 = 96 values), long form."""
    d = tdv(spark, sf_dir)
    mn = d.agg(F.min("date").alias("d0"))
    e = d.crossJoin(F.broadcast(mn)).select(
        "doc_id", F.concat("v", D.time_encoding(F.datediff("date", "d0"), D_MODEL)).alias("a"))
    return e.select("doc_id", F.posexplode("a").alias("dim", "value")).select(
        "doc_id", F.col("dim").cast("int"), F.round("value", 6).alias("value"))


N_TIME_BINS = 11


@register("time_bins", with_ctes(TOPIC_DOCS_CTE) + f""",
d AS (SELECT topic, date - (SELECT min(date) FROM topic_docs) AS t FROM topic_docs),
m AS (SELECT max(t) AS mx FROM d)
SELECT topic, CAST(least(floor(t * {N_TIME_BINS} / greatest(mx, 1)) + 1, {N_TIME_BINS}) AS INTEGER) AS bin,
       CAST(count(*) AS BIGINT) AS n FROM d, m GROUP BY 1, 2""")
def time_bins(spark, sf_dir):
    """11 equal-width, left-closed time bins over the corpus span (last
    bin closed); topic frequency per bin over all articles."""
    d = topic_docs(spark, sf_dir).select("topic", "date")
    mm = d.agg(F.min("date").alias("d0"), F.max("date").alias("d1"))
    x = d.crossJoin(F.broadcast(mm)).select(
        "topic", F.datediff("date", "d0").alias("t"), F.datediff("d1", "d0").alias("mx"))
    b = F.least(F.floor(F.col("t") * N_TIME_BINS / F.greatest("mx", F.lit(1))) + 1, F.lit(N_TIME_BINS))
    return x.groupBy("topic", b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ cohorts

COHORT_CUT = 2017
PATTERN_A = "tion|ment"
PATTERN_B = "eaux|ouen"
COHORT_SQL = with_ctes(TOPIC_DOCS_CTE) + f""",
coh AS (SELECT * FROM (SELECT doc_id, topic, date, embedding,
                              CASE WHEN year < {COHORT_CUT} AND regexp_matches({S.clean_alnum('text')}, '{PATTERN_A}') THEN 'A'
                                   WHEN year >= {COHORT_CUT} AND regexp_matches({S.clean_alnum('text')}, '{PATTERN_B}') THEN 'B' END AS grp
                       FROM topic_docs) WHERE grp IS NOT NULL)"""


def cohorts(docs):
    """``docs`` with ``grp``, in one scan; articles of neither cohort go."""
    c = T.clean_alnum("text")
    grp = (F.when((F.col("year") < COHORT_CUT) & c.rlike(PATTERN_A), "A")
           .when((F.col("year") >= COHORT_CUT) & c.rlike(PATTERN_B), "B"))
    return docs.withColumn("grp", grp).where(F.col("grp").isNotNull())


@register("era_cohorts", COHORT_SQL + """,
c AS (SELECT grp, topic, count(*) AS n FROM coh GROUP BY 1, 2),
r AS (SELECT grp, topic, n, row_number() OVER (PARTITION BY grp ORDER BY n DESC, topic) AS rk FROM c)
SELECT grp, CAST(rk AS INTEGER) AS rank, topic, CAST(n AS BIGINT) AS n FROM r WHERE rk <= 5""")
def era_cohorts(spark, sf_dir):
    """P5 + A13: year-and-pattern cohorts (substring patterns), top 5 topics each."""
    c = cohorts(topic_docs(spark, sf_dir)).groupBy("grp", "topic").agg(F.count(F.lit(1)).alias("n"))
    return sampling.first_k(c, "grp", [F.desc("n"), F.col("topic")], 5, "rank").select(
        "grp", F.col("rank").cast("int"), "topic", "n")


@register("cohort_separated", COHORT_SQL + f""",
c AS (SELECT grp, topic, count(*) AS n FROM coh WHERE topic <> -1 GROUP BY 1, 2),
m AS (SELECT grp, first(topic ORDER BY n DESC, topic) AS top FROM c GROUP BY grp),
g AS (SELECT coalesce((SELECT top FROM m WHERE grp = 'A'), -1) AS top_a,
             coalesce((SELECT top FROM m WHERE grp = 'B'), -1) AS top_b),
fb AS (SELECT topic, count(*) AS n FROM topic_docs WHERE year < 2020 AND regexp_matches({S.clean_alnum('text')}, '{PATTERN_A}')
       AND topic <> -1 GROUP BY topic)
SELECT top_a, top_b, top_a <> top_b AND top_a <> -1 AND top_b <> -1 AS separated,
       coalesce((SELECT first(topic ORDER BY n DESC, topic) FROM fb), -1) AS fallback_topic FROM g""")
def cohort_separated(spark, sf_dir):
    """A11 + A12 + P6: modal non-outlier topic per cohort (-1 if none), the
    separation test, and the fallback cohort's modal topic (three conjuncts), from
    one scan of all articles."""
    c = T.clean_alnum("text")
    d = topic_docs(spark, sf_dir).where(F.col("topic") != -1).select("topic", "year", c.rlike(PATTERN_A).alias("a"),
                                                                     c.rlike(PATTERN_B).alias("b"))
    of = {"top_a": (F.col("year") < COHORT_CUT) & F.col("a"), "top_b": (F.col("year") >= COHORT_CUT) & F.col("b"),
          "fallback_topic": (F.col("year") < 2020) & F.col("a")}
    n = d.groupBy("topic").agg(*[F.count(F.when(test, 1)).alias(name) for name, test in of.items()])
    modal = n.agg(*[F.coalesce(F.max_by("topic", F.when(F.col(name) > 0, F.struct(F.col(name), -F.col("topic")))), F.lit(-1)).alias(name)
                    for name in of])
    separated = (F.col("top_a") != F.col("top_b")) & (F.col("top_a") != -1) & (F.col("top_b") != -1)
    return modal.select("top_a", "top_b", separated.alias("separated"), "fallback_topic")


# ------------------------------------------------------------------ centroids and neighbours

CENT_SQL = TD + ",\n" + _mean_sql("(SELECT * FROM tdv WHERE topic <> -1)", "topic", "v", "cm") + f""",
cent AS (SELECT topic, {_unit_sql('mean')} AS c FROM cm)"""


def topic_centroids(spark, sf_dir, centred: bool = False):
    d = tdv(spark, sf_dir)
    mu = vecops.mean_vectors(d, None, "v") if centred else None
    return vecops.centroids(d.where(F.col("topic") != -1), "topic", "v", mu)


@register("nearest_topics", CENT_SQL + f""",
q AS (SELECT vec_id, {_unit_sql('CAST(embedding AS DOUBLE[])')} AS qv FROM embeddings),
s AS (SELECT q.vec_id, cent.topic, {_dot_sql('q.qv', 'cent.c')} AS sim FROM q, cent),
r AS (SELECT vec_id, topic, sim, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, topic) AS rk FROM s)
SELECT vec_id, CAST(rk AS INTEGER) AS rank, topic, round(sim, 6) AS sim FROM r WHERE rk <= 3""")
def nearest_topics(spark, sf_dir):
    """K7 + A17: the 3 nearest topic centroids (unit mean vectors) per query
    vector. The centroid side has one row per topic and is broadcast."""
    c = topic_centroids(spark, sf_dir).select(F.col("topic").alias("cid"), F.col("centroid").alias("cv"))
    q = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), V.unit("embedding").alias("qv"))
    t = vecops.nearest_few(q, c, 3)
    return t.select(F.col("qid").alias("vec_id"), "rank", F.col("cid").alias("topic"),
                    F.round("sim", 6).alias("sim"))


@register("centred_centroids", TD + ",\n" + _mean_sql("tdv", None, "v", "gm") + ",\n"
          + _mean_sql("(SELECT * FROM tdv WHERE topic <> -1)", "topic", "v", "cm") + f""",
cc AS (SELECT topic, list_transform(list_zip(cm.mean, (SELECT mean FROM gm)), lambda p: p[1] - p[2]) AS m FROM cm),
cu AS (SELECT topic, {_unit_sql('m')} AS c FROM cc)
SELECT topic, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS dim, round(unnest(c), 6) AS value FROM cu""")
def centred_centroids(spark, sf_dir):
    """A18 + D9: centroids after subtracting the global mean vector (one-row
    broadcast), unit length, long form."""
    c = topic_centroids(spark, sf_dir, centred=True)
    return c.select("topic", F.posexplode("centroid").alias("dim", "value")).select(
        "topic", F.col("dim").cast("int"), F.round("value", 6).alias("value"))


@register("similar_articles", TD + f""",
u AS (SELECT doc_id, topic, {_unit_sql('v')} AS u FROM tdv),
s AS (SELECT a.doc_id AS query_id, b.doc_id, b.topic, {_dot_sql('a.u', 'b.u')} AS sim FROM u a, u b WHERE a.doc_id <> b.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rk FROM s)
SELECT query_id, CAST(rk AS INTEGER) AS rank, doc_id, topic, round(sim, 6) AS sim FROM r WHERE rk <= 5""")
def similar_articles(spark, sf_dir):
    """K8 + J4 + D10: the 5 most similar other articles for every article,
    with their topic. Exact, by blocks on the executors."""
    d = tdv(spark, sf_dir).select("doc_id", "topic", V.unit("v").alias("u"))
    q = d.select(F.col("doc_id").alias("qid"), F.col("u").alias("qv"))
    c = d.select(F.col("doc_id").alias("cid"), F.col("u").alias("cv"))
    t = vecops.top_k_similar(q, c, 5, exclude_self=True)
    return (t.join(d.select(F.col("doc_id").alias("cid"), "topic"), "cid")
            .select(F.col("qid").alias("query_id"), "rank", F.col("cid").alias("doc_id"), "topic",
                    F.round("sim", 6).alias("sim")))


FALLBACK_SAMPLE = 30


@register("fallback_topic", TD + f""",
smp AS (SELECT doc_id, topic, v, row_number() OVER (PARTITION BY topic ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rk
        FROM tdv WHERE topic <> -1),
su AS (SELECT topic, {_unit_sql('v')} AS u FROM smp WHERE rk <= {FALLBACK_SAMPLE}),
""" + _mean_sql("su", "topic", "u", "sm") + f""",
q AS (SELECT vec_id, {_unit_sql('CAST(embedding AS DOUBLE[])')} AS qv FROM embeddings),
s AS (SELECT q.vec_id, sm.topic, {_dot_sql('q.qv', 'sm.mean')} AS sim FROM q, sm)
SELECT vec_id, first(topic ORDER BY sim DESC, topic) AS topic, round(max(sim), 6) AS mean_sim FROM s GROUP BY vec_id""")
def fallback_topic(spark, sf_dir):
    """Mean cosine to at most 30 seeded members per topic (closed form:
    query . mean of member unit vectors), best topic per query vector."""
    d = tdv(spark, sf_dir).where(F.col("topic") != -1)
    smp = sampling.balanced_sample(d, "topic", "doc_id", FALLBACK_SAMPLE, 42)
    sm = vecops.mean_vectors(smp.select("topic", V.unit("v").alias("u")), "topic", "u")
    q = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), V.unit("embedding").alias("qv"))
    t = vecops.nearest_few(q, sm.select(F.col("topic").alias("cid"), F.col("mean").alias("cv")), 1)
    return t.select(F.col("qid").alias("vec_id"), F.col("cid").alias("topic"), F.round("sim", 6).alias("mean_sim"))


# ------------------------------------------------------------------ quality

@register("topic_coherence", TD + ",\n" + _mean_sql(
    f"(SELECT topic, {_unit_sql('v')} AS u FROM tdv WHERE topic <> -1)", "topic", "u", "tm") + """
SELECT topic, round(list_sum(list_transform(mean, lambda x: x * x)), 6) AS coherence, CAST(n AS BIGINT) AS size
FROM tm WHERE n >= 2""")
def topic_coherence(spark, sf_dir):
    """Mean pairwise cosine of each topic's members (all members, closed form)."""
    d = tdv(spark, sf_dir).where(F.col("topic") != -1)
    c = vecops.group_coherence(d, "topic", "v")
    return c.select("topic", F.round("coherence", 6).alias("coherence"), F.col("n").cast("long").alias("size"))


PURITY_SQL = TD + """,
pc AS (SELECT topic, category, count(*) AS n FROM topic_docs WHERE topic <> -1 GROUP BY 1, 2),
pt AS (SELECT topic, sum(n) AS size, max(n) AS top_n, first(category ORDER BY n DESC, category) AS top_category
       FROM pc GROUP BY topic HAVING sum(n) >= 5),
pur AS (SELECT topic, top_category, top_n * 1.0 / size AS purity, size FROM pt)"""


@register("topic_purity", PURITY_SQL + """
SELECT topic, top_category, round(purity, 6) AS purity, round(purity * 100, 4) AS purity_pct,
       CASE WHEN purity >= 0.6 THEN 'high' WHEN purity >= 0.4 THEN 'mid' ELSE 'low' END AS band,
       CAST(size AS BIGINT) AS size FROM pur""")
def topic_purity(spark, sf_dir):
    """A9 + A10 + D13: dominant category (ties by name), its share, size;
    topics under 5 documents skipped."""
    p = purity_df(spark, sf_dir)
    return p.select("topic", "top_category", F.round("purity", 6).alias("purity"),
                    F.round(F.col("purity") * 100, 4).alias("purity_pct"), D.purity_band("purity").alias("band"),
                    F.col("size").cast("long"))


def purity_df(spark, sf_dir):
    d = topic_docs(spark, sf_dir).where(F.col("topic") != -1)
    pc = d.groupBy("topic", "category").agg(F.count(F.lit(1)).alias("n"))
    pt = pc.groupBy("topic").agg(F.sum("n").alias("size"), F.max("n").alias("top_n"),
                                 F.min_by("category", F.struct(-F.col("n"), F.col("category"))).alias("top_category"))
    return pt.where(F.col("size") >= 5).select("topic", "top_category", (F.col("top_n") / F.col("size")).alias("purity"),
                                              "size")


@register("metric_summary", PURITY_SQL + ",\n" + _mean_sql(
    f"(SELECT topic, {_unit_sql('v')} AS u FROM tdv WHERE topic <> -1)", "topic", "u", "tm") + """,
coh AS (SELECT topic, list_sum(list_transform(mean, lambda x: x * x)) AS c FROM tm WHERE n >= 2)
SELECT 'coherence' AS metric, round(avg(c), 6) AS mean, round(min(c), 6) AS min, round(max(c), 6) AS max FROM coh
UNION ALL SELECT 'purity', round(avg(purity), 6), round(min(purity), 6), round(max(purity), 6) FROM pur""")
def metric_summary(spark, sf_dir):
    """Mean, min, max of coherence and of purity over topics."""
    c = vecops.group_coherence(tdv(spark, sf_dir).where(F.col("topic") != -1), "topic", "v")
    p = purity_df(spark, sf_dir)

    def summ(df, col, name):
        return df.agg(F.lit(name).alias("metric"), F.round(F.avg(col), 6).alias("mean"),
                      F.round(F.min(col), 6).alias("min"), F.round(F.max(col), 6).alias("max"))
    return summ(c, "coherence", "coherence").unionByName(summ(p, "purity", "purity"))


@register("topic_features", PURITY_SQL + ",\n" + _mean_sql(
    f"(SELECT topic, {_unit_sql('v')} AS u FROM tdv WHERE topic <> -1)", "topic", "u", "tm") + """,
sz AS (SELECT topic, count(*) AS size FROM topic_docs WHERE topic <> -1 GROUP BY topic)
SELECT sz.topic AS topic_id, round(ln(greatest(sz.size, 2)), 6) AS log_size,
       round(list_sum(list_transform(tm.mean, lambda x: x * x)), 6) AS coherence,
       round(coalesce(pur.purity, 0), 6) AS purity
FROM sz JOIN tm ON tm.topic = sz.topic LEFT JOIN pur ON pur.topic = sz.topic WHERE tm.n >= 2""")
def topic_features(spark, sf_dir):
    """ln(max(size, 2)), coherence and purity per topic (purity 0 when
    the topic is too small for it)."""
    return features_df(spark, sf_dir).select(
        "topic_id", *[F.round(c, 6).alias(c) for c in ("log_size", "coherence", "purity")])


def features_df(spark, sf_dir):
    d = tdv(spark, sf_dir).where(F.col("topic") != -1)
    sz = topic_docs(spark, sf_dir).where(F.col("topic") != -1).groupBy("topic").agg(F.count(F.lit(1)).alias("size"))
    c = vecops.group_coherence(d, "topic", "v").select("topic", "coherence")
    p = purity_df(spark, sf_dir).select("topic", "purity")
    return (sz.join(c, "topic").join(p, "topic", "left")
            .select(F.col("topic").alias("topic_id"), F.log(F.greatest("size", F.lit(2))).alias("log_size"),
                    "coherence", F.coalesce("purity", F.lit(0.0)).alias("purity")))


@register("hard_negatives", CENT_SQL + f""",
o AS (SELECT doc_id, {_unit_sql('v')} AS u FROM tdv WHERE topic = -1),
s AS (SELECT o.doc_id, cent.topic, {_dot_sql('o.u', 'cent.c')} AS sim FROM o, cent),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, topic) AS rk FROM s),
p AS (SELECT doc_id, max(CASE WHEN rk = 1 THEN topic END) AS topic_1, max(CASE WHEN rk = 1 THEN sim END) AS topic_1_sim,
             max(CASE WHEN rk = 2 THEN topic END) AS topic_2, max(CASE WHEN rk = 2 THEN sim END) AS topic_2_sim
      FROM r WHERE rk <= 2 GROUP BY doc_id HAVING count(*) = 2)
SELECT doc_id, topic_1, round(topic_1_sim, 6) AS topic_1_sim, topic_2, round(topic_2_sim, 6) AS topic_2_sim,
       round(topic_1_sim + topic_2_sim, 6) AS ambiguity_score
FROM p ORDER BY topic_1_sim + topic_2_sim DESC, doc_id LIMIT 50""")
def hard_negatives(spark, sf_dir):
    """V21 + J10 + K9: outliers scored against the two nearest centroids;
    ambiguity = s1 + s2; the 50 most ambiguous (needs >= 2 topics)."""
    c = topic_centroids(spark, sf_dir).select(F.col("topic").alias("cid"), F.col("centroid").alias("cv"))
    o = tdv(spark, sf_dir).where(F.col("topic") == -1).select(F.col("doc_id").alias("qid"), V.unit("v").alias("qv"))
    t = vecops.nearest_few(o, c, 2)
    p = t.groupBy("qid").agg(
        F.max(F.when(F.col("rank") == 1, F.col("cid"))).alias("topic_1"),
        F.max(F.when(F.col("rank") == 1, F.col("sim"))).alias("s1"),
        F.max(F.when(F.col("rank") == 2, F.col("cid"))).alias("topic_2"),
        F.max(F.when(F.col("rank") == 2, F.col("sim"))).alias("s2"),
        F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 2)
    return (p.orderBy(F.desc(F.col("s1") + F.col("s2")), "qid").limit(50)
            .select(F.col("qid").alias("doc_id"), "topic_1", F.round("s1", 6).alias("topic_1_sim"),
                    "topic_2", F.round("s2", 6).alias("topic_2_sim"),
                    F.round(F.col("s1") + F.col("s2"), 6).alias("ambiguity_score")))


@register("participation_ratio", """
WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
e AS (SELECT vec_id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM x),
mu AS (SELECT i, avg(x) AS m FROM e GROUP BY i),
c AS (SELECT e.vec_id, e.i, e.x - mu.m AS y FROM e JOIN mu ON mu.i = e.i),
cov AS (SELECT a.i, b.i AS j, sum(a.y * b.y) AS c FROM c a JOIN c b ON a.vec_id = b.vec_id GROUP BY 1, 2)
SELECT round(pow(sum(CASE WHEN i = j THEN c END), 2) / sum(c * c), 6) AS participation_ratio,
       CAST((SELECT max(i) FROM mu) AS INTEGER) AS d FROM cov""")
def participation_ratio(spark, sf_dir):
    """A19 from per-task Gram partials (no eigen-solve)."""
    e = table(spark, sf_dir, "embeddings").select("embedding")
    r = vecops.participation_ratio(e, "embedding")
    return r.select(F.round("participation_ratio", 6).alias("participation_ratio"), F.col("d").cast("int"))


# ------------------------------------------------------------------ graph

K_NN = 15
MIN_SAMPLES = 10
KNN_SQL = """
WITH u AS (SELECT vec_id, """ + _unit_sql("CAST(embedding AS DOUBLE[])") + """ AS u FROM embeddings),
s AS (SELECT a.vec_id AS src, b.vec_id AS dst, 1 - """ + _dot_sql("a.u", "b.u") + """ AS distance
      FROM u a, u b WHERE a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rk FROM s),
knn AS (SELECT src, CAST(rk AS INTEGER) AS rank, dst, distance, min(distance) OVER (PARTITION BY src) AS rho
        FROM r WHERE rk <= """ + str(K_NN) + ")"


@register("knn_graph", KNN_SQL + """
SELECT src, rank, dst, round(distance, 6) AS distance, round(rho, 6) AS rho FROM knn""")
def knn_graph(spark, sf_dir):
    """Exact 15 nearest neighbours by cosine distance and rho."""
    g = vecops.knn_graph(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", K_NN)
    return g.select("src", "rank", "dst", F.round("distance", 6).alias("distance"), F.round("rho", 6).alias("rho"))


@register("mutual_reachability", KNN_SQL + f""",
core AS (SELECT src AS node, distance AS core FROM knn WHERE rank = {MIN_SAMPLES - 1})
SELECT k.src, k.dst, round(k.distance, 6) AS distance, round(a.core, 6) AS core_src, round(b.core, 6) AS core_dst,
       round(greatest(a.core, b.core, k.distance), 6) AS mreach
FROM knn k JOIN core a ON a.node = k.src JOIN core b ON b.node = k.dst""")
def mutual_reachability(spark, sf_dir):
    """V14 (core distances and mutual-reachability edges on the kNN graph)."""
    g = vecops.knn_graph(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", K_NN)
    m = vecops.mutual_reachability(g, MIN_SAMPLES)
    return m.select("src", "dst", *[F.round(c, 6).alias(c) for c in ("distance", "core_src", "core_dst", "mreach")])


@register("fuzzy_weights", None)
def fuzzy_weights(spark, sf_dir):
    """V13 weights: exp(-max(d - rho, 0) / sigma) with sigma by 64 bisection
    steps so that the weights of a node sum to log2(k). Rows-only check (a
    property test compares the sums with log2 k)."""
    g = vecops.knn_graph(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", K_NN)
    per = g.groupBy("src").agg(F.collect_list("distance").alias("ds"), F.first("rho").alias("rho"))
    per = per.withColumn("sigma", vecops.fuzzy_sigma(F.col("ds"), F.col("rho"), K_NN))
    e = g.join(per.select("src", "sigma"), "src")
    return e.select("src", "dst", "rank", F.exp(-F.greatest(F.col("distance") - F.col("rho"), F.lit(0.0))
                                                / F.col("sigma")).alias("weight"), "sigma")


# ------------------------------------------------------------------ sets

@register("topic_id_sets", with_ctes(TOPIC_DOCS_CTE) + """
SELECT array_to_string(list_sort(list_filter(list_distinct(list(topic)), lambda t: t <> -1)), ',') AS topics,
       CAST(count(DISTINCT topic) FILTER (WHERE topic <> -1) AS BIGINT) AS n_topics FROM topic_docs""")
def topic_id_sets(spark, sf_dir):
    """U4: the topic set minus the outlier id."""
    d = topic_docs(spark, sf_dir)
    s = d.agg(F.array_except(F.collect_set("topic"), F.array(F.lit(-1))).alias("s"))
    return s.select(F.array_join(F.transform(F.array_sort("s"), lambda x: x.cast("string")), ",").alias("topics"),
                    F.size("s").cast("long").alias("n_topics"))


# ------------------------------------------------------------------ index

@register("index_recall")
def index_recall(spark, sf_dir):
    """V13 + J4 through the index by probing alone: for every embedding whose id is divisible by 50 the 10
    nearest of all others, with the recall against exact search for several numbers of cells
    visited, and the share of all pairs compared."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.unit("embedding").alias("u"))
    index = vecindex.build_index(e, "vec_id", "u")
    q = cut_lineage(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("u").alias("qv")), "queries")
    exact = cut_lineage(vecops.top_k_blocks(q, e.select(F.col("vec_id").alias("cid"), F.col("u").alias("cv")), 10, exclude_self=True)
                        .select("qid", "cid"), "exact")
    cells, out = len(index.centroids), None
    for share in (0.1, 0.2, 0.4, 0.6, 0.8):
        probes = max(1, math.ceil(share * cells))
        found = vecindex.search(index, q, 10, exclude_self=True, probes=probes, complete="none").select("qid", "cid", F.lit(1).alias("hit"))
        row = exact.join(found, ["qid", "cid"], "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall")).select(
            F.lit(cells).alias("cells"), F.lit(probes).alias("probes"), "recall")
        out = row if out is None else out.unionByName(row)
    return out
