"""Corpus profile, period counts, histograms and monthly velocities.

Window functions here run over *aggregated* period tables (one row per month
or per (category, month)), never over raw rows.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trendspark.functions import text as T
from trendspark.functions import timefn as D
from trendspark.operators import sketches
from trendspark.plans import sqlfrag as S
from trendspark.plans.registry import register
from trendspark.plans.views import ARTICLES_CTE, articles, with_ctes
from trendspark.session import cut_lineage
from trendspark.sources.tables import table

# ------------------------------------------------------------------ prepare

BAD_ARTICLES = [
    (-1, "bad date", "x", "src0", "2020-13-45"),
    (-2, None, "null headline", "src1", "2019-05-01"),
    (-3, "null description", None, "src2", "2018-02-03"),
    (-4, "no date", "y", "src3", None),
]
BAD_SQL = ("SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if v is None else (str(v) if isinstance(v, int) else "'" + v + "'") for v in r) + ")"
    for r in BAD_ARTICLES) + ") v(doc_id, headline, short_description, category, date_str)")


@register("articles_prepare", with_ctes(ARTICLES_CTE) + f""",
raw AS (SELECT doc_id, headline, short_description, category, strftime(date, '%Y-%m-%d') AS date_str FROM articles
        UNION ALL {BAD_SQL}),
p AS (SELECT doc_id, category, headline || ' ' || short_description AS text,
             CAST(try_strptime(date_str, '%Y-%m-%d') AS DATE) AS date FROM raw)
SELECT doc_id, category, text, strftime(date, '%Y-%m-%d') AS date FROM p
WHERE date IS NOT NULL AND text IS NOT NULL""")
def articles_prepare(spark, sf_dir):
    """P1 select, P2 compose (null if a part is null), P3 date parse (bad -> null),
    P4 drop nulls, O2 order by date. Dates arrive as text, as in the JSON source."""
    a = articles(spark, sf_dir).select(
        "doc_id", "headline", "short_description", "category", D.ymd("date").alias("date_str"))
    bad = spark.createDataFrame(BAD_ARTICLES, "doc_id long, headline string, short_description string, "
                                              "category string, date_str string")
    p = a.unionByName(bad).select(
        "doc_id", "category", F.concat("headline", F.lit(" "), "short_description").alias("text"),
        F.try_to_date("date_str", "yyyy-MM-dd").alias("date"))
    p = p.dropna(subset=["date", "text"])
    return p.orderBy("date", "doc_id").select("doc_id", "category", "text", D.ymd("date").alias("date"))


@register("corpus_profile", with_ctes(ARTICLES_CTE) + f"""
SELECT CAST(count(*) AS BIGINT) AS n_rows, strftime(min(date), '%Y-%m-%d') AS first_date,
       strftime(max(date), '%Y-%m-%d') AS last_date,
       CAST(count(DISTINCT category) AS BIGINT) AS n_categories,
       CAST(count(DISTINCT year(date)) AS BIGINT) AS n_years,
       round(avg({S.raw_word_count("headline || ' ' || short_description")}), 6) AS mean_words
FROM articles""")
def corpus_profile(spark, sf_dir):
    """A5: one aggregate pass (distinct counts are exact; at scale
    approx_count_distinct is the cheaper option)."""
    a = articles(spark, sf_dir)
    words = T.raw_word_count(F.concat("headline", F.lit(" "), "short_description"))
    return a.agg(F.count(F.lit(1)).alias("n_rows"), D.ymd(F.min("date")).alias("first_date"),
                 D.ymd(F.max("date")).alias("last_date"),
                 F.countDistinct("category").alias("n_categories"),
                 F.countDistinct(F.year("date")).alias("n_years"),
                 F.round(F.avg(words), 6).alias("mean_words"))


# ------------------------------------------------------------------ period counts

def _monthly_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(D.month_start(F.col("o_orderdate").cast("date")).alias("month")).agg(
        F.count(F.lit(1)).alias("n"))


@register("counts_by_period", """
WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1)
SELECT 'month' AS grain, strftime(month, '%Y-%m-%d') AS period, CAST(n AS BIGINT) AS n FROM m
UNION ALL
SELECT 'quarter', strftime(CAST(date_trunc('quarter', month) AS DATE), '%Y-%m-%d'), CAST(sum(n) AS BIGINT) FROM m GROUP BY 2
UNION ALL
SELECT 'year', strftime(CAST(date_trunc('year', month) AS DATE), '%Y-%m-%d'), CAST(sum(n) AS BIGINT) FROM m GROUP BY 2""")
def counts_by_period(spark, sf_dir):
    """A1 + D1: one scan to monthly counts; quarters and years roll up from the
    month table (tiny), so the raw rows are aggregated only once."""
    m = _monthly_orders(spark, sf_dir)  # one subtree, reused exchange in all three branches
    q = m.groupBy(D.quarter_start("month").alias("p")).agg(F.sum("n").alias("n"))
    y = m.groupBy(D.year_start("month").alias("p")).agg(F.sum("n").alias("n"))
    return (m.select(F.lit("month").alias("grain"), D.ymd("month").alias("period"), "n")
            .unionByName(q.select(F.lit("quarter").alias("grain"), D.ymd("p").alias("period"), "n"))
            .unionByName(y.select(F.lit("year").alias("grain"), D.ymd("p").alias("period"), "n"))
            .withColumn("n", F.col("n").cast("long")))


@register("category_counts", with_ctes(ARTICLES_CTE) + """
SELECT category, CAST(count(*) AS BIGINT) AS n FROM articles GROUP BY category ORDER BY n DESC, category LIMIT 10""")
def category_counts(spark, sf_dir):
    """A2 + K2: top 10 categories (ties by name)."""
    a = articles(spark, sf_dir)
    return (a.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "category").limit(10))


TOP_PRIORITIES = 3


@register("category_quarter_counts", f"""
WITH top AS (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {TOP_PRIORITIES})
SELECT strftime(CAST(date_trunc('quarter', o_orderdate) AS DATE), '%Y-%m-%d') AS quarter,
       o_orderpriority AS category, CAST(count(*) AS BIGINT) AS n
FROM orders WHERE o_orderpriority IN (SELECT o_orderpriority FROM top) GROUP BY 1, 2""")
def category_quarter_counts(spark, sf_dir):
    """A3 + P7: (quarter, category) counts restricted to the top-k categories.
    The top-k side has k rows by construction, so it is broadcast."""
    o = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderpriority")
    top = (o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.desc("n"), "o_orderpriority").limit(TOP_PRIORITIES).select("o_orderpriority"))
    r = o.join(F.broadcast(top), "o_orderpriority", "left_semi")
    return (r.groupBy(D.ymd(D.quarter_start(F.col("o_orderdate").cast("date"))).alias("quarter"),
                      F.col("o_orderpriority").alias("category"))
            .agg(F.count(F.lit(1)).alias("n")))


N_BINS = 40


@register("wordcount_histogram", f"""
WITH w AS (SELECT {S.raw_word_count('text')} AS x FROM documents),
st AS (SELECT min(x) AS lo, max(x) AS hi, avg(x) AS mean FROM w),
b AS (SELECT CAST(least(floor((x - lo) * {N_BINS} / CAST(greatest(hi - lo, 1) AS DOUBLE)), {N_BINS - 1}) AS INTEGER) AS bin
      FROM w, st),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT CAST(g.bin AS INTEGER) AS bin, round(lo + g.bin * (hi - lo) / {N_BINS}.0, 6) AS lo,
       round(lo + (g.bin + 1) * (hi - lo) / {N_BINS}.0, 6) AS hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n, round(mean, 6) AS mean
FROM st, (SELECT unnest(range(0, {N_BINS})) AS bin) g LEFT JOIN c ON c.bin = g.bin""")
def wordcount_histogram(spark, sf_dir):
    """A4 + T4: 40 equal-width bins over [min, max] (last bin closed) and the
    mean. Stats are a one-row aggregate; binning is map-side; counts are a
    40-key aggregate; empty bins are kept."""
    w = table(spark, sf_dir, "documents").select(T.raw_word_count("text").alias("x"))
    st = w.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"))
    b = w.crossJoin(F.broadcast(st)).select(
        F.least(F.floor((F.col("x") - F.col("lo")) * N_BINS
                        / F.greatest(F.col("hi") - F.col("lo"), F.lit(1)).cast("double")),
                F.lit(N_BINS - 1)).cast("int").alias("bin"))
    c = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    g = st.select("lo", "hi", "mean", F.explode(F.sequence(F.lit(0), F.lit(N_BINS - 1))).alias("bin"))
    return (g.join(c, "bin", "left")
            .select(F.col("bin").cast("int").alias("bin"),
                    F.round(F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / float(N_BINS), 6).alias("lo"),
                    F.round(F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / float(N_BINS), 6)
                    .alias("hi"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round("mean", 6).alias("mean")))


# ------------------------------------------------------------------ velocities

MONTHLY_SQL = """
WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1),
g AS (SELECT month, n, (n - lag(n) OVER (ORDER BY month)) * 100.0 / lag(n) OVER (ORDER BY month) AS growth FROM m),
s AS (SELECT month, n, growth,
             avg(growth) OVER (ORDER BY month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smoothed FROM g)
"""


def monthly_velocity_df(spark, sf_dir):
    """W1 + W2 + D12 on the month table (one row per month: a tiny window input)."""
    m = _monthly_orders(spark, sf_dir)
    w = Window.orderBy("month")
    prev = F.lag("n").over(w)
    g = m.withColumn("growth", D.pct_change(F.col("n"), prev) * 100)
    g = g.withColumn("smoothed", F.avg("growth").over(w.rowsBetween(-1, 1)))
    return g


@register("monthly_velocity", MONTHLY_SQL + """
SELECT strftime(month, '%Y-%m-%d') AS month, CAST(n AS BIGINT) AS n, round(growth, 6) AS growth,
       round(smoothed, 6) AS smoothed, CAST(sign(coalesce(smoothed, 0)) AS INTEGER) AS band FROM s""")
def monthly_velocity(spark, sf_dir):
    g = monthly_velocity_df(spark, sf_dir)
    return g.select(D.ymd("month").alias("month"), F.col("n").cast("long").alias("n"),
                    F.round("growth", 6).alias("growth"), F.round("smoothed", 6).alias("smoothed"),
                    F.signum(F.coalesce("smoothed", F.lit(0.0))).cast("int").alias("band"))


@register("top_growth_months", MONTHLY_SQL + """
SELECT strftime(month, '%Y-%m-%d') AS month, CAST(n AS BIGINT) AS n, round(growth, 6) AS growth
FROM s ORDER BY growth DESC NULLS LAST, month LIMIT 5""")
def top_growth_months(spark, sf_dir):
    """K1: 5 months with the highest growth, earliest first on ties."""
    g = monthly_velocity_df(spark, sf_dir)
    return (g.orderBy(F.desc_nulls_last("growth"), "month").limit(5)
            .select(D.ymd("month").alias("month"), F.col("n").cast("long").alias("n"),
                    F.round("growth", 6).alias("growth")))


@register("category_velocity_join", """
WITH o AS (SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
                  o_orderpriority AS category FROM orders),
mc AS (SELECT month, category, count(*) AS n FROM o GROUP BY 1, 2),
v AS (SELECT month, category,
             coalesce((n - lag(n) OVER (PARTITION BY category ORDER BY month)) * 1.0
                      / lag(n) OVER (PARTITION BY category ORDER BY month), 0) AS cat_velocity FROM mc)
SELECT o.o_orderkey, strftime(o.month, '%Y-%m-%d') AS month, o.category,
       round(coalesce(v.cat_velocity, 0), 6) AS cat_velocity,
       round(least(greatest(coalesce(v.cat_velocity, 0), -1), 2), 6) AS cat_velocity_clipped
FROM o LEFT JOIN v ON o.month = v.month AND o.category = v.category""")
def category_velocity_join(spark, sf_dir):
    """W3 + J1 + D11: per-category monthly growth (first month 0) joined back to
    every row on (month, category). The velocity table has one row per
    (category, month) — bounded by the calendar — and is broadcast."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", D.month_start(F.col("o_orderdate").cast("date")).alias("month"),
        F.col("o_orderpriority").alias("category"))
    mc = o.groupBy("month", "category").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("category").orderBy("month")
    v = mc.select("month", "category",
                  F.coalesce(D.pct_change(F.col("n"), F.lag("n").over(w)), F.lit(0.0)).alias("cat_velocity"))
    j = o.join(F.broadcast(v), ["month", "category"], "left")
    vel = F.coalesce("cat_velocity", F.lit(0.0))
    return j.select("o_orderkey", D.ymd("month").alias("month"), "category",
                    F.round(vel, 6).alias("cat_velocity"),
                    F.round(D.clip(vel, -1.0, 2.0), 6).alias("cat_velocity_clipped"))


@register("temporal_weight", with_ctes(ARTICLES_CTE) + """,
d AS (SELECT doc_id, date - (SELECT min(date) FROM articles) AS days FROM articles)
SELECT doc_id, CAST(days AS INTEGER) AS days_from_start,
       round(coalesce(ln(1 + days) / nullif(ln(1 + (SELECT max(days) FROM d)), 0), 0), 6) AS temporal_weight
FROM d""")
def temporal_weight(spark, sf_dir):
    """D2 + D3: days since the first article (min from a one-row aggregate,
    broadcast) and log-recency weight."""
    a = articles(spark, sf_dir).select("doc_id", "date")
    mn = a.agg(F.min("date").alias("d0"), F.max("date").alias("d1"))
    d = a.crossJoin(F.broadcast(mn)).select(
        "doc_id", F.datediff("date", "d0").alias("days"), F.datediff("d1", "d0").alias("max_days"))
    return d.select("doc_id", F.col("days").cast("int").alias("days_from_start"),
                    F.round(D.temporal_weight("days", "max_days"), 6).alias("temporal_weight"))


# ------------------------------------------------------------------ sketches by period

PERIOD_RANKS = {"q25": 0.25, "median": 0.5, "q75": 0.75, "q99": 0.99}
_GROWTH_SQL = f"ln({1 + sketches.ERROR} / {1 - sketches.ERROR})"


@register("period_quantiles", with_ctes(ARTICLES_CTE) + f""",
w AS (SELECT strftime(date, '%Y') AS period, {S.raw_word_count('text')} AS v FROM articles),
b AS (SELECT period, CASE WHEN v = 0 THEN 0 ELSE 1 END AS sign, CASE WHEN v = 0 THEN 0 ELSE CAST(ceil(ln(v) / {_GROWTH_SQL}) AS BIGINT) END AS bucket,
             count(*) AS n FROM w GROUP BY ALL),
a AS (SELECT period, sign, bucket, n FROM b UNION ALL SELECT 'all', sign, bucket, sum(n) FROM b GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY period ORDER BY sign, bucket) AS upto, sum(n) OVER (PARTITION BY period) AS total FROM a),
x AS (SELECT period, total, upto, sign * {1 - sketches.ERROR} * exp(bucket * {_GROWTH_SQL}) AS v FROM u)
SELECT period, CAST(max(total) AS BIGINT) AS n, {", ".join(
    f"round(min(v) FILTER (WHERE upto >= ceil({p} * total)), 6) AS {name}" for name, p in PERIOD_RANKS.items())}
FROM x GROUP BY period""")
def period_quantiles(spark, sf_dir):
    """A4 with mergeable sketches: quantiles of words per article by year, and over all years
    from the years' sketches, without reading the articles again."""
    a = articles(spark, sf_dir).select(F.date_format("date", "yyyy").alias("period"), T.raw_word_count("text").alias("v"))
    years = cut_lineage(sketches.quantile_sketch(a, ["period"], "v"), "year-sketches")
    both = years.unionByName(sketches.merged_quantiles(years, []).withColumn("period", F.lit("all")))
    q = sketches.quantiles_of(both, ["period"], PERIOD_RANKS)
    return q.select("period", F.col("total").alias("n"), *[F.round(c, 6).alias(c) for c in PERIOD_RANKS])


@register("period_distinct_words")
def period_distinct_words(spark, sf_dir):
    """A5 with mergeable sketches: articles and estimated distinct words by year, and over all years
    from the years' sketches (1.6 % standard error)."""
    a = articles(spark, sf_dir).select(F.date_format("date", "yyyy").alias("period"), "text")
    n = a.groupBy("period").agg(F.count(F.lit(1)).alias("n"))
    words = a.select("period", F.explode(T.tokens(T.clean_alnum("text"))).alias("word"))
    years = cut_lineage(sketches.distinct_sketch(words, ["period"], "word"), "year-words")
    both = years.unionByName(sketches.merged_distinct(years, []).withColumn("period", F.lit("all")))
    n = n.unionByName(n.agg(F.sum("n").alias("n")).select(F.lit("all").alias("period"), "n"))
    return n.join(sketches.distinct_of(both, ["period"]), "period", "left").select("period", "n", F.col("distinct").alias("words"))
