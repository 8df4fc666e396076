"""Queries over the skewed topic_orders view: counts, velocities, signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendspark.operators import ranges, trend
from trendspark.plans.registry import register
from trendspark.plans.views import TOPIC_ORDERS_CTE, topic_orders, with_ctes

# Shared SQL: the dense grid with gap, velocity, popularity and class.
SIGNAL_SQL_CTES = with_ctes(TOPIC_ORDERS_CTE) + """,
counts AS (SELECT topic, year, count(*) AS n FROM topic_orders WHERE topic <> -1 GROUP BY topic, year),
topics AS (SELECT DISTINCT topic FROM topic_orders WHERE topic <> -1),
years AS (SELECT DISTINCT year FROM topic_orders),
grid AS (SELECT t.topic, y.year, CAST(coalesce(c.n, 0) AS INTEGER) AS n_kt
         FROM topics t CROSS JOIN years y
         LEFT JOIN counts c ON c.topic = t.topic AND c.year = y.year),
isl AS (SELECT *, sum(CASE WHEN n_kt > 0 THEN 1 ELSE 0 END)
          OVER (PARTITION BY topic ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
        FROM grid),
g AS (SELECT *, CAST(sum(CASE WHEN n_kt > 0 THEN 0 ELSE 1 END)
          OVER (PARTITION BY topic, island ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS gap,
        lag(n_kt) OVER (PARTITION BY topic ORDER BY year) AS prev
      FROM isl),
s AS (SELECT topic, year, n_kt, gap,
        round(coalesce(CAST(n_kt - prev AS DOUBLE) / (prev + 1.0), 0.0), 4) AS velocity,
        round(exp(-0.5 * gap), 6) AS decay,
        round(n_kt * CASE WHEN n_kt > 0 THEN 1 ELSE 0 END * exp(-0.5 * gap), 4) AS popularity,
        CAST(count(*) FILTER (WHERE n_kt > 0) OVER (PARTITION BY topic) AS INTEGER) AS nonzero_years
      FROM g),
q AS (SELECT coalesce(quantile_cont(popularity, 0.25), 1.0) AS q_low,
             coalesce(quantile_cont(popularity, 0.75), 10.0) AS q_high
      FROM s WHERE popularity > 0),
sig AS (SELECT s.*, CASE WHEN popularity < q_low THEN 'NOISE'
                         WHEN popularity < q_high THEN 'WEAK_SIGNAL'
                         WHEN velocity > 0.5 AND nonzero_years >= 2 THEN 'EMERGING'
                         ELSE 'STRONG_SIGNAL' END AS signal_class
        FROM s CROSS JOIN q)
"""


def signal_class(spark, sf_dir):
    return trend.signal_table(topic_orders(spark, sf_dir))


register("signal_class", SIGNAL_SQL_CTES + """
SELECT CAST(topic AS INTEGER) AS topic_id, CAST(year AS INTEGER) AS year, n_kt, velocity, popularity,
       nonzero_years, gap, decay, signal_class,
       'Topic ' || CAST(topic AS VARCHAR) AS topic_label, CAST(NULL AS VARCHAR) AS raw_label
FROM sig""")(signal_class)


@register("topic_year_counts", with_ctes(TOPIC_ORDERS_CTE) + """
SELECT topic, year, CAST(count(*) AS INTEGER) AS n_kt FROM topic_orders WHERE topic <> -1 GROUP BY topic, year""")
def topic_year_counts(spark, sf_dir):
    """A6 + P8."""
    return trend.sparse_counts(topic_orders(spark, sf_dir))


@register("topic_year_dense", SIGNAL_SQL_CTES + """
SELECT g.topic, g.year, g.n_kt, nz.nonzero_years
FROM grid g JOIN (SELECT topic, CAST(count(*) FILTER (WHERE n_kt > 0) AS INTEGER) AS nonzero_years
                  FROM grid GROUP BY topic) nz ON g.topic = nz.topic""")
def topic_year_dense(spark, sf_dir):
    """A7 + A8."""
    grid = trend.dense_grid(topic_orders(spark, sf_dir))
    return grid.join(trend.nonzero_periods(grid), "topic")


@register("eps_velocity", SIGNAL_SQL_CTES + """
SELECT topic, year, n_kt, velocity FROM s""")
def eps_velocity(spark, sf_dir):
    """W5 + D8."""
    g = trend.add_gap_velocity(trend.dense_grid(topic_orders(spark, sf_dir)))
    return g.select("topic", "year", "n_kt", "velocity")


@register("gap_popularity", SIGNAL_SQL_CTES + """
SELECT topic, year, n_kt, gap, decay, popularity FROM s""")
def gap_popularity(spark, sf_dir):
    """W6 + W7."""
    g = trend.add_gap_velocity(trend.dense_grid(topic_orders(spark, sf_dir)))
    return g.select("topic", "year", "n_kt", "gap", "decay", "popularity")


@register("signal_class_counts", SIGNAL_SQL_CTES + """
SELECT signal_class, CAST(count(*) AS BIGINT) AS n FROM sig GROUP BY signal_class""")
def signal_class_counts(spark, sf_dir):
    """A16."""
    s = trend.signal_table(topic_orders(spark, sf_dir))
    return s.groupBy("signal_class").agg(F.count(F.lit(1)).alias("n"))


@register("signal_matrix", SIGNAL_SQL_CTES + """
SELECT topic AS topic_id,
""" + ",\n".join(
    f"  CAST(coalesce(max(CASE WHEN year = {y} THEN CASE signal_class WHEN 'NOISE' THEN 0 WHEN 'WEAK_SIGNAL' THEN 1 "
    f"WHEN 'STRONG_SIGNAL' THEN 2 ELSE 3 END END), 0) AS INTEGER) AS y{y}" for y in range(1995, 2002)
) + "\nFROM sig GROUP BY topic")
def signal_matrix(spark, sf_dir):
    """Topic x year class-code matrix (pivot over a fixed year list, missing = 0)."""
    s = trend.signal_table(topic_orders(spark, sf_dir))
    years = list(range(1995, 2002))
    piv = (s.withColumn("code", trend.class_code(F.col("signal_class")))
           .groupBy("topic_id").pivot("year", years).agg(F.max("code")))
    return piv.select("topic_id", *[F.coalesce(F.col(str(y)), F.lit(0)).cast("int").alias(f"y{y}")
                                    for y in years])


# --------------------------------------------------------------------------- W4 / K5

@register("yearly_peak_growth", with_ctes(TOPIC_ORDERS_CTE) + """,
c AS (SELECT topic, year, count(*) AS n FROM topic_orders WHERE topic <> -1 GROUP BY 1, 2),
g AS (SELECT topic, year, n, (n - lag(n) OVER (PARTITION BY topic ORDER BY year)) * 100.0
                             / lag(n) OVER (PARTITION BY topic ORDER BY year) AS growth FROM c),
t AS (SELECT topic, sum(n) AS total FROM c GROUP BY topic),
p AS (SELECT topic, max(growth) AS peak_growth, first(year ORDER BY growth DESC NULLS LAST, year) AS peak_year
      FROM g GROUP BY topic HAVING count(growth) > 0)
SELECT p.topic, round(p.peak_growth, 6) AS peak_growth, CAST(p.peak_year AS INTEGER) AS peak_year,
       CAST(t.total AS BIGINT) AS total,
       p.topic IN (SELECT topic FROM t ORDER BY total DESC, topic LIMIT 5) AS top5_size
FROM p JOIN t ON t.topic = p.topic""")
def yearly_peak_growth(spark, sf_dir):
    """W4 + K5: growth % over present years per topic, its peak and first peak
    year (topics seen in one year only are dropped); 5 largest topics."""
    from pyspark.sql import Window
    c = trend.sparse_counts(topic_orders(spark, sf_dir)).withColumnRenamed("n_kt", "n")
    w = Window.partitionBy("topic").orderBy("year")
    g = c.withColumn("growth", F.try_divide((F.col("n") - F.lag("n").over(w)) * 100.0, F.lag("n").over(w)))
    p = (g.groupBy("topic").agg(F.max("growth").alias("peak_growth"),
                                F.max_by("year", F.struct(F.col("growth"), -F.col("year"))).alias("peak_year"),
                                F.count("growth").alias("_ng"))
         .where(F.col("_ng") > 0))
    t = c.groupBy("topic").agg(F.sum("n").alias("total"))
    top = t.orderBy(F.desc("total"), "topic").limit(5).select("topic", F.lit(True).alias("_t"))
    return (p.join(t, "topic").join(F.broadcast(top), "topic", "left")
            .select("topic", F.round("peak_growth", 6).alias("peak_growth"),
                    F.col("peak_year").cast("int").alias("peak_year"), F.col("total").cast("long").alias("total"),
                    F.coalesce("_t", F.lit(False)).alias("top5_size")))


# --------------------------------------------------------------------------- W11 / W12

NEWS_MONTHS = 252  # 21 years: the orders calendar moved onto the news calendar
SPIKE_THETA = 0.12

HYBRID_SQL = with_ctes(TOPIC_ORDERS_CTE) + f""",
r AS (SELECT topic, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q FROM topic_orders WHERE topic <> -1),
wr AS (SELECT topic, CAST(q + INTERVAL {NEWS_MONTHS} MONTH AS DATE) AS ws FROM r
       UNION ALL SELECT topic, CAST(q - INTERVAL 3 MONTH + INTERVAL {NEWS_MONTHS} MONTH AS DATE) FROM r),
c AS (SELECT ws, topic, count(*) AS n FROM wr GROUP BY 1, 2),
b AS (SELECT min(ws) AS w0, max(ws) AS w1 FROM c),
h AS (SELECT c.ws, c.topic, c.n, c.n * 1.0 / sum(c.n) OVER (PARTITION BY c.ws) AS share,
             coalesce(ln(1 + (c.ws - b.w0)) / nullif(ln(1 + (b.w1 - b.w0)), 0), 0) AS weight
      FROM c, b)
"""


def hybrid_table(spark, sf_dir):
    """Each row falls in the two 6-month windows (3-month step) whose
    starts are its quarter and the quarter before; counts per (window, topic)
    are a single aggregate, shares and weights run on that small table."""
    o = topic_orders(spark, sf_dir).where(F.col("topic") != -1)
    q = F.date_trunc("quarter", F.col("o_orderdate").cast("date")).cast("date")
    r = o.select("topic", F.explode(F.array(F.add_months(q, NEWS_MONTHS), F.add_months(q, NEWS_MONTHS - 3)))
                 .alias("ws"))
    c = r.groupBy("ws", "topic").agg(F.count(F.lit(1)).alias("n"))
    b = c.agg(F.min("ws").alias("w0"), F.max("ws").alias("w1"))
    from pyspark.sql import Window
    h = c.crossJoin(F.broadcast(b)).select(
        "ws", "topic", "n", (F.col("n") / F.sum("n").over(Window.partitionBy("ws"))).alias("share"),
        F.coalesce(F.try_divide(F.log1p(F.datediff("ws", "w0")), F.log1p(F.datediff("w1", "w0"))),
                   F.lit(0.0)).alias("weight"))
    return h.withColumn("v_hyb", F.col("share") * F.col("weight"))


@register("hybrid_velocity", HYBRID_SQL + """
SELECT strftime(ws, '%Y-%m-%d') AS window_start, topic, CAST(n AS BIGINT) AS n, round(share, 6) AS share,
       round(weight, 6) AS weight, round(share * weight, 6) AS v_hyb FROM h""")
def hybrid_velocity(spark, sf_dir):
    h = hybrid_table(spark, sf_dir)
    return h.select(F.date_format("ws", "yyyy-MM-dd").alias("window_start"), "topic",
                    F.col("n").cast("long").alias("n"), F.round("share", 6).alias("share"),
                    F.round("weight", 6).alias("weight"), F.round("v_hyb", 6).alias("v_hyb"))


def _spike_sql():
    from trendspark.plans.q_events import parsed_sql, timeline_sql
    return HYBRID_SQL + parsed_sql(timeline_sql(True)) + f""",
sp AS (SELECT * FROM h WHERE share * weight > {SPIKE_THETA}),
cor AS (SELECT DISTINCT sp.ws, sp.topic FROM sp JOIN parsed p ON p.topic_id = sp.topic
          AND CAST(try_strptime(substr(p.date, 1, 8), '%Y%m%d') AS DATE) >= sp.ws
          AND CAST(try_strptime(substr(p.date, 1, 8), '%Y%m%d') AS DATE) < CAST(sp.ws + INTERVAL 6 MONTH AS DATE))
SELECT strftime(sp.ws, '%Y-%m-%d') AS window_start, sp.topic, round(sp.share * sp.weight, 6) AS v_hyb,
       cor.ws IS NOT NULL AS corroborated, CASE WHEN cor.ws IS NOT NULL THEN 'EVENT' ELSE 'NOISE' END AS status
FROM sp LEFT JOIN cor ON cor.ws = sp.ws AND cor.topic = sp.topic"""


def spike_accept(spark, sf_dir):
    """Windows with V_hyb > theta; kept as EVENT only when a timeline
    record of the topic lies inside the window (interval join by time bins), else
    flagged NOISE."""
    from trendspark.operators import events as E
    from trendspark.plans.q_events import timeline_df
    h = hybrid_table(spark, sf_dir).where(F.col("v_hyb") > SPIKE_THETA)
    t = E.parse_timeline(timeline_df(spark, True)).select(
        F.col("topic_id").alias("topic"), F.try_to_date(F.substring("date", 1, 8), "yyyyMMdd").alias("d"))
    cor = (ranges.interval_join(h.select("ws", "topic", F.add_months("ws", 6).alias("we")), t, ["topic"], "ws", "we", "d", how="left_semi")
           .select("ws", "topic").withColumn("_c", F.lit(True)))
    j = h.join(cor, ["ws", "topic"], "left")
    ok = F.coalesce("_c", F.lit(False))
    return j.select(F.date_format("ws", "yyyy-MM-dd").alias("window_start"), "topic",
                    F.round("v_hyb", 6).alias("v_hyb"), ok.alias("corroborated"),
                    F.when(ok, "EVENT").otherwise("NOISE").alias("status"))


register("spike_accept", _spike_sql())(spike_accept)
