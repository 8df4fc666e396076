"""Streaming queries (rows-only checks; pytest compares them with batch)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from trendspark.functions import text as T
from trendspark.operators import topics as TP
from trendspark.plans.q_trend import NEWS_MONTHS
from trendspark.plans.registry import register
from trendspark.plans.views import order_topic
from trendspark.session import cut_lineage
from trendspark.sources.tables import table
from trendspark.streaming import stream as ST

WINDOW, SLIDE, WATERMARK = "2 days", "1 day", "1 day"


def _src(spark, sf_dir, name):
    schema = table(spark, sf_dir, name).schema  # parquet footer only
    return ST.source(spark, os.path.join(sf_dir, f"{name}.parquet"), schema, max_files=1)


WINDOW_SQL = """
WITH e AS (SELECT CAST(ts AS TIMESTAMP) AS ts, event_type FROM events),
w AS (SELECT date_trunc('day', ts) AS ws, event_type FROM e
      UNION ALL SELECT date_trunc('day', ts) - INTERVAL 1 DAY, event_type FROM e),
c AS (SELECT ws, ws + INTERVAL 2 DAY AS we, event_type, count(*) AS n FROM w GROUP BY 1, 2, 3)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(we, '%Y-%m-%d %H:%M:%S') AS window_end,
       event_type, CAST(n AS BIGINT) AS n
FROM c WHERE we <= (SELECT max(ts) FROM e) - INTERVAL 1 DAY"""


@register("stream_window_counts", WINDOW_SQL)
def stream_window_counts(spark, sf_dir):
    """S7 + X1: events per sliding 2-day window (1-day step) and event type;
    watermark 1 day; append mode emits closed windows only."""
    # event times are zone-less; windows and their text are defined in UTC
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ev = _src(spark, sf_dir, "events")
    c = ST.window_counts(ev, "ts", ["event_type"], WINDOW, SLIDE, WATERMARK)
    t = ST.run_to_table(c, "window_counts")
    return t.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                    F.date_format("window_end", "yyyy-MM-dd HH:mm:ss").alias("window_end"), "event_type", "n")


def _topic_rows(orders):
    return orders.select(order_topic().alias("topic"), F.year("o_orderdate").cast("int").alias("year"), "o_orderdate")


def _hybrid_sql():
    from trendspark.plans.q_trend import HYBRID_SQL
    return HYBRID_SQL + """
SELECT strftime(ws, '%Y-%m-%d') AS window_start, topic, CAST(n AS BIGINT) AS n, round(share, 6) AS share,
       round(weight, 6) AS weight, round(share * weight, 6) AS v_hyb FROM h"""


@register("stream_hybrid_velocity", _hybrid_sql())
def stream_hybrid_velocity(spark, sf_dir):
    """Window counts merged into a state table by foreachBatch, then the
    calendar-window hybrid velocity (W11) on the state."""
    o = _topic_rows(_src(spark, sf_dir, "orders"))
    q = F.date_trunc("quarter", F.col("o_orderdate").cast("date")).cast("date")
    r = o.select("topic", F.explode(F.array(F.add_months(q, NEWS_MONTHS), F.add_months(q, NEWS_MONTHS - 3)))
                 .alias("ws"))
    c = ST.run_foreach_batch(r, "hybrid_state", ["ws", "topic"])
    from pyspark.sql import Window
    b = c.agg(F.min("ws").alias("w0"), F.max("ws").alias("w1"))
    h = c.crossJoin(F.broadcast(b)).select(
        "ws", "topic", "n", (F.col("n") / F.sum("n").over(Window.partitionBy("ws"))).alias("share"),
        F.coalesce(F.try_divide(F.log1p(F.datediff("ws", "w0")), F.log1p(F.datediff("w1", "w0"))),
                   F.lit(0.0)).alias("weight"))
    return h.select(F.date_format("ws", "yyyy-MM-dd").alias("window_start"), "topic",
                    F.col("n").cast("long").alias("n"), F.round("share", 6).alias("share"),
                    F.round("weight", 6).alias("weight"),
                    F.round(F.col("share") * F.col("weight"), 6).alias("v_hyb"))


def _state_sql():
    from trendspark.plans.q_trend import SIGNAL_SQL_CTES
    return SIGNAL_SQL_CTES + """
SELECT topic, year, CAST(n_kt AS BIGINT) AS n_kt, velocity, gap FROM s"""


@register("stream_state_velocity", _state_sql())
def stream_state_velocity(spark, sf_dir):
    """Running dense velocity and gap per topic with state per topic
    (transformWithState; lag is not available on streams)."""
    o = _topic_rows(_src(spark, sf_dir, "orders")).where(F.col("topic") != -1).select("topic", "year")
    cal = table(spark, sf_dir, "orders").agg(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).first()
    t = ST.run_update_to_table(ST.running_velocity(o, (int(cal[0]), int(cal[1]))), "state_velocity")
    return ST.latest_per_key(t, ["topic", "year"], "_epoch").select("topic", "year", "n_kt", "velocity", "gap")


def _predict_sql():
    from trendspark.plans import sqlfrag as S
    from trendspark.plans.q_topics import BASE_SQL
    return BASE_SQL + f""",
q AS (SELECT doc_id AS query_id, {S.tokens(S.clean_alnum('text'))} AS t FROM documents),
qt AS (SELECT DISTINCT query_id, unnest(list_concat(t, {S.bigrams('t')})) AS term FROM q),
hits AS (SELECT qt.query_id, w.topic, sum(w.score) AS score FROM qt JOIN words w ON w.term = qt.term GROUP BY 1, 2),
hb AS (SELECT query_id, first(topic ORDER BY score DESC, topic) AS bt, max(score) AS bs FROM hits GROUP BY query_id)
SELECT q.query_id AS doc_id, coalesce(hb.bt, (SELECT min(topic) FROM words)) AS topic,
       round(coalesce(hb.bs, 0.0), 6) AS score FROM q LEFT JOIN hb ON hb.query_id = q.query_id"""


@register("stream_predict", _predict_sql())
def stream_predict(spark, sf_dir):
    """X4 + J12: documents as a stream scored against the static topic words
    (broadcast) in each micro-batch: best topic per document."""
    from trendspark.plans.q_topics import pipeline
    words = cut_lineage(pipeline(spark, sf_dir)["words"].select("topic", "term", "score"))
    docs = _src(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "text")

    def score(batch):
        # words of the topics only, so that a document's other terms are never joined
        vocab = T.query_vocab(T.tokens(T.clean_alnum("text")))
        return TP.predict_best(batch.select("query_id", vocab.alias("vocab")), words)

    t = ST.run_batches(docs, "predict", score, spread_by="query_id")
    return t.select(F.col("query_id").alias("doc_id"), F.col("best_topic").alias("topic"),
                    F.round("best_score", 6).alias("score"))
