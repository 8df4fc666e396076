"""Derived views over the driver tables, in Spark and as DuckDB SQL.

* ``articles``     documents + a derived date (2012-2022) and category.
* ``topic_docs``   all articles with a topic: the label of the embedding, or of the id
                   where an article has none; label 9 is the outlier topic -1.
* ``topic_orders`` all orders with a derived, skewed topic (8 topics x 7 years).

The same arithmetic is written twice: once with the DataFrame API and once as
SQL common table expressions for the independent oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.sources.tables import table

ARTICLE_EPOCH = "2012-01-01"
ARTICLE_SPAN_DAYS = 4018


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", "text", "lang", "source",
        F.date_add(F.lit(ARTICLE_EPOCH).cast("date"),
                   ((F.col("doc_id") * 37) % ARTICLE_SPAN_DAYS).cast("int")).alias("date"),
        F.col("source").alias("category"),
        F.substring("text", 1, 80).alias("headline"),
        F.expr("substring(text, 81)").alias("short_description"),
    )


def topic_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with topic and embedding (null where there is none); both sides are keyed
    by doc id, so the join is a plain shuffle (or broadcast, chosen by AQE on size)."""
    a = articles(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "embedding", "label")
    label = F.coalesce(F.col("label").cast("long"), F.pmod("doc_id", F.lit(10)))
    return (a.join(e, "doc_id", "left")
            .withColumn("topic", F.when(label == 9, F.lit(-1)).otherwise(label).cast("int"))
            .withColumn("year", F.year("date").cast("int")))


def order_topic():
    """A skewed topic for every order: its own (key mod 8) while the cell (topic, year) takes it,
    else the topic that collects the rest of an even (2) or odd (6) year. Cells that take none
    are the gaps of the grid."""
    own = (F.col("o_orderkey") % 8).cast("int")
    yr = F.year("o_orderdate").cast("int")
    takes = (F.floor(F.col("o_orderkey") / 8) % 7) < (
        (own * 3 + (yr - 1995) * 2) % 7 - F.when(own == 5, 3).otherwise(0))
    return F.when(takes, own).when(yr % 2 == 0, 2).otherwise(6).cast("int")


def topic_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey",
                                              "o_totalprice", "o_orderpriority")
    return o.select("o_orderkey", "o_orderdate", "o_custkey", "o_totalprice", "o_orderpriority",
                    order_topic().alias("topic"), F.year("o_orderdate").cast("int").alias("year"))


# --------------------------------------------------------------------------- SQL side

ARTICLES_CTE = """articles AS (
  SELECT doc_id, text, lang, source,
         CAST(date '2012-01-01' + CAST((doc_id * 37) % 4018 AS INTEGER) AS DATE) AS date,
         source AS category,
         substr(text, 1, 80) AS headline,
         substr(text, 81) AS short_description
  FROM documents)"""

TOPIC_DOCS_CTE = ARTICLES_CTE + """,
topic_docs AS (
  SELECT a.*, e.embedding, e.label,
         CAST(CASE WHEN coalesce(e.label, a.doc_id % 10) = 9 THEN -1 ELSE coalesce(e.label, a.doc_id % 10) END AS INTEGER) AS topic,
         CAST(year(a.date) AS INTEGER) AS year
  FROM articles a LEFT JOIN embeddings e ON a.doc_id = e.vec_id)"""

TOPIC_ORDERS_CTE = """topic_orders AS (
  SELECT o_orderkey, o_orderdate, o_custkey, o_totalprice, o_orderpriority,
         CAST(CASE WHEN floor(o_orderkey / 8) % 7 <
                        ((o_orderkey % 8) * 3 + (year(o_orderdate) - 1995) * 2) % 7
                        - CASE WHEN o_orderkey % 8 = 5 THEN 3 ELSE 0 END THEN o_orderkey % 8
                   WHEN year(o_orderdate) % 2 = 0 THEN 2 ELSE 6 END AS INTEGER) AS topic,
         CAST(year(o_orderdate) AS INTEGER) AS year
  FROM orders)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
