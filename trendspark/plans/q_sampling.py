"""Sampling and ordering queries (hash order: repeatable in both engines)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendspark.functions import text as T
from trendspark.operators import ordering, sampling
from trendspark.plans import sqlfrag as S
from trendspark.plans.registry import register
from trendspark.plans.views import TOPIC_DOCS_CTE, topic_docs, with_ctes
from trendspark.sources.tables import table

YEAR_CAP = 1000


@register("balanced_sample", f"""
WITH o AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year,
                  row_number() OVER (PARTITION BY year(o_orderdate)
                                     ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rn
           FROM orders)
SELECT o_orderkey, year FROM o WHERE rn <= {YEAR_CAP}""")
def balanced_sample(spark, sf_dir):
    """O1: at most 1,000 rows per year, seed 42, without replacement."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").cast("int").alias("year"))
    return sampling.balanced_sample(o, "year", "o_orderkey", YEAR_CAP, 42)


@register("topic_sample", with_ctes(TOPIC_DOCS_CTE) + """,
r AS (SELECT doc_id, topic,
             row_number() OVER (PARTITION BY topic ORDER BY doc_id) AS first_rank,
             row_number() OVER (PARTITION BY topic ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS hash_rank
      FROM topic_docs)
SELECT doc_id, topic, first_rank <= 200 AS in_first200, hash_rank <= 30 AS in_sample30
FROM r WHERE first_rank <= 200 OR hash_rank <= 30""")
def topic_sample(spark, sf_dir):
    """O4 (first 200 members by id) + O5 (seeded 30 per topic), one row per
    member that is in either set."""
    d = topic_docs(spark, sf_dir).select("doc_id", "topic")
    a = sampling.first_k(d, "topic", [F.col("doc_id")], 200).select("doc_id", "topic").withColumn("in_first200", F.lit(True))
    b = sampling.balanced_sample(d, "topic", "doc_id", 30, 42).select("doc_id", "topic").withColumn("in_sample30", F.lit(True))
    j = a.join(b, ["doc_id", "topic"], "full")
    return j.select("doc_id", "topic", F.coalesce("in_first200", F.lit(False)).alias("in_first200"),
                    F.coalesce("in_sample30", F.lit(False)).alias("in_sample30"))


N_BOOT = 20


@register("bootstrap_sample", f"""
WITH b AS (SELECT CAST(unnest(range(1, {N_BOOT + 1})) AS INTEGER) AS b),
n AS (SELECT count(*) AS n FROM embeddings),
r AS (SELECT b.b, e.vec_id,
             row_number() OVER (PARTITION BY b.b ORDER BY md5(CAST(b.b AS VARCHAR) || ':' || CAST(e.vec_id AS VARCHAR)), e.vec_id) AS rn
      FROM embeddings e, b)
SELECT b AS replicate, vec_id FROM r, n WHERE rn <= floor(0.8 * n.n)""")
def bootstrap_sample(spark, sf_dir):
    """20 resamples of 80% without replacement, each exact in size.
    Rows are replicated by a per-row generator (no join) and selected with the
    histogram method, so no replicate is ranked inside one task."""
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    n = e.agg(F.count(F.lit(1)).alias("_n"))
    rep = (e.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(N_BOOT))))
           .crossJoin(F.broadcast(n))
           .withColumn("_k", F.floor(F.col("_n") * 0.8)))
    out = sampling.exact_hash_sample(rep, "replicate", "vec_id", "replicate", "_k")
    return out.select(F.col("replicate").cast("int").alias("replicate"), "vec_id")


@register("curriculum_rank", f"""
WITH c AS (SELECT doc_id, {S.tokens(S.clean_alnum('text'))} AS t FROM documents),
r AS (SELECT doc_id, round({S.richness('t')}, 6) AS text_richness FROM c),
k AS (SELECT doc_id, text_richness, row_number() OVER (ORDER BY text_richness DESC, doc_id) AS curriculum_rank FROM r),
m AS (SELECT median(text_richness) AS med FROM r)
SELECT doc_id, text_richness, CAST(curriculum_rank AS BIGINT) AS curriculum_rank,
       text_richness >= med AS high_richness FROM k, m""")
def curriculum_rank(spark, sf_dir):
    """O3 + P9: global rank by richness (desc, then id) and the median split.
    Rank and median come from a distributed global sort (no single-partition
    window, no collect of all values)."""
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.round(T.richness(T.tokens(T.clean_alnum("text"))), 6).alias("text_richness"))
    ranked = ordering.global_rank(d, [F.desc("text_richness"), F.col("doc_id")], "curriculum_rank")
    med = ordering.exact_median(ranked, "text_richness", "curriculum_rank")
    return ranked.crossJoin(F.broadcast(med)).select(
        "doc_id", "text_richness", "curriculum_rank",
        (F.col("text_richness") >= F.col("median")).alias("high_richness"))
