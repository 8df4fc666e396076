"""Exact deduplication by a content sort.

Every row's normalised text (ASCII white space deleted) is range-partitioned on
sampled splitters (its first bytes, then a hash of all of it, so that a common
beginning splits and the splitters stay small) and sorted externally, so that
equal texts lie next to each other; a window over the text then compares each text in full with its
neighbour and closes a run where they differ. Of a run the row with the most
code points in the original text, then the smallest identifier, stays.

Hot texts: a first pass counts a 64-bit hash of each text (combined before its
shuffle). A text with more than ``t`` copies, ``t = max(256, rows / (4 *
partitions))``, gets ``ceil(copies / t)`` salts as a second sort key, so its
run spans several range partitions. There are at most ``4 * partitions`` such
texts and ``8 * partitions`` salted runs: that bounds the table of hot hashes
and the second content sort, over one representative of each salted run, which
joins the parts of a hot run. The hash only decides on salting; equality is
always a comparison of whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendspark.llm.common import BLANKS, partitions, text_or_empty
from trendspark.session import cut_lineage


LEAD = 64  # characters of a text in a splitter; comparisons take all


def normalised(text: Column) -> Column:
    return F.translate(text_or_empty(text), BLANKS, "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 carry: list[str] | None = None) -> DataFrame:
    """One row per input row: ``row`` (struct of the ``carry`` columns, by default
    all), ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` (of the
    normalised text).

    Null and empty texts and texts of white space only are equal to each other.
    Null identifiers sort last. Among rows that tie in length and identifier
    exactly one stays. An empty table gives an empty result. Input columns keep
    any name, as they travel inside ``row``.
    """
    spark = docs.sparkSession
    n_part = partitions(spark)
    carry = docs.columns if carry is None else carry
    threshold = max(256, docs.count() // (4 * n_part))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
                       F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"),
                       F.char_length(text_or_empty(F.col(text_col))).alias("chars"))
    hot = (docs.select(F.xxhash64(normalised(F.col(text_col))).alias("h"))
           .groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > threshold)
           .select("h", F.ceil(F.col("n") / threshold).cast("int").alias("salts")))
    hot = cut_lineage(hot, "hot-texts")  # at most 4 * n_part rows of 12 bytes
    salted = (base.join(F.broadcast(hot), F.xxhash64("norm") == F.col("h"), "left")
              .withColumn("salt", F.when(F.col("h").isNotNull(), F.pmod(F.xxhash64("id"), F.col("salts")))
                          .otherwise(F.lit(0)).cast("int"))
              .select("row", "id", "norm", "chars", "salt", F.col("h").isNotNull().alias("hot")))
    salted = salted.withColumn("lead", F.substring("norm", 1, LEAD)).withColumn("whole", F.xxhash64("norm"))
    run = (Window.partitionBy("lead", "whole", "norm", "salt").orderBy(F.desc("chars"), F.asc_nulls_last("id")))
    all_ = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.row_number().over(run) == 1
    runs = (salted.repartitionByRange("lead", "whole", "salt")
            .select("row", "id", "salt", "norm", "hot", "chars",
                    F.first("id").over(all_).alias("best"), F.count(F.lit(1)).over(all_).alias("n"),
                    first.alias("first"))
            .select("row", "id", "salt", "best", "n", "first", "chars", F.sha2("norm", 256).alias("sha"),
                    F.when(F.col("hot") & F.col("first"), F.col("norm")).alias("hot_text")))
    runs = cut_lineage(runs, "content-runs")
    joint = Window.partitionBy("lead", "whole", "hot_text").orderBy(F.desc("chars"), F.asc_nulls_last("id"), F.asc("salt"))
    joint = joint.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = (runs.where(F.col("hot_text").isNotNull()).select("hot_text", "id", "salt", "n", "chars", "sha")
              .withColumn("lead", F.substring("hot_text", 1, LEAD)).withColumn("whole", F.xxhash64("hot_text"))
              .repartitionByRange("lead", "whole")
              .select(F.col("sha").alias("m_sha"), F.col("salt").alias("m_salt"),
                      F.first("id").over(joint).alias("m_best"), F.sum("n").over(joint).alias("m_n"),
                      F.first("salt").over(joint).alias("m_first")))
    out = runs.drop("hot_text").join(  # at most 8 * n_part rows
        F.broadcast(merged), (F.col("sha") == F.col("m_sha")) & (F.col("salt") == F.col("m_salt")), "left")
    in_hot = F.col("m_n").isNotNull()
    return out.select(
        "row",
        F.when(in_hot, F.col("m_best")).otherwise(F.col("best")).alias("keep_id"),
        F.when(in_hot, F.col("m_n")).otherwise(F.col("n")).cast("long").alias("group_size"),
        (F.col("first") & (~in_hot | (F.col("salt") == F.col("m_first")))).alias("kept"),
        F.col("sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    return exact_groups(docs, id_col, text_col).where("kept").select("row.*")
