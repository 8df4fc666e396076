"""Topic x period counts, velocities, gaps, popularity and signal classes.

Everything here aggregates first (one shuffle on the topic/period key, with
map-side partial aggregation) and only then runs window functions, so the
windows see the small topic x period grid, never the raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the signal model (must equal the reference's).
LAMBDA_DECAY = 0.5
EPSILON = 1.0
MIN_NONZERO_YEARS = 2
EMERGING_VELOCITY = 0.5
DEFAULT_Q_LOW = 1.0
DEFAULT_Q_HIGH = 10.0
CLASS_CODE = {"NOISE": 0, "WEAK_SIGNAL": 1, "STRONG_SIGNAL": 2, "EMERGING": 3}


def sparse_counts(df: DataFrame, topic: str = "topic", period: str = "year",
                  drop_outliers: bool = True) -> DataFrame:
    """Rows per (topic, period); absent cells do not exist."""
    src = df.where(F.col(topic) != -1) if drop_outliers else df
    return src.groupBy(topic, period).agg(F.count(F.lit(1)).cast("int").alias("n_kt"))


def dense_grid(df: DataFrame, topic: str = "topic", period: str = "year") -> DataFrame:
    """Every non-outlier topic x every observed period, zeros kept.

    One grouped scan gives counts per (topic, period) including the outlier
    topic (so periods seen only in outliers still exist); the distinct topics
    and periods come from that small aggregate (one row of two sets, both
    dimension-sized), exploded twice, and the counts are joined back. The
    aggregate (K x P rows, independent of the row count) feeds several
    branches (dimensions, counts, quartiles), so it is written once as a table
    in the checkpoint folder: the raw rows are scanned and shuffled once."""
    from trendspark.session import cut_lineage
    counts = cut_lineage(df.groupBy(topic, period).agg(F.count(F.lit(1)).cast("int").alias("n_kt")), "counts")
    dims = counts.agg(
        F.array_sort(F.collect_set(F.when(F.col(topic) != -1, F.col(topic)))).alias("_topics"),
        F.array_sort(F.collect_set(F.col(period))).alias("_periods"))
    grid = (dims.select(F.explode("_topics").alias(topic), "_periods")
            .select(topic, F.explode("_periods").alias(period)))
    return (grid.join(counts.where(F.col(topic) != -1), [topic, period], "left")
            .select(topic, period, F.coalesce("n_kt", F.lit(0)).cast("int").alias("n_kt")))


def nonzero_periods(grid: DataFrame, topic: str = "topic") -> DataFrame:
    """Periods with any row, per topic."""
    return grid.groupBy(topic).agg(F.count_if(F.col("n_kt") > 0).cast("int").alias("nonzero_years"))


def add_gap_velocity(grid: DataFrame, topic: str = "topic", period: str = "year",
                     round_to: int | None = 4) -> DataFrame:
    """W5 + W6 + W7 on a dense grid.

    gap: consecutive empty periods so far (gaps-and-islands: the island id is
    the running count of non-empty cells). velocity: (N-P)/(P+eps), first
    period 0. popularity: N * [N>0] * exp(-lambda*gap); decay exposed too.
    """
    w = Window.partitionBy(topic).orderBy(period)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = grid.withColumn("_island", F.sum(F.when(F.col("n_kt") > 0, 1).otherwise(0)).over(run))
    w_isl = (Window.partitionBy(topic, "_island").orderBy(period)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    g = g.withColumn("gap", F.sum(F.when(F.col("n_kt") > 0, 0).otherwise(1)).over(w_isl).cast("int"))
    prev = F.lag("n_kt").over(w)
    vel = F.coalesce((F.col("n_kt") - prev) / (prev + F.lit(EPSILON)), F.lit(0.0))
    decay = F.exp(F.lit(-LAMBDA_DECAY) * F.col("gap"))
    pop = F.col("n_kt") * F.when(F.col("n_kt") > 0, 1).otherwise(0) * decay
    if round_to is not None:
        vel, pop = F.round(vel, round_to), F.round(pop, round_to)
    return (g.withColumn("velocity", vel.cast("double"))
            .withColumn("decay", F.round(decay, 6))
            .withColumn("popularity", pop.cast("double"))
            .drop("_island"))


def popularity_quartiles(signals: DataFrame) -> DataFrame:
    """Exact 25th/75th percentile (linear interpolation) over non-zero
    popularity; defaults 1.0 / 10.0 when there is none. One-row result."""
    q = signals.where(F.col("popularity") > 0).agg(
        F.percentile(F.col("popularity"), F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    return q.select(F.coalesce(F.col("_q")[0], F.lit(DEFAULT_Q_LOW)).alias("q_low"),
                    F.coalesce(F.col("_q")[1], F.lit(DEFAULT_Q_HIGH)).alias("q_high"))


def classify(p: Column, v: Column, nz: Column, q_low: Column, q_high: Column) -> Column:
    """NOISE / WEAK_SIGNAL / EMERGING / STRONG_SIGNAL."""
    return (F.when(p < q_low, "NOISE")
            .when(p < q_high, "WEAK_SIGNAL")
            .when((v > EMERGING_VELOCITY) & (nz >= MIN_NONZERO_YEARS), "EMERGING")
            .otherwise("STRONG_SIGNAL"))


def class_code(c: Column) -> Column:
    expr = F.lit(0)
    for name, code in CLASS_CODE.items():
        expr = F.when(c == name, code).otherwise(expr)
    return expr.cast("int")


def signal_table(df: DataFrame, topic: str = "topic", period: str = "year",
                 labels: DataFrame | None = None) -> DataFrame:
    """Full signal record per (topic, period): FIXTURES 1.4 plus gap and decay.

    ``labels`` (topic_id, topic_label, raw_label) is an optional small
    dimension; missing labels default to ``Topic {id}``.
    """
    grid = dense_grid(df, topic, period)
    nz = F.count_if(F.col("n_kt") > 0).over(Window.partitionBy(topic)).cast("int")
    sig = add_gap_velocity(grid, topic, period).withColumn("nonzero_years", nz)
    q = popularity_quartiles(sig)
    sig = sig.crossJoin(F.broadcast(q))  # one-row scalar side
    sig = sig.withColumn("signal_class", classify(F.col("popularity"), F.col("velocity"),
                                                  F.col("nonzero_years"), F.col("q_low"),
                                                  F.col("q_high")))
    out = sig.select(F.col(topic).cast("int").alias("topic_id"), F.col(period).cast("int").alias("year"),
                     "n_kt", "velocity", "popularity", "nonzero_years", "gap", "decay",
                     "signal_class")
    if labels is not None:
        out = out.join(F.broadcast(labels), "topic_id", "left")
    else:
        out = out.withColumn("topic_label", F.lit(None).cast("string")) \
                 .withColumn("raw_label", F.lit(None).cast("string"))
    return out.withColumn("topic_label", F.coalesce("topic_label",
                                                    F.concat(F.lit("Topic "), F.col("topic_id").cast("string"))))
