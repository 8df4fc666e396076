"""Mixing sources to target weights by Pareto order sampling.

A source with words S and target T has the rate r = T / S. Each of its documents
gets floor(r) certain whole copies. The fraction f of the rate is a sample
without replacement: a document's inclusion probability is ``f + min(f, 1 - f) *
(x - mean x)``, with ``x`` in [0, 1] preferring documents (by default shorter
ones, so that a few long texts don't decide a source) and ``mean x`` weighted by
words, so that the expected words are f * S. With U uniform (a hash of the
identifier and text) documents are ranked by odds(U) / odds(probability) and the
lowest ranks taken until f * S words are reached: the size that is fixed is
counted in words. Where the next text is too long for what is missing, the next
ranks that fit fill it.

The order is never sorted as a whole. Ranks fall into 8,192 buckets a source;
sums by bucket (combined before the shuffle) find the bucket in which the sample
ends, and only that bucket is ordered, for the cut's rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendspark.llm.common import text_or_empty, word_count
from trendspark.session import cut_lineage

BUCKETS = 8_192
_X = 10_000  # x in whole ten-thousandths, so that its sums don't depend on their order


def cycle_weights(n: int) -> Column:
    """1, 2, ..., n, repeating, for a column ``place`` from 1."""
    return ((F.col("place") - 1) % n + 1).cast("double")


def source_targets(sized: DataFrame, weight: Column, most: int = 3, total: Column | None = None) -> DataFrame:
    """One row per source of ``sized`` (source, size): ``source_size``, ``target``,
    ``rate``. ``place`` numbers sources by code point, null last. Targets share
    ``total`` (default: all words) by weight; one above ``most`` times its
    source's size stops there and its excess is shared by the others.

    The windows run over one row per source."""
    agg = sized.groupBy("source").agg(F.sum("size").alias("source_size"),
                                      F.sum(F.col("size").cast("decimal(38,0)") * F.col("x")).alias("sx"))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = agg.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    s = s.withColumn("weight", weight)
    s = s.withColumn("all", (total if total is not None else F.sum("source_size").over(everything)).cast("double"))
    # By rising size to weight, a source is full while the fair share of what is left reaches its cap.
    by = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    later = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("rank", F.row_number().over(by))
    s = s.withColumn("share", (F.col("all") - most * F.coalesce(F.sum("source_size").over(earlier), F.lit(0)))
                     / F.sum("weight").over(later))
    s = s.withColumn("full", most * F.col("source_size") <= F.col("share") * F.col("weight"))
    s = s.withColumn("level", F.min(F.when(~F.col("full"), F.struct("rank", "share"))).over(everything)["share"])
    target = F.when(F.col("full"), F.col("source_size").cast("double") * most).otherwise(F.col("level") * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"), "sx").withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    ).withColumn("whole", F.floor("rate").cast("int")).withColumn("part", F.col("rate") - F.col("whole")).withColumn(
        "mean_x", F.when(F.col("source_size") > 0, F.col("sx").cast("double") / F.col("source_size")).otherwise(F.lit(0.0))
    ).drop("sx")


def _ranked(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds each row's ``q`` (odds of the draw over odds of inclusion) and its bucket."""
    targets = targets.withColumnRenamed("source", "t_source")
    d = sized.join(targets, F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_source")
    p = F.col("part") + F.least("part", 1 - F.col("part")) * (F.col("x") - F.col("mean_x")) / F.lit(float(_X))
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    u = (F.conv(F.substring("draw", 1, 12), 16, 10).cast("double") + 0.5) * F.lit(2.0 ** -48)
    d = d.withColumn("q", (u / (1 - u)) / (p / (1 - p)))
    return d.withColumn("bucket", F.floor(F.col("q") / (1 + F.col("q")) * BUCKETS).cast("int"))


def sized_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               prefer: Column | None = None, seed: int = 7, carry: list[str] | None = None) -> DataFrame:
    """``row`` (struct of the carried columns), ``source``, ``size`` in words, ``x``
    and ``draw`` (32 hex digits from the seed, identifier and text)."""
    carry = docs.columns if carry is None else carry
    text = text_or_empty(F.col(text_col))
    own = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.md5(text))
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
                        F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"),
                        F.md5(own).alias("draw"),
                        (F.lit(None).cast("double") if prefer is None else prefer).alias("prefer"))
    short = F.floor(F.lit(float(_X) * 1000) / (F.col("size") + 1000))
    x = F.when(F.col("prefer").isNull(), short).otherwise(
        F.floor(F.least(F.greatest("prefer", F.lit(0.0)), F.lit(1.0)) * _X)).cast("long")
    return sized.withColumn("x", x).drop("prefer")


def _cut(ranked: DataFrame, goal: str, nearest: bool, tag: str) -> DataFrame:
    """Where the order's prefix of ``goal`` words ends in each source: the longest that
    does not pass the goal, or with ``nearest`` the one that comes nearest to it.
    One row per source: key, ``end`` (bucket), ``cut`` (last rank taken in it) and ``words``."""
    sums = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.max(goal).alias(goal))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (sums.withColumn("upto", F.sum("words").over(upto)).where(F.col("upto") > F.col(goal))
            .groupBy(F.col("source").alias("e_source"))
            .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("end"))
            .select("e_source", F.col("end.bucket").alias("end"), F.col("end.before").alias("before")))
    ends = cut_lineage(ends, f"mix-ends-{tag}")
    last = ranked.join(ends, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("bucket") == F.col("end")))
    order = Window.partitionBy("source").orderBy("q", "draw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("sum", F.col("before") + F.sum("size").over(order))
    inside = (F.col("sum") - F.col("size") / 2 if nearest else F.col("sum")) <= F.col(goal)
    taken = (last.where(inside).groupBy(F.col("source").alias("c_source"))
             .agg(F.max(F.struct("q", "draw")).alias("cut"), F.max("sum").alias("sum")))
    return cut_lineage(
        ends.join(taken, F.col("e_source").eqNullSafe(F.col("c_source")), "left")
        .select(F.col("e_source").alias(f"source_{tag}"), F.col("end").alias(f"end_{tag}"),
                F.col("cut").alias(f"cut_{tag}"), F.coalesce("sum", "before").alias(f"words_{tag}")),
        f"mix-cuts-{tag}")


def _inside(tag: str) -> Column:
    """Whether a row lies in the prefix; a source without an end is taken whole."""
    return F.col(f"end_{tag}").isNull() | (F.col("bucket") < F.col(f"end_{tag}")) | F.coalesce(
        (F.col("bucket") == F.col(f"end_{tag}")) & (F.struct("q", "draw") <= F.col(f"cut_{tag}")), F.lit(False))


def mix(sized: DataFrame, weight: Column | None = None, most: int = 3, total: Column | None = None,
        narrow: DataFrame | None = None) -> DataFrame:
    """Adds ``source_size``, ``target``, ``copies`` and ``taken`` (words: copies times
    size) to every row of ``sized`` (``sized_rows``); at most ``most`` copies.

    The order's prefix may stop before a long text; the words still missing then
    come from the next ranks whose texts are no longer than what is missing.

    ``narrow``: the same rows without what they carry, if they are already
    written. The result depends on identifiers, texts and sources only, so reruns
    agree. Null texts have size 0; a null source is a source of its own, the
    last; rows that repeat in identifier and text are taken or left together. An
    empty table gives an empty result.
    """
    weight = cycle_weights(3) if weight is None else weight
    narrow = cut_lineage(sized.drop("row"), "mix-sizes") if narrow is None else narrow
    targets = cut_lineage(source_targets(narrow, weight, most, total), "mix-targets")

    def with_goal(rows: DataFrame) -> DataFrame:
        return _ranked(rows, targets).withColumn("goal", F.col("part") * F.col("source_size"))

    first = _cut(with_goal(narrow), "goal", False, "a")

    def with_rest(rows: DataFrame) -> DataFrame:
        rows = with_goal(rows).join(first, F.col("source").eqNullSafe(F.col("source_a")), "left")
        rows = rows.withColumn("rest", F.coalesce(F.col("goal") - F.col("words_a"), F.lit(0.0)))
        return rows.withColumn("in_a", _inside("a")).withColumn("fits", ~F.col("in_a") & (F.col("size") <= F.col("rest")))

    second = _cut(with_rest(narrow).where("fits"), "rest", True, "b")
    out = with_rest(sized).join(second, F.col("source").eqNullSafe(F.col("source_b")), "left")
    more = (F.col("part") > 0) & (F.col("in_a") | (F.col("fits") & _inside("b")))
    out = out.withColumn("copies", (F.col("whole") + F.when(more, 1).otherwise(0)).cast("int"))
    kept = [c for c in ("row", "source", "size", "source_size", "target", "copies") if c in out.columns]
    return out.select(*kept, (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def take_copies(docs: DataFrame, weight: Column | None = None, most: int = 3) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns of ``docs``.

    Null texts and texts without words have size 0 and add nothing to a target; a null source is
    a source of its own. Rows equal in identifier and text share their draw and are
    taken or left together. Very long texts count whole. All columns travel in a struct, so
    names can't clash. An empty table gives an empty result."""
    mixed = mix(sized_rows(docs), weight, most)
    return mixed.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("_copy")).select("row.*")
