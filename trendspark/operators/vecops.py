"""Vector operators: centroids, nearest topics/articles, closed-form
coherence and separation, exact kNN graph, mutual reachability and the
participation ratio.

Nearest neighbours are searched through an index (``vecindex``), or by comparing all
blocks of queries with all blocks of the corpus (``top_k_blocks``); against a few
centroids the queries are scored where they lie.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendspark.functions import vectors as V
from trendspark.operators import vecindex
from trendspark.session import cut_lineage

BLOCK = 512  # vectors of a block in exact search


def mean_vectors(df: DataFrame, group: str | None, vec: str) -> DataFrame:
    """A17 (without the final normalisation): mean vector per group via
    posexplode + avg per (group, i) — partial aggregation, d values per group."""
    keys = [group] if group else []
    e = df.select(*keys, F.posexplode(V.as_double(vec)).alias("i", "x"))
    m = e.groupBy(*keys, "i").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    g = m.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("_l"),
                             F.max("n").alias("n"))
    return g.select(*keys, F.transform("_l", lambda s: s["m"]).alias("mean"), "n")


def centroids(df: DataFrame, group: str, vec: str, centre: DataFrame | None = None) -> DataFrame:
    """Unit-length mean vector per group; with ``centre`` (a one-row
    frame holding ``mean``) the global mean is subtracted first."""
    m = mean_vectors(df, group, vec)
    if centre is not None:
        m = m.crossJoin(F.broadcast(centre.select(F.col("mean").alias("_mu")))).withColumn(
            "mean", V.sub("mean", "_mu")).drop("_mu")
    return m.select(group, V.unit("mean").alias("centroid"), "n")


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values of each row, the largest first, ties in column order."""
    return np.argsort(-sims, axis=1, kind="stable")[:, :k]


def nearest_few(queries: DataFrame, few: DataFrame, k: int, qid: str = "qid", cid: str = "cid",
                qv: str = "qv", cv: str = "cv") -> DataFrame:
    """Exact top-k of a few vectors, one per topic, for every query: (qid, rank, cid, sim).

    Only the few come to the driver (topics x dimension, independent of the
    rows); they travel with the tasks, and each batch of queries is scored by one
    product where it lies: no shuffle. Ties: lower id first."""
    known = few.select(cid, cv).orderBy(cid).collect()
    ids = np.array([r[cid] for r in known])
    mat = np.array([r[cv] for r in known], dtype=np.float64)
    types = queries.schema[qid].dataType.simpleString(), few.schema[cid].dataType.simpleString()

    def score(batches):
        for pdf in batches:
            if len(pdf) and len(ids):
                sims = np.stack(pdf[qv].to_numpy()).astype(np.float64) @ mat.T
                best = _best(sims, k)
                n = best.shape[1]
                yield pd.DataFrame({qid: np.repeat(pdf[qid].to_numpy(), n), "rank": np.tile(np.arange(1, n + 1), len(pdf)),
                                    cid: ids[best].ravel(), "sim": np.take_along_axis(sims, best, 1).ravel()})

    return queries.select(qid, qv).mapInPandas(score, f"{qid} {types[0]}, rank int, {cid} {types[1]}, sim double")


def _blocks(df: DataFrame, keys: list[str], id_col: str, vec: str, prefix: str, size: int) -> DataFrame:
    """Rows packed into blocks of about ``size`` vectors by a hash of the id."""
    n = max(1, math.ceil(df.count() / size))
    return (df.groupBy(*keys, F.pmod(F.xxhash64(id_col), F.lit(n)).alias(f"{prefix}_block"))
            .agg(F.collect_list(F.struct(F.col(id_col).alias("id"), F.col(vec).alias("v"))).alias(prefix)))


def top_k_similar(queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool = False, group: str | None = None,
                  probes: int = 8, complete: str = "all") -> DataFrame:
    """Top-k by cosine of unit vectors through an index of the corpus (``vecindex``):
    (qid, rank, cid, sim), ties by the lower corpus id. With ``group`` only vectors of the same
    group are compared. Exact unless ``complete`` says otherwise; cells that hold nothing
    near a query are not visited. ``top_k_blocks`` is the same without an index."""
    index = vecindex.build_index(corpus, "cid", "cv", group)
    return vecindex.search(index, queries, k, group=group, exclude_self=exclude_self, probes=probes, complete=complete)


def top_k_blocks(queries: DataFrame, corpus: DataFrame, k: int, qid: str = "qid", cid: str = "cid",
                 qv: str = "qv", cv: str = "cv", exclude_self: bool = False,
                 block: int = BLOCK, group: str | None = None) -> DataFrame:
    """Exact top-k by dot product (cosine on unit vectors): (qid, rank, cid, sim).
    Ties: lower corpus id first. With ``group`` (a column on both sides) only
    pairs of the same group are compared.

    Both sides are packed into blocks of about ``block`` vectors and every block
    of queries meets every block of the corpus on the executors: one product of a
    bounded size per pair of blocks, of which only the k best per query go on to
    the final ``row_number() <= k``. Nothing passes through the driver; the cost
    is that of exact search, rows x rows / block^2 products."""
    keys = [group] if group else []
    q = _blocks(queries.select(*keys, qid, qv), keys, qid, qv, "q", block)
    c = _blocks(corpus.select(*keys, cid, cv), keys, cid, cv, "c", block)
    pairs = q.join(c, group) if group else q.crossJoin(c)  # blocks, not rows
    types = queries.schema[qid].dataType.simpleString(), corpus.schema[cid].dataType.simpleString()

    def side(rows) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array([r["id"] for r in rows])
        order = np.argsort(ids, kind="stable")
        return ids[order], np.array([r["v"] for r in rows], dtype=np.float64)[order]

    def score(batches):
        for pdf in batches:
            for q_rows, c_rows in zip(pdf["q"], pdf["c"]):
                (q_ids, q_mat), (c_ids, c_mat) = side(q_rows), side(c_rows)
                sims = q_mat @ c_mat.T
                if exclude_self:
                    sims[q_ids[:, None] == c_ids[None, :]] = -np.inf
                best = _best(sims, k)
                out = pd.DataFrame({qid: np.repeat(q_ids, best.shape[1]), cid: c_ids[best].ravel(),
                                    "sim": np.take_along_axis(sims, best, 1).ravel()})
                yield out[np.isfinite(out["sim"])]

    found = pairs.select("q", "c").mapInPandas(score, f"{qid} {types[0]}, {cid} {types[1]}, sim double")
    w = Window.partitionBy(qid).orderBy(F.desc("sim"), F.col(cid))
    return (found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
            .select(qid, "rank", cid, "sim"))


def group_coherence(df: DataFrame, group: str, vec: str, min_size: int = 2) -> DataFrame:
    """V22 in closed form: mean pairwise cosine (diagonal included) of a group's
    unit vectors = ||Σû||² / n²; groups under ``min_size`` are skipped."""
    u = df.select(group, V.unit(vec).alias("u"))
    s = mean_vectors(u, group, "u")  # mean of unit vectors; ||mean||² = ||Σû||²/n²
    return s.where(F.col("n") >= min_size).select(
        group, F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x).alias("coherence"), "n")


def vector_separation(df: DataFrame, grp: str, vec: str, mode: str = "min", min_size: int = 1) -> DataFrame:
    """V7 + V8 on dense vectors for groups 'A' and 'B' in closed form; both groups' means
    come from one aggregate by dimension."""
    of = lambda g, c: F.when(F.col(grp) == g, F.col(c))
    m = df.select(grp, F.posexplode(V.unit(vec)).alias("i", "x")).groupBy("i").agg(
        F.avg(of("A", "x")).alias("a"), F.avg(of("B", "x")).alias("b"), F.count(of("A", "x")).alias("n_a"), F.count(of("B", "x")).alias("n_b"))
    r = m.agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), *[
        F.sum(F.col(x) * F.col(y)).alias(name) for x, y, name in (("a", "a", "intra_a"), ("b", "b", "intra_b"), ("a", "b", "cross"))])
    gap = (F.least("intra_a", "intra_b") if mode == "min"
           else (F.col("intra_a") + F.col("intra_b")) / 2) - F.col("cross")
    return r.withColumn("gap", gap).where((F.col("n_a") >= min_size) & (F.col("n_b") >= min_size))


def knn_graph(df: DataFrame, id_col: str, vec: str, k: int = 15) -> DataFrame:
    """Exact k nearest other points by cosine distance (1 - cos):
    (src, rank, dst, distance) plus rho = distance to the nearest neighbour."""
    u = df.select(F.col(id_col).alias("qid"), V.unit(vec).alias("qv"))
    c = u.select(F.col("qid").alias("cid"), F.col("qv").alias("cv"))
    t = top_k_similar(u, c, k, exclude_self=True)
    t = cut_lineage(t.select(F.col("qid").alias("src"), "rank", F.col("cid").alias("dst"),
                             (1.0 - F.col("sim")).alias("distance")), "knn")  # several joins read it: searched once
    return t.withColumn("rho", F.min("distance").over(Window.partitionBy("src")))


def fuzzy_sigma(dists, rho, k: int, iters: int = 64):
    """sigma by bisection so that Σ exp(-max(d - rho, 0) / sigma) = log2(k)."""
    target = math.log2(k)

    def step(acc, _):
        lo, hi, mid = acc["lo"], acc["hi"], acc["mid"]
        s = F.aggregate(dists, F.lit(0.0), lambda a, d: a + F.exp(-F.greatest(d - rho, F.lit(0.0)) / mid))
        big = s > target
        new_lo = F.when(big, lo).otherwise(mid)
        new_hi = F.when(big, mid).otherwise(hi)
        new_mid = F.when(big, (lo + mid) / 2).otherwise(
            F.when(F.isnan(hi) | (hi > 1e300), mid * 2).otherwise((mid + hi) / 2))
        return F.struct(new_lo.alias("lo"), new_hi.alias("hi"), new_mid.alias("mid"))

    init = F.struct(F.lit(0.0).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(1.0).alias("mid"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(iters)), init, step)["mid"]


def mutual_reachability(knn: DataFrame, min_samples: int = 10, keys=()) -> DataFrame:
    """V14 (core distances and edges): core distance = distance to the
    (min_samples - 1)-th other neighbour (the point itself is the first of
    min_samples); edge weight = max(core_a, core_b, d(a, b)) on kNN edges.
    ``keys``: columns of independent graphs."""
    keys = list(keys)
    core = knn.where(F.col("rank") == min_samples - 1).select(*keys, F.col("src").alias("node"),
                                                               F.col("distance").alias("core"))
    e = (knn.join(core.withColumnRenamed("node", "src").withColumnRenamed("core", "core_src"), keys + ["src"])
         .join(core.withColumnRenamed("node", "dst").withColumnRenamed("core", "core_dst"), keys + ["dst"]))
    return e.select(*keys, "src", "dst", "distance", "core_src", "core_dst",
                    F.greatest("core_src", "core_dst", "distance").alias("mreach"))


def participation_ratio(df: DataFrame, vec: str) -> DataFrame:
    """(Σλ)² / Σλ² of the centred data = trace(C)² / ||C||_F², from the
    Gram matrix. Each task folds its rows into one d x d partial sum (numpy);
    the partials are summed per (i, j): no per-row d² explosion."""

    def part(it):
        g = s = None
        n = 0
        for pdf in it:
            x = np.stack(pdf[vec].map(lambda a: np.asarray(a, dtype=np.float64)).to_numpy()) \
                if len(pdf) else None
            if x is None:
                continue
            g = x.T @ x if g is None else g + x.T @ x
            s = x.sum(0) if s is None else s + x.sum(0)
            n += len(x)
        if g is None:
            return
        d = g.shape[0]
        ii, jj = np.meshgrid(np.arange(d), np.arange(d), indexing="ij")
        yield pd.DataFrame({"i": ii.ravel(), "j": jj.ravel(), "g": g.ravel(),
                            "si": np.repeat(s, d), "sj": np.tile(s, d), "n": n})

    parts = df.select(vec).mapInPandas(part, "i int, j int, g double, si double, sj double, n long")
    # One aggregate holds the Gram matrix, both sums and the count of every cell.
    c = (parts.groupBy("i", "j").agg(F.sum("g").alias("g"), F.sum("si").alias("s_i"), F.sum("sj").alias("s_j"),
                                     F.sum("n").alias("n"))
         .select("i", "j", (F.col("g") - F.col("s_i") * F.col("s_j") / F.col("n")).alias("c")))
    r = c.agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("c"))).alias("tr"),
              F.sum(F.col("c") * F.col("c")).alias("fro2"), (F.max("i") + 1).cast("int").alias("d"))
    return r.select((F.col("tr") * F.col("tr") / F.col("fro2")).alias("participation_ratio"), "d")
