"""Bag-of-words in long form: (doc, term, tf) tables, vocabulary, TF-IDF,
cosine of text pairs and closed-form group separation.

Nothing is densified: a document's vector is its set of (term, tf) rows.
Per-term aggregates use map-side partial aggregation, so a term present in
every document (a hot key) is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendspark.functions import text as T
from trendspark.functions.stopwords import all_stops, spark_english_stop_words
from trendspark.operators import textops


def doc_terms(df: DataFrame, doc_col: str, text_col: str, stops=None, bigrams: bool = False,
              clean: str = "alnum") -> DataFrame:
    """(doc, term) rows, one per occurrence. Tokens: ``\\w\\w+`` on cleaned text,
    stop words removed, optionally with bigrams over the filtered list."""
    cl = T.clean_alnum(text_col) if clean == "alnum" else T.clean_alpha(text_col)
    d = df.select(F.col(doc_col).alias("doc_id"), cl.alias("_clean"))
    stops = spark_english_stop_words() if stops is None else stops
    if bigrams:
        d = textops.vectorizer_terms(d, "_clean", "_terms", stops)
    else:
        d = textops.remove_stops(d.withColumn("_wt", T.word_tokens("_clean")), "_wt", "_terms", stops)
    # explode_outer + null filter: a plain explode lets Catalyst infer a
    # size(terms) > 0 filter below the scan, running the tokenizer twice
    return d.select("doc_id", F.explode_outer("_terms").alias("term")).where(F.col("term").isNotNull())


def term_counts(terms: DataFrame) -> DataFrame:
    """V2: (doc_id, term, tf)."""
    return terms.groupBy("doc_id", "term").agg(F.count(F.lit(1)).cast("long").alias("tf"))


def vocabulary(tc: DataFrame, n_docs: DataFrame, min_df: int = 2, max_df: float = 0.95,
               max_features: int | None = 5000) -> DataFrame:
    """V1: drop terms with df < min_df or df > int(max_df * n); keep the top
    ``max_features`` by total count (term name breaks ties). ``n_docs`` is a
    one-row frame with column ``n``. The result is bounded by max_features."""
    st = tc.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    st = st.crossJoin(F.broadcast(n_docs)).where(
        (F.col("df") >= min_df) & (F.col("df") <= F.floor(F.col("n") * F.lit(max_df)))).drop("n")
    if max_features is not None:
        st = st.orderBy(F.desc("total"), "term").limit(max_features)
    return st


def tfidf(tc: DataFrame, vocab: DataFrame, n_docs: DataFrame) -> DataFrame:
    """V3: tf * (ln((1+n)/(1+df)) + 1), rows L2-normalised. Columns doc_id, term, w."""
    v = vocab.select("term", "df").crossJoin(F.broadcast(n_docs))
    x = tc.join(F.broadcast(v), "term").withColumn(
        "w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return x.select("doc_id", "term", (F.col("w") / norm).alias("w"))


def unit_rows(tc: DataFrame, value: str = "tf") -> DataFrame:
    """D9 on long vectors: (doc_id, term, u) with u = x / ||x||; zero rows vanish."""
    norm = F.sqrt(F.sum(F.col(value) * F.col(value)).over(Window.partitionBy("doc_id")))
    return tc.select("doc_id", "term", (F.col(value) / norm).alias("u"))


def pair_cosine(pairs: DataFrame, tc: DataFrame) -> DataFrame:
    """V6: cosine of (pair_id, a_id, b_id) text pairs from long counts; 0 when
    either side is empty. One join per side on (doc, term)."""
    u = unit_rows(tc)
    a = pairs.select("pair_id", F.col("a_id").alias("doc_id")).join(u, "doc_id").select(
        "pair_id", "term", F.col("u").alias("ua"))
    b = pairs.select("pair_id", F.col("b_id").alias("doc_id")).join(u, "doc_id").select(
        "pair_id", "term", F.col("u").alias("ub"))
    dot = a.join(b, ["pair_id", "term"]).groupBy("pair_id").agg(F.sum(F.col("ua") * F.col("ub")).alias("cos"))
    return pairs.join(dot, "pair_id", "left").withColumn("cos", F.coalesce("cos", F.lit(0.0)))


def separation(u: DataFrame, groups: DataFrame, key: str = "term", value: str = "u",
               mode: str = "min", min_size: int = 1) -> DataFrame:
    """V7 + V8 in closed form for two groups named 'A' and 'B':
    intra = ||Σu||² / n², cross = Σu_A·Σu_B / (n_A n_B); gap = min (or mean)
    of the intras minus cross. Pairs are never formed: one aggregate by key holds
    both groups' sums, one more both norms and the product."""
    of = lambda g, c: F.sum(F.when(F.col("grp") == g, F.col(c)).otherwise(0.0))
    n = groups.agg(F.count_if(F.col("grp") == "A").alias("n_a"), F.count_if(F.col("grp") == "B").alias("n_b"))
    s = u.join(groups, "doc_id").groupBy(key).agg(of("A", value).alias("a"), of("B", value).alias("b"))
    r = s.agg(*[F.coalesce(F.sum(F.col(x) * F.col(y)), F.lit(0.0)).alias(x + y) for x, y in ("aa", "bb", "ab")])
    r = r.crossJoin(F.broadcast(n)).where((F.col("n_a") > 0) & (F.col("n_b") > 0)).select(
        "n_a", "n_b", (F.col("aa") / (F.col("n_a") * F.col("n_a"))).alias("intra_a"),
        (F.col("bb") / (F.col("n_b") * F.col("n_b"))).alias("intra_b"),
        (F.col("ab") / (F.col("n_a") * F.col("n_b"))).alias("cross"))
    gap = (F.least("intra_a", "intra_b") if mode == "min"
           else (F.col("intra_a") + F.col("intra_b")) / 2) - F.col("cross")
    return r.withColumn("gap", gap).where((F.col("n_a") >= min_size) & (F.col("n_b") >= min_size))


def english_stops():
    return spark_english_stop_words()


def bert_stops():
    return all_stops()
