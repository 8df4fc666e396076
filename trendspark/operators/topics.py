"""Class TF-IDF topic representation, outlier reassignment, labels and
topic prediction for new text.

Tables: doc terms (doc_id, term) -> class term counts (topic, term, tf) ->
c-TF-IDF (topic, term, w). Per-topic top-k uses ``row_number() <= k`` (map-side
WindowGroupLimit); document x topic similarity joins on ``term`` and lets AQE
broadcast the topic-term side at runtime when its measured size is small and
split skewed term partitions otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendspark.functions import text as T
from trendspark.operators import bow, textops
from trendspark.rules import SEMANTIC_RULES
from trendspark.session import cut_lineage

CTFIDF_MIN_DF = 2
CTFIDF_MAX_DF = 0.98
N_WORDS = 10
MOST_COLUMNS = 64  # classes whose counts travel as columns of one row


def doc_terms_12(df: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """T9 terms (1-2 grams, united stop list) per document occurrence."""
    return bow.doc_terms(df, doc_col, text_col, stops=bow.bert_stops(), bigrams=True)


def doc_term_lists(df: DataFrame, doc_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """(doc_id, terms): the T9 terms as one list a document, which joins move whole; with the columns ``keep``."""
    d = df.select(F.col(doc_col).alias("doc_id"), *keep, T.clean_alnum(text_col).alias("_clean"))
    return textops.vectorizer_terms(d, "_clean", "terms", bow.bert_stops()).select("doc_id", *keep, "terms")


def listed_terms(lists: DataFrame) -> DataFrame:
    """(doc_id, term) per occurrence from ``doc_term_lists``."""
    # explode_outer: see bow.doc_terms
    return lists.select("doc_id", F.explode_outer("terms").alias("term")).where(F.col("term").isNotNull())


def class_list_counts(lists: DataFrame, assign: DataFrame) -> DataFrame:
    """``class_term_counts`` of lists: documents meet their topics before their terms become rows."""
    return (lists.join(assign, "doc_id").select("topic", F.explode("terms").alias("term"))
            .groupBy("topic", "term").agg(F.count(F.lit(1)).alias("tf")))


def class_term_counts(terms: DataFrame, assign: DataFrame) -> DataFrame:
    """(topic, term, tf): the class pseudo-document counts — the topic model's
    state table (K x V rows); callers materialise it once."""
    return terms.join(assign, "doc_id").groupBy("topic", "term").agg(F.count(F.lit(1)).alias("tf"))


def counts_by_term(rows: DataFrame, classes: list[int]) -> DataFrame:
    """(term, by): the counts of every term as an array of (topic, tf), the zeros left out, from ``rows``
    (term, topic, n). One shuffle, of rows added up before it: a count a class travels in one row, so
    terms needn't be brought together again; with more than ``MOST_COLUMNS`` classes a second shuffle does it."""
    if len(classes) > MOST_COLUMNS:
        c = rows.groupBy("term", "topic").agg(F.sum("n").alias("tf")).where(F.col("tf") != 0)
        return c.groupBy("term").agg(F.collect_list(F.struct("topic", "tf")).alias("by"))
    c = rows.groupBy("term").agg(*[F.sum(F.when(F.col("topic") == t, F.col("n")).otherwise(F.lit(0))).alias(f"n{i}")
                                   for i, t in enumerate(classes)])
    by = F.array(*[F.struct(F.lit(t).cast("int").alias("topic"), F.col(f"n{i}").alias("tf")) for i, t in enumerate(classes)])
    return c.select("term", F.filter(by, lambda x: x["tf"] != 0).alias("by")).where(F.size("by") > 0)


def kept_class_terms(by_term: DataFrame, k: int, min_df: int = CTFIDF_MIN_DF, max_df: float = CTFIDF_MAX_DF) -> DataFrame:
    """(topic, term, tf, tf_t) of the terms that c-TF-IDF keeps of ``counts_by_term``; ``k``: classes with a term."""
    x = by_term.where((F.size("by") >= min_df) & (F.size("by") <= math.floor(k * max_df)))
    return x.select("term", F.aggregate("by", F.lit(0).cast("long"), lambda a, c: a + c["tf"]).alias("tf_t"), F.inline("by")) \
        .select("topic", "term", "tf", "tf_t")


def class_tfidf(ctc: DataFrame, min_df: int = CTFIDF_MIN_DF, max_df: float = CTFIDF_MAX_DF) -> DataFrame:
    """V16 (+ V17 column) from class term counts (topic, term, tf).

    The vocabulary is learned over the class pseudo-documents: a term is kept
    when it occurs in >= min_df classes and <= int(max_df * classes).
    W = tf_tc / Σ_t tf_tc * ln(1 + A / tf_t), A = int(mean class total).
    pmi = ln((tf_tc / A_c) * (A / tf_t)), A_c = class total.
    Per-term class frequency is a window over ``term`` (at most K rows per
    term); class totals are a K-row aggregate, broadcast back."""
    k = ctc.agg(F.countDistinct("topic").alias("_k"))
    wt = Window.partitionBy("term")
    x = (ctc.withColumn("cdf", F.count(F.lit(1)).over(wt)).withColumn("tf_t", F.sum("tf").over(wt))
         .crossJoin(F.broadcast(k))
         .where((F.col("cdf") >= min_df) & (F.col("cdf") <= F.floor(F.col("_k") * F.lit(max_df))))
         .select("topic", "term", "tf", "tf_t"))
    return weighted_terms(x)


def weighted_terms(x: DataFrame) -> DataFrame:
    """The weights W and pmi of kept class terms (topic, term, tf, tf_t)."""
    tot = x.groupBy("topic").agg(F.sum("tf").alias("tot"))
    a = tot.agg(F.floor(F.avg("tot")).alias("A"))
    x = x.join(F.broadcast(tot), "topic").crossJoin(F.broadcast(a))
    return x.select("topic", "term", "tf", "tf_t", "tot", "A",
                    (F.col("tf") / F.col("tot") * F.log(1 + F.col("A") / F.col("tf_t"))).alias("w"),
                    F.log((F.col("tf") / F.col("tot")) * (F.col("A") / F.col("tf_t"))).alias("pmi"))


def top_words(ct: DataFrame, k: int = N_WORDS, score: str = "w") -> DataFrame:
    """K4: (topic, rank, term, score) — best k terms per topic, term name on ties."""
    w = Window.partitionBy("topic").orderBy(F.desc(score), F.col("term"))
    return (ct.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("topic", F.col("rank").cast("int").alias("rank"), "term", F.col(score).alias("score")))


def reassign_outliers(terms: DataFrame, assign: DataFrame, ct: DataFrame,
                      threshold: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """C-TF-IDF cosine of each outlier document to each topic; best
    topic when its similarity >= threshold (lowest id on ties), else -1.
    Returns (per-outlier similarity table, new assignment)."""
    out = assign.where(F.col("topic") == -1).select("doc_id")
    tc = terms.join(out, "doc_id").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return reassign_counted(tc, assign, ct, threshold)


def reassign_counted(tc: DataFrame, assign: DataFrame, ct: DataFrame, threshold: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """``reassign_outliers`` from the outliers' counts (doc_id, term, tf). A term's weights in all topics are one
    row, which the counts meet once; the norm is added up along with the products (as the product with no topic)."""
    out = assign.where(F.col("topic") == -1).select("doc_id")
    tw = ct.where(F.col("topic") != -1).select("topic", "term", "w")
    tn = tw.groupBy("topic").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nw"))
    rows = ct.groupBy("term").agg(F.first(F.log(1 + F.col("A") / F.col("tf_t"))).alias("idf"),
                                  F.collect_list(F.when(F.col("topic") != -1, F.struct("topic", "w"))).alias("ws"))
    x = F.col("tf") * F.col("idf")
    products = F.concat(F.array(F.struct(F.lit(None).cast("int").alias("topic"), x.alias("w"))), F.col("ws"))
    dot = (tc.join(rows, "term").select("doc_id", x.alias("x"), F.inline(products)).groupBy("doc_id", "topic")
           .agg(F.sum(F.col("x") * F.col("w")).alias("dot")))
    dot = cut_lineage(dot, "outlier-products")
    nx = dot.where(F.col("topic").isNull()).select("doc_id", F.sqrt("dot").alias("nx"))
    sim = (dot.join(F.broadcast(tn), "topic").join(nx, "doc_id")
           .select("doc_id", "topic", (F.col("dot") / (F.col("nx") * F.col("nw"))).alias("sim")))
    best = sim.groupBy("doc_id").agg(
        F.max_by(F.struct("topic", "sim"), F.struct(F.col("sim"), -F.col("topic"))).alias("_b"))
    per = out.join(best, "doc_id", "left").select(
        "doc_id", F.col("_b.topic").alias("best_topic"), F.coalesce(F.col("_b.sim"), F.lit(0.0)).alias("best_sim"))
    per = per.withColumn("new_topic", F.when(F.col("best_sim") >= threshold, F.col("best_topic")).otherwise(-1)
                         .cast("int"))
    per = cut_lineage(per, "reassigned")  # the new assignment reads it too
    new = (assign.join(per.select("doc_id", "new_topic"), "doc_id", "left")
           .select("doc_id", F.when(F.col("topic") == -1, F.coalesce("new_topic", F.lit(-1)))
                   .otherwise(F.col("topic")).cast("int").alias("topic")))
    return per, new


def rule_label(words_joined: Column, rules=None) -> Column:
    """First rule (list order) with any keyword as a substring of the
    lower-cased word string; otherwise null (caller supplies the default)."""
    rules = SEMANTIC_RULES if rules is None else rules
    s = F.lower(words_joined)
    out = None
    for kws, label in rules:
        cond = F.lit(False)
        for kw in kws:
            cond = cond | F.contains(s, F.lit(kw))
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def default_label(words: Column) -> Column:
    """First three words, '/' -> ' ', stripped, title-cased, joined by ' & '."""
    return F.array_join(F.transform(F.slice(words, 1, 3),
                                    lambda w: F.initcap(F.trim(F.regexp_replace(w, "/", " ")))), " & ")


def topic_labels(words: DataFrame, rules=None, max_len: int = 55) -> DataFrame:
    """T11 + T13 + T18: (topic, words array, raw_label, label)."""
    agg = (words.groupBy("topic")
           .agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("_ws"))
           .select("topic", F.transform("_ws", lambda x: x["term"]).alias("words")))
    lab = F.coalesce(rule_label(F.array_join("words", " "), rules), default_label(F.col("words")))
    lab = T.shorten(lab, max_len)
    return agg.select("topic", "words", F.array_join(F.slice("words", 1, 3), " / ").alias("raw_label"),
                      lab.alias("label"))


def dedup_labels(labels: DataFrame) -> DataFrame:
    """For labels shared by more than one topic append ' (Word)' with the
    first of the top 6 words whose first token is not in the label, else
    ' (T{id})'. New clashes are not re-checked."""
    cnt = F.count(F.lit(1)).over(Window.partitionBy("label"))
    cand = F.filter(F.transform(F.slice("words", 1, 6), lambda w: F.initcap(F.split(w, " ")[0])),
                    lambda w: ~F.contains(F.lower(F.col("label")), F.lower(w)))
    new = F.when(cnt > 1, F.concat(F.col("label"), F.lit(" ("),
                                   F.coalesce(F.element_at(cand, 1),
                                              F.concat(F.lit("T"), F.col("topic").cast("string"))),
                                   F.lit(")"))).otherwise(F.col("label"))
    return labels.withColumn("dedup_label", new)


def label_lookup(ids: DataFrame, labels: DataFrame, id_col: str = "topic") -> DataFrame:
    """Label per id with default ``Topic {id}`` (labels broadcast: one row per topic)."""
    return ids.join(F.broadcast(labels.select(id_col, "label")), id_col, "left").withColumn(
        "label", F.coalesce("label", F.concat(F.lit("Topic "), F.col(id_col).cast("string"))))


def predict_best(queries: DataFrame, words: DataFrame) -> DataFrame:
    """J3 + argmax: (query_id, vocab array) against the topic words; a topic's
    score is the sum of its word scores found in the query vocabulary. Best
    topic = highest score, lowest id on ties; a query without any hit gets
    the lowest topic id with score 0 (every topic scores 0). Only hits are
    joined (broadcast topic words: n_words per topic), no query x topic grid."""
    # a query's words that are no topic word are dropped in its array, before any row is made of them
    wanted = words.agg(F.collect_set("term").alias("_wanted"))  # n_words per topic
    qv = queries.crossJoin(F.broadcast(wanted)).select("query_id", F.explode(F.array_intersect("vocab", "_wanted")).alias("term"))
    hits = qv.join(F.broadcast(words.select("topic", "term", "score")), "term") \
        .groupBy("query_id", "topic").agg(F.sum("score").alias("score"))
    best = hits.groupBy("query_id").agg(
        F.max_by(F.struct("topic", "score"), F.struct(F.col("score"), -F.col("topic"))).alias("_b"))
    first = words.agg(F.min("topic").alias("_t0"))
    return (queries.select("query_id").join(best, "query_id", "left").crossJoin(F.broadcast(first))
            .select("query_id", F.coalesce(F.col("_b.topic"), F.col("_t0")).alias("best_topic"),
                    F.coalesce(F.col("_b.score"), F.lit(0.0)).alias("best_score")))


def query_vocab_col(text_col: str) -> Column:
    tok = T.tokens(T.clean_alnum(text_col))
    return T.query_vocab(tok)
