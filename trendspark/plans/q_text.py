"""Text queries over whole documents (map-only plans, no shuffle)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from trendspark.functions import text as T
from trendspark.functions.stopwords import all_stops, sql_list
from trendspark.operators import keywords, ordering, textops
from trendspark.plans import sqlfrag as S
from trendspark.plans.registry import register
from trendspark.plans.views import ARTICLES_CTE, articles, with_ctes
from trendspark.rules import HEALTHCARE_SIGNALS
from trendspark.sources.tables import table

# Edge rows carried over from the reference's unit cases (FIXTURES 2):
# null, empty, digits only, non-breaking space, specials, padding, mixed.
EDGE_ROWS = [
    (-1, None), (-2, ""), (-3, "12345"), (-4, "hello world"),
    (-5, "it's a test! @#$%"), (-6, "  HELLO   World  "), (-7, "COVID-19 pandemic 2020"),
    (-8, "Year 2020!"),
]
EDGE_SQL = ("SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES "
            + ", ".join(f"({i}, {'NULL' if t is None else chr(39) + t.replace(chr(39), chr(39) * 2) + chr(39)})"
                        for i, t in EDGE_ROWS)
            + ") v(doc_id, text)")


def docs_with_edges(spark, sf_dir):
    edge = spark.createDataFrame(EDGE_ROWS, Ty.StructType([
        Ty.StructField("doc_id", Ty.LongType()), Ty.StructField("text", Ty.StringType())]))
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(edge)


@register("clean_alpha", f"SELECT doc_id, {S.clean_alpha('text')} AS clean_text FROM ({EDGE_SQL})")
def clean_alpha(spark, sf_dir):
    """T1 over every document plus the edge rows."""
    return docs_with_edges(spark, sf_dir).select("doc_id", T.clean_alpha("text").alias("clean_text"))


@register("clean_alnum", f"SELECT doc_id, {S.clean_alnum('text')} AS clean_text FROM ({EDGE_SQL})")
def clean_alnum(spark, sf_dir):
    """T2 over every document plus the edge rows."""
    return docs_with_edges(spark, sf_dir).select("doc_id", T.clean_alnum("text").alias("clean_text"))


@register("text_richness", f"""
WITH c AS (SELECT doc_id, {S.tokens(S.clean_alnum('text'))} AS t, {S.raw_word_count('text')} AS raw_words
           FROM ({EDGE_SQL}))
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct,
       CAST(raw_words AS INTEGER) AS raw_words, round({S.richness('t')}, 6) AS text_richness FROM c""")
def text_richness(spark, sf_dir):
    """T3 + T4 + T5."""
    d = docs_with_edges(spark, sf_dir).select(
        "doc_id", T.tokens(T.clean_alnum("text")).alias("t"), T.raw_word_count("text").alias("raw_words"))
    return d.select("doc_id", F.size("t").cast("int").alias("n_tokens"),
                    F.size(F.array_distinct("t")).cast("int").alias("n_distinct"),
                    F.col("raw_words").cast("int").alias("raw_words"),
                    F.round(T.richness("t"), 6).alias("text_richness"))


@register("query_vocabulary", f"""
WITH c AS (SELECT doc_id, {S.tokens(S.clean_alnum('text'))} AS t FROM ({EDGE_SQL})),
v AS (SELECT doc_id, t, {S.bigrams('t')} AS bi FROM c)
SELECT doc_id, CAST(len(bi) AS INTEGER) AS n_bigrams,
       CAST(len(list_distinct(list_concat(t, bi))) AS INTEGER) AS vocab_size,
       array_to_string(list_sort(list_distinct(list_concat(t, bi))), '|') AS vocab
FROM v""")
def query_vocabulary(spark, sf_dir):
    """T6 + T7 + U2: tokens united with adjacent bigrams, as a sorted set."""
    d = docs_with_edges(spark, sf_dir).select("doc_id", T.tokens(T.clean_alnum("text")).alias("t"))
    # pairs and set are made once; sort_array compares strings itself, array_sort calls a lambda for each comparison
    d = d.select("doc_id", T.once("t", lambda t: T.once(T.bigrams(t), lambda b: F.struct(
        F.size(b).alias("n"), F.sort_array(F.array_union(F.array_distinct(t), b)).alias("vocab")))).alias("v"))
    return d.select("doc_id", F.col("v.n").cast("int").alias("n_bigrams"),
                    F.size("v.vocab").cast("int").alias("vocab_size"),
                    F.array_join("v.vocab", "|").alias("vocab"))


_STOPS_SQL = sql_list(all_stops())


@register("stopword_filter", f"""
WITH c AS (SELECT doc_id, {S.tokens(S.clean_alnum('text'))} AS t FROM ({EDGE_SQL})),
k AS (SELECT doc_id, t, {S.stop_filter('t', _STOPS_SQL)} AS kept FROM c)
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(kept) AS INTEGER) AS n_kept,
       array_to_string(kept, ' ') AS kept_text FROM k""")
def stopword_filter(spark, sf_dir):
    """T8 + U1: the united stop list removed from whole token lists."""
    d = docs_with_edges(spark, sf_dir).select("doc_id", T.tokens(T.clean_alnum("text")).alias("t"))
    d = textops.remove_stops(d, "t", "kept")
    return d.select("doc_id", F.size("t").cast("int").alias("n_tokens"),
                    F.size("kept").cast("int").alias("n_kept"),
                    F.array_join("kept", " ").alias("kept_text"))


@register("vectoriser_tokens", f"""
WITH c AS (SELECT doc_id, regexp_extract_all({S.clean_alnum('text')}, '\\b\\w\\w+\\b') AS wt FROM documents),
k AS (SELECT doc_id, {S.stop_filter('wt', _STOPS_SQL)} AS kept FROM c),
g AS (SELECT doc_id, list_concat(kept, {S.bigrams('kept')}) AS terms FROM k)
SELECT doc_id, CAST(len(terms) AS INTEGER) AS n_terms, array_to_string(terms, '|') AS terms FROM g""")
def vectoriser_tokens(spark, sf_dir):
    """T9 on all documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.clean_alnum("text").alias("clean"))
    d = textops.vectorizer_terms(d, "clean", "terms")
    return d.select("doc_id", F.size("terms").cast("int").alias("n_terms"),
                    F.array_join("terms", "|").alias("terms"))


# The reference's signal set never occurs in the invented prose; the query
# passes it extended by four frequent corpus words so both branches occur.
SIGNAL_WORDS = HEALTHCARE_SIGNALS + ["the", "les", "und", "que"]


@register("signal_word_test", f"""
WITH c AS (SELECT doc_id, {S.tokens(S.clean_alnum('text'))} AS t FROM ({EDGE_SQL}))
SELECT doc_id, len(list_intersect(t, {sql_list(SIGNAL_WORDS)})) > 0 AS has_signal,
       array_to_string(list_sort(list_distinct(list_intersect(t, {sql_list(SIGNAL_WORDS)}))), ' ') AS matched
FROM c""")
def signal_word_test(spark, sf_dir):
    """T10 + U3."""
    d = docs_with_edges(spark, sf_dir).select("doc_id", T.tokens(T.clean_alnum("text")).alias("t"))
    sig = F.array(*[F.lit(w) for w in SIGNAL_WORDS])
    return d.select("doc_id", F.arrays_overlap("t", sig).alias("has_signal"),
                    F.array_join(F.array_sort(F.array_intersect("t", sig)), " ").alias("matched"))


@register("leave_one_out", f"""
WITH c AS (SELECT doc_id, {S.tokens(S.clean_alnum('text'))} AS t FROM documents),
l AS (SELECT doc_id, t, CAST(len(array_to_string(t, ' ')) AS INTEGER) AS total_chars,
             CAST(len(t) AS INTEGER) AS n FROM c),
e AS (SELECT doc_id, n, total_chars, unnest(range(0, len(t))) AS pos, unnest(t) AS token FROM l)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, token, n - 1 AS variant_tokens,
       CAST(total_chars - length(token) - CASE WHEN n > 1 THEN 1 ELSE 0 END AS INTEGER) AS variant_chars
FROM e""")
def leave_one_out(spark, sf_dir):
    """One row per removed token over whole documents. The variant text
    itself is never materialised (it would be quadratic in document length);
    each variant is identified by (doc_id, pos) and described in closed form."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.tokens(T.clean_alnum("text")).alias("t"))
    d = d.select("doc_id", "t", F.length(F.array_join("t", " ")).cast("int").alias("total_chars"),
                 F.size("t").cast("int").alias("n"))
    e = d.select("doc_id", "n", "total_chars", F.posexplode("t").alias("pos", "token"))
    return e.select("doc_id", F.col("pos").cast("int").alias("pos"), "token",
                    (F.col("n") - 1).cast("int").alias("variant_tokens"),
                    (F.col("total_chars") - F.length("token")
                     - F.when(F.col("n") > 1, 1).otherwise(0)).cast("int").alias("variant_chars"))


N_KEYWORDS = 2000


@register("keyword_rules", with_ctes(ARTICLES_CTE) + f""",
w AS (SELECT unnest({S.tokens(S.clean_alnum('text'))}) AS word FROM articles),
k AS (SELECT word AS keyword, count(*) AS n FROM w WHERE length(word) >= 6 GROUP BY 1),
r AS (SELECT keyword, CAST(row_number() OVER (ORDER BY n, keyword) AS INTEGER) AS rule_idx FROM k QUALIFY rule_idx <= {N_KEYWORDS}),
m AS (SELECT a.doc_id, r.rule_idx, r.keyword FROM articles a JOIN r ON contains(lower(a.text), r.keyword))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_rules, min(rule_idx) AS first_rule, first(keyword ORDER BY rule_idx) AS first_keyword
FROM m GROUP BY doc_id""")
def keyword_rules(spark, sf_dir):
    """T11 + J5 for a large rule table: the N_KEYWORDS rarest words of six letters or more as rules
    (in that order), found as substrings of every article by one automaton; per article the rules that
    match and the first of them."""
    a = articles(spark, sf_dir).select("doc_id", "text")
    words = a.select(F.explode(T.tokens(T.clean_alnum("text"))).alias("keyword")).where(F.length("keyword") >= 6)
    top = words.groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "keyword").limit(N_KEYWORDS)
    rules = ordering.global_rank(top, ["n", "keyword"]).select(F.col("rank").cast("int").alias("rule_idx"), "keyword")
    m = keywords.matched_rules(a, ["doc_id"], F.col("text"), rules)
    return m.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rules"), F.min("rule_idx").alias("first_rule"),
                                   F.min_by("keyword", "rule_idx").alias("first_keyword"))
