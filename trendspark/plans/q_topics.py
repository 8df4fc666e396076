"""Topic representation queries on topic_docs: class TF-IDF, PMI, outlier
reassignment, labels, catalogue, keyword search, seeded assignment and
prediction for new text (benchmark items as queries)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trendspark.functions import text as T
from trendspark.functions.stopwords import all_stops, sql_list
from trendspark.operators import bow, sampling
from trendspark.operators import topics as TP
from trendspark.plans import sqlfrag as S
from trendspark.plans.registry import register
from trendspark.plans.views import TOPIC_DOCS_CTE, topic_docs, with_ctes
from trendspark.rules import (HEALTHCARE_COHORT_BEFORE_YEAR, HEALTHCARE_COHORT_PATTERN, HEALTHCARE_SIGNALS,
                              LOW_CONFIDENCE_GATE, OUTLIER_REASSIGN_THRESHOLD, SEMANTIC_RULES)
from trendspark.session import cut_lineage, on_drop, versions
from trendspark.sources.tables import table

COUNTED_BYTES = 8 << 20  # of the input, whose terms one task counts

ALL_STOPS_SQL = sql_list(all_stops())


class Fitted(dict):
    """The topic model of one input: initial assignment (a0) -> c-TF-IDF (ct0) -> outlier
    reassignment (per, a1) -> refreshed c-TF-IDF (ct1) -> top words (non-outlier topics).
    A part is computed when a query first asks for it and written to the shared folder."""

    def __init__(self, spark, sf_dir):
        super().__init__(td=topic_docs(spark, sf_dir).select("doc_id", "text", "topic", "year"))
        self["a0"] = self["td"].select("doc_id", "topic")
        self.spark, self.sf_dir = spark, sf_dir
        size = sum(int(f.split()[-2]) for f in versions(spark, f"{sf_dir.rstrip('/')}/documents.parquet"))
        # the terms counted by a task fit its memory, however many bytes a scan gives it
        self.tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // COUNTED_BYTES)

    def __missing__(self, part):
        if part in ("per", "a1"):
            out = self["outliers"].repartition(self.tasks, "doc_id").select("doc_id", F.explode("again"), "terms")
            tc = TP.listed_terms(out).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
            per, a1 = TP.reassign_counted(tc, self["a0"], self["ct0"], OUTLIER_REASSIGN_THRESHOLD)
            self["per"], self["a1"] = per, cut_lineage(a1, "topics-a1")
        else:
            self[part] = getattr(self, f"_{part}")()
        return self[part]

    def _terms(self):
        return TP.listed_terms(TP.doc_term_lists(self["td"]))

    def _lists(self):
        """(doc_id, topics, terms) of all articles; ``topics``: all that the identifier has, more than one if it repeats."""
        topics = self["a0"].groupBy("doc_id").agg(F.collect_list("topic").alias("topics"))
        rows = table(self.spark, self.sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
        texts = table(self.spark, self.sf_dir, "documents").select("doc_id", "text").repartition(self.tasks, "doc_id")
        return TP.doc_term_lists(texts.join(rows, "doc_id", "left").join(topics, "doc_id"), keep=("topics",))

    def _outliers(self):
        """The lists of articles with an outlier row; ``again`` has an entry a such row."""
        again = F.filter("topics", lambda t: t == -1)
        return cut_lineage(self["lists"].where(F.array_contains("topics", -1)).withColumn("again", again), "topics-outliers")

    def _classes(self):
        return sorted(r["topic"] for r in self["a0"].where("topic is not null").select("topic").distinct().collect())

    def _counts0(self):
        """Of all terms, those in two classes or more and all those of outliers, whose classes may change."""
        rows = self["lists"].select(F.explode("topics").alias("topic"), "terms").select(
            "topic", F.explode_outer("terms").alias("term"), F.lit(1).alias("n")).where(F.col("term").isNotNull())
        by = TP.counts_by_term(rows, self["classes"])
        return cut_lineage(by.where((F.size("by") >= TP.CTFIDF_MIN_DF) | F.exists("by", lambda c: c["topic"] == -1)), "topics-counts0")

    def _counts1(self):
        """``counts0``, less what the terms of moved outliers had, plus what they have now. A row of the new
        assignment stands for each pair of an identifier's rows before and of its rows in ``per``."""
        old = self["counts0"].select("term", F.inline("by")).select("term", "topic", F.col("tf").alias("n"))
        new = self["per"].groupBy("doc_id").agg(F.first("new_topic").alias("new_topic"))
        moved = self["outliers"].join(new, "doc_id").where((F.col("new_topic") != -1) | (F.size("again") > 1))
        one = lambda t, n: F.struct(t.alias("topic"), n.cast("long").alias("n"))
        to = F.transform("topics", lambda t: one(F.when(t == -1, F.col("new_topic")).otherwise(t), F.size("again")))
        moved = moved.select("terms", F.concat(to, F.transform("topics", lambda t: one(t, F.lit(-1)))).alias("changes"))
        moved = moved.select("changes", F.explode("terms").alias("term")).select("term", F.inline("changes"))
        return cut_lineage(TP.counts_by_term(old.unionByName(moved), self["classes"]), "topics-counts1")

    def _ct(self, counts, assign):
        # classes that hold a term: where none is among those written, the texts are asked
        held = {r[0] for r in self[counts].select(F.explode("by.topic")).distinct().collect()}
        k = len(held)
        if missing := [t for t in self["classes"] if t not in held]:
            of = self[assign].where(F.col("topic").isin(missing))
            k += TP.listed_terms(TP.doc_term_lists(self["td"].join(of.select("doc_id"), "doc_id", "left_semi"))).join(
                of, "doc_id").agg(F.countDistinct("topic")).first()[0]
        return TP.weighted_terms(cut_lineage(TP.kept_class_terms(self[counts], k), "topics-kept"))

    def _ct0(self):
        return self._ct("counts0", "a0")

    def _ct1(self):
        return self._ct("counts1", "a1")

    def _words(self):
        return cut_lineage(TP.top_words(self["ct1"].where(F.col("topic") != -1)), "topics-words")


_FITTED: dict[tuple, Fitted] = {}
on_drop(_FITTED.clear)


def pipeline(spark, sf_dir) -> Fitted:
    """The model of ``sf_dir``, fitted once per application and version of its tables; every
    query reads its written parts. A rewritten input has other files and is fitted anew; ``drop_scratch``
    forgets the models with their tables."""
    files = tuple(sorted(f for t in ("documents", "embeddings") for f in versions(spark, f"{sf_dir.rstrip('/')}/{t}.parquet")))
    key = (spark.sparkContext.applicationId, sf_dir, files)
    if key not in _FITTED:
        _FITTED[key] = Fitted(spark, sf_dir)
    return _FITTED[key]


# ----------------------------------------------------------------- SQL side

def _terms12(src: str, id_col: str = "doc_id") -> str:
    wt = f"regexp_extract_all({S.clean_alnum('text')}, '\\b\\w\\w+\\b')"
    return (f"SELECT doc_id, unnest(list_concat(kept, {S.bigrams('kept')})) AS term FROM "
            f"(SELECT {id_col} AS doc_id, {S.stop_filter(wt, ALL_STOPS_SQL)} AS kept FROM {src})")


def ctfidf_sql(p: str, assign: str) -> str:
    return f""",
{p}ctc AS (SELECT a.topic, t.term, count(*) AS tf FROM dterms t JOIN {assign} a ON a.doc_id = t.doc_id GROUP BY 1, 2),
{p}k AS (SELECT count(DISTINCT topic) AS k FROM {p}ctc),
{p}st AS (SELECT term, count(*) AS cdf, sum(tf) AS tf_t FROM {p}ctc GROUP BY term),
{p}kept AS (SELECT c.topic, c.term, c.tf, s.tf_t FROM {p}ctc c JOIN {p}st s ON s.term = c.term, {p}k
            WHERE s.cdf >= {TP.CTFIDF_MIN_DF} AND s.cdf <= floor({p}k.k * {TP.CTFIDF_MAX_DF})),
{p}tot AS (SELECT topic, sum(tf) AS tot FROM {p}kept GROUP BY topic),
{p}a AS (SELECT floor(avg(tot)) AS A FROM {p}tot),
{p}w AS (SELECT kp.topic, kp.term, kp.tf, kp.tf_t, t.tot, a.A,
                kp.tf * 1.0 / t.tot * ln(1 + a.A / kp.tf_t) AS w,
                ln((kp.tf * 1.0 / t.tot) * (a.A / kp.tf_t)) AS pmi
         FROM {p}kept kp JOIN {p}tot t ON t.topic = kp.topic, {p}a a)"""


BASE_SQL = with_ctes(TOPIC_DOCS_CTE) + f""",
dterms AS ({_terms12('topic_docs')}),
a0 AS (SELECT doc_id, topic FROM topic_docs)""" + ctfidf_sql("c0", "a0") + f""",
idf AS (SELECT DISTINCT term, ln(1 + A / tf_t) AS idf FROM c0w),
dv AS (SELECT o.doc_id, o.term, count(*) * i.idf AS x FROM dterms o JOIN a0 ON a0.doc_id = o.doc_id AND a0.topic = -1
       JOIN idf i ON i.term = o.term GROUP BY o.doc_id, o.term, i.idf),
dn AS (SELECT doc_id, sqrt(sum(x * x)) AS nx FROM dv GROUP BY doc_id),
tn AS (SELECT topic, sqrt(sum(w * w)) AS nw FROM c0w WHERE topic <> -1 GROUP BY topic),
sim AS (SELECT dv.doc_id, w.topic, sum(dv.x * w.w) / (dn.nx * tn.nw) AS sim
        FROM dv JOIN c0w w ON w.term = dv.term AND w.topic <> -1 JOIN dn ON dn.doc_id = dv.doc_id
        JOIN tn ON tn.topic = w.topic GROUP BY dv.doc_id, w.topic, dn.nx, tn.nw),
best AS (SELECT doc_id, first(topic ORDER BY sim DESC, topic) AS best_topic, max(sim) AS best_sim FROM sim GROUP BY doc_id),
per AS (SELECT a0.doc_id, b.best_topic, coalesce(b.best_sim, 0.0) AS best_sim,
               CAST(CASE WHEN coalesce(b.best_sim, 0.0) >= {OUTLIER_REASSIGN_THRESHOLD} THEN b.best_topic ELSE -1 END AS INTEGER) AS new_topic
        FROM a0 LEFT JOIN best b ON b.doc_id = a0.doc_id WHERE a0.topic = -1),
a1 AS (SELECT a0.doc_id, CAST(CASE WHEN a0.topic = -1 THEN coalesce(per.new_topic, -1) ELSE a0.topic END AS INTEGER) AS topic
       FROM a0 LEFT JOIN per ON per.doc_id = a0.doc_id)""" + ctfidf_sql("c1", "a1") + f""",
words AS (SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY w DESC, term) AS INTEGER) AS rank, term, w AS score
          FROM c1w WHERE topic <> -1 QUALIFY rank <= {TP.N_WORDS}),
wl AS (SELECT topic, list(term ORDER BY rank) AS words FROM words GROUP BY topic)"""


def _initcap_sql(e: str) -> str:
    return f"array_to_string(list_transform(string_split({e}, ' '), lambda x: upper(x[1:1]) || lower(x[2:])), ' ')"


def rule_label_sql(words_joined: str, rules) -> str:
    parts = []
    for kws, label in rules:
        cond = " OR ".join(f"contains(lower({words_joined}), '{k}')" for k in kws)
        parts.append(f"WHEN {cond} THEN '{label}'")
    return "CASE " + " ".join(parts) + " END"


def labels_sql(rules, name: str = "labs") -> str:
    default = ("array_to_string(list_transform(list_slice(words, 1, 3), lambda w: "
               + _initcap_sql("trim(replace(w, '/', ' '))") + "), ' & ')")
    lab = f"coalesce({rule_label_sql('array_to_string(words, ' + chr(39) + ' ' + chr(39) + ')', rules)}, {default})"
    return f""",
{name}0 AS (SELECT topic, words, array_to_string(list_slice(words, 1, 3), ' / ') AS raw_label, {lab} AS label FROM wl),
{name} AS (SELECT topic, words, raw_label,
                  CASE WHEN length(label) > 55 THEN substr(label, 1, 52) || '...' ELSE label END AS label FROM {name}0)"""


# ----------------------------------------------------------------- queries

@register("class_tfidf", BASE_SQL + f""",
iw AS (SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY w DESC, term) AS INTEGER) AS rank, term, w
       FROM c0w QUALIFY rank <= {TP.N_WORDS})
SELECT topic, rank, term, round(w, 6) AS score,
       round(CASE WHEN rank <= 8 THEN w / sum(CASE WHEN rank <= 8 THEN w END) OVER (PARTITION BY topic) END, 6) AS share8
FROM iw""")
def class_tfidf(spark, sf_dir):
    """V16 + K4: top 10 c-TF-IDF terms per class of the initial assignment
    (the outlier class included, as a class of its own); ``share8`` is the
    8-word form rescaled to sum 1."""
    p = pipeline(spark, sf_dir)
    w = TP.top_words(p["ct0"])
    top8 = F.sum(F.when(F.col("rank") <= 8, F.col("score"))).over(Window.partitionBy("topic"))
    return w.select("topic", "rank", "term", F.round("score", 6).alias("score"),
                    F.round(F.when(F.col("rank") <= 8, F.col("score") / top8), 6).alias("share8"))


@register("term_pmi", BASE_SQL + """,
ip AS (SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY pmi DESC, term) AS INTEGER) AS rank, term, pmi
       FROM c0w QUALIFY rank <= 10)
SELECT topic, rank, term, round(pmi, 6) AS pmi FROM ip""")
def term_pmi(spark, sf_dir):
    """Pointwise mutual information of term and class, top 10 per class."""
    p = pipeline(spark, sf_dir)
    w = TP.top_words(p["ct0"], 10, "pmi")
    return w.select("topic", "rank", "term", F.round("score", 6).alias("pmi"))


@register("outlier_reassign", BASE_SQL + """
SELECT doc_id, best_topic, round(best_sim, 6) AS best_sim, new_topic FROM per""")
def outlier_reassign(spark, sf_dir):
    """Best c-TF-IDF topic per outlier; reassigned when cosine >= 0.1."""
    p = pipeline(spark, sf_dir)
    return p["per"].select("doc_id", "best_topic", F.round("best_sim", 6).alias("best_sim"), "new_topic")


@register("rule_labels", BASE_SQL + labels_sql(SEMANTIC_RULES) + """
SELECT topic, raw_label, label FROM labs""")
def rule_labels(spark, sf_dir):
    """T11 + T13 + T18 on the refreshed topic words."""
    p = pipeline(spark, sf_dir)
    return TP.topic_labels(p["words"]).select("topic", "raw_label", "label")


# A rule that most invented word lists satisfy, so that several topics share
# a label and the de-duplication runs (a parameter of this query).
DEDUP_RULES = SEMANTIC_RULES + [(["an", "en", "er"], "Common Label")]


@register("label_dedup", BASE_SQL + labels_sql(DEDUP_RULES) + """,
cnt AS (SELECT label, count(*) AS c FROM labs GROUP BY label),
dd AS (SELECT l.topic, l.label, CASE WHEN c.c > 1 THEN l.label || ' (' || coalesce(
          list_filter(list_transform(list_slice(l.words, 1, 6), lambda w: """ + _initcap_sql("string_split(w, ' ')[1]") + """),
                      lambda w: NOT contains(lower(l.label), lower(w)))[1], 'T' || CAST(l.topic AS VARCHAR)) || ')'
          ELSE l.label END AS dedup_label FROM labs l JOIN cnt c ON c.label = l.label),
ids AS (SELECT DISTINCT topic FROM a1)
SELECT ids.topic, coalesce(dd.label, 'Topic ' || CAST(ids.topic AS VARCHAR)) AS label,
       coalesce(dd.dedup_label, 'Topic ' || CAST(ids.topic AS VARCHAR)) AS dedup_label
FROM ids LEFT JOIN dd ON dd.topic = ids.topic""")
def label_dedup(spark, sf_dir):
    """T12 + J2: de-duplicated labels looked up for every assigned topic id
    (the outlier id has none and gets ``Topic -1``)."""
    p = pipeline(spark, sf_dir)
    labs = TP.dedup_labels(TP.topic_labels(p["words"], DEDUP_RULES))
    ids = p["a1"].select("topic").distinct()
    j = ids.join(F.broadcast(labs.select("topic", "label", "dedup_label")), "topic", "left")
    dflt = F.concat(F.lit("Topic "), F.col("topic").cast("string"))
    return j.select("topic", F.coalesce("label", dflt).alias("label"),
                    F.coalesce("dedup_label", dflt).alias("dedup_label"))


@register("search_terms", BASE_SQL + labels_sql(SEMANTIC_RULES) + """,
ty AS (SELECT a1.topic, td.year, count(*) AS n FROM a1 JOIN topic_docs td ON td.doc_id = a1.doc_id
       WHERE a1.topic <> -1 GROUP BY 1, 2),
pk AS (SELECT topic, first(year ORDER BY n DESC, year) AS peak_year FROM ty GROUP BY topic)
SELECT l.topic, coalesce(nullif(array_to_string(list_slice(list_filter(list_transform(
           list_slice(l.words, 1, 3), lambda w: string_split(trim(w), ' ')[1]), lambda w: length(w) > 3), 1, 2), ' '), ''),
           trim(string_split(l.raw_label, '/')[1])) AS query_terms,
       CAST(pk.peak_year AS INTEGER) AS peak_year,
       CAST(greatest(2017, pk.peak_year - 1) AS INTEGER) AS start_year,
       CAST(least(2023, pk.peak_year + 1) AS INTEGER) AS end_year
FROM labs l JOIN pk ON pk.topic = l.topic""")
def search_terms(spark, sf_dir):
    """T14 + D7: search terms from the top 3 words and the clamped query range
    around the topic's busiest year."""
    from trendspark.operators.events import query_terms
    p = pipeline(spark, sf_dir)
    labs = TP.topic_labels(p["words"])
    ty = (p["a1"].where(F.col("topic") != -1).join(p["td"].select("doc_id", "year"), "doc_id")
          .groupBy("topic", "year").agg(F.count(F.lit(1)).alias("n")))
    pk = ty.groupBy("topic").agg(F.max_by("year", F.struct(F.col("n"), -F.col("year"))).alias("peak_year"))
    j = labs.join(pk, "topic")
    return j.select("topic", query_terms(F.array_join(F.slice("words", 1, 3), " / ")).alias("query_terms"),
                    F.col("peak_year").cast("int"),
                    F.greatest(F.lit(2017), F.col("peak_year") - 1).cast("int").alias("start_year"),
                    F.least(F.lit(2023), F.col("peak_year") + 1).cast("int").alias("end_year"))


@register("topic_catalogue", BASE_SQL + labels_sql(SEMANTIC_RULES) + """,
sz AS (SELECT a1.topic, count(*) AS n, min(td.year) AS y0, max(td.year) AS y1
       FROM a1 JOIN topic_docs td ON td.doc_id = a1.doc_id WHERE a1.topic <> -1 GROUP BY 1),
ws AS (SELECT topic, string_agg(term || ':' || CAST(round(score, 6) AS VARCHAR), '|' ORDER BY rank) AS top_words
       FROM words GROUP BY topic)
SELECT sz.topic, l.label AS name, ws.top_words, CAST(sz.n AS BIGINT) AS n,
       CAST(sz.y0 AS INTEGER) AS first_year, CAST(sz.y1 AS INTEGER) AS last_year
FROM sz JOIN labs l ON l.topic = sz.topic JOIN ws ON ws.topic = sz.topic ORDER BY n DESC, topic""")
def topic_catalogue(spark, sf_dir):
    """V42 + A14: id, name, ten scored words, size and year range, by size."""
    p = pipeline(spark, sf_dir)
    labs = TP.topic_labels(p["words"])
    sz = (p["a1"].where(F.col("topic") != -1).join(p["td"].select("doc_id", "year"), "doc_id")
          .groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.min("year").alias("y0"), F.max("year").alias("y1")))
    ws = p["words"].groupBy("topic").agg(F.sort_array(F.collect_list(
        F.struct("rank", F.concat("term", F.lit(":"), F.round("score", 6).cast("string")).alias("s")))).alias("_l"))
    ws = ws.select("topic", F.array_join(F.transform("_l", lambda x: x["s"]), "|").alias("top_words"))
    return (sz.join(labs, "topic").join(ws, "topic")
            .select("topic", F.col("label").alias("name"), "top_words", F.col("n").cast("long").alias("n"),
                    F.col("y0").cast("int").alias("first_year"), F.col("y1").cast("int").alias("last_year"))
            .orderBy(F.desc("n"), "topic"))


KEYWORD_CUT_YEAR = 2017


@register("keyword_topic_years", BASE_SQL + f""",
kw AS (SELECT term FROM words WHERE rank = 1 ORDER BY topic LIMIT 1),
hit AS (SELECT min(topic) AS topic FROM words WHERE rank <= 10 AND term = (SELECT term FROM kw)),
yd AS (SELECT td.year, count(*) AS n FROM a1 JOIN topic_docs td ON td.doc_id = a1.doc_id
       WHERE a1.topic = (SELECT topic FROM hit) GROUP BY td.year)
SELECT (SELECT topic FROM hit) AS topic, CAST(year AS INTEGER) AS year, CAST(n AS BIGINT) AS n,
       CAST(sum(CASE WHEN year < {KEYWORD_CUT_YEAR} THEN n ELSE 0 END) OVER () AS BIGINT) AS n_before_cut FROM yd""")
def keyword_topic_years(spark, sf_dir):
    """V41 + A28: the first topic (by id) holding the keyword among its top 10
    words, its year distribution and its count before the cut year. The
    keyword is the best word of the lowest topic id (taken from the data)."""
    p = pipeline(spark, sf_dir)
    w = p["words"]
    kw = w.where(F.col("rank") == 1).orderBy("topic").limit(1).select(F.col("term").alias("kw"))
    hit = w.where(F.col("rank") <= 10).join(F.broadcast(kw), F.col("term") == F.col("kw")).agg(
        F.min("topic").alias("hit_topic"))
    yd = (p["a1"].join(F.broadcast(hit), F.col("topic") == F.col("hit_topic"))
          .join(p["td"].select("doc_id", "year"), "doc_id").groupBy("hit_topic", "year")
          .agg(F.count(F.lit(1)).alias("n")))
    return yd.select(F.col("hit_topic").alias("topic"), F.col("year").cast("int"), F.col("n").cast("long"),
                     F.sum(F.when(F.col("year") < KEYWORD_CUT_YEAR, F.col("n")).otherwise(0))
                     .over(Window.partitionBy("hit_topic")).cast("long").alias("n_before_cut"))


SEED_M = 5


@register("seeded_assignment", BASE_SQL + f""",
seeds AS (SELECT topic, term, score FROM words WHERE rank <= {SEED_M}),
sdv AS (SELECT DISTINCT doc_id, term FROM dterms),
sc AS (SELECT sdv.doc_id, s.topic, sum(s.score) AS score FROM sdv JOIN seeds s ON s.term = sdv.term GROUP BY 1, 2),
b AS (SELECT doc_id, first(topic ORDER BY score DESC, topic) AS seed_topic, max(score) AS seed_score FROM sc GROUP BY doc_id)
SELECT td.doc_id, CAST(coalesce(b.seed_topic, -1) AS INTEGER) AS seed_topic, round(coalesce(b.seed_score, 0), 6) AS seed_score
FROM topic_docs td LEFT JOIN b ON b.doc_id = td.doc_id""")
def seeded_assignment(spark, sf_dir):
    """Seed lists = top 5 words of each topic; each document goes to the
    topic whose seed words it holds with the highest summed weight (-1 if none)."""
    p = pipeline(spark, sf_dir)
    seeds = p["words"].where(F.col("rank") <= SEED_M).select("topic", "term", "score")
    # only the seeds' terms are told apart by document
    dv = p["terms"].join(F.broadcast(seeds.select("term").distinct()), "term", "left_semi").select("doc_id", "term").distinct()
    sc = dv.join(F.broadcast(seeds), "term").groupBy("doc_id", "topic").agg(F.sum("score").alias("score"))
    b = sc.groupBy("doc_id").agg(F.max_by(F.struct("topic", "score"),
                                          F.struct(F.col("score"), -F.col("topic"))).alias("_b"))
    return (p["td"].select("doc_id").join(b, "doc_id", "left")
            .select("doc_id", F.coalesce(F.col("_b.topic"), F.lit(-1)).cast("int").alias("seed_topic"),
                    F.round(F.coalesce(F.col("_b.score"), F.lit(0.0)), 6).alias("seed_score")))


FALLBACK_MEMBERS = 30  # the reference's sample of members per topic

PREDICT_SQL = BASE_SQL + f""",
q AS (SELECT item_id AS query_id, {S.tokens(S.clean_alnum('text'))} AS t FROM benchmark),
qv AS (SELECT query_id, t, list_distinct(list_concat(t, {S.bigrams('t')})) AS vocab FROM q),
qt AS (SELECT DISTINCT query_id, unnest(vocab) AS term FROM qv),
hits AS (SELECT qt.query_id, w.topic, sum(w.score) AS score FROM qt JOIN words w ON w.term = qt.term GROUP BY 1, 2),
hb AS (SELECT query_id, first(topic ORDER BY score DESC, topic) AS bt, max(score) AS bs FROM hits GROUP BY query_id),
pb AS (SELECT qv.query_id, qv.t, coalesce(hb.bt, (SELECT min(topic) FROM words)) AS best_topic,
              coalesce(hb.bs, 0.0) AS best_score FROM qv LEFT JOIN hb ON hb.query_id = qv.query_id),
coh AS (SELECT a1.topic, count(*) AS n FROM a1 JOIN topic_docs td ON td.doc_id = a1.doc_id
        WHERE td.year < {HEALTHCARE_COHORT_BEFORE_YEAR} AND regexp_matches({S.clean_alnum('td.text')}, '{HEALTHCARE_COHORT_PATTERN}')
          AND a1.topic <> -1 GROUP BY 1),
cm AS (SELECT first(topic ORDER BY n DESC, topic) AS ct FROM coh),
pred AS (SELECT pb.query_id,
                CASE WHEN best_score > 0 THEN 'keyword'
                     WHEN len(list_intersect(t, {sql_list(HEALTHCARE_SIGNALS)})) > 0 AND (SELECT ct FROM cm) IS NOT NULL THEN 'cohort'
                     ELSE 'similarity' END AS method,
                best_topic, best_score FROM pb),
smp AS (SELECT doc_id, topic, row_number() OVER (PARTITION BY topic ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rk
        FROM a1 WHERE topic <> -1 QUALIFY rk <= {FALLBACK_MEMBERS}),
mtf AS (SELECT s.topic, t.doc_id, t.term, count(*) AS tf FROM dterms t JOIN smp s ON s.doc_id = t.doc_id GROUP BY 1, 2, 3),
mu AS (SELECT topic, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)) AS u FROM mtf),
ms AS (SELECT mu.topic, term, sum(u) / n AS s FROM mu JOIN (SELECT topic, count(*) AS n FROM smp GROUP BY 1) mn
       ON mn.topic = mu.topic GROUP BY mu.topic, term, n),
btf AS (SELECT doc_id AS query_id, term, count(*) AS tf FROM ({_terms12('benchmark', 'item_id')}) GROUP BY 1, 2),
bu AS (SELECT query_id, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY query_id)) AS u FROM btf),
fsim AS (SELECT query_id, topic, round(sum(u * s), 9) AS sim FROM bu JOIN ms ON ms.term = bu.term GROUP BY 1, 2),
fb AS (SELECT query_id, first(topic ORDER BY sim DESC, topic) AS ft, max(sim) AS fs FROM fsim GROUP BY 1),
chosen AS (SELECT p.query_id, method,
                  CASE WHEN method = 'keyword' THEN best_topic WHEN method = 'cohort' THEN (SELECT ct FROM cm)
                       ELSE coalesce(ft, (SELECT min(topic) FROM words)) END AS topic,
                  CASE WHEN method = 'keyword' THEN best_score WHEN method = 'cohort' THEN 0.5 ELSE coalesce(fs, 0.0) END AS score
           FROM pred p LEFT JOIN fb ON fb.query_id = p.query_id)
"""


def predict_df(spark, sf_dir):
    p = pipeline(spark, sf_dir)
    b = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), T.tokens(T.clean_alnum("text")).alias("t"))
    q = b.withColumn("vocab", T.query_vocab("t"))
    pb = TP.predict_best(q, p["words"]).join(q.select("query_id", "t"), "query_id")
    td = p["td"]
    coh = (p["a1"].join(td.where((F.col("year") < HEALTHCARE_COHORT_BEFORE_YEAR)
                                 & T.clean_alnum("text").rlike(HEALTHCARE_COHORT_PATTERN))
                        .select("doc_id"), "doc_id")
           .where(F.col("topic") != -1).groupBy("topic").agg(F.count(F.lit(1)).alias("n")))
    cm = coh.agg(F.max_by("topic", F.struct(F.col("n"), -F.col("topic"))).alias("cohort_topic"))
    sig = F.arrays_overlap("t", F.array(*[F.lit(w) for w in HEALTHCARE_SIGNALS]))
    j = pb.crossJoin(F.broadcast(cm))
    method = (F.when(F.col("best_score") > 0, "keyword")
              .when(sig & F.col("cohort_topic").isNotNull(), "cohort").otherwise("similarity"))
    j = j.withColumn("method", method).join(member_similarity(p, b_text(spark, sf_dir)), "query_id", "left")
    first = p["words"].agg(F.min("topic").alias("first_topic"))
    m = F.col("method")
    return j.crossJoin(F.broadcast(first)).select(
        "query_id", "method",
        F.when(m == "keyword", F.col("best_topic")).when(m == "cohort", F.col("cohort_topic"))
        .otherwise(F.coalesce("sim_topic", "first_topic")).cast("int").alias("topic"),
        F.when(m == "keyword", F.col("best_score")).when(m == "cohort", 0.5)
        .otherwise(F.coalesce("sim", F.lit(0.0))).alias("score"))


def b_text(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def topic_similarity(p, queries):
    """V39 in closed form on bag-of-words vectors: (query_id, topic, sim), the mean cosine of a
    query to at most 30 seeded members of each topic = its unit vector times the mean of the
    members' unit vectors. Only pairs that share a term occur; a topic's mean has at most
    30 documents' terms."""
    members = sampling.balanced_sample(p["a1"].where(F.col("topic") != -1).select("doc_id", "topic"),
                                       "topic", "doc_id", FALLBACK_MEMBERS, 42)
    size = members.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    mean = (bow.unit_rows(bow.term_counts(p["terms"].join(members.select("doc_id"), "doc_id", "left_semi")))
            .join(members, "doc_id").groupBy("topic", "term").agg(F.sum("u").alias("s"))
            .join(F.broadcast(size), "topic").select("topic", "term", (F.col("s") / F.col("n")).alias("s")))
    q = bow.unit_rows(bow.term_counts(TP.doc_terms_12(queries, "query_id", "text"))).withColumnRenamed("doc_id", "query_id")
    return (q.join(mean, "term").groupBy("query_id", "topic")
            .agg(F.round(F.sum(F.col("u") * F.col("s")), 9).alias("sim")))


def member_similarity(p, queries):
    """(query_id, sim_topic, sim): the topic with the highest similarity, the lowest id on ties."""
    best = F.max_by(F.struct("topic", "sim"), F.struct(F.col("sim"), -F.col("topic"))).alias("b")
    return topic_similarity(p, queries).groupBy("query_id").agg(best).select(
        "query_id", F.col("b.topic").alias("sim_topic"), F.col("b.sim").alias("sim"))


@register("predict_topic", PREDICT_SQL + """
SELECT query_id, method, CAST(topic AS INTEGER) AS topic, round(score, 6) AS score FROM chosen""")
def predict_topic(spark, sf_dir):
    """V38 + J3 + V39 on a table of queries (benchmark items): keyword score over the
    topic words; if the best is 0, the signal-word cohort's modal topic with
    score 0.5; otherwise the topic whose members are most similar."""
    return predict_df(spark, sf_dir).select("query_id", "method", "topic", F.round("score", 6).alias("score"))


@register("predict_gate", PREDICT_SQL + labels_sql(SEMANTIC_RULES) + f""",
r AS (SELECT query_id, topic, score FROM chosen)
SELECT r.query_id, CAST(CASE WHEN score < {LOW_CONFIDENCE_GATE} THEN -1 ELSE r.topic END AS INTEGER) AS topic,
       CASE WHEN score < {LOW_CONFIDENCE_GATE} THEN 'No Matching Topic Found'
            ELSE coalesce(l.label, 'Topic ' || CAST(r.topic AS VARCHAR)) END AS label,
       CASE WHEN score < {LOW_CONFIDENCE_GATE} THEN 'UNCERTAIN' ELSE 'SCORED' END AS verdict,
       CASE WHEN score < {LOW_CONFIDENCE_GATE} THEN 0.0 ELSE round(score, 6) END AS probability,
       printf('%.1f%%', least(score, 1.0) * 100) AS confidence_text
FROM r LEFT JOIN labs l ON l.topic = r.topic""")
def predict_gate(spark, sf_dir):
    """P10 + T17: the low-confidence gate (score < 0.15 -> -1, "No Matching
    Topic Found", UNCERTAIN, probability 0) and the confidence text."""
    d = predict_df(spark, sf_dir).select("query_id", "topic", "score")
    labs = TP.topic_labels(pipeline(spark, sf_dir)["words"]).select("topic", "label")
    j = d.join(F.broadcast(labs), "topic", "left")
    gate = F.col("score") < LOW_CONFIDENCE_GATE
    return j.select("query_id", F.when(gate, -1).otherwise(F.col("topic")).cast("int").alias("topic"),
                    F.when(gate, "No Matching Topic Found").otherwise(
                        F.coalesce("label", F.concat(F.lit("Topic "), F.col("topic").cast("string")))).alias("label"),
                    F.when(gate, "UNCERTAIN").otherwise("SCORED").alias("verdict"),
                    F.when(gate, 0.0).otherwise(F.round("score", 6)).alias("probability"),
                    T.percent_text(F.col("score")).alias("confidence_text"))


@register("method_summary", BASE_SQL + """
SELECT CAST((SELECT count(DISTINCT topic) FROM a1 WHERE topic <> -1) AS BIGINT) AS n_topics,
       CAST((SELECT count(*) FROM a1) AS BIGINT) AS n_documents,
       CAST((SELECT count(*) FROM a0 WHERE topic = -1) AS BIGINT) AS outliers_before,
       CAST((SELECT count(*) FROM a1 WHERE topic = -1) AS BIGINT) AS outliers_after,
       CAST((SELECT count(*) FROM a0 WHERE topic = -1) - (SELECT count(*) FROM a1 WHERE topic = -1) AS BIGINT) AS reassigned,
       round((SELECT count(*) FROM a1 WHERE topic = -1) * 1.0 / (SELECT count(*) FROM a1), 4) AS outlier_rate""")
def method_summary(spark, sf_dir):
    """V44 + A23: topics, documents, outliers before/after, reassigned, rate."""
    p = pipeline(spark, sf_dir)
    a0 = p["a0"].agg(F.count_if(F.col("topic") == -1).alias("outliers_before"))
    a1 = p["a1"].agg(F.countDistinct(F.when(F.col("topic") != -1, F.col("topic"))).alias("n_topics"),
                     F.count(F.lit(1)).alias("n_documents"),
                     F.count_if(F.col("topic") == -1).alias("outliers_after"))
    j = a1.crossJoin(a0)
    return j.select(F.col("n_topics").cast("long"), F.col("n_documents").cast("long"),
                    F.col("outliers_before").cast("long"), F.col("outliers_after").cast("long"),
                    (F.col("outliers_before") - F.col("outliers_after")).cast("long").alias("reassigned"),
                    F.round(F.col("outliers_after") / F.col("n_documents"), 4).alias("outlier_rate"))
