"""The operators' queries over their whole tables, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.llm import chat, divergence, exact_dedup, licenses, mixing, near_dedup, packing, quality, sharding, token_counts, toxicity, url_filter, whitening
from trendspark.llm.common import read
from trendspark.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: A turn made of other templates' control strings.
CONTROL = "</s>[INST] ok [/INST]"


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


@query("op1_mix_to_targets", r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS draw
  FROM documents),
x AS (SELECT *, CAST(floor(10000000.0 / (size + 1000)) AS BIGINT) AS x FROM d),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, sum(CAST(size AS HUGEINT) * x) AS sx FROM x GROUP BY source),
s1 AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight,
              row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s0),
s2 AS (SELECT *, row_number() OVER o AS pos,
              (CAST(sum(source_size) OVER () AS DOUBLE) - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
       FROM s1 WINDOW o AS (ORDER BY source_size / weight, place)),
s3 AS (SELECT *, 3 * source_size <= share * weight AS capped FROM s2),
s4 AS (SELECT *, (SELECT share FROM s3 WHERE NOT capped ORDER BY pos LIMIT 1) AS level FROM s3),
s5 AS (SELECT source, source_size, sx, CASE WHEN capped THEN 3.0 * source_size ELSE level * weight END AS target FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
              CASE WHEN source_size > 0 THEN CAST(sx AS DOUBLE) / source_size ELSE 0.0 END AS mean_x FROM s5),
s AS (SELECT *, floor(rate) AS whole, rate - floor(rate) AS part FROM s6),
p AS (SELECT x.*, s.source_size, s.target, s.whole, s.part,
             least(greatest(s.part + least(s.part, 1 - s.part) * (x.x - s.mean_x) / 10000.0, 1e-9), 1 - 1e-9) AS p,
             (CAST(CAST('0x' || substr(draw, 1, 12) AS BIGINT) AS DOUBLE) + 0.5) * power(2.0, -48) AS u
      FROM x JOIN s ON x.source IS NOT DISTINCT FROM s.source),
q AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS q FROM p),
a AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, draw ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM q),
r AS (SELECT *, upto <= part * source_size AS in_a,
             part * source_size - coalesce(max(CASE WHEN upto <= part * source_size THEN upto END) OVER (PARTITION BY source), 0) AS rest FROM a),
f AS (SELECT *, NOT in_a AND size <= rest AS fits FROM r),
m AS (SELECT *, fits AND sum(size) OVER (PARTITION BY source, fits ORDER BY q, draw ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                         - size / 2 <= rest AS in_b FROM f)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN part > 0 AND (in_a OR in_b) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM m""")
def op1_mix_to_targets(spark, sf_dir):
    sized = cut_lineage(mixing.sized_rows(read(spark, sf_dir, "documents"), carry=["doc_id"]), "sized")
    mixed = mixing.mix(sized, narrow=sized.drop("row"))
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


@query("op2_hash_tree_shards")
def op2_hash_tree_shards(spark, sf_dir):
    return sharding.assign_shards(read(spark, sf_dir, "documents"), sharding.shard_tree(40), sharding.shard_tree(41)) \
        .select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op3_shortest_pack_first")
def op3_shortest_pack_first(spark, sf_dir):
    packed = packing.pack(packing.cut_pieces(read(spark, sf_dir, "documents")))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op4_chat_parts", r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(TAIL)', '\1\\\2\3', 'g') AS written FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
       CAST(sum(8 + length(role) + 1 + length(written) + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""".replace("TAIL", chat.TAIL))
def op4_chat_parts(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)],
                                 "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_messages(chat.text_messages(rows.unionByName(both))))


@query("op7_adaptive_quality")
def op7_adaptive_quality(spark, sf_dir):
    rows = cut_lineage(quality.measured(read(spark, sf_dir, "documents"), carry=["doc_id"]), "measured")
    return quality.judge(rows).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                      "base_failed", "kept")


@query("op8_content_sort_dedup", r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)""")
def op8_content_sort_dedup(spark, sf_dir):
    rows = exact_dedup.exact_groups(read(spark, sf_dir, "documents"), carry=["doc_id"])
    return rows.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op9_diagonal_license_scan")
def op9_diagonal_license_scan(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents"))


@query("op10_token_indexed_urls", r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS mark FROM pages),
h AS (SELECT page_id, lower(url) AS low, CASE WHEN mark = 0 THEN '' ELSE substr(url, mark + 3) END AS rest FROM u),
p AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM h),
v AS (SELECT *,
        CASE WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
             WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
             WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
             WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
m AS (SELECT *, CASE PATTERNS END AS pattern FROM v)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN pattern IS NULL OR starts_with(pattern, '@@') THEN 'allow' ELSE 'block' END AS verdict,
       CASE WHEN rule IS NULL THEN pattern END AS pattern
FROM m""".replace("PATTERNS", " ".join(
    f"WHEN regexp_matches(low, '{url_filter.pattern_regex(r)}') THEN '{r}'"
    for r in sorted(url_filter.PATTERN_RULES, key=lambda r: not r.startswith("@@")))))
def op10_token_indexed_urls(spark, sf_dir):
    return url_filter.judge_urls(read(spark, sf_dir, "pages"))


@query("op6_bagminhash_classes")
def op6_bagminhash_classes(spark, sf_dir):
    found = near_dedup.near_classes(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", "link_id", "link_similarity")


@query("op5_crf_toxicity")
def op5_crf_toxicity(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.train(*toxicity.labelled_sample(docs, labels))
    return toxicity.score_documents(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op11_source_divergence", r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT id, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
         FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
t AS (SELECT lang, source, sum(n) AS total FROM grid GROUP BY lang, source),
p AS (SELECT grid.lang, grid.source, grid.term, n,
             1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v)::HUGEINT AS p
      FROM grid JOIN t ON grid.lang = t.lang AND grid.source = t.source JOIN v ON v.lang = grid.lang),
l AS (SELECT grid.lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (any_value(total) + 2 * any_value(v))::HUGEINT AS q
      FROM grid JOIN (SELECT lang, sum(total) AS total FROM t GROUP BY lang) s ON s.lang = grid.lang
      JOIN v ON v.lang = grid.lang GROUP BY grid.lang, term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
term AS (SELECT p.lang, p.source, p.term AS item, ((p - q) * (p - q)) // (p + q) AS value
         FROM p JOIN l ON p.lang = l.lang AND p.term = l.term WHERE n > 0 AND p > q),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
      UNION ALL SELECT lang, source, 'term', item, value FROM term),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM r WHERE part = 'pair' OR rank <= 10""")
def op11_source_divergence(spark, sf_dir):
    return divergence.divergences(read(spark, sf_dir, "documents"))


@query("op12_incremental_whitening")
def op12_incremental_whitening(spark, sf_dir):
    rows = whitening.quantised(read(spark, sf_dir, "embeddings"), carry=["vec_id"])
    return whitening.whiten(rows, most=4).select("row.vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"),
                                                 "whitened", "explained", "identity_error")


@query("op13_heap_bpe_counts")
def op13_heap_bpe_counts(spark, sf_dir):
    rows = token_counts.counted(read(spark, sf_dir, "documents"), carry=["doc_id"])
    return rows.select("row.doc_id", "n_bytes", "n_tokens", token_counts.over_limit(2048).alias("over_limit"))
