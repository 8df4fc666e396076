"""Cleaning by Arrow batches against the regular expressions."""

from pyspark.sql import functions as F

from trendspark.functions import text as T


def test_cleaning_is_vectorised_and_equals_the_regular_expressions(spark):
    rows = [(f"x{chr(i)}Y 9{chr(i)}{chr(i)} ",) for i in [*range(0x3100), *range(0xFE00, 0x10000), 0x1D400]] + [(None,), ("",), (" \t ",)]
    d = spark.createDataFrame(rows, "text string")
    for clean, kept in ((T.clean_alnum, "a-z0-9"), (T.clean_alpha, "a-z")):
        plain = F.trim(F.regexp_replace(F.regexp_replace(T.as_text("text"), f"[^{kept}{T.WS}]", ""), f"[{T.WS}]+", " "))
        assert d.where(~plain.eqNullSafe(clean("text"))).count() == 0
        assert "regexp" not in d.select(clean("text"))._jdf.queryExecution().optimizedPlan().toString()


def test_query_vocabulary_makes_its_set_once(spark, tmp_path):
    from trendspark.plans.registry import QUERIES, load_all
    load_all()
    spark.createDataFrame([(1, "b a b a"), (2, ""), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["query_vocabulary"](spark, str(tmp_path))
    got = {r["doc_id"]: (r["n_bigrams"], r["vocab_size"], r["vocab"]) for r in out.where("doc_id > 0").collect()}
    assert got == {1: (3, 4, "a|a b|b|b a"), 2: (0, 0, ""), 3: (0, 1, "none")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # one of the documents, one of the edge rows
    assert plan.count("array_union(") == 2 and "array_sort(" not in plan
