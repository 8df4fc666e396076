"""Versioned state, written models and streams over several batches."""

import os
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trendspark.plans.registry import QUERIES, load_all
from trendspark.session import cut_lineage, drop_scratch, scratch_path
from trendspark.sources import io as IO
from trendspark.streaming import stream as ST

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- state

def test_a_broken_save_leaves_the_state_before_it(spark, tmp_path):
    root = str(tmp_path / "state")
    with pytest.raises(FileNotFoundError):
        IO.load_state(spark, root, ["a"])
    one, two = spark.range(3), spark.range(5)
    assert IO.save_state(root, {"a": one, "b": one}) == 1
    broken = two.select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        IO.save_state(root, {"a": two, "b": broken})
    state = IO.load_state(spark, root, ["a", "b", "c"])
    assert state["version"] == 1 and state["missing"] == ["c"]
    assert {n: df.count() for n, df in state["parts"].items()} == {"a": 3, "b": 3}
    assert IO.save_state(root, {"a": two}) == 2
    new = IO.load_state(spark, root, ["b"])
    assert new["missing"] == ["b"] and new["parts"]["a"].count() == 5
    assert IO.load_state(spark, root, [], version=1)["parts"]["b"].count() == 3
    assert state["parts"]["a"].count() == 3  # a reader of the version before goes on
    IO.save_state(root, {"a": one})
    assert [p.name for p in sorted((tmp_path / "state" / "manifests").glob("*.json"))] == ["00000002.json", "00000003.json"]


def test_two_saves_of_one_version_dont_mix(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "state")
    monkeypatch.setattr(IO, "_manifests", lambda *a: [])  # both believe that there is no version yet
    IO.save_state(root, {"a": spark.range(3)})
    with pytest.raises(RuntimeError):
        IO.save_state(root, {"a": spark.range(4)})
    monkeypatch.undo()
    assert IO.load_state(spark, root, [])["parts"]["a"].count() == 3


def test_corrupt_lines_are_kept_apart(spark, tmp_path):
    good = '{"headline": "h", "short_description": "d", "category": "c", "date": "2020-01-01", "authors": "a"}'
    (tmp_path / "articles.json").write_text("\n".join([good, '{"headline": "x", ', "no json", good, '{"headline": 7}', ""]))
    df = cut_lineage(IO.read_articles_json(spark, str(tmp_path / "articles.json")))
    assert df.count() == 5
    bad = df.where("_corrupt_record IS NOT NULL").select("_corrupt_record").collect()
    assert sorted(r[0] for r in bad) == ['no json', '{"headline": "x", ']
    assert df.where("headline = 'h' AND _corrupt_record IS NULL").count() == 2


def test_queries_run_again_after_their_tables_were_dropped(spark):
    load_all()
    before = sorted(map(str, QUERIES["topic_catalogue"](spark, SF).collect()))
    drop_scratch(spark)
    assert sorted(map(str, QUERIES["topic_catalogue"](spark, SF).collect())) == before


def test_a_rewritten_input_is_fitted_anew(spark, tmp_path):
    from trendspark.plans.q_topics import pipeline
    for name in ("documents", "embeddings"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    first = pipeline(spark, str(tmp_path))
    assert pipeline(spark, str(tmp_path)) is first
    spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 100").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    again = pipeline(spark, str(tmp_path))
    assert again is not first and again["a0"].count() == spark.read.parquet(str(tmp_path / "documents.parquet")).count()


# ---------------------------------------------------------------- streams

def batch_velocity(rows, lo, hi):
    counts, out = Counter(rows), {}
    for topic in {t for t, _ in rows}:
        gap = 0
        for y in range(lo, hi + 1):
            n, prev = counts[topic, y], counts[topic, y - 1]
            gap = 0 if n else gap + 1
            out[topic, y] = (n, 0.0 if y == lo else round((n - prev) / (prev + 1.0), 4), gap)
    return out


def test_state_over_several_batches_and_a_restart_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(6), rng.choice([2012, 2013, 2016, 2019, 2020])) for _ in range(600)]
    src, paths = str(tmp_path / "in"), (str(tmp_path / "out"), str(tmp_path / "ckpt"))

    def run():
        stream = ST.source(spark, src, "topic int, year int", max_files=1)
        return ST.latest_per_key(ST.run_update_to_table(ST.running_velocity(stream, (2012, 2021)), "v", paths), ["topic", "year"], "_epoch")

    done = []
    for part in (rows[:100], rows[100:350], rows[350:]):  # each run is a new query on the same checkpoint
        for k in range(0, len(part), 90):  # and several micro-batches
            spark.createDataFrame(part[k:k + 90], "topic int, year int").coalesce(1).write.mode("append").parquet(src)
            time.sleep(0.01)
        done += part
        got = {(r["topic"], r["year"]): (r["n_kt"], r["velocity"], r["gap"]) for r in run().collect()}
        assert got == batch_velocity(done, 2012, 2021)
    epochs = spark.read.parquet(paths[0]).select("_epoch").distinct().count()
    assert epochs >= 7
    # later batches write the years they touch, not the whole calendar of a topic
    last = spark.read.parquet(paths[0]).where(F.col("_epoch") == epochs - 1).groupBy("topic").count().agg(F.min("count")).first()[0]
    assert last < 10


def test_windows_close_and_late_rows_are_dropped_over_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    # The late file comes two batches after the watermark has passed its day: rows are held against the
    # watermark that the batch before began with.
    days = [("2024-01-01", 3), ("2024-01-02", 2), ("2024-01-05", 1), ("2024-01-05", 1), ("2024-01-01", 4), ("2024-01-09", 1), ("2024-01-09", 2)]
    seen = set()
    for day, n in days:
        spark.range(n).select(F.lit(f"{day} 12:00:00").cast("timestamp").alias("ts"), F.lit("k").alias("key")).coalesce(1).write.mode("append").parquet(src)
        for f in set((tmp_path / "in").glob("*.parquet")) - seen:  # files are read in the order of their times
            os.utime(f, (1_700_000_000 + 10 * len(seen), 1_700_000_000 + 10 * len(seen)))
            seen.add(f)
    stream = ST.source(spark, src, "ts timestamp, key string", max_files=1)
    out = ST.run_to_table(ST.window_counts(stream, "ts", ["key"], "1 day", None, "1 day"), "late")
    got = {str(r["window_start"])[:10]: r["n"] for r in out.collect()}
    assert got == {"2024-01-01": 3, "2024-01-02": 2, "2024-01-05": 2}, got


def test_merged_counts_over_batches_equal_batch(spark, tmp_path):
    rng, src, rows = random.Random(5), str(tmp_path / "in"), []
    for _ in range(4):
        part = [(rng.randrange(3), rng.randrange(4)) for _ in range(50)]
        rows += part
        spark.createDataFrame(part, "a int, b int").coalesce(1).write.mode("append").parquet(src)
    out = ST.run_foreach_batch(ST.source(spark, src, "a int, b int", max_files=1), "merged", ["a", "b"])
    assert {(r["a"], r["b"]): r["n"] for r in out.collect()} == Counter(rows)
