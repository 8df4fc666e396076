"""The registry must load without files beside PySpark, from any directory, and without
the training-data subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code: str, cwd: str) -> str:
    out = subprocess.run([sys.executable, "-c", code], cwd=cwd, capture_output=True, text=True, timeout=120,
                         env=os.environ | {"PYTHONPATH": ROOT})
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout


def test_queries_load_from_another_directory_and_read_no_file(tmp_path):
    code = """
import glob
glob.glob = None  # nothing may look for jars
import __spark_entry__ as e
print(len(e.queries()) >= 100, set(e.oracle_sql()) <= set(e.queries()))
"""
    assert run(code, str(tmp_path)).split() == ["True", "True"]


def test_queries_load_without_the_training_data_subpackage(tmp_path):
    code = """
import sys
sys.modules["trendspark.llm"] = None
sys.modules["corpus_pipeline"] = None
import __spark_entry__ as e
names = e.queries()
print("signal_class" in names, any(n.startswith("op1_") or n == "pipeline" for n in names))
"""
    assert run(code, str(tmp_path)).split() == ["True", "False"]


def test_stop_words_equal_spark_ml(spark):
    from pyspark.ml.feature import StopWordsRemover

    from trendspark.functions.stopwords import spark_english_stop_words
    assert list(spark_english_stop_words()) == StopWordsRemover.loadDefaultStopWords("english")


def test_stateful_stream_runs_from_another_directory(tmp_path):
    code = """
import os, sys
sys.path.insert(0, %r)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
os.environ.pop("PYTHONPATH", None)
print("rows", e.queries()["stream_state_velocity"](spark, "/root/testdata/sf0.001").count())
""" % ROOT
    out = subprocess.run([sys.executable, "-c", code], cwd=str(tmp_path), capture_output=True, text=True, timeout=240,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert "rows 56" in out.stdout, out.stderr[-2000:]
