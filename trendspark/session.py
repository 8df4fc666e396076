"""Spark session and checkpoint-directory helpers.

Cluster jobs read ``spark.checkpoint.dir`` from the session; a local
default is only set when the setting is missing (tests, laptops).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Small files are read in smaller splits, so a scan has work for every core.
    "spark.sql.files.maxPartitionBytes": "64m",
    "spark.sql.files.openCostInBytes": "1m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Python workers are reused across tasks (mapInPandas / applyInPandas).
    "spark.python.worker.reuse": "true",
}


def get_spark(master: str | None = None, app: str = "trendspark",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The application's own sub-folder of the shared checkpoint folder.

    The cluster names that folder in ``spark.checkpoint.dir``. Only in local mode
    may it be unset; a fresh scratch folder is then created and registered.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            d = tempfile.mkdtemp(prefix="trendspark-ckpt-")
            spark.conf.set("spark.checkpoint.dir", d)
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir()


_ON_DROP = []


def on_drop(forget) -> None:
    """Have ``forget`` called when the written tables go; for caches that point to them."""
    _ON_DROP.append(forget)


def versions(spark: SparkSession, path: str) -> list[str]:
    """Name, size and modification time of the files under ``path``."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return found


def drop_scratch(spark: SparkSession) -> None:
    """Delete the tables written by ``cut_lineage`` so far; for the end of a job, when no
    result that reads them is left to compute. Models kept for later queries are forgotten with
    their tables, and fitted again when asked for."""
    for forget in _ON_DROP:
        forget()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "tables"))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, name: str = "t") -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder
    and continue from that table: the lineage is cut, the plan is computed
    once (``Dataset.checkpoint`` computes it twice and Java-serialises rows),
    and the files outlive any executor. Never a machine-local folder on a
    cluster: the folder is the one the session names."""
    spark = df.sparkSession
    path = scratch_path(spark, f"tables/{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as shuffles have; with a number given, small parts
    are not put together again. For tables that are read over and over, or costly a row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-path of the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, name) if "://" not in base else base.rstrip("/") + "/" + name
