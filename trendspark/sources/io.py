"""Sources and sinks: JSON-lines articles, CSV/JSON result tables and the
persisted model state with its manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as Ty

ARTICLE_SCHEMA = Ty.StructType([
    Ty.StructField("headline", Ty.StringType()),
    Ty.StructField("short_description", Ty.StringType()),
    Ty.StructField("category", Ty.StringType()),
    Ty.StructField("date", Ty.StringType()),
    Ty.StructField("authors", Ty.StringType()),
    Ty.StructField("_corrupt_record", Ty.StringType()),
])


def read_articles_json(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited JSON with a declared schema (never inferred);
    malformed lines land in ``_corrupt_record`` instead of failing the job."""
    return (spark.read.schema(ARTICLE_SCHEMA).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header (parquet is the default format elsewhere)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """S3: CSV read back with a declared schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON records."""
    df.write.mode("overwrite").json(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _manifests(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete versions of a state, rising."""
    fs, folder = _fs(spark, f"{root}/manifests")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def save_state(root: str, parts: dict[str, DataFrame], keep: int = 2) -> int:
    """A new immutable version of a state: one parquet table per part in a folder of its
    own, then the manifest that lists them, which appears under its final name in one
    rename. A save that breaks leaves the earlier versions as they were; readers see the old
    version or the whole new one. The last ``keep`` versions stay, so that a reader that has just
    opened the one before can finish. Returns the version's number; of two saves at once
    the second to finish raises an error."""
    spark = next(iter(parts.values())).sparkSession
    known = _manifests(spark, root)
    version = known[-1] + 1 if known else 1
    folder = f"versions/{version:08d}-{uuid.uuid4().hex}"
    for name, df in parts.items():
        df.write.parquet(f"{root}/{folder}/{name}")
    lines = "".join(json.dumps({"part": name, "path": f"{folder}/{name}"}) + "\n" for name in parts)
    fs, final = _fs(spark, f"{root}/manifests/{version:08d}.json")
    _, draft = _fs(spark, f"{root}/{folder}/manifest")
    out = fs.create(draft, True)
    out.write(bytearray(lines.encode()))
    out.close()
    fs.mkdirs(final.getParent())
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"version {version} of {root} was written by another job")
    for old in known[:len(known) + 1 - keep] if keep else []:
        paths = {r["path"].rsplit("/", 1)[0] for r in _manifest(spark, root, old).collect()}  # the folder of a version
        fs.delete(_fs(spark, f"{root}/manifests/{old:08d}.json")[1], False)
        for path in paths:
            fs.delete(_fs(spark, f"{root}/{path}")[1], True)
    return version


def _manifest(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.schema("part string, path string").json(f"{root}/manifests/{version:08d}.json")


def load_state(spark: SparkSession, root: str, required: list[str], version: int | None = None) -> dict:
    """S5 + U5: read the manifest of the newest version (or of ``version``), report required parts
    that are missing (required EXCEPT present) and load the present ones."""
    known = _manifests(spark, root)
    if not known:
        raise FileNotFoundError(f"no complete state under {root}")
    present = _manifest(spark, root, version or known[-1])
    req = spark.createDataFrame([(r,) for r in required], "part string")
    missing = [r["part"] for r in req.exceptAll(present.select("part")).collect()]  # bounded: a list of part names
    return {"version": version or known[-1], "missing": missing,
            "parts": {r["part"]: spark.read.parquet(f"{root}/{r['path']}") for r in present.collect()}}
