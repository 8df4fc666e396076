"""Compare column types of every Spark query with its DuckDB oracle
(LongType~BIGINT, IntegerType~INTEGER, DoubleType~DOUBLE, StringType~VARCHAR,
BooleanType~BOOLEAN, DateType~DATE). usage: python tools/schema_check.py [sf_dir]"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from trendspark.plans.registry import ORACLES, QUERIES, load_all  # noqa: E402
from trendspark.session import get_spark  # noqa: E402
from trendspark.sources.tables import TABLES  # noqa: E402

MAP = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
       "date": "DATE", "float": "FLOAT", "smallint": "SMALLINT", "timestamp": "TIMESTAMP WITH TIME ZONE",
       "timestamp_ntz": "TIMESTAMP"}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    load_all()
    spark = get_spark("local[8]", shuffle_partitions=8, extra={"spark.driver.memory": "8g"})
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name in sorted(ORACLES):
        sp = {f.name: MAP.get(f.dataType.simpleString(), f.dataType.simpleString())
              for f in QUERIES[name](spark, sf).schema.fields}
        dd = {r[0]: r[1] for r in con.execute(f"DESCRIBE {ORACLES[name]}").fetchall()}
        diff = {c: (sp.get(c), dd.get(c)) for c in set(sp) | set(dd) if sp.get(c) != dd.get(c)}
        if diff:
            bad += 1
            print(f"TYPES {name}: {diff}")
    print(f"== {bad} queries with type differences of {len(ORACLES)}")


if __name__ == "__main__":
    main()
