"""Every statement of the library against DuckDB on sf0.001 (tools/check_oracle.py
does the same on any folder)."""

import math

import duckdb
import pytest

from conftest import SF_CHECK, SF_SMALL
from trendspark.plans.registry import ORACLES, QUERIES, load_all
from trendspark.sources.tables import TABLES

load_all()
#: Words that occur in the same texts tie at sf0.001, where the last digits of a sum would decide.
LARGER = {"word_rerank"}


def _rows(pdf):
    cols = sorted(pdf.columns)

    def n(v):
        if v is None:
            return None
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        if hasattr(v, "tolist") and getattr(v, "ndim", 0):
            v = v.tolist()
        return tuple(n(x) for x in v) if isinstance(v, (list, tuple)) else v
    return cols, sorted((tuple(n(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def tables():
    def opened(sf):
        c = duckdb.connect()
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
        return c
    return {sf: opened(sf) for sf in (SF_SMALL, SF_CHECK)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, tables, name):
    sf = SF_CHECK if name in LARGER else SF_SMALL
    sp = QUERIES[name](spark, sf).toPandas()
    dd = tables[sf].execute(ORACLES[name]).df().astype(object).where(lambda x: x.notna(), None)
    assert _rows(sp.astype(object).where(sp.notna(), None)) == _rows(dd)


def test_every_query_has_a_callable_and_most_have_sql():
    assert len(QUERIES) >= 100
    assert set(ORACLES) <= set(QUERIES)
