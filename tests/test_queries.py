"""Every query with SQL equals DuckDB on the smallest tables; the entry points hold together."""

import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from gaugeline import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(df):
    cols = sorted(df.columns)
    cell = lambda v: None if v is None or v is pd.NA else round(float(v), 6) + 0.0 if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return df[cols].map(cell).astype(str).sort_values(cols).reset_index(drop=True)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = plain(queries.QUERIES[name](spark, SF).toPandas()), plain(duck.sql(queries.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want), got.compare(want).head() if len(got) == len(want) else (len(got), len(want))


def test_entry_points(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir(SF):
        assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_every_event_is_rendered(spark):
    assert queries.QUERIES["frame_text"](spark, SF).count() == queries.table(spark, SF, "events").count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_every_order_stamp_is_resampled_onto(spark):
    stamps = queries.table(spark, SF, "orders").select("o_orderdate").distinct().count()
    kinds = queries.table(spark, SF, "events").select("event_type").distinct().count()
    assert queries.QUERIES["resample_onto_orders"](spark, SF).count() == stamps * kinds


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_whole_vectors_and_tracks(spark):
    assert len(queries.QUERIES["flatten_array"](spark, SF).columns) == 65
    sf = SF.replace("sf0.001", "sf0.01")
    assert queries.QUERIES["gps_track"](spark, sf).count() == queries.one(spark, sf, "click").count() > 500
