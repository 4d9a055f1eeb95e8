"""Queries on tables whose keys, stamps and values the small tables do not have, against DuckDB."""

import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gaugeline import queries

duckdb = pytest.importorskip("duckdb")


def both(spark, path, name, rows):
    """Sorted rows of a query and of its SQL on events of (event_id, ts, user_id, event_type, value, props)."""
    names = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    pq.write_table(pa.table(dict(zip(names, map(list, zip(*rows)), strict=True))), f"{path}/events.parquet")
    got = queries.QUERIES[name](spark, str(path))
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{path}/events.parquet'").fetchall()
    want = c.execute("select {} from ({}) as w".format(", ".join(f'"{n}"' for n in got.columns), queries.ORACLES[name])).fetchall()
    return sorted(map(tuple, got.collect()), key=repr), sorted(want, key=repr)


def event(i, user=0, kind="click", value=1.5, k=0, at=None):
    return (i, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i if at is None else at), user, kind, value, f'{{"k": {k}}}')


@pytest.mark.parametrize("name", ["dbc_pgn", "signals_gathered", "attached_channels", "dbc_exact", "dbc_pgn_source"])
def test_frames_hold_whole_user_ids(spark, tmp_path, name):
    users = [5, 255, 256, 65_535, 65_536, 65_657, 89_999, 2**31 + 7, 2**48 + 258, 2**52 + 1]
    got, want = both(spark, tmp_path, name, [event(i, users[i // 3 % len(users)]) for i in range(6 * len(users))])
    assert got == want


def test_formula_logarithms_to_the_last_bit(spark, tmp_path):
    got, want = both(spark, tmp_path, "formula_logarithms", [event(i, k=i) for i in range(200)])
    assert [tuple(map(repr, r)) for r in got] == [tuple(map(repr, r)) for r in want]


def test_computed_defined_keeps_samples_that_share_a_stamp(spark, tmp_path):
    got, want = both(spark, tmp_path, "computed_defined", [event(i, value=float(i), at=i // 3) for i in range(30)] + [event(30, value=float("inf"), at=40), event(31, value=2.0, at=41)])
    assert got == want and len(got) == 32


@pytest.mark.parametrize("name", ["align_div", "align_add", "align_sub"])
def test_aligned_values_round_as_the_sql_does(spark, tmp_path, name):
    pairs = [(1.000055, 1.0), (1.000085, 1.0), (2.00031, 2.0), (-1.000155, 1.0), (-1e-9, 1.0), (1.0, 1.0 + 1e-9), (0.0, 3.0), (1.0, 0.0), (0.0, 0.0), (1.000055, 0.0)]
    pairs += [(47.404805, 0.0), (1e308, 1.0), (1234567890123.4567, 1.0), (2.0, 1e-12), (7.7, 3e-13), (47.4048, 5e-6), (0.015625, 1.0), (5.0, 7.0)]
    rows = [event(2 * i + j, kind=kind, value=pair[j], at=i) for i, pair in enumerate(pairs) for j, kind in enumerate(("click", "view"))]
    got, want = both(spark, tmp_path, name, rows)
    assert [tuple(map(repr, r)) for r in got] == [tuple(map(repr, r)) for r in want] and len(got) == len(pairs)
