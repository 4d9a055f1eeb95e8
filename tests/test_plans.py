import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.operators.series import StructureError, series_of
from gaugeline.operators.viewport import Viewport
from gaugeline.plans.workspace import Workspace
from gaugeline.sources import mdf4_meta, sinks
from gaugeline.sources.database import Database, MessageDef, SignalDef
from gaugeline.sources.mdf4 import Mdf4, read_group
from gaugeline.sources.mdf4_write import Mdf4Writer


def test_operands_of_one_group_are_a_projection(spark):
    w = Workspace(spark)
    table = spark.createDataFrame([(0, 0.0, 6.0, 2.0, True), (1, 1.0, 8.0, 0.0, True), (2, 2.0, 9.0, 3.0, False)], "idx long, time double, a double, b double, a__valid boolean")
    w.add_group("g", table, "time")
    out = w.define("ratio", "a / b")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = out.orderBy("idx").collect()
    assert got[0]["v"] == 3 and got[0]["valid"] and not got[1]["valid"] and not got[2]["valid"]
    assert w.evaluate("[ratio] + A").where("t = 0").first()["v"] == 9
    assert [(r["t"], r["v"]) for r in w.evaluate("2 * 3").orderBy("t").collect()] == [(0, 6), (1, 6)]
    for bad in ("nobody + 1",):
        with pytest.raises(StructureError):
            w.evaluate(bad)
    with pytest.raises(StructureError):
        w.define("ratio", "a")
    w.remove("ratio")
    with pytest.raises(StructureError):
        w.remove("ratio")


def test_operands_of_two_clocks_and_databases(spark):
    w = Workspace(spark)
    w.add_series("x", series_of(spark, "x", [0, 2], [0, 20]))
    w.add_series("y", series_of(spark, "y", [1], [5]))
    assert [(r["t"], r["v"]) for r in w.evaluate("x + y").orderBy("t").collect()] == [(0, 5), (1, 15), (2, 25)]
    assert [(r["t"], r["v"]) for r in w.evaluate("max(x, y)", web=True).orderBy("t").collect()] == [(0, 5), (2, 20)]
    db = Database((MessageDef("M", 5, False, 1, (SignalDef("S", 0, 8),)),))
    f = spark.createDataFrame([(0, 0.0, 5, 1, bytes([7]))], "idx long, t double, id long, bus int, data binary")
    assert w.attach("d", f, db) == ["M.S"] and w.evaluate("M.S * 2").first()["v"] == 14
    w.detach("d")
    assert "M.S" not in w.channels


def test_viewport():
    v = Viewport(0, 10, 0, 100)
    z = v.zoom(2, 5)
    assert (z.start, z.end) == (2.5, 7.5)
    assert (v.pan(-50).start, v.pan(500).end) == (0, 100)
    assert v.between(8, 3) == Viewport(3, 8, 0, 100)
    assert v.zoom(1e12, 5).span == pytest.approx(1e-5)


def test_edit_and_level_five(spark, tmp_path):
    w = Mdf4Writer(3, "c")
    g = w.add_group("g", [0.0, 1.0])
    w.add_channel(g, "a", np.array([1, 2], np.int16), "V", valid=[True, False])
    w.add_channel(g, "b", ["x", "y"])
    path = str(tmp_path / "a.mf4")
    w.write(path)
    f = Mdf4.open(path)
    again, report = mdf4_meta.edited(f, spark, path, keep=lambda c: c.name == "a", codec="deflate")
    again.write(str(tmp_path / "b.mf4"))
    got = read_group(spark, str(tmp_path / "b.mf4")).orderBy("idx").collect()
    assert [r["a"] for r in got] == [1, 2] and [r["a__valid"] for r in got] == [True, False] and "b" not in got[0]
    assert report.count() == 0 and mdf4_meta.compression_ratio(f) == 1.0
    assert mdf4_meta.gaps(f.block_map(spark), f.source.size).where(F.col("length") > 8).count() == 0
    raw = sinks.mat5({"x": [1.0, 2.0]})
    assert raw[124:128] == b"\x00\x01IM" and raw.endswith(np.array([1.0, 2.0]).tobytes())
