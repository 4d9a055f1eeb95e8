"""Hand-computed cases of the series operators."""

import math

import pytest
from pyspark.sql import functions as F

from gaugeline.functions import ieee
from gaugeline.operators import algebra, asof, multifile, resample, search, series, stats, windows, xy
from gaugeline.operators.series import AxisError, StructureError, series_of


def tv(df):
    return [(r["t"], r["v"]) for r in df.orderBy("t").collect()]


def targets(spark, ts, name="s"):
    return spark.createDataFrame([(name, float(t)) for t in ts], "series string, t double")


@pytest.mark.parametrize("a,b,want", [(2, 4, [2, 3, 4]), (1.5, 4.5, [2, 3, 4]), (6, 10, []), (-5, 0.5, []), (4, 2, [])])
def test_cut(spark, a, b, want):
    s = series_of(spark, "s", [1, 2, 3, 4, 5], [10, 20, 30, 40, 50])
    assert [t for t, _ in tv(series.cut(s, a, b))] == want


def test_resample_finer_coarser_and_beyond(spark):
    s = series_of(spark, "s", [1, 2, 3, 4], [10, 20, 30, 40])
    assert [v for _, v in tv(resample.resample(s, 0.5, "linear"))] == [10, 15, 20, 25, 30, 35, 40]
    assert [v for _, v in tv(resample.resample(s, 0.5, "hold"))] == [10, 10, 20, 20, 30, 30, 40]
    wide = series_of(spark, "s", [0, 1, 2, 3, 4], [0, 100, 200, 300, 400])
    assert tv(resample.resample(wide, 2.0, "linear")) == [(0, 0), (2, 200), (4, 400)]
    short, grid = series_of(spark, "s", [1, 2, 3], [10, 20, 30]), targets(spark, [0, 0.5, 1, 1.5, 2, 2.5, 3, 3.5, 4])
    for bucket in (None, 1.0):
        assert [v for _, v in tv(asof.linear(short, grid, bucket=bucket))] == [10, 10, 10, 15, 20, 25, 30, 30, 30]
        assert [v for _, v in tv(asof.hold(short, grid, bucket=bucket))] == [10, 10, 10, 10, 20, 20, 30, 30, 30]
    with pytest.raises(ValueError):
        resample.resample(s, 0.0)


def test_duplicate_stamps(spark):
    s = series_of(spark, "s", [0, 0, 1, 1, 2], [1, 2, 3, 4, 5])
    grid = targets(spark, [-1, 0, 0.5, 1, 1.5, 2, 3])
    for bucket in (None, 1.0, 0.4):
        assert [v for _, v in tv(asof.hold(s, grid, bucket=bucket))] == [1, 2, 2, 4, 4, 5, 5]
        assert [v for _, v in tv(asof.linear(s, grid, bucket=bucket))] == [1, 1, 2.5, 4, 4.5, 5, 5]


def test_text_holds_under_linear(spark):
    s = series_of(spark, "s", [0, 1, 2, 3], ["zero", "one", "two", "three"])
    assert [v for _, v in tv(asof.linear(s, targets(spark, [0.5, 1, 1.5, 2, 2.5, 3])))] == ["zero", "one", "one", "two", "two", "three"]


def test_common_raster(spark):
    s = series_of(spark, "A", [0, 2, 4], [0, 20, 40]).unionByName(series_of(spark, "B", [1, 3, 5], [10, 30, 50]))
    got = resample.resample(s, 1.0, "linear", common=True)
    assert [v for _, v in tv(got.where("series = 'A'"))] == [0, 10, 20, 30, 40, 40]
    assert [v for _, v in tv(got.where("series = 'B'"))] == [10, 10, 20, 30, 40, 50]


def test_nearest_prefers_the_earlier(spark):
    s = series_of(spark, "s", [0, 2, 2, 4], [1, 2, 3, 4])
    for bucket in (None, 1.5):
        got = asof.nearest(s, targets(spark, [-1, 1, 2, 3, 3.5, 9]), bucket=bucket).orderBy("t").collect()
        assert [r["v"] for r in got] == [1, 1, 2, 3, 4, 4]
    assert asof.first_nearest(s, targets(spark, [1, math.inf])).orderBy("t").collect()[0]["v"] == 1


def test_algebra_on_mixed_axes(spark):
    a, b = series_of(spark, "s", [0, 1, 2, 3], [10, 20, 30, 40]), series_of(spark, "s", [0.5, 1.5, 2.5], [5, 15, 25])
    assert tv(algebra.combine(a, b, "add")) == [(0.5, 20), (1, 30), (1.5, 40), (2, 50), (2.5, 60)]
    assert [v for _, v in tv(algebra.combine(a, b, "div"))] == [3, 2, 25 / 15, 1.5, 1.4]
    apart = series_of(spark, "s", [7, 8], [1, 1])
    assert algebra.combine(a, apart, "add").count() == 0
    with pytest.raises(StructureError):
        algebra.combine(a, a.where("t < 0"), "add")


def test_validity_of_either_side(spark):
    a = series_of(spark, "s", [0, 1, 2], [1, 1, 1], [True, False, True])
    b = series_of(spark, "s", [0, 1, 2], [1, 1, 1], [False, False, True])
    assert [r["valid"] for r in algebra.combine(a, b, "add").orderBy("t").collect()] == [True, False, True]
    assert [r["valid"] for r in algebra.combine(a, b, "add", combine_valid="and").orderBy("t").collect()] == [False, False, True]


def test_scalars_and_ieee(spark):
    row = spark.createDataFrame([(1.0, 0.0, math.nan)], "a double, z double, n double").select(
        ieee.div(F.col("a"), F.col("z")).alias("inf"), ieee.div(-F.col("a"), F.col("z")).alias("minus"), ieee.div(F.col("z"), F.col("z")).alias("nan"),
        ieee.compare("eq", F.col("n"), F.col("n")).alias("eq"), ieee.compare("ne", F.col("n"), 1.0).alias("ne"), ieee.log(F.col("z")).alias("log"), ieee.largest(F.col("n"), F.col("a")).alias("most"),
    ).first()
    assert row["inf"] == math.inf and row["minus"] == -math.inf and math.isnan(row["nan"]) and row["eq"] == 0.0 and row["ne"] == 1.0 and row["log"] == -math.inf and row["most"] == 1.0
    assert [v for _, v in tv(algebra.scalar(series_of(spark, "s", [0, 1, 2], [10, 20, 30]), "div", 1.0, swapped=True))] == [0.1, 0.05, 1 / 30]


def test_union_stamps_greedy(spark):
    s = series_of(spark, "s", [0, 0.6e-9, 1.2e-9, 5], [0, 0, 0, 0])
    assert [r["t"] for r in algebra.union_stamps([s]).orderBy("t").collect()] == [0, 1.2e-9, 5]


def test_axis(spark):
    assert series.axis_faults(series_of(spark, "s", [0, 1, 1, 0.5, math.nan], [0] * 5)).orderBy("idx").select("idx", "reason").collect() == [(3, "decreasing"), (4, "not finite")]
    with pytest.raises(AxisError, match="sample 3"):
        series.checked_axis(series_of(spark, "s", [0, 1, 1, 0.5], [0] * 4))
    with pytest.raises(StructureError):
        series_of(spark, "s", [0, 1], [0])


def test_stats(spark):
    s = series_of(spark, "s", [0, 1, 2, 3, 4], [1.0, 2.0, 3.0, math.nan, 10.0], [True, True, True, True, False])
    r = stats.series_stats(s).first()
    assert (r["samples"], r["valid_samples"], r["excluded"], r["nan_inf"], r["min"], r["max"], r["mean"], r["median"]) == (5, 4, 2, 1, 1, 3, 2, 2)
    assert math.isnan(r["last"]) and r["rate"] == 1.0 and abs(r["std"] - math.sqrt(2 / 3)) < 1e-12
    assert stats.percentile(series_of(spark, "s", [0, 1, 2, 3], [1, 2, 3, 4]), 0.25).first()["percentile"] == 1.75
    assert stats.percentile(series_of(spark, "s", [0, 1], [1, 2]), 2).first()["percentile"] == 2
    assert stats.histogram(series_of(spark, "s", [0, 1], [5, 5])).count() == 0
    bins = stats.histogram(series_of(spark, "s", [0, 1, 2], [0, 10, 5])).orderBy("bin").collect()
    assert len(bins) == 50 and bins[0]["n"] == bins[49]["n"] == bins[25]["n"] == 1
    w = stats.window_stats(s, 3, 1).first()
    assert w["count"] == 0
    d = {r["label"]: (r["samples"], r["seconds"]) for r in stats.label_durations(series_of(spark, "s", [0, 1, 3, 6], ["a", "b", "a", "a"])).collect()}
    assert d == {"a": (3, 4.0), "b": (1, 2.0)}


def test_decimation_keeps_the_spike(spark):
    s = series_of(spark, "s", list(range(2000)), [999.0 if i == 733 else 1.0 for i in range(2000)])
    for f in (windows.decimate_min_max, windows.decimate_curve):
        got = f(s, 0, 1999, 50).collect()
        assert any(r["v"] == 999 and r["idx"] == 733 for r in got) and len(got) <= 200
    assert windows.view_window(s, 0, 1999, 100).count() <= 100
    runs = windows.label_runs(series_of(spark, "s", [0, 1, 2, 3], ["a", "a", "b", "b"])).orderBy("idx").collect()
    assert [r["idx"] for r in runs] == [0, 2, 3]
    gaps = series_of(spark, "s", [0, 1, 2, 3], [1, 2, 3, 4], [True, False, False, True])
    assert [tuple(r)[1:] for r in windows.valid_islands(gaps).orderBy("run").collect()] == [(0, 0, 0, 1), (1, 3, 3, 1)]
    assert sum(math.isnan(r["v"]) for r in windows.decimate_gaps(gaps, 0, 3, 10).collect()) == 1


def test_concatenate(spark):
    a = series_of(spark, "s", [0, 1, 2], [10, 20, 30]).withColumn("file_index", F.lit(0))
    b = series_of(spark, "s", [0, 0.5, 1], [40, 50, 60]).withColumn("file_index", F.lit(1))
    assert [t for t, _ in tv(multifile.concatenate(a.unionByName(b), {0: 0.0, 1: 0.0}))] == [0, 1, 2, 2.5, 3, 3.5]
    one = series_of(spark, "s", [0], [7]).withColumn("file_index", F.lit(1))
    assert tv(multifile.concatenate(a.unionByName(one), {}))[-1][0] == 2.001
    with pytest.raises(StructureError):
        multifile.check_structure([[["a", "b"]], [["a", "c"]]])
    multifile.check_structure([[["a", "b", "a"]], [["a", "a", "b"]]])
    assert multifile.offsets([5_000_000_000, 3_000_000_000]) == {0: 2.0, 1: 0.0}


def test_xy(spark):
    x, y = series_of(spark, "x", [0, 1, 2], [1, 2, 3]), series_of(spark, "y", [0, 1, 2], [10, math.nan, 30])
    pairs, dropped = xy.pair(x, y)
    assert [tuple(r) for r in pairs.orderBy("t").collect()] == [(0, 1, 10), (2, 3, 30)] and dropped.first()["dropped"] == 1
    other = series_of(spark, "y", [0.5, 1.5], [5, 15])
    assert [tuple(r) for r in xy.pair(x, other)[0].collect()] == [(1.0, 2.0, 10.0)]
    for bad, reason in ((series_of(spark, "y", [9], [1]), "no_overlap"), (y.where("t < 0"), "empty")):
        with pytest.raises(xy.PairRefused) as e:
            xy.pair(x, bad)
        assert e.value.reason == reason
    with pytest.raises(xy.PairRefused):
        xy.pair(x, y, cross_file=True, absolute=False)
    assert xy.gps_pairs([("GPS_Lat", 0, 0), ("GPS_Lon", 0, 0), ("LateralAccel", 1, 0)]) == (("GPS_Lat", 0, 0), ("GPS_Lon", 0, 0))


def test_search_and_sort(spark):
    names = spark.createDataFrame([("Speed", 0, 0, 1), ("speed_raw", 0, 0, 2), ("Gear.x", 1, 0, 1), ("Speed", 1, 0, 2)], "name string, dg int, cg int, cn int")
    assert [r["name"] for r in search.names(names, "Sp*d", "wildcard").collect()] == ["Speed"]
    assert [r["name"] for r in search.names(names, "SPEED", "case_insensitive").collect()] == ["Speed", "speed_raw"]
    assert [r["name"] for r in search.names(names, "Gear.?", "wildcard").collect()] == ["Gear.x"]
    assert search.find_by_reference(names, "GEAR.X").first()["dg"] == 1 and search.find(names, "Speed").first()["dg"] == 0
    with pytest.raises(StructureError):
        search.select_channels(names, ["Speed"])
    assert [r["cn"] for r in search.select_channels(names, [("Speed", 1), (0, 0, 2)])] == [2, 2]
    cells = spark.createDataFrame([(0, "10"), (1, "9"), (2, None), (3, "b"), (4, "A")], "idx int, c string")
    assert [r["idx"] for r in search.sorted_rows(cells, "c").collect()] == [1, 0, 4, 3, 2]
    assert [r["idx"] for r in search.sorted_rows(cells, "c", True).collect()] == [3, 4, 0, 1, 2]
    with pytest.raises(ValueError):
        search.matches(F.col("c"), "a|b", "regex")
