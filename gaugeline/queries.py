"""Queries over the driver's tables, one or more for each operator, with the equal DuckDB SQL.

``events`` is the main series table: key ``event_type``, time in seconds, value ``value``; samples whose
id is divisible by 11 count as invalid. Orders give a second series, types and roles give labels.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeline.functions import bits, conversions, expressions, ieee, text
from gaugeline.functions.conversions import Conversion
from gaugeline.operators import algebra, asof, multifile, resample, search, series, stats, windows, xy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DAY = 86_400.0
T0 = 1_704_067_200.0  # 2024-01-01, the first day of the events


def _add(name: str, sql: str | None = None):
    def enter(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return enter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(df: DataFrame, column: str) -> Column:
    """Seconds since 1970 of a timestamp with or without zone."""
    kind = dict(df.dtypes)[column]
    c = F.col(column)
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c) / 1e6
    return F.unix_micros(c) / 1e6


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return series.series_from(e, F.col("event_type"), seconds(e, "ts"), F.col("value"), ["ts", "event_id"], F.col("event_id") % 11 != 0, bucket=DAY)


def one(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return events(spark, sf_dir).where(F.col("series") == kind).withColumn("series", F.lit("s"))


EV = """ev AS (SELECT event_type AS series, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1)::BIGINT AS idx,
 epoch_us(ts) / 1e6 AS t, value AS v, event_id % 11 <> 0 AS valid FROM events)"""


# -- cuts, statistics ----------------------------------------------------------------------------------


@_add("cut_inclusive", f"WITH {EV} SELECT series, idx, t, v, valid FROM ev WHERE t BETWEEN {T0 + 3 * DAY} AND {T0 + 5 * DAY}")
def _(spark, sf):
    return series.cut(events(spark, sf), T0 + 3 * DAY, T0 + 5 * DAY)


@_add("series_stats", f"""WITH {EV}, u AS (SELECT *, CASE WHEN valid AND isfinite(v) THEN v END AS x FROM ev)
SELECT series, count(*)::BIGINT AS samples, count(*) FILTER (WHERE valid)::BIGINT AS valid_samples, (count(*) - count(x))::BIGINT AS excluded,
 count(*) FILTER (WHERE valid AND NOT isfinite(v))::BIGINT AS nan_inf, min(x) AS min, max(x) AS max, max(x) - min(x) AS peak_to_peak, round(avg(x), 6) AS mean,
 round(stddev_pop(x), 6) AS std, round(median(x), 6) AS median, round(quantile_cont(x, 0.05), 6) AS p5, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.75), 6) AS p75,
 round(quantile_cont(x, 0.95), 6) AS p95, arg_min(v, idx) FILTER (WHERE valid) AS first, arg_max(v, idx) FILTER (WHERE valid) AS last, arg_min(t, idx) AS t_first, arg_max(t, idx) AS t_last,
 round(arg_max(t, idx) - arg_min(t, idx), 6) AS duration, round((count(*) - 1) / (arg_max(t, idx) - arg_min(t, idx)), 9) AS rate
FROM u GROUP BY series""")  # fmt: skip
def _(spark, sf):
    out = stats.series_stats(events(spark, sf))
    for c in ("mean", "std", "median", "p5", "p25", "p75", "p95", "duration"):
        out = out.withColumn(c, F.round(c, 6))
    return out.withColumn("rate", F.round("rate", 9))


@_add("min_max_all", f"WITH {EV} SELECT series, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean FROM ev GROUP BY series")
def _(spark, sf):
    e = events(spark, sf)
    return stats.min_max(e).join(stats.mean(e), "series").withColumn("mean", F.round("mean", 6))


@_add("percentile_90", f"WITH {EV} SELECT series, round(quantile_cont(v, 0.9), 6) AS percentile FROM ev WHERE valid GROUP BY series")
def _(spark, sf):
    return stats.percentile(events(spark, sf), 0.9).withColumn("percentile", F.round("percentile", 6))


@_add("histogram50", f"""WITH {EV}, u AS (SELECT * FROM ev WHERE valid), e AS (SELECT series, min(v) AS lo, max(v) AS hi FROM u GROUP BY series HAVING max(v) > min(v)),
h AS (SELECT u.series, least(floor((v - lo) / ((hi - lo) / 50)), 49)::INTEGER AS bin, count(*) AS n FROM u JOIN e USING (series) GROUP BY ALL)
SELECT e.series, b::INTEGER AS bin, round(lo + b * ((hi - lo) / 50), 6) AS low, coalesce(n, 0)::BIGINT AS n FROM e CROSS JOIN range(50) r(b) LEFT JOIN h ON h.series = e.series AND h.bin = b""")  # fmt: skip
def _(spark, sf):
    return stats.histogram(events(spark, sf)).withColumn("low", F.round("low", 6))


@_add("region_stats", f"""WITH {EV}, u AS (SELECT series, CASE WHEN valid THEN v END AS x FROM ev WHERE t BETWEEN {T0 + 2 * DAY} AND {T0 + 9 * DAY})
SELECT series, count(x)::BIGINT AS n, (count(*) - count(x))::BIGINT AS excluded, min(x) AS min, max(x) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM u GROUP BY series""")
def _(spark, sf):
    return stats.region_stats(events(spark, sf), T0 + 9 * DAY, T0 + 2 * DAY).withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@_add("window_stats", f"""WITH {EV}, u AS (SELECT *, CASE WHEN valid THEN v END AS x, t BETWEEN {T0 + DAY} AND {T0 + 4 * DAY} AS i FROM ev)
SELECT series, count(x) FILTER (WHERE i)::BIGINT AS count, count(*) FILTER (WHERE i AND NOT valid)::BIGINT AS invalid, min(x) FILTER (WHERE i) AS min, max(x) FILTER (WHERE i) AS max,
 round(avg(x) FILTER (WHERE i), 6) AS mean, arg_min(x, idx) FILTER (WHERE i AND valid) AS first, arg_max(x, idx) FILTER (WHERE i AND valid) AS last, min(t) FILTER (WHERE i) AS t0, max(t) FILTER (WHERE i) AS t1
FROM u GROUP BY series""")  # fmt: skip
def _(spark, sf):
    return stats.window_stats(events(spark, sf), T0 + DAY, T0 + 4 * DAY).withColumn("mean", F.round("mean", 6))


@_add("label_durations", """WITH l AS (SELECT user_id % 10 AS series, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS idx, epoch_us(ts) / 1e6 AS t, event_type AS label, event_id % 11 <> 0 AS valid FROM events),
d AS (SELECT series, CASE WHEN valid THEN label END AS label, greatest(coalesce(lead(t) OVER (PARTITION BY series ORDER BY idx) - t, 0), 0) AS d FROM l)
SELECT series, label, count(*)::BIGINT AS samples, round(sum(d), 3) AS seconds FROM d GROUP BY ALL""")  # fmt: skip
def _(spark, sf):
    return stats.label_durations(labels(spark, sf)).withColumn("seconds", F.round("seconds", 3))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """Event types as a text series for every tenth of the users."""
    e = table(spark, sf, "events")
    return series.series_from(e, F.col("user_id") % 10, seconds(e, "ts"), F.col("event_type"), ["ts", "event_id"], F.col("event_id") % 11 != 0, bucket=DAY)


@_add("label_runs", """WITH l AS (SELECT user_id % 10 AS series, (row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) - 1)::BIGINT AS idx, epoch_us(ts) / 1e6 AS t, CASE WHEN event_id % 11 <> 0 THEN event_type END AS label FROM events),
m AS (SELECT *, lag(label) OVER w AS b, lag(idx) OVER w AS bi, lead(idx) OVER w AS ai FROM l WINDOW w AS (PARTITION BY series ORDER BY idx))
SELECT series, idx, t, label, false AS truncated FROM m WHERE bi IS NULL OR ai IS NULL OR b IS DISTINCT FROM label""")  # fmt: skip
def _(spark, sf):
    return windows.label_runs(labels(spark, sf))


@_add("text_transitions", """WITH l AS (SELECT user_id % 10 AS series, (row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) - 1)::BIGINT AS idx, epoch_us(ts) / 1e6 AS t, event_type AS label FROM events),
m AS (SELECT *, lag(label) OVER w IS DISTINCT FROM label OR lag(idx) OVER w IS NULL AS new, lead(idx) OVER w IS NULL AS fin FROM l WINDOW w AS (PARTITION BY series ORDER BY idx)),
k AS (SELECT *, sum(new::INT) OVER (PARTITION BY series ORDER BY idx) - 1 AS i, sum(new::INT) OVER (PARTITION BY series) AS n FROM m)
SELECT series, idx, t, label FROM k WHERE (new AND i % greatest(1, ceil(n / 49.0)) = 0) OR fin""")  # fmt: skip
def _(spark, sf):
    return windows.text_transitions(labels(spark, sf), 50)


@_add("cursor_measurement", f"""WITH {EV}, q AS (SELECT unnest([{T0 + DAY}, {T0 + 10 * DAY}]) AS q), n AS (SELECT series, q, arg_min(t, (abs(t - q), t, idx)) AS at, arg_min(CASE WHEN valid THEN v ELSE NULL END, (abs(t - q), t, idx)) AS x, min((abs(t - q), t, idx)) AS k FROM ev, q GROUP BY ALL),
v AS (SELECT n.series, n.q, n.at, CASE WHEN ev.valid THEN ev.v END AS x FROM n JOIN ev ON ev.series = n.series AND ev.t = n.at)
SELECT a.series, a.at AS ta, b.at AS tb, a.x AS va, b.x AS vb, b.at - a.at AS dt, b.x - a.x AS dv FROM v a JOIN v b ON a.series = b.series AND a.q < b.q""")  # fmt: skip
def _(spark, sf):
    return stats.cursor(events(spark, sf), T0 + DAY, T0 + 10 * DAY)


@_add("pre_aggregated", f"WITH {EV} SELECT series, floor(t / 3600)::BIGINT AS slot, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max FROM ev GROUP BY ALL")
def _(spark, sf):
    return stats.pre_aggregated(events(spark, sf), 3600.0).withColumn("mean", F.round("mean", 6)).withColumn("slot", F.col("slot").cast("long"))


@_add("valid_count", f"WITH {EV} SELECT series, count(*)::BIGINT AS samples, count(*) FILTER (WHERE valid)::BIGINT AS valid_samples FROM ev GROUP BY series")
def _(spark, sf):
    return series.valid_count(events(spark, sf))


@_add("axis_faults", """WITH l AS (SELECT o_orderstatus AS series, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1)::BIGINT AS idx, epoch_us(o_orderdate) / 1e6 AS t FROM orders),
m AS (SELECT *, lag(t) OVER (PARTITION BY series ORDER BY idx) AS b FROM l) SELECT series, idx, t, 'decreasing' AS reason FROM m WHERE t < b""")  # fmt: skip
def _(spark, sf):
    o = table(spark, sf, "orders")
    return series.axis_faults(series.series_from(o, F.col("o_orderstatus"), seconds(o, "o_orderdate"), F.col("o_totalprice"), ["o_orderkey"]))


# -- as-of, resampling ------------------------------------------------------------------------------------

_GRID = "g AS (SELECT series, min(t) AS lo, max(t) AS hi FROM ev GROUP BY series), tg AS (SELECT series, lo + i * {step} AS t FROM g, LATERAL (SELECT unnest(range(0, floor((hi - lo) / {step} + {step} * 1e-6)::BIGINT + 1)) AS i))"
_ASOF = """p AS (SELECT tg.series, tg.t, e.v AS pv, e.t AS pt, e.valid AS pk FROM tg ASOF LEFT JOIN ev e ON tg.series = e.series AND tg.t >= e.t),
pn AS (SELECT p.*, e.v AS nv, e.t AS nt FROM p ASOF LEFT JOIN ev e ON p.series = e.series AND p.t < e.t),
f AS (SELECT series, arg_min(v, idx) AS fv, min(t) AS ft, arg_min(valid, idx) AS fk FROM ev GROUP BY series)"""
_LINEAR = "CASE WHEN pt IS NULL OR pn.t <= ft THEN fv WHEN nt IS NULL THEN pv ELSE pv * (1 - (pn.t - pt) / (nt - pt)) + nv * ((pn.t - pt) / (nt - pt)) END"


@_add("resample_hold", f"WITH {EV}, {_GRID.format(step=7200.0)}, {_ASOF} SELECT pn.series, round(pn.t, 6) AS t, coalesce(pv, fv) AS v, coalesce(pk, fk) AS valid FROM pn JOIN f USING (series)")
def _(spark, sf):
    return resample.resample(events(spark, sf), 7200.0, "hold").withColumn("t", F.round("t", 6))


@_add("resample_linear", f"WITH {EV}, {_GRID.format(step=7200.0)}, {_ASOF} SELECT pn.series, round(pn.t, 6) AS t, round({_LINEAR}, 6) AS v, coalesce(pk, fk) AS valid FROM pn JOIN f USING (series)")
def _(spark, sf):
    return resample.resample(events(spark, sf), 7200.0, "linear").withColumn("t", F.round("t", 6)).withColumn("v", F.round("v", 6))


@_add("resample_bucketed", ORACLES["resample_linear"])
def _(spark, sf):
    return resample.resample(events(spark, sf), 7200.0, "linear", bucket=DAY).withColumn("t", F.round("t", 6)).withColumn("v", F.round("v", 6))


_COMMON = "g AS (SELECT min(t) AS lo, max(t) AS hi FROM ev), tg AS (SELECT s.series, lo + i * 10800.0 AS t FROM g, (SELECT DISTINCT series FROM ev) s, LATERAL (SELECT unnest(range(0, floor((hi - lo) / 10800.0 + 10800.0 * 1e-6)::BIGINT + 1)) AS i))"


@_add("resample_batched", f"WITH {EV}, {_COMMON}, {_ASOF} SELECT pn.series, round(pn.t, 6) AS t, round({_LINEAR}, 6) AS v, coalesce(pk, fk) AS valid FROM pn JOIN f USING (series)")
def _(spark, sf):
    return resample.resample(events(spark, sf), 10800.0, "linear", common=True).withColumn("t", F.round("t", 6)).withColumn("v", F.round("v", 6))


@_add("resample_onto_orders", f"""WITH {EV}, tg AS (SELECT DISTINCT s.series, epoch_us(o_orderdate) / 1e6 + 3.0e8 AS t FROM orders, (SELECT DISTINCT series FROM ev) s), {_ASOF}
SELECT pn.series, pn.t, coalesce(pv, fv) AS v, coalesce(pk, fk) AS valid FROM pn JOIN f USING (series)""")  # fmt: skip
def _(spark, sf):
    return _onto_orders(spark, sf, table(spark, sf, "orders"))


def _onto_orders(spark: SparkSession, sf: str, o: DataFrame) -> DataFrame:
    stamps = o.select((seconds(o, "o_orderdate") + 3.0e8).alias("t")).distinct().withColumn("one", F.lit(1))
    e = events(spark, sf)
    targets = stamps.join(F.broadcast(e.select("series").distinct().withColumn("one", F.lit(1))), "one").select("series", "t")
    return resample.onto(e, targets, "hold")


_NEAR = """p AS (SELECT tg.series, tg.t, e.t AS pt, e.v AS pv, e.idx AS pi FROM tg ASOF LEFT JOIN ev e ON tg.series = e.series AND tg.t > e.t),
pn AS (SELECT p.*, e.t AS nt, e.v AS nv, e.idx AS ni FROM p ASOF LEFT JOIN ev e ON p.series = e.series AND p.t <= e.t)"""


@_add("nearest_sample", f"""WITH {EV}, {_GRID.format(step=5000.0)}, {_NEAR} SELECT series, round(t, 6) AS t, CASE WHEN pt IS NOT NULL AND (nt IS NULL OR t - pt <= nt - t) THEN pt ELSE nt END AS at,
 CASE WHEN pt IS NOT NULL AND (nt IS NULL OR t - pt <= nt - t) THEN pi ELSE ni END AS at_idx, CASE WHEN pt IS NOT NULL AND (nt IS NULL OR t - pt <= nt - t) THEN pv ELSE nv END AS v FROM pn""")  # fmt: skip
def _(spark, sf):
    e = events(spark, sf)
    return asof.nearest(e, resample.raster(e, 5000.0)).withColumn("t", F.round("t", 6))


@_add("sample_at", f"WITH {EV}, q AS (SELECT unnest([{T0 + 1e5}, {T0 + 9e5}]) AS t) SELECT series, q.t AS t, arg_min(v, (abs(ev.t - q.t), idx)) AS v, arg_min(idx, (abs(ev.t - q.t), idx)) AS at_idx FROM ev, q GROUP BY series, q.t")
def _(spark, sf):
    e = events(spark, sf)
    return asof.first_nearest(e, e.select("series").distinct().select("series", F.explode(F.array(F.lit(T0 + 1e5), F.lit(T0 + 9e5))).alias("t")))


@_add("value_at", f"WITH {EV} SELECT series, arg_max(t, idx) FILTER (WHERE valid AND t <= {T0 + 6 * DAY}) AS t, arg_max(v, idx) FILTER (WHERE valid AND t <= {T0 + 6 * DAY}) AS v FROM ev GROUP BY series")
def _(spark, sf):
    return asof.value_at(events(spark, sf), T0 + 6 * DAY)


# -- algebra -----------------------------------------------------------------------------------------------

_AB = """a AS (SELECT idx, t, v, valid FROM ev WHERE series = 'click'), b AS (SELECT idx, t, v, valid FROM ev WHERE series = 'view'),
r AS (SELECT greatest((SELECT min(t) FROM a), (SELECT min(t) FROM b)) AS lo, least((SELECT max(t) FROM a), (SELECT max(t) FROM b)) AS hi),
ts AS (SELECT t FROM (SELECT t FROM a UNION SELECT t FROM b), r WHERE t > lo AND t < hi UNION SELECT lo FROM r UNION SELECT hi FROM r),
pa AS (SELECT ts.t, x.t AS pt, x.v AS pv, x.valid AS k FROM ts ASOF LEFT JOIN a x ON ts.t >= x.t), la AS (SELECT pa.*, x.t AS nt, x.v AS nv FROM pa ASOF LEFT JOIN a x ON pa.t < x.t),
pb AS (SELECT ts.t, x.t AS pt, x.v AS pv, x.valid AS k FROM ts ASOF LEFT JOIN b x ON ts.t >= x.t), lb AS (SELECT pb.*, x.t AS nt, x.v AS nv FROM pb ASOF LEFT JOIN b x ON pb.t < x.t),
j AS (SELECT la.t, CASE WHEN la.nt IS NULL THEN la.pv ELSE la.pv * (1 - (la.t - la.pt) / (la.nt - la.pt)) + la.nv * ((la.t - la.pt) / (la.nt - la.pt)) END AS va,
 CASE WHEN lb.nt IS NULL THEN lb.pv ELSE lb.pv * (1 - (lb.t - lb.pt) / (lb.nt - lb.pt)) + lb.nv * ((lb.t - lb.pt) / (lb.nt - lb.pt)) END AS vb, la.k OR lb.k AS valid FROM la JOIN lb USING (t))"""
_KINDS: dict[str, str] = {"add": "va + vb", "sub": "va - vb", "mul": "va * vb", "div": "va / vb", "lt": "(va < vb)::DOUBLE", "le": "(va <= vb)::DOUBLE", "gt": "(va > vb)::DOUBLE", "ge": "(va >= vb)::DOUBLE", "eq": "(va = vb)::DOUBLE", "ne": "(va <> vb)::DOUBLE"}


def _binary(op: str, sql: str) -> None:
    @_add(f"align_{op}", f"WITH {EV}, {_AB} SELECT 's' AS series, (row_number() OVER (ORDER BY t) - 1)::BIGINT AS idx, t, round({sql}, 5) AS v, valid FROM j")
    def _(spark, sf):
        return algebra.combine(one(spark, sf, "click"), one(spark, sf, "view"), op).withColumn("v", ieee.rounded(F.col("v"), 5))


for _op, _sql in _KINDS.items():
    _binary(_op, _sql)


@_add("scalar_ops", f"""WITH {EV}, o AS (SELECT series, idx, unnest([{{'op': 'plus', 'v': v + 2.5}}, {{'op': 'times', 'v': v * -3}}, {{'op': 'minus_from', 'v': 10 - v}}, {{'op': 'inverse', 'v': round(1 / v, 9)}},
 {{'op': 'negative', 'v': -v}}, {{'op': 'above', 'v': (v > 100)::DOUBLE}}]) AS o FROM ev) SELECT series, idx, o.op AS op, o.v AS v FROM o""")  # fmt: skip
def _(spark, sf):
    e = events(spark, sf)
    parts = {
        "plus": algebra.scalar(e, "add", 2.5), "times": algebra.scalar(e, "mul", -3.0), "minus_from": algebra.scalar(e, "sub", 10.0, swapped=True),
        "inverse": algebra.scalar(e, "div", 1.0, swapped=True).withColumn("v", F.round("v", 9)), "negative": algebra.neg(e), "above": algebra.scalar(e, "gt", 100.0),
    }
    out = [x.select("series", "idx", F.lit(op).alias("op"), "v") for op, x in parts.items()]
    return functools.reduce(DataFrame.unionByName, out)


@_add("series_object", f"WITH {EV}, {_AB} SELECT (row_number() OVER (ORDER BY t) - 1)::BIGINT AS idx, t, round(2 * va - (-vb) / 4, 5) AS v, valid FROM j")
def _(spark, sf):
    a, b = algebra.Series(one(spark, sf, "click")), algebra.Series(one(spark, sf, "view"))
    return (2 * a - (-b) / 4).df.select("idx", "t", F.round("v", 5).alias("v"), "valid")


@_add("computed_channel", f"WITH {EV}, k AS (SELECT series, idx, v, valid, (idx % 3)::DOUBLE AS w FROM ev) SELECT series, idx, round(CASE WHEN abs(w - 1) < 1e-15 THEN 'nan'::DOUBLE ELSE (v * 2 - 4) / (w - 1) END, 6) AS v FROM k")
def _(spark, sf):
    e = events(spark, sf).withColumn("w", (F.col("idx") % 3).cast("double"))
    return e.select("series", "idx", F.round(expressions.compiled("([Value] * 2 - 4) / (w - 1)", {"Value": "v", "w": "w"}), 6).alias("v"))


@_add("computed_union", f"""WITH {EV}, a AS (SELECT t, v, valid FROM ev WHERE series = 'click'), b AS (SELECT t, v, valid FROM ev WHERE series = 'purchase'), ts AS (SELECT t FROM a UNION SELECT t FROM b),
fa AS (SELECT arg_min(v, t) AS v FROM a), fb AS (SELECT arg_min(v, t) AS v FROM b), ka AS (SELECT arg_min(valid, t) AS v FROM a), kb AS (SELECT arg_min(valid, t) AS v FROM b),
pa AS (SELECT ts.t, x.t AS pt, x.v AS pv, x.valid AS k FROM ts ASOF LEFT JOIN a x ON ts.t >= x.t), la AS (SELECT pa.*, x.t AS nt, x.v AS nv FROM pa ASOF LEFT JOIN a x ON pa.t < x.t),
pb AS (SELECT ts.t, x.t AS pt, x.v AS pv, x.valid AS k FROM ts ASOF LEFT JOIN b x ON ts.t >= x.t), lb AS (SELECT pb.*, x.t AS nt, x.v AS nv FROM pb ASOF LEFT JOIN b x ON pb.t < x.t)
SELECT 's' AS series, la.t, round(CASE WHEN la.pt IS NULL THEN (SELECT v FROM fa) WHEN la.nt IS NULL THEN la.pv ELSE la.pv * (1 - (la.t - la.pt) / (la.nt - la.pt)) + la.nv * ((la.t - la.pt) / (la.nt - la.pt)) END
 - CASE WHEN lb.pt IS NULL THEN (SELECT v FROM fb) WHEN lb.nt IS NULL THEN lb.pv ELSE lb.pv * (1 - (lb.t - lb.pt) / (lb.nt - lb.pt)) + lb.nv * ((lb.t - lb.pt) / (lb.nt - lb.pt)) END, 5) AS v,
 coalesce(la.k, (SELECT v FROM ka)) AND coalesce(lb.k, (SELECT v FROM kb)) AS valid FROM la JOIN lb USING (t)""")  # fmt: skip
def _(spark, sf):
    got = algebra.computed(expressions.compiled("a - b", {"a": "a", "b": "b"}), {"a": one(spark, sf, "click"), "b": one(spark, sf, "purchase")})
    return got.withColumn("v", F.round("v", 5))


@_add("xy_pair", f"""WITH {EV}, a AS (SELECT t, v, valid FROM ev WHERE series = 'click'), b AS (SELECT t, v, valid FROM ev WHERE series = 'view'),
o AS (SELECT a.t, a.v AS x, a.valid AS xk FROM a WHERE a.t BETWEEN (SELECT min(t) FROM b) AND (SELECT max(t) FROM b)),
p AS (SELECT o.*, y.t AS pt, y.v AS pv, y.valid AS yk FROM o ASOF LEFT JOIN b y ON o.t >= y.t), n AS (SELECT p.*, y.t AS nt, y.v AS nv FROM p ASOF LEFT JOIN b y ON p.t < y.t)
SELECT t, x, round(CASE WHEN nt IS NULL THEN pv ELSE pv * (1 - (t - pt) / (nt - pt)) + nv * ((t - pt) / (nt - pt)) END, 6) AS y FROM n WHERE xk AND yk""")  # fmt: skip
def _(spark, sf):
    pairs, _dropped = xy.pair(one(spark, sf, "click"), one(spark, sf, "view"))
    return pairs.select("t", "x", F.round("y", 6).alias("y"))


# -- viewer windows -----------------------------------------------------------------------------------------

_WIN = f"w AS (SELECT series, idx, t, v, least(floor((t - {T0}) / ({20 * DAY} / 100)), 99) AS c, count(*) OVER (PARTITION BY series) AS n FROM ev WHERE t BETWEEN {T0} AND {T0 + 20 * DAY})"


@_add("decimate_minmax", f"WITH {EV}, {_WIN}, d AS (SELECT series, unnest([arg_min(idx, (v, idx)), arg_max(idx, (v, -idx))]) AS idx FROM w WHERE n > 200 GROUP BY series, c) SELECT DISTINCT w.series, w.idx, w.t, w.v FROM w WHERE n <= 200 OR (series, idx) IN (SELECT (series, idx) FROM d)")
def _(spark, sf):
    return windows.decimate_min_max(events(spark, sf), T0, T0 + 20 * DAY, 100)


@_add("decimate_curve", f"WITH {EV}, {_WIN}, d AS (SELECT series, unnest([min(idx), arg_min(idx, (v, idx)), arg_max(idx, (v, -idx)), max(idx)]) AS idx FROM w WHERE n > 400 GROUP BY series, c) SELECT DISTINCT w.series, w.idx, w.t, w.v FROM w WHERE n <= 400 OR (series, idx) IN (SELECT (series, idx) FROM d)")
def _(spark, sf):
    return windows.decimate_curve(events(spark, sf), T0, T0 + 20 * DAY, 100)


@_add("view_window", f"""WITH {EV}, w AS (SELECT series, idx, t, v, valid, least(floor((t - {T0}) / ({20 * DAY} / 60)), 59) AS c, count(*) OVER (PARTITION BY series) AS n FROM ev WHERE t BETWEEN {T0} AND {T0 + 20 * DAY}),
d AS (SELECT series, unnest([min(idx), arg_min(idx, (v, idx)) FILTER (WHERE valid), arg_max(idx, (v, -idx)) FILTER (WHERE valid), min(idx) FILTER (WHERE NOT valid), max(idx)]) AS idx FROM w WHERE n > 300 GROUP BY series, c)
SELECT DISTINCT w.series, w.idx, w.t, CASE WHEN valid THEN v ELSE 'nan'::DOUBLE END AS v FROM w WHERE n <= 300 OR (series, idx) IN (SELECT (series, idx) FROM d WHERE idx IS NOT NULL)""")  # fmt: skip
def _(spark, sf):
    return windows.view_window(events(spark, sf), T0, T0 + 20 * DAY, 300)


@_add("valid_islands", f"""WITH {EV}, m AS (SELECT *, idx - row_number() OVER (PARTITION BY series ORDER BY idx) AS g FROM ev WHERE valid),
r AS (SELECT series, g, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS n FROM m GROUP BY series, g)
SELECT series, (row_number() OVER (PARTITION BY series ORDER BY first_idx) - 1)::BIGINT AS run, first_idx, last_idx, n FROM r""")  # fmt: skip
def _(spark, sf):
    return windows.valid_islands(events(spark, sf))


_GAPS = f"""r0 AS (SELECT series, idx, t, v, valid AND isfinite(v) AS ok FROM ev WHERE t BETWEEN {T0} AND {T0 + 20 * DAY}),
r1 AS (SELECT *, coalesce(lag(ok) OVER (PARTITION BY series ORDER BY idx) <> ok, true)::INTEGER AS new FROM r0), r2 AS (SELECT *, sum(new) OVER (PARTITION BY series ORDER BY idx) AS run FROM r1),
good AS (SELECT *, count(*) OVER (PARTITION BY series, run) AS n, row_number() OVER (PARTITION BY series, run ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY series) AS every FROM r2 WHERE ok),
g AS (SELECT *, greatest(1, n * 100 // every) AS cols FROM good), c AS (SELECT *, i * cols // n AS c FROM g),
few AS (SELECT series, idx, t, v FROM c WHERE n <= 2 * cols), d AS (SELECT series, unnest([arg_min(idx, (v, idx)), arg_max(idx, (v, -idx))]) AS idx FROM c WHERE n > 2 * cols GROUP BY series, run, c),
gaps AS (SELECT series, idx, t, 'nan'::DOUBLE AS v FROM r2 WHERE NOT ok AND new = 1)"""


@_add("decimate_gaps", f"WITH {EV}, {_GAPS} SELECT * FROM few UNION ALL (SELECT DISTINCT r0.series, r0.idx, r0.t, r0.v FROM r0 JOIN d USING (series, idx)) UNION ALL SELECT * FROM gaps")
def _(spark, sf):
    return windows.decimate_gaps(events(spark, sf), T0, T0 + 20 * DAY, 100)


@_add("page", f"WITH {EV} SELECT * FROM ev WHERE idx BETWEEN 100 AND 149")
def _(spark, sf):
    return series.page(events(spark, sf), 100, 50)


# -- several files --------------------------------------------------------------------------------------------


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """Pseudo files: the events of each ten days, each starting at its own zero."""
    e = table(spark, sf, "events")
    t = seconds(e, "ts")
    file = F.least(F.floor((t - T0) / (10 * DAY)), F.lit(2)).cast("int")
    rows = e.select(file.alias("file_index"), F.col("event_type").alias("series"), (t - T0 - file * 10 * DAY + file * 0.0).alias("t"), F.col("value").alias("v"), (F.col("event_id") % 11 != 0).alias("valid"), "event_id")
    w = W.partitionBy("file_index", "series").orderBy("t", "event_id")
    return rows.withColumn("idx", (F.row_number().over(w) - 1).cast("long")).drop("event_id")


_FL = f"""fl AS (SELECT least(floor((epoch_us(ts) / 1e6 - {T0}) / {10 * DAY}), 2)::INTEGER AS file_index, event_type AS series, epoch_us(ts) / 1e6 - {T0} AS a, value AS v, event_id % 11 <> 0 AS valid, event_id FROM events),
fi AS (SELECT file_index, series, a - file_index * {10 * DAY} AS t, v, valid, (row_number() OVER (PARTITION BY file_index, series ORDER BY a, event_id) - 1)::BIGINT AS idx FROM fl)"""


@_add("stack_files", f"WITH {_FL} SELECT file_index, series, idx, round(t + file_index * {9 * DAY}, 6) AS t, v, valid FROM fi")
def _(spark, sf):
    out = multifile.stack(_files(spark, sf), {0: 0.0, 1: 9 * DAY, 2: 18 * DAY})
    return out.withColumn("t", F.round("t", 6)).select("file_index", "series", "idx", "t", "v", "valid")


@_add("concat_shift", f"""WITH {_FL}, s AS (SELECT series, file_index, arg_min(t, idx) AS t1, arg_min(t, idx) FILTER (WHERE idx > 0) AS t2, max(t) AS tl FROM fi GROUP BY series, file_index),
a0 AS (SELECT series, 0.0 AS sh, tl + 0.0 AS e FROM s WHERE file_index = 0),
a1 AS (SELECT s.series, CASE WHEN t1 + {9 * DAY} > a0.e THEN {9 * DAY}::DOUBLE ELSE a0.e + coalesce(t2 - t1, 0.001) - t1 END AS sh, tl FROM s JOIN a0 USING (series) WHERE file_index = 1),
a2 AS (SELECT s.series, CASE WHEN t1 + {18 * DAY} > a1.tl + a1.sh THEN {18 * DAY}::DOUBLE ELSE a1.tl + a1.sh + coalesce(t2 - t1, 0.001) - t1 END AS sh FROM s JOIN a1 USING (series) WHERE file_index = 2),
sh AS (SELECT series, 0 AS file_index, sh FROM a0 UNION ALL SELECT series, 1, sh FROM a1 UNION ALL SELECT series, 2, sh FROM a2)
SELECT series, (row_number() OVER (PARTITION BY series ORDER BY file_index, idx) - 1)::BIGINT AS idx, round(t + sh, 5) AS t, v, valid FROM fi JOIN sh USING (series, file_index)""")  # fmt: skip
def _(spark, sf):
    return multifile.concatenate(_files(spark, sf), {0: 0.0, 1: 9 * DAY, 2: 18 * DAY}).withColumn("t", F.round("t", 5))


# -- conversions ---------------------------------------------------------------------------------------------

_K = "k AS (SELECT event_id, (json_extract(props, '$.k'))::DOUBLE AS k FROM events)"


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("double").alias("k"))


def _conversion(name: str, c: Conversion, sql: str, digits: int | None = 9, x: str = "k") -> None:
    @_add(f"conv_{name}", f"WITH {_K} SELECT event_id, {f'round({sql}, {digits})' if digits else sql} AS v FROM k")
    def _(spark, sf):
        v = conversions.physical(F.expr(x), c)
        return _raw(spark, sf).select("event_id", (F.round(v, digits) if digits else v).alias("v"))


_conversion("identity", Conversion("identity"), "k")
_conversion("linear", Conversion("linear", (0.25, -40.0)), "0.25 * k - 40")
_conversion("rational", Conversion("rational", (0, 2, 3, 0, 1, 7)), "(2 * k + 3) / (k + 7)")
_conversion("formula", Conversion("formula", text="2*X^2 - sqrt(abs(X1-50)) + sin(x)/pi"), "2 * k * k - sqrt(abs(k - 50)) + sin(k) / pi()")
_conversion("interpolated", Conversion("interpolated", keys=(10, 50, 80), results=(100, 200, 50)), "CASE WHEN k <= 10 THEN 100 WHEN k <= 50 THEN 100 + (k - 10) / 40 * 100 WHEN k <= 80 THEN 200 + (k - 50) / 30 * -150 ELSE 50 END")
_conversion("nearest", Conversion("nearest", keys=(10, 20, 60), results=(1, 2, 6)), "CASE WHEN k <= 15 THEN 1 WHEN k <= 40 THEN 2 ELSE 6 END")
_conversion("range_to_value", Conversion("range_to_value", keys=(0, 10, 15), upper=(10, 20, 40), results=(1, 2, 3), default=-1), "CASE WHEN k >= 15 AND k < 40 THEN 3 WHEN k >= 10 AND k < 20 THEN 2 WHEN k >= 0 AND k < 10 THEN 1 ELSE -1 END")
_conversion("value_to_text", Conversion("value_to_text", keys=(0, 1, 2), results=("off", "on", Conversion("linear", (2.0, 1.0))), default="other"), "CASE WHEN k = 0 THEN 'off' WHEN k = 1 THEN 'on' WHEN k = 2 THEN '5' ELSE 'other' END", None)
_conversion("range_to_text", Conversion("range_to_text", keys=(0, 30), upper=(30, 60), results=("low", "mid"), default="high"), "CASE WHEN k >= 30 AND k < 60 THEN 'mid' WHEN k >= 0 AND k < 30 THEN 'low' ELSE 'high' END", None)
_conversion("bitfield", Conversion("bitfield", masks=(1, 6, 8), results=("odd", Conversion("value_to_text", keys=(2, 4), results=("two", "four"), default=""), "eight"), names=("", "pair", "")), "concat_ws(' | ', CASE WHEN k::BIGINT & 1 <> 0 THEN 'odd' END, CASE k::BIGINT & 6 WHEN 2 THEN 'pair = two' WHEN 4 THEN 'pair = four' END, CASE WHEN k::BIGINT & 8 <> 0 THEN 'eight' END)", None)
_conversion("polynomial3", Conversion("polynomial3", (1, 2, 3, 4, 5, 6)), "(2 - 4 * (k - 11)) / (3 * (k - 11) - 1)")
_conversion("exponential3", Conversion("exponential3", (100, 2, 3, 0, 0, 1, 7)), "exp(((k - 7) * 1 - 3) / 100) / 2")
_conversion("logarithmic3", Conversion("logarithmic3", (2, 3, -500, 0, 0, 1, 7)), "ln(((k - 7) * 1 + 500) / 2) / 3")
_conversion("rational3", Conversion("rational3", (1, 2, 3, 0, 0, 4)), "(k * k + 2 * k + 3) / 4")
_conversion("range_to_text3", Conversion("range_to_text3", keys=(0, 10, 20), upper=(10, 20, 30), results=("a", "b", "c"), default="?"), "CASE WHEN k > 0 AND k < 10 OR k = 0 THEN 'a' WHEN k > 10 AND k < 20 THEN 'b' WHEN k > 20 AND k <= 30 THEN 'c' ELSE '?' END", None)


@_add("conv_text_tables", "SELECT event_id, CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 2.0 ELSE 'nan'::DOUBLE END AS number, CASE event_type WHEN 'click' THEN 'Klick' WHEN 'view' THEN 'Blick' ELSE '-' END AS word FROM events")
def _(spark, sf):
    e = table(spark, sf, "events")
    number = Conversion("text_to_value", keys=("click", "view"), results=(1.0, 2.0))
    word = Conversion("text_to_text", keys=("click", "view"), results=("Klick", "Blick"), default="-")
    return e.select("event_id", conversions.physical(F.col("event_type"), number).alias("number"), conversions.physical(F.col("event_type"), word).alias("word"))


# -- bus ---------------------------------------------------------------------------------------------------------


@_add("id_lookup", """WITH m AS (SELECT n_nationkey AS msg_idx, n_name AS name, (n_nationkey * 7)::BIGINT AS id FROM nation)
SELECT event_id, m.msg_idx, m.name AS message FROM events e JOIN m ON ((e.user_id + 536870912) & 536870911) = m.id""")
def _(spark, sf):
    return _matched(spark, sf, "exact", F.col("user_id") + 536870912, 7)


@_add("pgn_fallback", """WITH m AS (SELECT n_nationkey AS msg_idx, n_name AS name, (419364096 + n_nationkey * 256 + 5)::BIGINT AS id FROM nation), e AS (SELECT event_id, 419364096 + (user_id % 30) * 256 + user_id % 7 AS id FROM events)
SELECT event_id, coalesce(x.msg_idx, p.msg_idx) AS msg_idx, coalesce(x.name, p.name) AS message FROM e LEFT JOIN m x ON x.id = e.id LEFT JOIN m p ON p.id >> 8 = e.id >> 8 WHERE coalesce(x.msg_idx, p.msg_idx) IS NOT NULL""")
def _(spark, sf):
    return _matched(spark, sf, "pgn", 419364096 + (F.col("user_id") % 30) * 256 + F.col("user_id") % 7, None)


def _matched(spark: SparkSession, sf: str, matching: str, can_id: Column, step: int | None) -> DataFrame:
    from gaugeline.operators import bus

    ids = F.col("n_nationkey") * step if step else 419364096 + F.col("n_nationkey") * 256 + 5
    m = table(spark, sf, "nation").select(F.col("n_nationkey").alias("msg_idx"), F.col("n_name").alias("name"), ids.cast("long").alias("id"))
    m = m.withColumn("pgn", bits.pgn(F.col("id"))).withColumn("source", bits.source_address(F.col("id")))
    frames = table(spark, sf, "events").select("event_id", can_id.cast("long").alias("id"))
    return bus.matched(frames, m, matching).select("event_id", "msg_idx", "message")


_BYTES = "CAST(event_id * 2654435761 % 9007199254740991 AS BIGINT)"


@_add("bit_extract", f"""WITH b AS (SELECT event_id, {_BYTES} AS n FROM events) SELECT event_id, ((n >> 44) & 4095)::BIGINT AS motorola, ((n >> 5) & 2047)::BIGINT AS wide,
 (CASE WHEN (n & 255) >= 128 THEN (n & 255) - 256 ELSE n & 255 END)::BIGINT AS low_signed FROM b""")
def _(spark, sf):
    n = F.expr("(event_id * 2654435761L) % 9007199254740991L")
    data = F.unhex(F.lpad(F.hex(n), 16, "0"))  # big-endian bytes
    back = F.unhex(F.concat(*[F.substring(F.lpad(F.hex(n), 16, "0"), 15 - 2 * i, 2) for i in range(8)]))  # little-endian
    return table(spark, sf, "events").select(
        "event_id",
        bits.unsigned_field(data, 15, 12, True).cast("bigint").alias("motorola"),
        bits.unsigned_field(back, 5, 11).cast("bigint").alias("wide"),
        bits.signed(bits.unsigned_field(back, 0, 8), 8).alias("low_signed"),
    )


@_add("value_label", "SELECT e.event_id, n.n_name AS label FROM events e LEFT JOIN nation n ON n.n_nationkey = e.user_id % 40")
def _(spark, sf):
    from gaugeline.operators import bus

    n = table(spark, sf, "nation")
    tables = n.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("long"), "n_name"))).alias("labels")).withColumn("msg_idx", F.lit(0)).withColumn("sig_idx", F.lit(0))
    rows = table(spark, sf, "events").select("event_id", F.lit(0).alias("msg_idx"), F.lit(0).alias("sig_idx"), (F.col("user_id") % 40).alias("raw"))
    return bus.value_labels(rows, tables).select("event_id", "label")


# -- search, tables ------------------------------------------------------------------------------------------------


@_add("search_plain", "SELECT DISTINCT c_name AS name FROM customer WHERE contains(c_name, '00001')")
def _(spark, sf):
    return search.names(table(spark, sf, "customer").select(F.col("c_name").alias("name")), "00001", "plain")


@_add("search_wildcard", "SELECT DISTINCT p_name AS name FROM part WHERE p_name LIKE '%e%a%'")
def _(spark, sf):
    return search.names(table(spark, sf, "part").select(F.col("p_name").alias("name")), "*e*a*", "wildcard")


@_add("search_ci", "SELECT DISTINCT n_name AS name FROM nation WHERE contains(lower(n_name), 'tion_2')")
def _(spark, sf):
    return search.names(table(spark, sf, "nation").select(F.col("n_name").alias("name")), "tIon_2", "case_insensitive")


@_add("search_gui", "SELECT n_name AS name, regexp_matches(lower(n_name), 'n.*1[0-5]$') AS regex, contains(lower(n_name), 'on_1') AS within, lower(n_name) LIKE 'nat%#_2' ESCAPE '#' AS wild FROM nation WHERE regexp_matches(lower(n_name), 'n.*[1-2]')")
def _(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("name"))
    found = n.where(search.matches(F.col("name"), "N.*[1-2]", "regex"))
    return found.select("name", search.matches(F.col("name"), "n.*1[0-5]$", "regex").alias("regex"), search.matches(F.col("name"), "ON_1").alias("within"), search.matches(F.col("name"), "nAt*_2", "wildcard").alias("wild"))


@_add("table_filter", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE contains(lower(n_name), '1') OR contains(n_nationkey::VARCHAR, '1') OR contains(n_regionkey::VARCHAR, '1')")
def _(spark, sf):
    return search.filter_rows(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), "1")


@_add("table_sort_invalid_last", f"WITH {EV} SELECT series, idx, v, row_number() OVER (PARTITION BY series ORDER BY valid DESC, CASE WHEN valid THEN v END DESC, idx) AS rank FROM ev")
def _(spark, sf):
    e = events(spark, sf)
    keys = search.sort_keys(F.when(F.col("valid"), F.col("v")), descending=True)
    return e.select("series", "idx", "v", F.row_number().over(W.partitionBy("series").orderBy(*keys, "idx")).cast("long").alias("rank"))


@_add("array_element", "SELECT vec_id, embedding[4]::DOUBLE AS v, coalesce(embedding[200]::DOUBLE, 'nan'::DOUBLE) AS beyond FROM embeddings")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v"), F.lit(True).alias("valid"))
    return series.element(e, 3).select("vec_id", "v").join(series.element(e, 199).select("vec_id", F.col("v").alias("beyond")), "vec_id")


@_add("flatten_array", "SELECT vec_id, " + ", ".join(f'embedding[{8 * i + j + 1}] AS "m[{i}][{j}]"' for i in range(8) for j in range(8)) + " FROM embeddings")
def _(spark, sf):
    return series.flattened(table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("m")), (8, 8), "m")


@_add("index_master", "SELECT conv_id, turn AS idx, turn::DOUBLE AS t, role AS v FROM conversations")
def _(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("idx"), F.col("role").alias("v"))
    return series.attach_axis(c, None, ["conv_id"])


@_add("gps_track", f"WITH {EV}, n AS (SELECT max(idx) + 1 AS n FROM ev WHERE series = 'click'), a AS (SELECT idx, t, v FROM ev WHERE series = 'click'), b AS (SELECT idx, v FROM ev WHERE series = 'view') SELECT a.idx, a.t, a.v AS lat, coalesce(b.v, 'nan'::DOUBLE) AS lon FROM a LEFT JOIN b USING (idx), n WHERE a.idx % greatest(1, ceil(n / 20000.0)) = 0")
def _(spark, sf):
    return xy.gps_track(one(spark, sf, "click"), one(spark, sf, "view")).select("idx", "t", "lat", "lon")


@_add("frame_text", "SELECT event_id, regexp_replace(lpad(upper(to_hex(user_id)), 4, '0'), '(..)(..)', '\\1 \\2') AS hex, strftime(make_timestamp(epoch_us(ts)), '%Y-%m-%d %H:%M:%S') || '.' || lpad(((epoch_us(ts) // 1000) % 1000)::VARCHAR, 3, '0') AS label FROM events")
def _(spark, sf):
    from gaugeline.operators import bus

    e = table(spark, sf, "events")
    data = F.unhex(F.lpad(F.hex(F.col("user_id").cast("long")), 4, "0"))
    millis = F.floor(seconds(e, "ts") * 1000 + 1e-4).cast("long")
    return e.select("event_id", bus.hex_bytes(data).alias("hex"), text.absolute_label(millis).alias("label"))


@_add("json_samples", f"""WITH {EV} SELECT series, idx, '{{"t":' || (idx)::VARCHAR || ',"v":' || CASE WHEN valid THEN (idx * 2)::VARCHAR ELSE 'null' END || '}}' AS json FROM ev""")
def _(spark, sf):
    e = events(spark, sf)
    return e.select("series", "idx", text.sample_json(F.col("idx"), F.when(F.col("valid"), F.col("idx") * 2)).alias("json"))


@_add("same_series", "SELECT * FROM (VALUES ('shuffled', true), ('later', false), ('shorter', false)) AS x(what, same)")
def _(spark, sf):
    a = events(spark, sf)
    others = {"shuffled": a.repartition(3, "idx"), "later": a.withColumn("t", F.col("t") + 1), "shorter": a.where("idx > 0")}
    return spark.createDataFrame([(k, series.same(a, b)) for k, b in others.items()], "what string, same boolean")


from gaugeline import file_queries, value_queries  # noqa: E402, F401 - they enter their queries here
