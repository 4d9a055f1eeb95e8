"""Queries over values: conversions of the older versions, formulas, text, time, bits, names and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions import bits, conversions, expressions, ieee, text
from gaugeline.functions.conversions import Conversion
from gaugeline.operators import algebra, bus, multifile, search, series, stats, windows, xy
from gaugeline.operators.viewport import Viewport
from gaugeline.plans.workspace import Workspace
from gaugeline.queries import DAY, EV, T0, _add, _conversion, events, one, seconds, table

# -- conversions of versions 2 and 3 -----------------------------------------------------------------------

_conversion("linear3", Conversion("linear3", (0.25, -40.0)), "k * 0.25 - 40")
_conversion("interpolated3", Conversion("interpolated3", keys=(10, 50, 80), results=(100, 200, 50)), "CASE WHEN k <= 10 THEN 100 WHEN k <= 50 THEN 100 + (k - 10) * 2.5 WHEN k <= 80 THEN 200 - (k - 50) * 5 ELSE 50 END")
_conversion("nearest3", Conversion("nearest3", keys=(10, 20, 60), results=(1, 2, 6)), "CASE WHEN k <= 15 THEN 1 WHEN k <= 40 THEN 2 ELSE 6 END")
_conversion("formula3", Conversion("formula3", text="X1*X1-3*X1+1"), "k * k - 3 * k + 1")
_conversion("value_to_text3", Conversion("value_to_text3", keys=(0, 1, 7), results=("off", "on", "seven")), "CASE k WHEN 0 THEN 'off' WHEN 1 THEN 'on' WHEN 7 THEN 'seven' ELSE '' END", None)
_conversion("polynomial3_short", Conversion("polynomial3", (4, 0, 0, 2, 0, 0)), "2 * k / 4")
_conversion("rational3_short", Conversion("rational3", (0, 5, 0, 0, 0, 2)), "k * 5 / 2")
_conversion("exponential3_other", Conversion("exponential3", (0, 0, 300, 50, 2, 1, -7)), "exp((300 / (k + 7) - 1) / 50) / 2")
_conversion("logarithmic3_other", Conversion("logarithmic3", (0, 0, 900, 2, 3, 1, -7)), "ln((900 / (k + 7) - 1) / 2) / 3")
_conversion("functions", Conversion("formula", text="sinh(x/50)+cosh(x/50)*tanh(x)+exp(-x)"), "sinh(k / 50) + cosh(k / 50) * tanh(k) + exp(-k)")
_conversion("angles", Conversion("formula", text="tan(x/100)+asin(x/200)+acos(x/200)-atan(x)*cos(x)"), "tan(k / 100) + asin(k / 200) + acos(k / 200) - atan(k) * cos(k)")

_LOG = "CASE WHEN x > 0 THEN {f}(x) WHEN x = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END"


@_add("formula_logarithms", f"WITH k AS (SELECT event_id, (json_extract(props, '$.k'))::DOUBLE - 50 AS x FROM events) SELECT event_id, {_LOG.format(f='ln')} AS natural, {_LOG.format(f='log10')} AS decimal FROM k")
def _(spark, sf):
    x = F.get_json_object("props", "$.k").cast("double") - 50
    return table(spark, sf, "events").select("event_id", expressions.formula("ln(x)", x).alias("natural"), expressions.formula("log10(x)", x).alias("decimal"))


@_add("conversion_refused", "SELECT * FROM (VALUES ('algebra 99', true), ('linear', false)) AS x(kind, refused)")
def _(spark, sf):
    out = []
    for c, kind in ((Conversion("algebra 99"), "algebra 99"), (Conversion("linear", (1.0, 0.0)), "linear")):
        try:
            conversions.physical(F.lit(1.0), c)
            out.append((kind, False))
        except conversions.UnsupportedConversion:
            out.append((kind, True))
    return spark.createDataFrame(out, "kind string, refused boolean")


@_add("conversion_described", "SELECT * FROM (VALUES ('0.25 * x + -40'), ('X1^2'), ('value to text, 2 entries')) AS x(line)")
def _(spark, sf):
    kinds = [Conversion("linear", (0.25, -40.0)), Conversion("formula", text="X1^2"), Conversion("value_to_text", keys=(0, 1), results=("a", "b"))]
    return spark.createDataFrame([(conversions.described(c),) for c in kinds], "line string")


# -- text and time ------------------------------------------------------------------------------------------

_HEX = "lpad(lower(to_hex(user_id)), 4, '0')"


@_add("bus_texts", f"SELECT event_id, upper({_HEX}[1:2]) || ' ' || upper({_HEX}[3:4]) AS hex, {_HEX}[1:2] || ':' || {_HEX}[3:4] AS mac FROM events")
def _(spark, sf):
    data = F.unhex(F.lpad(F.hex(F.col("user_id").cast("long")), 4, "0"))
    return table(spark, sf, "events").select("event_id", bus.hex_bytes(data).alias("hex"), bus.mac_text(data).alias("mac"))


@_add("text_decoded", "SELECT doc_id, split_part(text[1:200], chr(10), 1) AS latin, text[1:200] AS wide, text[1:200] AS eight FROM documents")
def _(spark, sf):
    cut = F.substring(F.coalesce("text", F.lit("")), 1, 200)
    line = F.substring_index(cut, "\n", 1)
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    # the first line ends at a NUL; charsets as recordings use them
    ended = F.concat(F.encode(line, "UTF-16LE"), F.lit(b"\0\0"), F.encode(F.lit("rest"), "UTF-16LE"))
    return d.select("doc_id", text.decoded(ended, "utf-16-le").alias("latin"), text.decoded(F.encode(cut, "UTF-16BE"), "utf-16-be").alias("wide"), text.decoded(F.encode(cut, "UTF-8"), "utf-8").alias("eight"))


@_add("text_decoded_latin", "SELECT n_nationkey, n_name AS name FROM nation")
def _(spark, sf):
    raw = F.concat(F.encode("n_name", "ISO-8859-1"), F.lit(b"\0\xff"))
    return table(spark, sf, "nation").select("n_nationkey", text.decoded(raw, "latin-1").alias("name"))


@_add("parsed_ids", "SELECT event_id, user_id::BIGINT AS hexed, user_id::BIGINT AS plain, NULL::BIGINT AS bad FROM events")
def _(spark, sf):
    hexed = F.concat(F.lit(" 0x"), F.hex(F.col("user_id").cast("long")))
    return table(spark, sf, "events").select("event_id", text.parsed_id(hexed).alias("hexed"), text.parsed_id(F.col("user_id").cast("string")).alias("plain"), text.parsed_id(F.concat(F.lit("x"), F.col("user_id").cast("string"))).alias("bad"))


@_add("csv_cells", """SELECT doc_id, CASE WHEN contains(text, ',') OR contains(text, '"') OR contains(text, chr(10)) OR contains(text, chr(13)) THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS cell FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.csv_cell(F.col("text")).alias("cell"))


@_add("headers", "SELECT * FROM (VALUES ('Speed [km/h]'), ('Gear')) AS x(header)")
def _(spark, sf):
    return spark.createDataFrame([(text.headed("Speed", "km/h"),), (text.headed("Gear", ""),)], "header string")


@_add("numbers_displayed", "SELECT p_partkey, CASE WHEN p_retailprice = 0 THEN 0.0 ELSE round(p_retailprice, 5 - floor(log10(p_retailprice))::INTEGER) END AS shown FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.displayed(F.col("p_retailprice").cast("double")).cast("double").alias("shown"))


@_add("iso_times", "SELECT event_id, strftime(make_timestamp(epoch_us(ts)), '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0'), '0') END || 'Z' AS iso FROM events")
def _(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", text.iso_time(F.round(seconds(e, "ts") * 1e6).cast("long") * 1000).alias("iso"))


@_add("absolute_seconds", f"SELECT event_id, round(epoch_us(ts) / 1e6, 5) AS absolute, {T0}::DOUBLE AS start, (60 + user_id % 2 * 60)::INTEGER AS utc_offset FROM events")
def _(spark, sf):
    e = table(spark, sf, "events")
    start = F.lit(int(T0) * 1_000_000_000)
    offset = text.utc_offset_minutes(F.lit(60), (F.col("user_id") % 2 * 60).cast("int"))
    return e.select("event_id", F.round(text.absolute_seconds(seconds(e, "ts") - T0, start), 5).alias("absolute"), text.unix_seconds(start).alias("start"), offset.cast("int").alias("utc_offset"))


@_add("canopen_times", "SELECT o_orderkey, (epoch_us(o_orderdate) * 1000 + 7 * 3600000000000 + 11 * 60000000000 + 13 * 1000000)::BIGINT AS date_ns, ((o_orderkey % 9000 + 5113) * 86400000 + o_orderkey % 1000)::BIGINT * 1000000 AS time_ns FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders")
    d = F.col("o_orderdate")
    date = text.canopen_date_nanos(F.year(d), F.month(d), F.day(d), F.lit(7).cast("bigint"), F.lit(11).cast("bigint"), F.lit(13).cast("bigint"))
    return o.select("o_orderkey", date.alias("date_ns"), text.canopen_time_nanos((F.col("o_orderkey") % 1000).cast("bigint"), F.col("o_orderkey") % 9000).alias("time_ns"))


@_add("comment_paths", "SELECT r_regionkey, r_name AS comment, 'v' || r_regionkey AS vendor FROM region")
def _(spark, sf):
    # a comment is one text of a file's structure, read on the driver; regions stand for files
    rows = [(r["r_regionkey"], f"<HDcomment><TX>{r['r_name']}</TX><common_properties><e name='vendor'>v{r['r_regionkey']}</e></common_properties></HDcomment>") for r in table(spark, sf, "region").collect()]
    out = [(k, text.comment_text(x), text.metadata_map(x)["HDcomment/common_properties/e/vendor"]) for k, x in rows]
    return spark.createDataFrame(out, "r_regionkey int, comment string, vendor string")


# -- bits ----------------------------------------------------------------------------------------------------


@_add("j1939_parts", "WITH e AS (SELECT event_id, (419364096 + user_id * 7919)::BIGINT AS id FROM events) SELECT event_id, id & 255 AS source, id & 536870911 AS masked, CASE WHEN (id >> 16) & 255 < 240 THEN (id >> 8) & 261888 ELSE (id >> 8) & 262143 END AS pgn FROM e")
def _(spark, sf):
    i = (F.lit(419364096) + F.col("user_id") * 7919).cast("bigint")
    return table(spark, sf, "events").select("event_id", bits.source_address(i).alias("source"), bits.masked_id(i).alias("masked"), bits.pgn(i).alias("pgn"))


@_add("trimmed_payload", "SELECT event_id, lpad(lower(to_hex(user_id)), 8, '0')[1:2 * least(4, user_id % 6)] AS data FROM events")
def _(spark, sf):
    data = F.unhex(F.lpad(F.hex(F.col("user_id").cast("long")), 8, "0"))
    return table(spark, sf, "events").select("event_id", F.lower(F.hex(bits.trimmed(data, (F.col("user_id") % 6).cast("long")))).alias("data"))


@_add("uniform_width", "SELECT lang, CASE WHEN min(octet_length(encode(lang || source))) = max(octet_length(encode(lang || source))) THEN min(octet_length(encode(lang || source))) END::BIGINT AS width FROM documents WHERE text IS NOT NULL GROUP BY lang")
def _(spark, sf):
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("lang", F.concat("lang", "source").cast("binary").alias("data"))
    return stats.uniform_width(d, "data", ["lang"])


# -- expressions ------------------------------------------------------------------------------------------------

_NEAREST = """a AS (SELECT idx, t, v FROM ev WHERE series = 'click'), b AS (SELECT idx, t, v FROM ev WHERE series = 'view'),
p AS (SELECT a.idx, a.t, a.v, x.t AS pt, x.v AS pv FROM a ASOF LEFT JOIN b x ON a.t > x.t), n AS (SELECT p.*, x.t AS nt, x.v AS nv FROM p ASOF LEFT JOIN b x ON p.t <= x.t),
m AS (SELECT idx, t, v AS a, CASE WHEN pt IS NOT NULL AND (nt IS NULL OR t - pt <= nt - t) THEN pv ELSE nv END AS b FROM n)"""


@_add("computed_web", f"WITH {EV}, {_NEAREST} SELECT idx, t, round(greatest(a, b) + sqrt(abs(a - b)) - least(a, 20), 6) AS v FROM m")
def _(spark, sf):
    w = Workspace(spark)
    w.add_series("a.x", one(spark, sf, "click"))
    w.add_series("b", one(spark, sf, "view"))
    return w.evaluate("max(a.x, [b]) + sqrt(abs(a.x - b)) - min(a.x, 20)", web=True).select("idx", "t", F.round("v", 6).alias("v"))


@_add("computed_defined", f"WITH {EV}, a AS (SELECT idx, t, v, valid FROM ev WHERE series = 'click') SELECT idx, t, round((v * 2 + 1) * 3, 6) AS v FROM a")
def _(spark, sf):
    w = Workspace(spark)
    w.add_series("base", one(spark, sf, "click"))
    w.define("twice", "base * 2 + 1")
    out = w.evaluate("twice * 3")
    w.remove("twice")
    return out.select("idx", "t", F.round("v", 6).alias("v"))


@_add("ieee_extremes", "SELECT event_id, greatest(x, 40) AS hi, CASE WHEN x = 7 THEN 40 ELSE least(x, 40) END AS lo, CASE WHEN x = 0 THEN 'inf'::DOUBLE ELSE round(1 / x, 9) END AS inverse FROM (SELECT event_id, (user_id % 60)::DOUBLE AS x FROM events)")
def _(spark, sf):
    x = (F.col("user_id") % 60).cast("double")
    gone = F.when(x == 7, F.lit(float("nan"))).otherwise(x)
    return table(spark, sf, "events").select("event_id", ieee.largest(gone, F.lit(40.0)).alias("hi"), ieee.smallest(gone, F.lit(40.0)).alias("lo"), F.round(ieee.div(1.0, x), 9).alias("inverse"))


# -- names ------------------------------------------------------------------------------------------------------


def _catalog(spark, sf):
    """Parts as channels: names repeat over groups (brands)."""
    return table(spark, sf, "part").select(F.col("p_name").alias("name"), F.expr("int(p_size)").alias("dg"), F.lit(0).alias("cg"), F.col("p_partkey").cast("int").alias("cn"), F.col("p_brand").alias("unit"))


@_add("search_exact", "SELECT DISTINCT p_name AS name FROM part WHERE p_name = 'red widget'")
def _(spark, sf):
    return search.names(_catalog(spark, sf), "red widget", "exact")


@_add("channel_places", "SELECT p_name AS name, p_size::INTEGER AS dg, 0 AS cg, p_partkey::INTEGER AS cn FROM part WHERE p_name = 'red widget'")
def _(spark, sf):
    return search.locate(_catalog(spark, sf), "red widget").drop("unit")


@_add("channel_first", "(SELECT 'exact' AS how, p_partkey::INTEGER AS cn FROM part WHERE p_name = 'red widget' ORDER BY p_size, p_partkey LIMIT 1) UNION ALL (SELECT 'reference', p_partkey::INTEGER FROM part WHERE lower(p_name) = 'red widget' ORDER BY p_size, p_partkey LIMIT 1)")
def _(spark, sf):
    c = _catalog(spark, sf)
    return search.find(c, "red widget").select(F.lit("exact").alias("how"), "cn").unionByName(search.find_by_reference(c, "RED Widget").select(F.lit("reference").alias("how"), "cn"))


@_add("tree_filter", "SELECT p_partkey::INTEGER AS cn FROM part WHERE contains(lower(p_name), 'brand#1') OR contains(lower(p_brand), 'brand#1')")
def _(spark, sf):
    return search.tree_filter(_catalog(spark, sf), "bRand#1").select("cn")


@_add("channels_selected", "SELECT * FROM (VALUES (0, 'NATION_3', 1), (1, 'NATION_7', 2), (2, 'NATION_1', 0)) AS x(place, name, dg)")
def _(spark, sf):
    c = table(spark, sf, "nation").where("n_nationkey < 12").select(F.col("n_name").alias("name"), F.expr("n_nationkey div 3").cast("int").alias("dg"), F.lit(0).alias("cg"), F.expr("n_nationkey % 3").cast("int").alias("cn"))
    got = search.select_channels(c, ["NATION_3", ("NATION_7", 2), (0, 0, 1)])
    return spark.createDataFrame([(i, r["name"], r["dg"]) for i, r in enumerate(got)], "place int, name string, dg int")


@_add("channels_matching", "SELECT n_name AS name FROM nation WHERE n_nationkey % 5 = 2")
def _(spark, sf):
    c = table(spark, sf, "nation").select(F.col("n_name").alias("name"), "n_nationkey")
    return search.channels_matching(c, lambda r: r["n_nationkey"] % 5 == 2).select("name")


@_add("table_view", "SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey)::BIGINT AS place FROM customer WHERE contains(lower(c_mktsegment), 'build')")
def _(spark, sf):
    from pyspark.sql import Window as W

    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    view = search.table_view(c, "BUILD", "c_acctbal", True, "c_custkey")
    # the order of a view is its rank
    return view.withColumn("place", F.row_number().over(W.orderBy(*search.sort_keys(F.col("c_acctbal"), True), "c_custkey")).cast("long")).select("c_custkey", "c_name", "place")


@_add("gps_names", "SELECT * FROM (VALUES ('GPS_Lat', 'gps.londeg'), ('vboxlatitude', 'Longitude')) AS x(lat, lon)")
def _(spark, sf):
    sets = [[("speed", 0, 0), ("GPS_Lat", 0, 0), ("gps.londeg", 0, 0), ("lat_accel", 0, 0)], [("vboxlatitude", 0, 0), ("distance_lon", 0, 0), ("Longitude", 1, 0)]]
    return spark.createDataFrame([tuple(c[0] for c in xy.gps_pairs(s)) for s in sets], "lat string, lon string")


# -- several files, windows ---------------------------------------------------------------------------------------


@_add("structure_checked", "SELECT * FROM (VALUES ('same', true), ('other order', true), ('one more', false), ('renamed', false)) AS x(what, fits)")
def _(spark, sf):
    names = [r["n_name"] for r in table(spark, sf, "nation").orderBy("n_nationkey").limit(10).collect()]
    cases = {"same": [names], "other order": [names[::-1]], "one more": [[*names, names[0]]], "renamed": [["x", *names[1:]]]}
    out = []
    for what, other in cases.items():
        try:
            multifile.check_structure([[names], other])
            out.append((what, True))
        except series.StructureError:
            out.append((what, False))
    return spark.createDataFrame(out, "what string, fits boolean")


@_add("compare_offset", "SELECT * FROM (VALUES ('absolute', 1.5::DOUBLE), ('own zero', 0.0::DOUBLE)) AS x(how, offset_s)")
def _(spark, sf):
    a, b = int(T0 * 1e9), int(T0 * 1e9) + 1_500_000_000
    return spark.createDataFrame([("absolute", multifile.compare_offset(a, b, True)), ("own zero", multifile.compare_offset(a, b, False))], "how string, offset_s double")


@_add("viewport", "SELECT * FROM (VALUES ('zoom', 2.5::DOUBLE, 7.5::DOUBLE), ('pan', 90.0, 100.0), ('between', 3.0, 8.0)) AS x(what, lo, hi)")
def _(spark, sf):
    v = Viewport(0, 10, 0, 100)
    got = {"zoom": v.zoom(2, 5), "pan": v.pan(500), "between": v.between(8, 3)}
    return spark.createDataFrame([(k, float(w.start), float(w.end)) for k, w in got.items()], "what string, lo double, hi double")


@_add("xy_point", f"""WITH {EV}, a AS (SELECT t, v, valid FROM ev WHERE series = 'click' AND valid), q AS (SELECT t, v FROM a ORDER BY abs(t - {T0 + 5 * DAY}), t LIMIT 1) SELECT t, v AS x, 2 * v AS y FROM q""")
def _(spark, sf):
    a = one(spark, sf, "click").where("valid")
    pairs, _dropped = xy.pair(a, a.withColumn("v", F.col("v") * 2))
    return xy.point_at(pairs, T0 + 5 * DAY).select("t", "x", "y")


@_add("axis_faults_all", f"WITH {EV}, m AS (SELECT series, idx, CASE WHEN idx % 97 = 3 THEN 'inf'::DOUBLE WHEN idx % 89 = 5 THEN t - 1e6 ELSE t END AS t, valid FROM ev), l AS (SELECT *, lag(t) OVER (PARTITION BY series ORDER BY idx) AS b FROM m) SELECT series, idx, CASE WHEN NOT valid THEN 'invalid stamp' WHEN t = 'inf'::DOUBLE THEN 'not finite' ELSE 'decreasing' END AS reason FROM l WHERE NOT valid OR t = 'inf'::DOUBLE OR t < b")
def _(spark, sf):
    e = events(spark, sf)
    t = F.when(F.col("idx") % 97 == 3, F.lit(float("inf"))).when(F.col("idx") % 89 == 5, F.col("t") - 1e6).otherwise(F.col("t"))
    return series.axis_faults(e.withColumn("t", t)).select("series", "idx", "reason")


_CHANGES = "l AS (SELECT series, idx, t, CASE WHEN valid THEN (user_id % 3)::VARCHAR END AS label FROM (SELECT event_type AS series, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1)::BIGINT AS idx, epoch_us(ts) / 1e6 AS t, event_id % 11 <> 0 AS valid, user_id FROM events)), k AS (SELECT *, lag(idx) OVER w IS NULL OR lag(label) OVER w IS DISTINCT FROM label OR lead(idx) OVER w IS NULL AS keep FROM l WINDOW w AS (PARTITION BY series ORDER BY idx))"


@_add("label_runs_cut", f"WITH {_CHANGES}, r AS (SELECT series, idx, t, label, row_number() OVER (PARTITION BY series ORDER BY idx) AS r, count(*) OVER (PARTITION BY series) AS n FROM k WHERE keep) SELECT series, idx, t, label, n > 60 AS truncated FROM r WHERE r <= 60")
def _(spark, sf):
    e = table(spark, sf, "events")
    s = series.series_from(e, F.col("event_type"), seconds(e, "ts"), (F.col("user_id") % 3).cast("string"), ["ts", "event_id"], F.col("event_id") % 11 != 0, bucket=DAY)
    return windows.label_runs(s, 40)


@_add("constant_channel", "SELECT * FROM (VALUES (0.0::DOUBLE, 7.5::DOUBLE, true), (1.0, 7.5, true)) AS x(t, v, valid)")
def _(spark, sf):
    return algebra.constant(spark, 7.5)
