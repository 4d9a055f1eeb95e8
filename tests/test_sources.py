"""Databases, frames, sinks, older recordings, streams, conversions and bits."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.functions import bits, conversions, expressions, text
from gaugeline.functions.conversions import Conversion
from gaugeline.operators import bus
from gaugeline.operators.series import StructureError, series_of
from gaugeline.sources import database, frames, mdf3, sinks
from gaugeline.sources.mdf4 import Mdf4, read_group
from gaugeline.sources.mdf4_write import Mdf4Writer

DBC = """VERSION "1"
NS_ :
    VAL_TABLE_
BS_:
BU_: Tester

VAL_TABLE_ States 0 "Off" 1 "On" 2 "Error" ;

BO_ 100 Mixed: 8 Tester
 SG_ Mux M : 0|8@1+ (1,0) [0|255] "" Tester
 SG_ Still : 8|16@1+ (0.1,0) [0|6553.5] "V" Tester
 SG_ Motor : 31|16@0+ (1,-100) [-100|65435] "rpm" Tester
 SG_ Ranged : 32|16@1+ (0.5,0) [0|32767.5] "kPa" Tester
 SG_ Plain m2 : 48|8@1- (1,0) [0|255] "" Tester

BO_ 2364540158 EEC1: 8 Tester
 SG_ Speed : 24|16@1+ (0.125,0) [0|8031] "rpm" Tester

BO_ 200 States: 8 Tester
 SG_ State : 0|8@1+ (1,0) [0|255] "" Tester

SG_MUL_VAL_ 100 Ranged Mux 1-3, 10-15;
BA_DEF_ SG_ "ValTable" STRING ;
BA_DEF_DEF_ "ValTable" "" ;
BA_ "ValTable" SG_ 200 State "States" ;
VAL_ 200 State 2 "Fault" ;
"""


def frames_of(spark, rows):
    return spark.createDataFrame([(i, float(i), r[0], 1, bytes(r[1])) for i, r in enumerate(rows)], "idx long, t double, id long, bus int, data binary")


def test_dbc_decoding_by_hand_and_in_bulk(spark):
    db = database.parse_dbc(DBC)
    payload = lambda m: bytes([m, 10, 0, 1, 44, 8, 0xFF, 0])
    assert dict((s, v) for s, v, _, _ in database.decode(db, 100, payload(0))) == {"Mux": 0, "Still": 1.0, "Motor": 0x012C - 100}
    assert {s for s, *_ in database.decode(db, 100, payload(2))} == {"Mux", "Still", "Motor", "Ranged", "Plain"}
    assert {s for s, *_ in database.decode(db, 100, payload(4))} == {"Mux", "Still", "Motor"}
    assert database.decode(db, 100, bytes([1]))[0][0] == "Mux" and len(database.decode(db, 100, bytes([1]))) == 1
    assert database.decode(db, 200, bytes([2]))[0][3] == "Fault" and database.decode(db, 200, bytes([1]))[0][3] == "On"
    rows = [(100, payload(m)) for m in range(22)] + [(200, [2]), (999, [1]), (0x0CF00431, [0, 0, 0, 8, 1, 0, 0, 0])]
    for matching in ("exact", "pgn", "pgn_source"):
        mine = db.with_matching(matching)
        got = sorted((r["idx"], r["signal"], r["v"], r["unit"], r["label"]) for r in bus.decode_frames(frames_of(spark, rows), mine).collect())
        want = sorted((i, s, v, u, lab) for i, (can_id, data) in enumerate(rows) for s, v, u, lab in database.decode(mine, can_id, bytes(data)))
        assert got == want
    assert ("Speed", 33.0) in [(s, v) for s, v, *_ in database.decode(db.with_matching("pgn"), 0x0CF00431, bytes([0, 0, 0, 8, 1, 0, 0, 0]))]


def test_matching_joins_agree_with_the_index(spark):
    db = database.parse_dbc(DBC)
    messages, signals = db.tables(spark)
    f = frames_of(spark, [(100, [0]), (0x0CF00431, [0]), (999, [0]), (200, [0])])
    for matching in ("exact", "pgn", "pgn_source"):
        got = {r["id"]: r["msg_idx"] for r in bus.matched(f, messages, matching).collect()}
        want = {i: db.with_matching(matching).find(i) for i in (100, 0x0CF00431, 999, 200)}
        assert got == {k: v for k, v in want.items() if v is not None}
    assert signals.where("name = 'State'").first()["labels"][2] == "Fault"
    assert bus.filter_frames(f, "0x64").count() == 1 and bus.filter_frames(f, "stat", db=db).count() == 1 and bus.filter_frames(f, "eec", db=db.with_matching("pgn")).count() == 1


def test_database_faults():
    with pytest.raises(database.DatabaseError):
        database.parse_dbc(b"\xff\xfe")
    with pytest.raises(database.DatabaseError):
        database.parse_dbc("not a database")
    with pytest.raises(database.DatabaseError):
        database.parse_dbc(DBC.replace("Ranged Mux", "Ranged Nobody"))
    with pytest.raises(database.DatabaseError):
        database.parse_dbc(DBC.replace("SG_MUL_VAL_ 100 Ranged Mux 1-3, 10-15;", "SG_MUL_VAL_ 100 Ranged Still 1-3;\nSG_MUL_VAL_ 100 Still Ranged 1-3;"))


LDF = """LIN_description_file ;
LIN_protocol_version = "2.1" ;
LIN_speed = 19.2 kbps ;
Nodes { Master: A, 5.0 ms, 0.1 ms ; Slaves: B ; }
Signals { Lock: 2, 0, B, A ; Pos: 10, 0, B, A ; Temp: 8, 40, B, A ; }
Frames { Door: 0x20, B, 4 { Lock, 0 ; Pos, 2 ; Temp, 16 ; } }
Signal_encoding_types {
  Locks { logical_value, 0, "Open" ; logical_value, 1, "Shut" ; }
  Temps { physical_value, -40, 215, 0.5, -40.0, "degC" ; }
}
Signal_representation { Locks: Lock ; Temps: Temp ; }
"""

ARXML = """<AUTOSAR xmlns="http://autosar.org/schema/r4.0"><AR-PACKAGES><AR-PACKAGE><SHORT-NAME>p</SHORT-NAME><ELEMENTS>
<CAN-FRAME-TRIGGERING><SHORT-NAME>t</SHORT-NAME><FRAME-REF>/p/f</FRAME-REF><CAN-ADDRESSING-MODE>STANDARD</CAN-ADDRESSING-MODE><IDENTIFIER>300</IDENTIFIER></CAN-FRAME-TRIGGERING>
<CAN-FRAME><SHORT-NAME>f</SHORT-NAME><FRAME-LENGTH>8</FRAME-LENGTH><PDU-TO-FRAME-MAPPINGS><PDU-TO-FRAME-MAPPING><SHORT-NAME>m</SHORT-NAME><PDU-REF>/p/u</PDU-REF></PDU-TO-FRAME-MAPPING></PDU-TO-FRAME-MAPPINGS></CAN-FRAME>
<I-SIGNAL-I-PDU><SHORT-NAME>u</SHORT-NAME><I-SIGNAL-TO-PDU-MAPPINGS><I-SIGNAL-TO-I-PDU-MAPPING><SHORT-NAME>x</SHORT-NAME><I-SIGNAL-REF>/p/s</I-SIGNAL-REF><START-POSITION>8</START-POSITION></I-SIGNAL-TO-I-PDU-MAPPING></I-SIGNAL-TO-PDU-MAPPINGS></I-SIGNAL-I-PDU>
<I-SIGNAL><SHORT-NAME>s</SHORT-NAME><LENGTH>8</LENGTH><SYSTEM-SIGNAL-REF>/p/y</SYSTEM-SIGNAL-REF></I-SIGNAL>
<SYSTEM-SIGNAL><SHORT-NAME>y</SHORT-NAME><PHYSICAL-PROPS><COMPU-METHOD-REF>/p/c</COMPU-METHOD-REF></PHYSICAL-PROPS></SYSTEM-SIGNAL>
<COMPU-METHOD><SHORT-NAME>c</SHORT-NAME><COMPU-INTERNAL-TO-PHYS><COMPU-SCALES>
<COMPU-SCALE><COMPU-RATIONAL-COEFFS><COMPU-NUMERATOR><V>-10</V><V>2</V></COMPU-NUMERATOR><COMPU-DENOMINATOR><V>4</V></COMPU-DENOMINATOR></COMPU-RATIONAL-COEFFS></COMPU-SCALE>
<COMPU-SCALE><LOWER-LIMIT>254</LOWER-LIMIT><UPPER-LIMIT>255</UPPER-LIMIT><COMPU-CONST><VT>bad</VT></COMPU-CONST></COMPU-SCALE>
</COMPU-SCALES></COMPU-INTERNAL-TO-PHYS></COMPU-METHOD>
</ELEMENTS></AR-PACKAGE></AR-PACKAGES></AUTOSAR>"""


def test_ldf_and_arxml():
    db = database.parse_ldf(LDF)
    got = {s: (v, u, lab) for s, v, u, lab in database.decode(db, 0x20, bytes([0b00000101, 0, 100, 0]))}
    assert got == {"Lock": (1.0, "", "Shut"), "Pos": (1.0, "", None), "Temp": (10.0, "degC", None)}
    with pytest.raises(database.DatabaseError):
        database.parse_ldf("Nodes { ")
    db = database.parse_arxml(ARXML)
    assert database.decode(db, 300, bytes([0, 20]))[0][:2] == ("s", 7.5) and database.decode(db, 300, bytes([0, 255]))[0][3] == "bad"
    with pytest.raises(database.DatabaseError):
        database.parse_arxml("<a>")


def test_native_bits_equal_integers(spark):
    rng = np.random.default_rng(2)
    data = [rng.integers(0, 256, 8, dtype=np.uint8).tobytes() for _ in range(40)] + [b"\xff" * 8, b"\x01"]
    df = spark.createDataFrame([(bytearray(d),) for d in data], "d binary")
    for start, size, big in [(0, 8, False), (5, 11, False), (3, 57, False), (0, 64, False), (7, 64, True), (15, 12, True), (2, 60, True), (6, 62, True), (63, 1, False), (60, 9, False)]:
        s = database.SignalDef("x", start, size, big)
        got = [None if r[0] is None else int(r[0]) for r in df.select(bits.unsigned_field(F.col("d"), start, size, big)).collect()]
        assert got == [database.raw_value(d, s) for d in data], (start, size, big)
    row = spark.range(1).select(bits.signed(F.lit(255), 8).alias("a"), bits.signed(F.lit("18446744073709551615").cast("decimal(20,0)"), 64).alias("b"), bits.pgn(F.lit(0x18EA1234)).alias("c"), bits.pgn(F.lit(0x18FEF100)).alias("d")).first()
    assert tuple(row) == (-1, -1, 0xEA00, 0xFEF1)


def one_value(spark, x, c, kind="double", integers=False):
    return spark.createDataFrame([(x,)], f"x {kind}").select(conversions.physical(F.col("x"), c, integers)).first()[0]


def test_conversions(spark):
    assert one_value(spark, 4.0, Conversion("linear", (3.0, 2.0))) == 14
    assert one_value(spark, 2.0, Conversion("rational", (1, 2, 3, 0, 0, 2))) == 5.5
    assert one_value(spark, 2.0, Conversion("rational", (1, 2, 3, 0, 0, 0))) == math.inf
    table = Conversion("interpolated", keys=(0, 10), results=(100, 200))
    assert [one_value(spark, x, table) for x in (5.0, -5.0, 50.0)] == [150, 100, 200]
    assert one_value(spark, 15.0, Conversion("nearest", keys=(20, 10), results=(2, 1))) == 2
    assert one_value(spark, 15.0, Conversion("nearest3", keys=(20, 10), results=(2, 1))) == 1
    ranges = Conversion("range_to_text", keys=(0, 10), upper=(10, 20), results=("a", "b"), default="z")
    assert [one_value(spark, x, ranges) for x in (10.0, 20.0, 9.0)] == ["b", "z", "a"]
    assert one_value(spark, 20.0, ranges, integers=True) == "b"
    assert one_value(spark, "q", Conversion("text_to_text", keys=("a",), results=("b",)), "string") == ""
    assert math.isnan(one_value(spark, "q", Conversion("text_to_value", keys=("a",), results=(1.0,)), "string"))
    shared = Conversion("range_to_text3", keys=(0, 10), upper=(10, 20), results=("a", "b"), default="d")
    assert [one_value(spark, x, shared) for x in (5.0, 10.0, 20.0, 21.0)] == ["a", "d", "b", "d"]
    flags = Conversion("bitfield", masks=(1, 2), results=("one", "two"))
    assert [one_value(spark, x, flags) for x in (3.0, 0.0, -1.0, 1.5)] == ["one | two", "", "", ""]
    with pytest.raises(conversions.UnsupportedConversion):
        one_value(spark, 1.0, Conversion("unsupported 99"))


def test_formulas(spark):
    x = F.lit(3.0)
    value = lambda t: spark.range(1).select(expressions.formula(t, x)).first()[0]
    assert value("-x^2") == -9 and value("2^-1") == 0.5 and value("2**3**2") == 512 and value("1/(X1-3)") == math.inf
    assert value("LN(0*x)") == -math.inf and abs(value("sin(pi/2)") - 1) < 1e-12 and value("1e2+.5") == 100.5
    for bad in ("x +", "foo(x)", "y", "(x", "x x", "1 2", "sin(x, x)", "(" * 40 + "x" + ")" * 40):
        with pytest.raises(expressions.ExpressionError):
            value(bad)
    web = lambda t: spark.range(1).select(expressions.compiled(t, lambda n: F.lit(math.nan if n == "n" else 2.0), expressions.COMPUTED_WEB)).first()[0]
    assert web("max([n], 1) + min(a.b, {c d})") == 3 and expressions.names_in("[a b] + c * 'a b'") == ["a b", "c"]


def test_sinks(spark, tmp_path):
    s = series_of(spark, "s", [0, 0.5, 1], [1.0, 2.0, 3.0], [True, False, True])
    g = series_of(spark, "g", [0, 0.5, 1], [7.0, 8.0, 9.0])
    wide = sinks.wide([("Speed", s), ("Gear", g)])
    assert [tuple(r) for r in wide.orderBy("idx").collect()] == [(0, 0.0, 1.0, 7.0), (1, 0.5, None, 8.0), (2, 1.0, 3.0, 9.0)]
    lines = [r["line"] for r in sinks.csv_lines(wide, ["Speed", "Gear"], ["km/h", ""]).orderBy("idx").collect()]
    assert lines[:3] == ["Time [s],Speed [km/h],Gear", "0.000000000,1.000000000,7.000000000", "0.500000000,,8.000000000"]
    with pytest.raises(StructureError):
        sinks.wide([("a", s), ("b", series_of(spark, "b", [0, 0.6, 1], [1, 2, 3]))])
    sinks.write_arrow(wide, str(tmp_path / "a.arrow"))
    import pyarrow as pa

    assert sum(pa.ipc.open_file(str(p)).read_all().num_rows for p in (tmp_path / "a.arrow").glob("*.arrow")) == 3
    sinks.write_mat([("Speed", s)], str(tmp_path / "a.mat"))
    raw = (tmp_path / "a.mat").read_bytes()
    assert struct.unpack("<iiiii", raw[:20]) == (0, 3, 1, 0, 16) and b"DG0_Speed_invalid" in raw
    f = spark.createDataFrame([(1.5, 1, 0, 0x123, None, 0, bytes([1, 171])), (1.5, 0, 5, 0x12345, True, 2, b"")], "t double, grp int, idx long, id long, extended boolean, bus int, data binary")
    got = [r["line"] for r in sinks.asc_lines(f).collect()]
    assert got == [" 1.500000 2  12345x          Rx   d 0 ", " 1.500000 1  123             Rx   d 2 01 AB"]


def test_frames_and_scrambling(spark, tmp_path):
    w = Mdf4Writer()
    g = w.add_group("bus", [0.0, 0.1, 0.2])
    w.add_channel(g, "CAN_DataFrame.ID", np.array([0x80000100, 100, 200], np.uint32))
    w.add_channel(g, "CAN_DataFrame.DataLength", np.array([2, 8, 1], np.uint8))
    w.add_channel(g, "CAN_DataFrame.DataBytes", [bytes([1, 2, 3]), bytes(8), bytes([2])])
    path = str(tmp_path / "bus.mf4")
    w.write(path)
    got = frames.frames(spark, path, "can").orderBy("idx").collect()
    assert [(r["id"], r["bus"], bytes(r["data"]), r["extended"]) for r in got] == [(0x100, 0, bytes([1, 2]), None), (100, 0, bytes(8), None), (200, 0, bytes([2]), None)]
    assert bus.decode_frames(frames.frames(spark, path, "can"), database.parse_dbc(DBC)).where("signal = 'State'").first()["label"] == "Fault"
    raw = open(path, "rb").read()
    copy, n = sinks.scramble(raw, 7)
    assert n > 3 and len(copy) == len(raw) and sinks.scramble(raw, 7)[0] == copy and sinks.scramble(raw, 8)[0] != copy
    assert "CAN_DataFrame.ID" not in {c.name for c in Mdf4.from_bytes(copy).groups[0].channels}


def old_file(order, vals):
    """A version 3 file of one group: time, a 16-bit number with a linear conversion, 12 bits, text."""
    p = lambda code, *v: struct.pack(order + code, *v)
    ident = bytearray(b"MDF     3.30    program \0" + b"\0" * 39)
    ident[24:26] = p("H", 0 if order == "<" else 1)
    ident[28:30] = p("H", 330)
    out = bytearray(ident[:64])
    dg_at, cg_at = 64 + 164, 64 + 164 + 28
    cn_at = cg_at + 30
    cc_at = cn_at + 4 * 228
    data_at = cc_at + 62
    out += b"HD" + p("HIIIH", 164, dg_at, 0, 0, 1) + b"\0" * 146
    out += b"DG" + p("HIIIIHHI", 28, 0, cg_at, 0, data_at, 1, 0, 0)
    out += b"CG" + p("HIIIHHHII", 30, 0, cn_at, 0, 0, 4, 16, len(vals), 0)
    for i, (name, start, size, kind, cc, time) in enumerate([("t", 0, 64, 3, 0, 1), ("n", 64, 16, 0, cc_at, 0), ("b", 82, 12, 0, 0, 0), ("s", 96, 32, 7, 0, 0)]):
        out += b"CN" + p("HIIIIIH", 228, cn_at + 228 * (i + 1) if i < 3 else 0, cc, 0, 0, 0, time) + name.encode().ljust(32, b"\0") + b"\0" * 128
        out += p("HHHHdddIIH", start, size, kind, 0, 0.0, 0.0, 0.0, 0, 0, 0)
    out += b"CC" + p("HHdd", 62, 0, 0.0, 0.0) + b"V".ljust(20, b"\0") + p("HHdd", 0, 2, 1.0, 0.5)
    for t, n, b, s in vals:
        body = bytearray(p("dH", t, n) + bytes(2) + s.encode().ljust(4, b"\0"))
        body[10:12] = (b << 2).to_bytes(2, "little" if order == "<" else "big")
        out += body
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
def test_old_recordings(spark, tmp_path, order):
    path = str(tmp_path / "a.mdf")
    vals = [(0.5 * i, 10 * i, 100 + i, f"v{i}") for i in range(5)]
    open(path, "wb").write(old_file(order, vals))
    got = [tuple(r) for r in mdf3.read_group3(spark, path).orderBy("idx").collect()]
    assert [(r[0], r[1], r[2], r[4]) for r in got] == [(i, t, 1.0 + 0.5 * n, s) for i, (t, n, _, s) in enumerate(vals)]
    if order == "<":
        assert [r[3] for r in got] == [v[2] for v in vals]


def test_vax_floats():
    assert mdf3.vax(np.array([[0x80, 0x40, 0, 0]], np.uint8), 4)[0] == 1.0
    assert mdf3.vax(np.array([[0x20, 0xC2, 0, 0]], np.uint8), 4)[0] == -10.0
    assert mdf3.vax(np.array([[0x10, 0x40, 0, 0, 0, 0, 0, 0]], np.uint8), 6)[0] == 1.0


def test_streams(spark, tmp_path):
    from gaugeline.streaming import chunks

    w = Mdf4Writer()
    g = w.add_group("g", [float(i) for i in range(250)])
    w.add_channel(g, "v", np.arange(250, dtype=np.int32))
    path = str(tmp_path / "s.mf4")
    w.write(path)
    chunks.register(spark)
    stream = spark.readStream.format("mdf_stream").option("maxRecords", 100).load(path)
    q = stream.writeStream.format("memory").queryName("grown").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(6):
            q.processAllAvailable()
            if spark.table("grown").count() >= 250:
                break
    finally:
        q.stop()
    assert sorted(r["v"] for r in spark.table("grown").collect()) == list(range(250))
    parts = list(chunks.chunks(read_group(spark, path), 100))
    assert [len(p) for p in parts] == [100, 100, 50] and parts[2]["v"].iloc[-1] == 249
    with pytest.raises(ValueError):
        next(chunks.chunks(read_group(spark, path), 0))


def test_text_and_time(spark):
    row = spark.range(1).select(
        text.decoded(F.lit(b"ab\x00cd"), "latin-1").alias("a"), text.decoded(F.lit("hé".encode("utf-16-le")), "utf-16-le").alias("b"), text.parsed_id(F.lit("0x1F")).alias("c"), text.parsed_id(F.lit("zz")).alias("d"),
        text.iso_time(F.lit(1_700_000_000_123_000_000)).alias("e"), text.absolute_label(F.lit(1_700_000_000_007)).alias("f"),
        text.canopen_date_nanos(F.lit(1984), F.lit(1), F.lit(2), F.lit(0), F.lit(0), F.lit(5)).alias("g"), text.canopen_time_nanos(F.lit(5), F.lit(1)).alias("h"), text.sample_json(F.lit(1), F.lit(math.nan)).alias("i"), text.csv_cell(F.lit('a"b')).alias("j"),
    ).first()
    assert row["a"] == "ab" and row["b"] == "hé" and row["c"] == 31 and row["d"] is None
    assert row["e"] == "2023-11-14T22:13:20.123Z" and row["f"] == "2023-11-14 22:13:20.007"
    assert row["g"] == row["h"] == (5114 * 86_400_000 + 5) * 1_000_000 and row["i"] == '{"t":1,"v":null}' and row["j"] == '"a""b"'
    assert text.metadata_map("<HD><TX>c</TX><e name='k'>v</e></HD>") == {"HD/TX": "c", "HD/e/k": "v"} and text.comment_text("<X><TX>hi</TX></X>") == "hi"
