import numpy as np
import pytest

from gaugeline.functions.conversions import Conversion
from gaugeline.sources.mdf4 import Mdf4, MdfError, read_group, read_series, transposed, untransposed
from gaugeline.sources.mdf4_write import Mdf4Writer


def recording(codec="none", n=5000):
    w = Mdf4Writer(1_700_000_000_000_000_000, "a run", codec)
    g = w.add_group("engine", [i * 0.5 for i in range(n)])
    w.add_channel(g, "Speed", np.arange(n) * 0.25, "km/h", valid=[i % 7 != 0 for i in range(n)])
    w.add_channel(g, "Raw", np.arange(n, dtype=np.uint16), "V", conversion=Conversion("linear", (2.0, 3.0)))
    w.add_channel(g, "Gear", np.array([i % 3 for i in range(n)], np.int8), conversion=Conversion("value_to_text", keys=(0, 1, 2), results=("N", "1", "2"), default="?"))
    w.add_channel(g, "Note", [f"n{i}" for i in range(n)])
    return w


@pytest.mark.parametrize("codec", ["none", "deflate", "transposed_deflate", "zstd"])
def test_round_trip(spark, tmp_path, codec):
    path = str(tmp_path / "a.mf4")
    recording(codec).write(path)
    f = Mdf4.open(path)
    assert f.start_ns == 1_700_000_000_000_000_000 and f.comment == "a run"
    assert [c.name for c in f.groups[0].channels] == ["time", "Speed", "Raw", "Gear", "Note"]
    rows = read_group(spark, path, per_task=1200).orderBy("idx").collect()
    assert len(rows) == 5000
    assert rows[17]["time"] == 8.5 and rows[17]["Speed"] == 4.25 and rows[17]["Raw"] == 37.0 and rows[17]["Gear"] == "2" and rows[17]["Note"] == "n17"
    assert [r["Speed__valid"] for r in rows[:8]] == [False] + [True] * 6 + [False]
    raw = read_group(spark, path, channels=["Raw"], raw=True)
    assert set(raw.columns) == {"idx", "time", "time__valid", "Raw", "Raw__valid"}
    assert raw.where("idx = 4999").first()["Raw"] == 4999


def test_series_catalog_and_blocks(spark, tmp_path):
    path = str(tmp_path / "a.mf4")
    recording(n=50).write(path)
    s = read_series(spark, path, "Speed").orderBy("idx").collect()
    assert (s[3]["t"], s[3]["v"], s[3]["valid"]) == (1.5, 0.75, True)
    f = Mdf4.open(path)
    assert f.catalog(spark).count() == 5
    kinds = {r["type"] for r in f.block_map(spark).collect()}
    assert {"HD", "DG", "CG", "CN", "CC", "TX", "DT", "SD"} <= kinds


def test_spark_writer(spark, tmp_path):
    from gaugeline.sources.mdf4 import register

    register(spark)
    df = spark.range(100).selectExpr("id * 0.1D as t", "id * 2 as a", "CASE WHEN id % 2 = 0 THEN id * 1.0D END as b").coalesce(1)
    df.write.format("mdf").mode("append").save(str(tmp_path / "out"))
    got = read_group(spark, str(tmp_path / "out" / "part-00000.mf4")).orderBy("idx").collect()
    assert len(got) == 100 and got[10]["a"] == 20 and got[10]["b__valid"] and not got[11]["b__valid"]


def test_faults(tmp_path):
    with pytest.raises(MdfError):
        Mdf4.from_bytes(b"x" * 100)
    raw = bytearray(recording(n=5).to_bytes())
    raw[28:30] = b"\x2c\x01"
    with pytest.raises(MdfError):
        Mdf4.from_bytes(bytes(raw))
    with pytest.raises(MdfError):
        Mdf4.from_bytes(recording(n=5).to_bytes()[:300])


def test_transposition_keeps_the_tail():
    raw = bytes(range(23))
    assert untransposed(transposed(raw, 5), 5) == raw
