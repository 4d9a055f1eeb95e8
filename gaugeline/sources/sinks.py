"""Sinks: CSV, Arrow, Parquet, bus traces, MATLAB level 4, and anonymised copies."""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.text import headed
from gaugeline.operators.series import StructureError, exported
from gaugeline.sources.mdf4 import Mdf4


def wide(series: Sequence[tuple[str, DataFrame]], shared_axis: bool = True) -> DataFrame:
    """(time, one column a series) of series that share one axis; invalid samples are null.

    With ``shared_axis`` differing axes are an error; otherwise rows pair by position, shorter series
    leave nulls.
    """
    out = None
    for name, s in series:
        part = exported(s).select("idx", F.col("t").alias("time"), F.col("v").alias(name))
        if out is None:
            out = part
        elif shared_axis:
            both = out.select("idx", "time").join(part.select("idx", F.col("time").alias("_t")), "idx", "full")
            if not both.where(~F.col("time").eqNullSafe(F.col("_t"))).isEmpty():
                raise StructureError(f"{name} has an axis of its own")
            out = out.join(part.drop("time"), "idx")
        else:
            out = out.join(part.drop("time"), "idx", "full")
    if out is None:
        raise StructureError("no series to write")
    return out


def csv_lines(df: DataFrame, columns: Sequence[str], units: Sequence[str] = (), time: str | None = "time", time_unit: str = "s") -> DataFrame:
    """(idx, line) of a wide table: nine decimals, empty cells for nulls; the header is line -1."""
    names = [headed(n, u) for n, u in zip(columns, [*units, *[""] * (len(columns) - len(units))], strict=True)]
    quote = lambda s: '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\r\n') else s
    head = ",".join(quote(x) for x in ["Index" if time is None else f"Time [{time_unit}]", *names])

    def cell(c: Column, kind: str) -> Column:
        number = F.when(c.isNull(), "").when(F.isnan(c.cast("double")), "NaN").otherwise(F.format_string("%.9f", c.cast("double")))
        return F.coalesce(c, F.lit("")) if kind == "string" else number

    kinds = dict(df.dtypes)
    first = F.col("idx").cast("string") if time is None else cell(F.col(time), kinds[time])
    line = F.concat_ws(",", first, *[cell(F.col(f"`{c}`"), kinds[c]) for c in columns])
    body = df.select(F.col("idx").cast("long").alias("idx"), line.alias("line"))
    return df.sparkSession.createDataFrame([(-1, head)], "idx long, line string").unionByName(body)


def write_csv(df: DataFrame, path: str, columns: Sequence[str], units: Sequence[str] = (), **options) -> None:
    """The lines as a folder of text files in order."""
    csv_lines(df, columns, units, **options).orderBy("idx").select("line").write.mode("overwrite").text(path)


def write_arrow(df: DataFrame, path: str) -> None:
    """A folder of Arrow IPC files of a wide table, one a partition, written batch by batch by the tasks."""
    os.makedirs(path, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = f"{path}/part-{TaskContext.get().partitionId():05d}.arrow"
        writer, rows = None, 0
        for b in batches:
            if writer is None:
                writer = pyarrow.ipc.new_file(f"{part}.tmp", b.schema)
            writer.write_batch(b)
            rows += b.num_rows
        if writer is not None:
            writer.close()
            os.replace(f"{part}.tmp", part)
        yield pa.record_batch([pa.array([rows], pa.int64())], names=["rows"])

    df.mapInArrow(run, "rows long").agg(F.sum("rows")).collect()


def write_parquet(df: DataFrame, path: str, compression: str = "snappy") -> None:
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def asc_lines(frames: DataFrame) -> DataFrame:
    """(t, grp, idx, line) of CAN frames as trace lines, the order being that of a stable sort by time."""
    bus = F.when(F.coalesce("bus", F.lit(0)) == 0, 1).otherwise(F.col("bus"))
    extended = F.coalesce(F.col("extended") if "extended" in frames.columns else F.lit(None).cast("boolean"), F.col("id") > 0x7FF)
    name = F.concat(F.lower(F.hex("id")), F.when(extended, "x").otherwise(""))
    data = F.trim(F.regexp_replace(F.hex("data"), "(..)", "$1 "))
    line = F.concat(F.format_string("%9.6f", "t"), F.lit(" "), bus.cast("string"), F.lit("  "), F.rpad(name, 15, " "), F.lit(" Rx   d "), F.lower(F.hex(F.octet_length("data"))), F.lit(" "), data)
    return frames.select("t", "grp", "idx", line.alias("line")).orderBy("t", "grp", "idx")


ASC_HEAD = ("base hex  timestamps absolute", "no internal events logged")


def frame_csv(frames: DataFrame) -> DataFrame:
    """Frames with hexadecimal data, for a CSV writer."""
    return frames.select(*[F.trim(F.regexp_replace(F.hex(c), "(..)", "$1 ")).alias(c) if k == "binary" else F.col(c) for c, k in frames.dtypes])


def mat4(variables: dict[str, np.ndarray | Sequence[float]]) -> bytes:
    """A MATLAB level 4 file of double column vectors."""
    out = b""
    for name, v in variables.items():
        x = np.asarray(v, "<f8").reshape(-1)
        out += struct.pack("<iiiii", 0, len(x), 1, 0, len(name) + 1) + name.encode("ascii", "replace") + b"\0" + x.tobytes()
    return out


def write_mat(series: Sequence[tuple[str, DataFrame]], path: str, group: int = 0) -> None:
    """Series of one group as ``DGM<g>_timestamps``, ``DG<g>_<name>`` and ``..._invalid``: a local file."""
    variables: dict[str, np.ndarray] = {}
    for name, s in series:
        rows = s.orderBy("idx").toPandas()
        variables.setdefault(f"DGM{group}_timestamps", rows["t"].to_numpy(float))
        variables[f"DG{group}_{name}"] = rows["v"].to_numpy(float)
        if not rows["valid"].all():
            variables[f"DG{group}_{name}_invalid"] = (~rows["valid"]).to_numpy(float)
    with open(f"{path}.tmp", "wb") as f:
        f.write(mat4(variables))
    os.replace(f"{path}.tmp", path)


def scrambled_text(text: str, seed: int) -> str:
    """Text of the same length, letters and digits replaced by others that seed and text decide."""
    digest = hashlib.sha256(f"{seed}:{text}".encode()).digest()
    out = []
    for i, c in enumerate(text):
        d = digest[i % 32] + i // 32
        out.append(chr(97 + d % 26) if c.islower() and c.isascii() else chr(65 + d % 26) if c.isupper() and c.isascii() else chr(48 + d % 10) if c.isdigit() and c.isascii() else c)
    return "".join(out)


def scramble(raw: bytes, seed: int = 0) -> tuple[bytes, int]:
    """(copy, texts replaced): a recording whose names and comments are replaced in place, byte for byte as
    long; formulas, and texts that conversions compare with, stay; samples are untouched."""
    f = Mdf4.from_bytes(raw)
    out, met, keep, stack, n = bytearray(raw), set(), set(), [64], 0
    texts = []
    while stack:
        at = stack.pop()
        if not at or at in met:
            continue
        met.add(at)
        b = f.block(at, payload=False)
        if b.kind in ("TX", "MD"):
            texts.append(b)
        if b.kind == "CC":
            kind = f.block(at).data[0]
            if kind in (3, 9, 10):
                keep |= set(b.links[4:])
        stack += [x for x in b.links if x + 24 <= len(raw)]
    for b in texts:
        if b.at in keep:
            continue
        body = f.block(b.at).data.split(b"\0", 1)[0]
        try:
            text = body.decode("utf-8")
        except UnicodeDecodeError:
            continue
        new = scrambled_text(text, seed).encode() if b.kind == "TX" else _scrambled_xml(text, seed).encode()
        at = b.at + 24 + 8 * len(b.links)
        out[at : at + len(body)] = new
        n += 1
    return bytes(out), n


def _scrambled_xml(text: str, seed: int) -> str:
    """An XML text whose character data is scrambled and whose tags stay."""
    out, at = [], 0
    while at < len(text):
        if text[at] == "<":
            end = text.find(">", at) + 1 or len(text)
            out.append(text[at:end])
        else:
            end = text.find("<", at)
            end = len(text) if end < 0 else end
            out.append(scrambled_text(text[at:end], seed))
        at = end
    return "".join(out)


def mat5(variables: dict[str, np.ndarray | Sequence[float]]) -> bytes:
    """A MATLAB level 5 file of double column vectors."""

    def element(kind: int, body: bytes) -> bytes:
        return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    out = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<HH", 0x0100, 0x4D49)
    for name, v in variables.items():
        x = np.asarray(v, "<f8").reshape(-1)
        body = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", len(x), 1)) + element(1, name.encode("ascii", "replace")) + element(9, x.tobytes())
        out += element(14, body)
    return out
