"""Writing MDF 4 files: typed channels, validity, conversions, variable-length text and compression."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage

from gaugeline.functions.conversions import Conversion
from gaugeline.sources.mdf4 import MdfError, Unsupported, transposed

CODECS = {"none": None, "deflate": 0, "transposed_deflate": 1, "zstd": 2, "transposed_zstd": 3, "lz4": 4, "transposed_lz4": 5}
BLOCK = 4 << 20


@dataclass
class WriteChannel:
    name: str
    values: Sequence
    unit: str = ""
    valid: Sequence[bool] | None = None
    conversion: Conversion | None = None


@dataclass
class WriteGroup:
    name: str
    times: Sequence[float]
    channels: list[WriteChannel] = field(default_factory=list)


class Mdf4Writer:
    """Collects groups and gives the bytes of a file. Samples are written in the order of their stamps."""

    def __init__(self, start_ns: int = 0, comment: str = "", codec: str = "none") -> None:
        if codec not in CODECS:
            raise Unsupported(f"codec {codec}")
        self.start_ns, self.comment, self.codec = start_ns, comment, CODECS[codec]
        self.groups: list[WriteGroup] = []

    def add_group(self, name: str, times: Sequence[float]) -> WriteGroup:
        if any(t != t for t in times):
            raise MdfError(f"group {name} has a time that is no number")
        self.groups.append(WriteGroup(name, list(times)))
        return self.groups[-1]

    def add_channel(self, group: WriteGroup, name: str, values: Sequence, unit: str = "", valid: Sequence[bool] | None = None, conversion: Conversion | None = None) -> WriteChannel:
        for what, x in (("values", values), ("validity flags", valid)):
            if x is not None and len(x) != len(group.times):
                raise MdfError(f"{name} has {len(x)} {what} for {len(group.times)} stamps")
        group.channels.append(WriteChannel(name, values, unit, valid, conversion))
        return group.channels[-1]

    def remove_channel(self, name: str) -> None:
        for g in self.groups:
            g.channels = [c for c in g.channels if c.name != name]

    def retain_channels(self, keep) -> None:
        for g in self.groups:
            g.channels = [c for c in g.channels if keep(c)]

    def retain_groups(self, keep) -> None:
        self.groups = [g for g in self.groups if keep(g)]

    # -- blocks --

    def _put(self, kind: str, links: Sequence[int], data: bytes) -> int:
        pad = -len(self.out) % 8
        self.out += b"\0" * pad
        at = len(self.out)
        self.out += struct.pack("<4sIQQ", b"##" + kind.encode(), 0, 24 + 8 * len(links) + len(data), len(links)) + struct.pack(f"<{len(links)}Q", *links) + data
        return at

    def _patch(self, at: int, link: int, value: int) -> None:
        struct.pack_into("<Q", self.out, at + 24 + 8 * link, value)

    def _text(self, text: str) -> int:
        raw = text.encode() + b"\0"
        return self._put("TX", (), raw + b"\0" * (-len(raw) % 8)) if text else 0

    def _conversion(self, c: Conversion | None) -> int:
        if c is None or c.kind == "identity":
            return 0
        refs: list[int] = []
        if c.kind == "linear":
            code, v = 1, [c.p[1], c.p[0]]
        elif c.kind == "rational":
            code, v = 2, list(c.p)
        elif c.kind == "formula":
            code, v, refs = 3, [], [self._text(c.text)]
        elif c.kind in ("interpolated", "nearest"):
            code, v = (4 if c.kind == "interpolated" else 5), [x for pair in zip(c.keys, c.results, strict=True) for x in pair]
        elif c.kind == "value_to_text" and all(isinstance(r, str) for r in c.results):
            code, v = 7, list(c.keys)
            refs = [self._text(r) for r in c.results] + [self._text(c.default) if isinstance(c.default, str) else 0]
        else:
            raise Unsupported(f"writing a conversion of kind {c.kind}")
        return self._put("CC", [0, 0, 0, 0, *refs], struct.pack("<BBHHHdd", code, 0, 0, len(refs), len(v), 0.0, 0.0) + struct.pack(f"<{len(v)}d", *v))

    def _data(self, raw: bytes, record: int, kind: str = "DT") -> int:
        if not raw:
            return 0
        if self.codec is None:
            return self._put(kind, (), raw)
        step = max(record, BLOCK // max(1, record) * max(1, record))
        links = []
        for at in range(0, len(raw), step):
            part = raw[at : at + step]
            body = transposed(part, record) if self.codec in (1, 3, 5) else part
            if self.codec >= 4:
                packed = pa.compress(body, codec="lz4", asbytes=True)
            elif self.codec >= 2:
                import zstandard

                packed = zstandard.ZstdCompressor().compress(body)
            else:
                packed = zlib.compress(body)
            links.append(self._put("DZ", (), struct.pack("<2sBBIQQ", kind.encode(), self.codec, 0, record if self.codec in (1, 3, 5) else 0, len(part), len(packed)) + packed))
        offsets = [i * step for i in range(len(links))]
        dl = self._put("DL", [0, *links], struct.pack("<B3xI", 0, len(links)) + struct.pack(f"<{len(links)}Q", *offsets))
        return self._put("HL", [dl], struct.pack("<HB5x", 0, self.codec))

    def _channel_bytes(self, c: WriteChannel, order: np.ndarray) -> tuple[int, int, int, np.ndarray, int]:
        """(channel kind, data type, bits, bytes by record, link to variable data)."""
        first = next((v for v in c.values if v is not None), 0.0)
        if isinstance(first, str | bytes):
            text = isinstance(first, str)
            blobs = [(v.encode() + b"\0" if text else bytes(v)) if v is not None else b"" for v in c.values]
            at, offsets, body = 0, [], []
            for i in order.tolist():
                offsets.append(at)
                body.append(struct.pack("<I", len(blobs[i])) + blobs[i])
                at += len(body[-1])
            return 1, 7 if text else 10, 64, np.array(offsets, "<u8"), self._data(b"".join(body), 1, "SD")
        if isinstance(first, list | tuple | dict):
            raise Unsupported(f"writing {type(first).__name__} samples of {c.name}")
        v = np.asarray([0 if x is None else x for x in c.values])[order]
        if v.dtype == bool:
            v = v.astype(np.uint8)
        if v.dtype.kind == "O":
            v = v.astype(np.float64)
        kind = {"u": 0, "i": 2, "f": 4}[v.dtype.kind]
        return 0, kind, v.dtype.itemsize * 8, v.astype(v.dtype.newbyteorder("<")), 0

    def to_bytes(self) -> bytes:
        self.out = bytearray(struct.pack("<8s8s8s4xH30xHH", b"MDF     ", b"4.10    ", b"gaugeln ", 410, 0, 0))
        self.out += b"\0" * (64 - len(self.out))
        hd = self._put("HD", [0] * 6, struct.pack("<qhhBBBBdd", self.start_ns, 0, 0, 0, 0, 0, 0, 0.0, 0.0))
        self._patch(hd, 5, self._text(self.comment))
        self._patch(hd, 1, self._put("FH", [0, self._put("MD", (), b"<FHcomment><TX>written</TX></FHcomment>\0")], struct.pack("<QhhB3x", self.start_ns, 0, 0, 0)))
        before, link = hd, 0
        for g in self.groups:
            dg = self._put("DG", [0] * 4, struct.pack("<B7x", 0))
            self._patch(before, link, dg)
            before, link = dg, 0
            order = np.argsort(np.asarray(g.times, float), kind="stable")
            parts = [np.asarray(g.times, "<f8")[order]]
            described = [(2, 1, 4, 64, 0, "time", "s", None, 0, -1)]
            byte, inval = 8, 0
            for c in g.channels:
                kind, dtype, bits, raw, data = self._channel_bytes(c, order)
                described.append((kind, 0, dtype, bits, byte, c.name, c.unit, c.conversion, data, inval if c.valid is not None else -1))
                inval += c.valid is not None
                parts.append(raw)
                byte += bits // 8
            n = len(g.times)
            flags = np.zeros((n, -(-inval // 8)), np.uint8)
            bit = 0
            for c in g.channels:
                if c.valid is not None:
                    flags[:, bit // 8] |= (~np.asarray(c.valid, bool)[order]).astype(np.uint8) << (bit % 8)
                    bit += 1
            rows = np.concatenate([np.ascontiguousarray(p).view(np.uint8).reshape(n, -1) for p in parts] + [flags], 1) if n else np.zeros((0, 1), np.uint8)
            cg = self._put("CG", [0, 0, self._text(g.name), 0, 0, 0], struct.pack("<QQHHIII", 0, n, 0, 46, 0, byte, flags.shape[1]))
            self._patch(dg, 1, cg)
            last, at = cg, 1
            for kind, sync, dtype, bits, off, name, unit, conv, data, ipos in described:
                links = [0, 0, self._text(name), 0, self._conversion(conv), data, self._text(unit), 0]
                cn = self._put("CN", links, struct.pack("<BBBBIIIIBBHdddddd", kind, sync, dtype, 0, off, bits, 2 if ipos >= 0 else 0, max(0, ipos), 0, 0, 0, *[0.0] * 6))
                self._patch(last, at, cn)
                last, at = cn, 0
            self._patch(dg, 2, self._data(rows.tobytes(), rows.shape[1] if n else 1))
        return bytes(self.out)

    def write(self, path: str) -> None:
        raw = self.to_bytes()
        temporary = f"{path}.{uuid.uuid4().hex}"
        with open(temporary, "wb") as f:
            f.write(raw)
        os.replace(temporary, path)


@dataclass
class Part(WriterCommitMessage):
    path: str
    rows: int


class MdfWriterTask(DataSourceWriter):
    """``df.write.format("mdf").save(folder)``: each task writes its rows as one file; the column ``t``
    (or the option ``time``) is the axis, and ``<name>__valid`` columns the validity."""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool) -> None:
        self.folder, self.schema = options["path"], schema
        self.time, self.codec = options.get("time", "t"), options.get("codec", "none")
        if self.time not in schema.names:
            raise MdfError(f"no column {self.time} for the time axis")
        if os.path.isdir(self.folder) and not overwrite and any(x.endswith(".mf4") for x in os.listdir(self.folder)):
            raise MdfError(f"{self.folder} holds recordings already")

    def write(self, iterator: Iterator) -> Part:
        rows = list(iterator)
        w = Mdf4Writer(codec=self.codec)
        g = w.add_group("", [float(r[self.time]) for r in rows])
        for name in self.schema.names:
            if name == self.time or name.endswith("__valid"):
                continue
            flags = [bool(r[f"{name}__valid"]) for r in rows] if f"{name}__valid" in self.schema.names else [r[name] is not None for r in rows]
            w.add_channel(g, name, [r[name] for r in rows], valid=None if all(flags) else flags)
        os.makedirs(self.folder, exist_ok=True)
        path = f"{self.folder}/part-{uuid.uuid4().hex}.mf4.tmp"
        w.write(path)
        return Part(path, len(rows))

    def commit(self, messages: list) -> None:
        for i, m in enumerate(x for x in messages if x is not None):
            os.replace(m.path, f"{self.folder}/part-{i:05d}.mf4")

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)
