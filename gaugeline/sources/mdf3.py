"""MDF 2 and 3 recordings: 32-bit links, either byte order, records of bit fields.

The structure is read on the driver; ``read_group3`` gives a channel group as a wide table.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.functions.conversions import Conversion, physical
from gaugeline.sources.mdf4 import MdfError, Source, Unsupported


@dataclass
class Channel3:
    name: str
    unit: str
    is_time: bool
    start_bit: int
    bits: int
    data_type: int
    conversion: Conversion | None


@dataclass
class Group3:
    dg: int
    cg: int
    record_id: int
    id_bytes: int
    id_last: bool
    alone: bool
    record_size: int
    records: int
    data_at: int
    channels: list[Channel3] = field(default_factory=list)


class Mdf3:
    def __init__(self, source: Source) -> None:
        self.source = source
        head = source.read(0, 64)
        if head[:3] != b"MDF":
            raise MdfError("the file is no MDF file")
        self.order = ">" if struct.unpack_from("<H", head, 24)[0] else "<"
        self.version = struct.unpack_from(self.order + "H", head, 28)[0]
        if not 200 <= self.version < 400:
            raise Unsupported(f"version {self.version / 100:.2f} is not 2 or 3")
        hd = source.read(64, 20)
        if hd[:2] != b"HD":
            raise MdfError("the header block is missing")
        self.comment = self.text(self._u(hd, 8))
        self.groups = list(self._groups(self._u(hd, 4)))

    @classmethod
    def open(cls, path: str) -> Mdf3:
        return cls(Source.of_file(path))

    def _u(self, raw: bytes, at: int, code: str = "I") -> int:
        return struct.unpack_from(self.order + code, raw, at)[0]

    def block(self, at: int, kind: bytes, least: int) -> bytes:
        head = self.source.read(at, 4)
        n = self._u(head, 2, "H")
        if head[:2] != kind or n < min(least, 4):
            raise MdfError(f"no {kind.decode()} block at {at}")
        return self.source.read(at, n) + b"\0" * max(0, least - n)

    def text(self, at: int) -> str:
        if not at:
            return ""
        return self.block(at, b"TX", 4)[4:].split(b"\0", 1)[0].decode("latin-1")

    def chain(self, at: int, kind: bytes, least: int) -> Iterator[bytes]:
        met: set[int] = set()
        while at:
            if at in met:
                raise MdfError(f"the {kind.decode()} list runs in a circle at {at}")
            met.add(at)
            b = self.block(at, kind, least)
            yield b
            at = self._u(b, 4)

    def _groups(self, first: int) -> Iterator[Group3]:
        for d, dg in enumerate(self.chain(first, b"DG", 24)):
            ids, cgs = self._u(dg, 22, "H"), list(self.chain(self._u(dg, 8), b"CG", 26))
            for c, cg in enumerate(cgs):
                g = Group3(d, c, self._u(cg, 16, "H"), min(1, ids), ids == 2, len(cgs) == 1, self._u(cg, 20, "H"), self._u(cg, 22), self._u(dg, 16))
                for cn in self.chain(self._u(cg, 8), b"CN", 228):
                    name = self.text(self._u(cn, 218)) or cn[26:58].split(b"\0", 1)[0].decode("latin-1")
                    conversion, unit = self._conversion(self._u(cn, 8))
                    bit = self._u(cn, 186, "H") + 8 * self._u(cn, 226, "H")
                    ch = Channel3(name, unit, self._u(cn, 24, "H") == 1, bit, self._u(cn, 188, "H"), self._u(cn, 190, "H"), conversion)
                    if ch.start_bit + ch.bits > 8 * g.record_size:
                        raise MdfError(f"channel {name} lies beyond its record")
                    g.channels.append(ch)
                yield g

    def _conversion(self, at: int) -> tuple[Conversion | None, str]:
        if not at:
            return None, ""
        b = self.block(at, b"CC", 46)
        unit, kind, n = b[22:42].split(b"\0", 1)[0].decode("latin-1"), self._u(b, 42, "H"), self._u(b, 44, "H")
        p = lambda k, o=46: struct.unpack_from(f"{self.order}{k}d", b, o)
        if kind == 65535:
            return None, unit
        if kind == 0:
            offset, factor = p(2)
            return (None if (factor, offset) == (1.0, 0.0) else Conversion("linear3", (factor, offset))), unit
        if kind in (1, 2):
            v = p(2 * n)
            pairs = sorted(zip(v[0::2], v[1::2], strict=True)) if kind == 2 else list(zip(v[0::2], v[1::2], strict=True))
            return Conversion("interpolated3" if kind == 1 else "nearest3", keys=[a for a, _ in pairs], results=[z for _, z in pairs]), unit
        if kind in (6, 9):
            return Conversion("polynomial3" if kind == 6 else "rational3", p(6)), unit
        if kind in (7, 8):
            return Conversion("exponential3" if kind == 7 else "logarithmic3", p(7)), unit
        if kind == 10:
            return Conversion("formula3", text=b[46:302].split(b"\0", 1)[0].decode("latin-1")), unit
        if kind == 11:
            rows = sorted((p(1, 46 + 40 * i)[0], b[54 + 40 * i : 86 + 40 * i].split(b"\0", 1)[0].decode("latin-1")) for i in range(n))
            return Conversion("value_to_text3", keys=[a for a, _ in rows], results=[t for _, t in rows]), unit
        if kind == 12:
            default = self.text(self._u(b, 62))
            rows = sorted((*p(2, 66 + 20 * i), self.text(self._u(b, 82 + 20 * i))) for i in range(n - 1))
            return Conversion("range_to_text3", keys=[r[0] for r in rows], upper=[r[1] for r in rows], results=[r[2] for r in rows], default=default), unit
        return Conversion(f"unsupported3 {kind}"), unit

    def records(self, g: Group3) -> np.ndarray:
        """The group's records without their ids, as a matrix of bytes."""
        whole = g.record_size + g.id_bytes * (2 if g.id_last else 1)
        if g.alone:
            n = min(g.records, (self.source.size - g.data_at) // whole if whole else 0)
            raw = self.source.read(g.data_at, n * whole)
            return np.frombuffer(raw, np.uint8).reshape(n, whole)[:, g.id_bytes : g.id_bytes + g.record_size] if n else np.zeros((0, g.record_size), np.uint8)
        mates = {x.record_id: x for x in self.groups if x.dg == g.dg}
        left, at, out = sum(x.records for x in mates.values()), g.data_at, []
        while left and at < self.source.size:
            mate = mates.get(self.source.read(at, 1)[0])
            if mate is None:
                raise MdfError(f"an unknown record id at {at}")
            if mate is g or mate.cg == g.cg:
                out.append(self.source.read(at + 1, g.record_size))
            at += 1 + mate.record_size + (1 if mate.id_last else 0)
            left -= 1
        return np.frombuffer(b"".join(out), np.uint8).reshape(-1, g.record_size)

    def values(self, m: np.ndarray, ch: Channel3) -> list | np.ndarray:
        """A channel's raw values."""
        t = ch.data_type
        if t in (7, 8):
            if ch.start_bit % 8:
                raise Unsupported(f"text of {ch.name} off the byte grid")
            rows = [r.tobytes() for r in np.ascontiguousarray(m[:, ch.start_bit // 8 : (ch.start_bit + ch.bits) // 8])]
            return [r.split(b"\0", 1)[0].decode("latin-1") for r in rows] if t == 7 else rows
        if t not in (0, 1, 2, 3, 4, 5, 6, 9, 10, 11, 12, 13, 14, 15, 16):
            raise Unsupported(f"data type {t} of {ch.name}")
        big = self.order == ">" if t <= 3 else 9 <= t <= 12
        first, bit = divmod(ch.start_bit, 8)
        n = (bit + ch.bits + 7) // 8
        raw = np.zeros(len(m), np.uint64)
        for i in range(n):
            b = m[:, first + (n - 1 - i if big else i)].astype(np.uint64)
            move = 8 * i - bit
            raw |= b << np.uint64(move) if 0 <= move < 64 else b >> np.uint64(-move) if move < 0 else np.uint64(0)
        if ch.bits < 64:
            raw &= np.uint64((1 << ch.bits) - 1)
        if t in (1, 10, 14):
            up = 64 - ch.bits
            return (raw << np.uint64(up)).view(np.int64) >> np.int64(up)
        if t in (2, 3, 11, 12, 15, 16):
            return raw.view(np.float64) if ch.bits == 64 else raw.astype(np.uint32).view(np.float32).astype(np.float64)
        if t in (4, 5, 6):
            return vax(np.ascontiguousarray(m[:, first : first + ch.bits // 8]), t)
        return raw


def vax(b: np.ndarray, kind: int) -> np.ndarray:
    """VAX F, D and G floats (types 4, 5, 6): 16-bit words from the most significant on, a hidden half."""
    words = b.view("<u2").astype(np.uint64)
    value = np.zeros(len(b), np.uint64)
    for i in range(words.shape[1]):
        value = value << np.uint64(16) | words[:, i]
    bits, exponent = 16 * words.shape[1], 11 if kind == 6 else 8
    fraction = bits - 1 - exponent
    sign = np.where(value >> np.uint64(bits - 1), -1.0, 1.0)
    e = (value >> np.uint64(fraction) & np.uint64((1 << exponent) - 1)).astype(np.int64)
    f = (value & np.uint64((1 << fraction) - 1)).astype(np.float64) / 2.0**fraction
    return np.where(e == 0, 0.0, sign * (0.5 + f / 2) * np.exp2((e - (1 << (exponent - 1))).astype(np.float64)))


def read_group3(spark: SparkSession, path: str, dg: int = 0, cg: int = 0, raw: bool = False) -> DataFrame:
    """A channel group as a wide table with ``idx``; decoded by one task, as its records may be mixed."""
    f = Mdf3.open(path)
    g = next((x for x in f.groups if (x.dg, x.cg) == (dg, cg)), None)
    if g is None:
        raise MdfError(f"no channel group {dg}.{cg}")
    kinds = {c.name: "string" if c.data_type == 7 else "binary" if c.data_type == 8 else "double" if c.data_type in (2, 3, 4, 5, 6, 11, 12, 15, 16) else "bigint" if c.bits < 64 or c.data_type in (1, 10, 14) else "double" for c in g.channels}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _ in range(len(b)):
                mine = Mdf3.open(path)
                group = next(x for x in mine.groups if (x.dg, x.cg) == (dg, cg))
                m = mine.records(group)
                for at in range(0, max(1, len(m)), 65_536):
                    part = m[at : at + 65_536]
                    cols = {"idx": np.arange(at, at + len(part))}
                    for c in group.channels:
                        v = mine.values(part, c)
                        cols[c.name] = v if isinstance(v, list) else v.astype(np.int64 if kinds[c.name] == "bigint" else np.float64)
                    yield pd.DataFrame(cols)

    schema = "idx bigint, " + ", ".join(f"`{n}` {k}" for n, k in kinds.items())
    df = spark.range(1).mapInPandas(run, schema)
    if raw:
        return df
    by = {c.name: c for c in g.channels}
    return df.select("idx", *[(physical(F.col(f"`{n}`"), by[n].conversion) if by[n].conversion and kinds[n] not in ("string", "binary") else F.col(f"`{n}`")).alias(n) for n in kinds])
