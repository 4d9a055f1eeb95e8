"""MDF 4 recordings: structure on the driver, samples on the executors.

``Mdf4.open`` parses a file's blocks into a catalog without touching samples. The ``mdf`` data source
reads one channel group as a wide table of raw values; each task decodes a range of records with numpy.
``read_group`` adds the conversions as column expressions, and ``read_series`` the long form.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gaugeline.functions.conversions import TEXT_KINDS, Conversion, applies_to_text, physical
from gaugeline.functions.text import comment_text, metadata_map

MAX_ALLOC = 64 << 20
MAX_INFLATED = 1 << 30
RECORDS_PER_TASK = 1_000_000
#: Bytes of a window that a distant source keeps, and how many of them.
WINDOW = 64 << 10
WINDOWS = 64
_HEAD = 24


class MdfError(ValueError):
    """A file that can't be read, with the reason."""


class Unsupported(MdfError):
    """A feature that is named instead of being read wrongly."""


@dataclass(frozen=True)
class Block:
    kind: str
    at: int
    length: int
    links: tuple[int, ...]
    data: bytes


@dataclass
class Channel:
    dg: int
    cg: int
    cn: int
    name: str
    unit: str
    comment: str
    kind: int
    sync: int
    data_type: int
    bit_offset: int
    byte_offset: int
    bit_count: int
    flags: int
    inval_bit: int
    conversion: Conversion | None
    data_link: int
    shape: tuple[int, ...] = ()
    stride: tuple[int, ...] = ()

    @property
    def is_master(self) -> bool:
        return self.kind in (2, 3)

    @property
    def is_virtual(self) -> bool:
        return self.kind in (3, 6)

    @property
    def is_text(self) -> bool:
        return self.data_type in (6, 7, 8, 9)


@dataclass
class Group:
    dg: int
    cg: int
    record_id: int
    cycles: int
    flags: int
    data_bytes: int
    inval_bytes: int
    name: str
    rec_id_size: int
    sorted: bool
    data_link: int
    channels: list[Channel] = field(default_factory=list)

    @property
    def record_size(self) -> int:
        return self.data_bytes + self.inval_bytes

    @property
    def master(self) -> Channel | None:
        return next((c for c in self.channels if c.is_master), None)


class Source:
    """Byte ranges of a file, through a function (offset, length) -> bytes."""

    def __init__(self, fetch: Callable[[int, int], bytes], size: int) -> None:
        self.fetch, self.size = fetch, size

    @classmethod
    def of_path(cls, path: str) -> Source:
        """A file that is mounted here, or an object of a store that Arrow's file systems know (s3://, gs://, hdfs://)."""
        scheme, _, rest = path.partition("://")
        if not rest or scheme == "file":
            return cls.of_file(rest or path)
        import pyarrow.fs

        system, at = pyarrow.fs.FileSystem.from_uri(path)
        f = system.open_input_file(at)
        return cls.windowed(lambda a, n: f.read_at(n, a), f.size())

    @classmethod
    def windowed(cls, fetch: Callable[[int, int], bytes], size: int) -> Source:
        """A source whose small reads are served from the ``WINDOWS`` windows read last; a read larger than a
        window goes to the store itself."""

        @functools.lru_cache(maxsize=WINDOWS)
        def window(k: int) -> bytes:
            return fetch(k * WINDOW, min(WINDOW, size - k * WINDOW))

        def get(at: int, n: int) -> bytes:
            n = max(0, min(n, size - at))
            if n > WINDOW:
                return fetch(at, n)
            part = b"".join(window(k) for k in range(at // WINDOW, (at + n - 1) // WINDOW + 1)) if n else b""
            return part[at % WINDOW : at % WINDOW + n]

        return cls(get, size)

    @classmethod
    def of_file(cls, path: str) -> Source:
        f = open(path, "rb")  # noqa: SIM115 - lives as long as the source

        def fetch(at: int, n: int) -> bytes:
            f.seek(at)
            return f.read(n)

        f.seek(0, 2)
        return cls(fetch, f.tell())

    @classmethod
    def of_bytes(cls, raw: bytes) -> Source:
        return cls(lambda at, n: raw[at : at + n], len(raw))

    def read(self, at: int, n: int) -> bytes:
        got = self.fetch(at, n)
        if len(got) < n:
            raise MdfError(f"the file ends at {self.size}, {n} bytes at {at} are missing")
        return got


class Mdf4:
    """The structure of one file."""

    def __init__(self, source: Source) -> None:
        self.source = source
        head = source.read(0, 64)
        if head[:8] not in (b"MDF     ", b"UnFinMF "):
            raise MdfError("the file is no MDF file")
        self.version = struct.unpack_from("<H", head, 28)[0]
        if self.version not in (400, 410, 411, 420):
            raise Unsupported(f"version {self.version / 100:.2f} is not read here")
        self.unfinished = head[:8] == b"UnFinMF "
        self.blocks: dict[int, Block] = {}
        self._conversions: dict[int, Conversion | None] = {}
        hd = self.block(64, "HD")
        self.start_ns, self.tz_min, self.dst_min = struct.unpack_from("<qhh", hd.data)
        self.comment = self.text(hd.links[5])
        self.header = hd
        self.groups = self._groups(hd.links[0])

    @classmethod
    def open(cls, path: str) -> Mdf4:
        return cls(Source.of_path(path))

    @classmethod
    def from_bytes(cls, raw: bytes) -> Mdf4:
        return cls(Source.of_bytes(raw))

    def block(self, at: int, want: str | None = None, payload: bool = True) -> Block:
        if at in self.blocks and (self.blocks[at].data or not payload):
            return self.blocks[at]
        mark, _, length, links = struct.unpack("<4sIQQ", self.source.read(at, _HEAD))
        if mark[:2] != b"##" or length < _HEAD or links > (length - _HEAD) // 8:
            raise MdfError(f"no block at {at}")
        kind = mark[2:].decode("ascii", "replace")
        if want and kind not in want.split("|"):
            raise MdfError(f"a {kind} block at {at} where {want} is expected")
        if payload and length > MAX_INFLATED:
            raise MdfError(f"the block at {at} has {length} bytes")
        raw = self.source.read(at + _HEAD, 8 * links)
        data = self.source.read(at + _HEAD + 8 * links, length - _HEAD - 8 * links) if payload else b""
        out = Block(kind, at, length, struct.unpack(f"<{links}Q", raw), data)
        self.blocks[at] = out
        return out

    def chain(self, at: int, kind: str) -> Iterator[Block]:
        """A linked list by its first link; a circle is an error."""
        met: set[int] = set()
        while at:
            if at in met:
                raise MdfError(f"the {kind} list runs in a circle at {at}")
            met.add(at)
            b = self.block(at, kind)
            yield b
            at = b.links[0]

    def text(self, at: int) -> str:
        if not at:
            return ""
        raw = self.block(at, "TX|MD").data
        text = raw.split(b"\0", 1)[0].decode("utf-8", "replace")
        return comment_text(text) if text.lstrip().startswith("<") else text

    def metadata(self) -> dict[str, str]:
        at = self.header.links[5]
        return metadata_map(self.block(at).data.split(b"\0", 1)[0].decode("utf-8", "replace")) if at else {}

    def _groups(self, first: int) -> list[Group]:
        out = []
        for d, dg in enumerate(self.chain(first, "DG")):
            size = dg.data[0]
            cgs = list(self.chain(dg.links[1], "CG"))
            for c, cg in enumerate(cgs):
                rid, cycles, flags, _sep, _, data, inval = struct.unpack_from("<QQHHIII", cg.data)
                g = Group(d, c, rid, cycles, flags, data, inval, self.text(cg.links[2]), size, not (size and len(cgs) > 1), dg.links[2])
                if not flags & 1:
                    self._channels(g, cg.links[1], "", d, c)
                out.append(g)
        return out

    def _channels(self, g: Group, first: int, parent: str, d: int, c: int, base: int = 0) -> None:
        for cn in self.chain(first, "CN"):
            kind, sync, dtype, bit, byte, bits, flags, ipos = struct.unpack_from("<BBBBIIII", cn.data)
            name = self.text(cn.links[2])
            if parent and not name.startswith(parent + "."):
                name = f"{parent}.{name}"
            shape: tuple[int, ...] = ()
            stride: tuple[int, ...] = ()
            composed = cn.links[1]
            if composed and self.block(composed).kind == "CA":
                shape, stride = self._array(self.block(composed), bits)
            ch = Channel(d, c, len(g.channels), name, self.text(cn.links[6]), self.text(cn.links[7]), kind, sync, dtype, bit, byte + base, bits, flags, ipos, self._conversion(cn.links[4]), cn.links[5], shape, stride)
            g.channels.append(ch)
            if composed and self.block(composed).kind == "CN":
                self._channels(g, composed, name, d, c, base)

    def _array(self, ca: Block, bits: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
        kind, storage, ndim, flags, base, _inv = struct.unpack_from("<BBHIiI", ca.data)
        shape = struct.unpack_from(f"<{ndim}Q", ca.data, 16)
        if storage != 0:
            raise Unsupported("arrays over channel groups or data groups")
        if flags & 1:
            raise Unsupported("arrays of dynamic size")
        strides, step = [0] * ndim, base or -(-bits // 8)
        order = range(ndim) if flags & 64 else range(ndim - 1, -1, -1)
        for i in order:
            strides[i] = step
            step *= shape[i]
        return tuple(shape), tuple(strides)

    def _conversion(self, at: int) -> Conversion | None:
        if not at:
            return None
        if at in self._conversions:
            return self._conversions[at]
        self._conversions[at] = None  # a circle ends here
        b = self.block(at, "CC")
        kind, _prec, _flags, nref, nval = struct.unpack_from("<BBHHH", b.data)
        v = struct.unpack_from(f"<{nval}d", b.data, 24) if kind != 11 else struct.unpack_from(f"<{nval}Q", b.data, 24)
        refs = b.links[4 : 4 + nref]

        def entry(link: int):
            if not link:
                return ""
            return self._conversion(link) if self.block(link).kind == "CC" else self.text(link)

        if kind == 0:
            c = Conversion("identity")
        elif kind == 1:
            c = Conversion("linear", (v[1], v[0]))
        elif kind == 2:
            c = Conversion("rational", v)
        elif kind == 3:
            c = Conversion("formula", text=self.text(refs[0]))
        elif kind in (4, 5):
            c = Conversion("interpolated" if kind == 4 else "nearest", keys=v[0::2], results=v[1::2])
        elif kind == 6:
            n = len(v) // 3 * 3
            c = Conversion("range_to_value", keys=v[0:n:3], upper=v[1:n:3], results=v[2:n:3], default=v[n] if len(v) % 3 == 1 else None)
        elif kind == 7:
            r = [entry(x) for x in refs]
            c = Conversion("value_to_text", keys=v, results=r[: len(v)], default=(r[len(v)] if len(r) > len(v) else None) or None)
        elif kind == 8:
            r = [entry(x) for x in refs]
            n = len(v) // 2
            c = Conversion("range_to_text", keys=v[0 : 2 * n : 2], upper=v[1 : 2 * n : 2], results=r[:n], default=(r[n] if len(r) > n else None) or None)
        elif kind == 9:
            c = Conversion("text_to_value", keys=[self.text(x) for x in refs], results=v[:nref], default=v[nref] if nval > nref else None)
        elif kind == 10:
            t = [self.text(x) for x in refs]
            c = Conversion("text_to_text", keys=t[0:-1:2], results=t[1:-1:2], default=t[-1] if len(t) % 2 else None)
        elif kind == 11:
            r = [entry(x) for x in refs]
            names = [self.text(self.block(x).links[0]) if x and self.block(x).kind == "CC" else "" for x in refs]
            c = Conversion("bitfield", masks=v, results=r, names=names)
        else:
            c = Conversion(f"unsupported {kind}")
        self._conversions[at] = c
        return c

    # -- sample data --

    def pieces(self, at: int) -> list[tuple[str, int, int, int]]:
        """(kind, address, length of the plain data, length on disk) of the data blocks below a link."""
        out: list[tuple[str, int, int, int]] = []
        met: set[int] = set()
        stack = [at] if at else []
        while stack:
            here = stack.pop(0)
            if not here:
                continue
            if here in met:
                raise MdfError(f"the data list runs in a circle at {here}")
            met.add(here)
            b = self.block(here, payload=False)
            if b.kind in ("DT", "SD", "RD", "DV", "DI"):
                n = b.length - _HEAD
                if self.unfinished and not n:
                    n = self.source.size - here - _HEAD
                out.append((b.kind, here, n, n))
            elif b.kind == "DZ":
                plain, packed = struct.unpack("<QQ", self.source.read(here + _HEAD + 8, 16))
                out.append((b.kind, here, plain, packed))
            elif b.kind in ("DL", "LD"):
                n = b.links[1:]
                if b.kind == "LD":
                    flags, count = struct.unpack_from("<II", self.source.read(here + _HEAD + 8 * len(b.links), 8))
                    n = b.links[1 : 1 + count]
                    if flags & (1 << 31):
                        raise Unsupported("column-oriented data with invalidation blocks")
                stack = [*n, b.links[0], *stack]
            elif b.kind == "HL":
                stack = [b.links[0], *stack]
            else:
                raise MdfError(f"a {b.kind} block at {here} among data")
        return out

    def plain(self, piece: tuple[str, int, int, int]) -> bytes:
        return plain_data(self.source, piece)

    def stream(self, at: int) -> bytes:
        return b"".join(self.plain(p) for p in self.pieces(at))

    def group(self, dg: int, cg: int) -> Group:
        for g in self.groups:
            if (g.dg, g.cg) == (dg, cg):
                return g
        raise MdfError(f"no channel group {dg}.{cg}")

    def records(self, g: Group) -> np.ndarray:
        """The group's records as a matrix of bytes."""
        raw = self.stream(g.data_link)
        if g.sorted:
            size = g.record_size + g.rec_id_size
            n = len(raw) // size if size else g.cycles
            n = min(n, g.cycles) if g.cycles and g.cycles <= n else n
            return np.frombuffer(raw, np.uint8, n * size).reshape(n, size)[:, g.rec_id_size :]
        return np.frombuffer(self._demultiplexed(g, raw)[g.record_id], np.uint8).reshape(-1, max(1, g.record_size))

    def _demultiplexed(self, g: Group, raw: bytes) -> dict[int, bytes]:
        """The records of every group of an unsorted data group, by record id; VLSD groups as payload streams."""
        mates = {x.record_id: x for x in self.groups if x.dg == g.dg}
        parts: dict[int, list[bytes]] = {i: [] for i in mates}
        at, n = 0, g.rec_id_size
        while at + n <= len(raw):
            rid = int.from_bytes(raw[at : at + n], "little")
            mate = mates.get(rid)
            if mate is None:
                break
            at += n
            size = 4 + int.from_bytes(raw[at : at + 4], "little") if mate.flags & 1 else mate.record_size
            if at + size > len(raw):
                break
            parts[rid].append(raw[at : at + size])
            at += size
        return {i: b"".join(p) for i, p in parts.items()}

    def payloads(self, g: Group, ch: Channel) -> bytes:
        """The stream that a channel of variable length points into."""
        if not ch.data_link:
            return b""
        b = self.block(ch.data_link, payload=False)
        if b.kind == "CG":
            mate = next(x for x in self.groups if x.dg == g.dg and x.flags & 1 and self._cg_at(x) == ch.data_link)
            return self._demultiplexed(g, self.stream(g.data_link))[mate.record_id]
        return self.stream(ch.data_link)

    def payload_range(self, g: Group, ch: Channel, m: np.ndarray) -> tuple[bytes, int]:
        """(bytes, place of the first one in the stream): the part of the stream that a matrix of records points
        into; only the data blocks that hold it are read."""
        if not ch.data_link or self.block(ch.data_link, payload=False).kind == "CG" or not len(m):
            return self.payloads(g, ch), 0
        at = _bits(m, ch.byte_offset, ch.bit_offset, ch.bit_count, False)
        low, high = int(at.min()), int(at.max())
        got, start, end = [], None, 0
        for p in self.pieces(ch.data_link):
            first, end = end, end + p[2]
            if end <= low:
                continue
            if start is not None and first >= high + 4:
                held = b"".join(got)
                got = [held]
                if first - start >= high - start + 4 + int.from_bytes(held[high - start : high - start + 4], "little"):
                    break
            start = first if start is None else start
            got.append(self.plain(p))
        return b"".join(got), start or 0

    def _cg_at(self, g: Group) -> int:
        dg = list(self.chain(self.header.links[0], "DG"))[g.dg]
        return list(self.chain(dg.links[1], "CG"))[g.cg].at

    def catalog(self, spark: SparkSession, file_id: int = 0) -> DataFrame:
        """One row a channel."""
        rows = [(file_id, c.dg, c.cg, c.cn, c.name, c.unit, c.comment, "master" if c.is_master else "virtual" if c.is_virtual else "value", c.data_type, c.bit_count, c.byte_offset, c.bit_offset, c.conversion.kind if c.conversion else "identity", g.cycles, list(c.shape)) for g in self.groups for c in g.channels]
        return spark.createDataFrame(rows, "file_id int, dg int, cg int, cn int, name string, unit string, comment string, channel_type string, data_type int, bit_count int, byte_offset int, bit_offset int, conversion string, sample_count long, shape array<long>")

    def block_map(self, spark: SparkSession) -> DataFrame:
        """Every block that links reach: (address, type, length, links)."""
        stack, met = [64], {}
        while stack:
            at = stack.pop()
            if at in met or not at:
                continue
            b = self.block(at, payload=False)
            met[at] = b
            stack += [x for x in b.links if x and x + _HEAD <= self.source.size]
        return spark.createDataFrame([(b.at, b.kind, b.length, list(b.links)) for b in met.values()], "address long, type string, length long, links array<long>")


def plain_data(source: Source, piece: tuple[str, int, int, int]) -> bytes:
    """A data block's bytes, inflated and un-transposed."""
    kind, at, n, _ = piece
    if kind != "DZ":
        _, _, _, links = struct.unpack("<4sIQQ", source.read(at, _HEAD))
        return source.read(at + _HEAD + 8 * links, n)
    _orig, how, _, columns, size, packed = struct.unpack("<2sBBIQQ", source.read(at + _HEAD, 24))
    if size > MAX_INFLATED:
        raise MdfError(f"the block at {at} inflates to {size} bytes")
    body = source.read(at + _HEAD + 24, packed)
    if how in (0, 1):
        d = zlib.decompressobj()
        raw = d.decompress(body, size)
    elif how in (2, 3):
        try:
            import zstandard
        except ImportError as e:
            raise Unsupported("zstd data, and no zstandard module") from e
        raw = zstandard.ZstdDecompressor().decompress(body, max_output_size=size)
    elif how in (4, 5):
        raw = pa.decompress(body, decompressed_size=size, codec="lz4", asbytes=True)
    else:
        raise Unsupported(f"compression {how}")
    if len(raw) != size:
        raise MdfError(f"the block at {at} inflates to {len(raw)} of {size} bytes")
    return untransposed(raw, columns) if how in (1, 3, 5) else raw


def untransposed(raw: bytes, columns: int) -> bytes:
    lines = len(raw) // columns if columns else 0
    if lines < 2:
        return raw
    body = np.frombuffer(raw, np.uint8, lines * columns).reshape(columns, lines).T.tobytes()
    return body + raw[lines * columns :]


def transposed(raw: bytes, columns: int) -> bytes:
    lines = len(raw) // columns if columns else 0
    if lines < 2:
        return raw
    return np.frombuffer(raw, np.uint8, lines * columns).reshape(lines, columns).T.tobytes() + raw[lines * columns :]


# -- decoding ------------------------------------------------------------------------------------------


def _bits(m: np.ndarray, byte: int, bit: int, bits: int, big: bool) -> np.ndarray:
    """A field of up to 64 bits of every record, as unsigned numbers."""
    out = np.zeros(len(m), np.uint64)
    if bit > 7 or not 1 <= bits <= 64:
        return out
    n = (bit + bits + 7) // 8
    for i in range(n):
        b = m[:, byte + (n - 1 - i if big else i)].astype(np.uint64)
        move = 8 * i - bit
        out |= b << np.uint64(move) if 0 <= move < 64 else b >> np.uint64(-move) if move < 0 else np.uint64(0)
    return out & np.uint64((1 << bits) - 1) if bits < 64 else out


def _numbers(m: np.ndarray, ch: Channel, byte: int) -> np.ndarray:
    big = ch.data_type in (1, 3, 5)
    raw = _bits(m, byte, ch.bit_offset, ch.bit_count, big)
    if ch.data_type in (2, 3):
        up = np.uint64(64 - ch.bit_count)
        return (raw << up).view(np.int64) >> np.int64(64 - ch.bit_count)
    if ch.data_type in (4, 5):
        if ch.bit_count == 64:
            return raw.view(np.float64)
        if ch.bit_count == 32:
            return raw.astype(np.uint32).view(np.float32)
        if ch.bit_count == 16:
            return raw.astype(np.uint16).view(np.float16).astype(np.float32)
        raise Unsupported(f"floats of {ch.bit_count} bits")
    return raw


_CHARSETS = {6: "latin-1", 7: "utf-8", 8: "utf-16-le", 9: "utf-16-be"}


def _string(raw: bytes, data_type: int) -> str:
    return raw.decode(_CHARSETS[data_type], "replace").split("\0", 1)[0]


def column_type(ch: Channel) -> T.DataType:
    if ch.shape:
        return T.ArrayType(T.DoubleType())
    if ch.is_virtual:
        return T.LongType()
    if ch.is_text:
        return T.StringType()
    if ch.data_type in (4, 5):
        return T.DoubleType() if ch.bit_count > 32 else T.FloatType()
    if ch.data_type in (0, 1):
        return T.ShortType() if ch.bit_count <= 8 else T.IntegerType() if ch.bit_count <= 16 else T.LongType() if ch.bit_count <= 63 else T.DecimalType(20, 0)
    if ch.data_type in (2, 3):
        return T.ByteType() if ch.bit_count <= 8 else T.ShortType() if ch.bit_count <= 16 else T.IntegerType() if ch.bit_count <= 32 else T.LongType()
    if ch.data_type == 13:
        return T.StructType([T.StructField(n, T.IntegerType()) for n in ("year", "month", "day", "hour", "minute", "ms", "day_of_week", "summer_time")])
    if ch.data_type == 14:
        return T.StructType([T.StructField("ms", T.LongType()), T.StructField("days", T.IntegerType())])
    if ch.data_type in (15, 16):
        return T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])
    return T.BinaryType()


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def decode(m: np.ndarray, ch: Channel, first: int = 0, payloads: bytes = b"", base: int = 0) -> pa.Array:
    """A channel's raw values in a matrix of records; ``payloads`` begins at ``base`` of the channel's stream."""
    kind = _arrow(column_type(ch))
    if ch.shape:
        size = int(np.prod(ch.shape))
        flat = [sum(i * s for i, s in zip(np.unravel_index(k, ch.shape), ch.stride, strict=True)) for k in range(size)]
        values = np.stack([_numbers(m, ch, ch.byte_offset + int(o)).astype(np.float64) for o in flat], 1) if size else np.zeros((len(m), 0))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, (len(m) + 1) * size, size or 1, dtype=np.int32)[: len(m) + 1]), pa.array(values.reshape(-1)))
    if ch.is_virtual:
        return pa.array(np.arange(first, first + len(m), dtype=np.int64))
    if ch.kind == 1:
        at = [int(a) - base for a in _bits(m, ch.byte_offset, ch.bit_offset, ch.bit_count, False).tolist()]
        blobs = [payloads[int(a) + 4 : int(a) + 4 + int.from_bytes(payloads[int(a) : int(a) + 4], "little")] if int(a) + 4 <= len(payloads) else b"" for a in at]
        return pa.array([_string(x, ch.data_type) for x in blobs] if ch.is_text else blobs, kind)
    if ch.data_type in (0, 1, 2, 3, 4, 5):
        v = _numbers(m, ch, ch.byte_offset)
        return pa.array([int(x) for x in v], kind) if pa.types.is_decimal(kind) else pa.array(v).cast(kind)
    raw = np.ascontiguousarray(m[:, ch.byte_offset : ch.byte_offset + -(-ch.bit_count // 8)])
    rows = [r.tobytes() for r in raw]
    if ch.is_text:
        return pa.array([_string(r, ch.data_type) for r in rows], kind)
    if ch.data_type == 13:
        out = []
        for r in rows:
            ms, minute, hour, day, month, year = struct.unpack("<HBBBBB", r[:7])
            out.append({"year": 1984 + (year & 127), "month": month & 63, "day": day & 31, "hour": hour & 31, "minute": minute & 63, "ms": ms, "day_of_week": day >> 5, "summer_time": hour >> 7})
        return pa.array(out, kind)
    if ch.data_type == 14:
        return pa.array([{"ms": struct.unpack("<I", r[:4])[0] & 0x0FFFFFFF, "days": struct.unpack("<H", r[4:6])[0]} for r in rows], kind)
    if ch.data_type in (15, 16):
        code = ("<" if ch.data_type == 15 else ">") + ("2d" if ch.bit_count == 128 else "2f")
        return pa.array([dict(zip(("re", "im"), struct.unpack(code, r), strict=True)) for r in rows], kind)
    return pa.array(rows, kind)


def validity(m: np.ndarray, g: Group, ch: Channel) -> np.ndarray | None:
    """True where a sample is valid; None where the file says nothing."""
    if ch.flags & 1:
        return np.zeros(len(m), bool)
    if not ch.flags & 2 or not g.inval_bytes or ch.inval_bit >= 8 * g.inval_bytes:
        return None
    return m[:, g.data_bytes + ch.inval_bit // 8] >> (ch.inval_bit % 8) & 1 == 0


def kind_of_channel(ch: Channel) -> str:
    """What a channel's samples are: array, text, bytes, f64, or the name of a kind of their own."""
    if ch.shape:
        return "array"
    if ch.kind in (1, 5):
        return "text" if ch.kind == 1 and ch.is_text else "bytes"
    if ch.is_text or ch.conversion is not None and ch.conversion.kind in TEXT_KINDS:
        return "text"
    own = {13: "canopen_date", 14: "canopen_time", 15: "complex", 16: "complex"}
    return "f64" if ch.data_type <= 5 else own.get(ch.data_type, "bytes")


def unique_names(g: Group) -> dict[int, str]:
    """Column names by channel number; repeated ones carry their place."""
    seen: dict[str, int] = {}
    for c in g.channels:
        seen[c.name] = seen.get(c.name, 0) + 1
    return {c.cn: c.name if seen[c.name] == 1 else f"{c.name}#{c.dg}.{c.cg}.{c.cn}" for c in g.channels}


def _chosen(g: Group, wanted: list[str] | None) -> list[Channel]:
    names = unique_names(g)
    if wanted is None:
        return g.channels
    missing = [w for w in wanted if w not in names.values() and w not in {c.name for c in g.channels}]
    if missing:
        raise MdfError(f"no channel {missing[0]} in group {g.dg}.{g.cg}")
    return [c for c in g.channels if names[c.cn] in wanted or c.name in wanted or c.is_master]


class RecordRange(InputPartition):
    def __init__(self, path: str, first: int, count: int) -> None:
        super().__init__((path, first, count))
        self.path, self.first, self.count = path, first, count


class MdfReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.dg, self.cg = int(options.get("dg", 0)), int(options.get("cg", 0))
        self.wanted = options["channels"].split("\n") if options.get("channels") else None
        self.per_task = int(options.get("recordspertask", RECORDS_PER_TASK))

    def partitions(self) -> list[RecordRange]:
        f = Mdf4.open(self.path)
        g = f.group(self.dg, self.cg)
        if not g.sorted:  # a walk over the records: one task
            return [RecordRange(self.path, 0, -1)]
        total = sum(p[2] for p in f.pieces(g.data_link))
        size = g.record_size + g.rec_id_size
        n = total // size if size else g.cycles
        n = min(n, g.cycles) if g.cycles else n
        return [RecordRange(self.path, i, min(self.per_task, n - i)) for i in range(0, n, self.per_task)] or [RecordRange(self.path, 0, 0)]

    def read(self, partition: RecordRange) -> Iterator[pa.RecordBatch]:
        f = Mdf4.open(partition.path)
        g = f.group(self.dg, self.cg)
        channels = _chosen(g, self.wanted)
        names = unique_names(g)
        if partition.count < 0:
            m, first = f.records(g), 0
        else:
            m, first = record_range(f, g, partition.first, partition.count), partition.first
        streams = {c.cn: f.payload_range(g, c, m) for c in channels if c.kind == 1}
        step = 65_536
        for at in range(0, max(1, len(m)), step):
            part = m[at : at + step]
            cols, heads = [pa.array(np.arange(first + at, first + at + len(part), dtype=np.int64))], ["idx"]
            for c in channels:
                cols.append(decode(part, c, first + at, *streams.get(c.cn, (b"", 0))))
                heads.append(names[c.cn])
                ok = validity(part, g, c)
                cols.append(pa.array(np.ones(len(part), bool) if ok is None else ok))
                heads.append(f"{names[c.cn]}__valid")
            yield pa.RecordBatch.from_arrays(cols, names=heads)


def record_range(f: Mdf4, g: Group, first: int, count: int) -> np.ndarray:
    """Records first .. first+count-1 of a sorted group; only the data blocks that hold them are read."""
    size = g.record_size + g.rec_id_size
    lo, hi, at, got = first * size, (first + count) * size, 0, []
    start = None
    for p in f.pieces(g.data_link):
        if at < hi and at + p[2] > lo:
            start = at if start is None else start
            got.append(f.plain(p))
        at += p[2]
    raw = b"".join(got)
    cut = lo - (start or 0)
    return np.frombuffer(raw, np.uint8, count * size, cut).reshape(count, size)[:, g.rec_id_size :] if count else np.zeros((0, g.record_size), np.uint8)


class MdfSource(DataSource):
    """``spark.read.format("mdf").option("dg", 0).option("cg", 0).load(path)``: one channel group, raw."""

    @classmethod
    def name(cls) -> str:
        return "mdf"

    def schema(self) -> T.StructType:
        f = Mdf4.open(self.options["path"])
        g = f.group(int(self.options.get("dg", 0)), int(self.options.get("cg", 0)))
        wanted = self.options["channels"].split("\n") if self.options.get("channels") else None
        names = unique_names(g)
        fields = [T.StructField("idx", T.LongType(), False)]
        for c in _chosen(g, wanted):
            about = {"unit": c.unit, "comment": c.comment, "dg": c.dg, "cg": c.cg, "cn": c.cn}
            fields += [T.StructField(names[c.cn], column_type(c), True, about), T.StructField(f"{names[c.cn]}__valid", T.BooleanType(), False)]
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> MdfReader:
        return MdfReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool):
        from gaugeline.sources.mdf4_write import MdfWriterTask

        return MdfWriterTask(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MdfSource)


def converted(c: Column, ch: Channel) -> Column:
    """The physical column of a raw one; conversions that start from numbers are ignored on text."""
    conv = ch.conversion
    if conv is None or ch.shape or (ch.is_text and not applies_to_text(conv)) or (not ch.is_text and applies_to_text(conv)):
        return c
    if not ch.is_text and ch.data_type > 5 and not ch.is_virtual:
        return c
    return physical(c, conv, integers=ch.data_type in (0, 1, 2, 3))


def read_group(spark: SparkSession, path: str, dg: int = 0, cg: int = 0, channels: list[str] | None = None, raw: bool = False, per_task: int = RECORDS_PER_TASK) -> DataFrame:
    """A channel group as a wide table: idx, each channel and its validity, physical unless ``raw``."""
    register(spark)
    reader = spark.read.format("mdf").option("dg", dg).option("cg", cg).option("recordsPerTask", per_task)
    df = (reader.option("channels", "\n".join(channels)) if channels else reader).load(path)
    if raw:
        return df
    g = Mdf4.open(path).group(dg, cg)
    names = unique_names(g)
    by = {names[c.cn]: c for c in g.channels}
    return df.select(*[converted(F.col(f"`{n}`"), by[n]).alias(n) if n in by else F.col(f"`{n}`") for n in df.columns])


def read_series(spark: SparkSession, path: str, name: str, dg: int | None = None, cg: int | None = None) -> DataFrame:
    """(series, idx, t, v, valid) of a channel, the first of its name unless its place is given."""
    f = Mdf4.open(path)
    for g in f.groups:
        if dg is not None and g.dg != dg or cg is not None and g.cg != cg:
            continue
        for c in g.channels:
            if c.name == name and not c.is_master:
                names = unique_names(g)
                df = read_group(spark, path, g.dg, g.cg, [names[c.cn]])
                axis = F.col(f"`{names[g.master.cn]}`").cast("double") if g.master else F.col("idx").cast("double")
                return df.select(F.lit(name).alias("series"), "idx", axis.alias("t"), F.col(f"`{names[c.cn]}`").alias("v"), F.col(f"`{names[c.cn]}__valid`").alias("valid"))
    raise MdfError(f"no channel {name}")
