"""Recordings as streams: a source that follows a growing file, windows of bounded size, and stateful
holds over unbounded series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from gaugeline.sources.mdf4 import Mdf4, MdfError, column_type, decode, read_group, record_range, unique_names, validity


class GrowingReader(SimpleDataSourceStreamReader):
    """Offsets count the records that the file holds; a micro-batch decodes those that came since."""

    def __init__(self, options: dict) -> None:
        self.path, self.dg, self.cg = options["path"], int(options.get("dg", 0)), int(options.get("cg", 0))
        self.most = int(options.get("maxrecords", 100_000))

    def initialOffset(self) -> dict:
        return {"records": 0}

    def _available(self) -> int:
        f = Mdf4.open(self.path)
        g = f.group(self.dg, self.cg)
        size = g.record_size + g.rec_id_size
        n = sum(p[2] for p in f.pieces(g.data_link)) // max(1, size)
        return n if f.unfinished or not g.cycles else min(n, g.cycles)

    def _rows(self, first: int, last: int) -> Iterator[tuple]:
        f = Mdf4.open(self.path)
        g = f.group(self.dg, self.cg)
        m = record_range(f, g, first, last - first)
        cols: list = [range(first, last)]
        for c in g.channels:
            cols.append(decode(m, c, first, f.payloads(g, c) if c.kind == 1 else b"").to_pylist())
            ok = validity(m, g, c)
            cols.append([True] * len(m) if ok is None else ok.tolist())
        return zip(*cols, strict=True)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        first = start["records"]
        last = min(self._available(), first + self.most)
        return (self._rows(first, last) if last > first else iter(())), {"records": max(first, last)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._rows(start["records"], end["records"]) if end["records"] > start["records"] else iter(())


class GrowingSource(DataSource):
    """``spark.readStream.format("mdf_stream").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "mdf_stream"

    def schema(self) -> T.StructType:
        g = Mdf4.open(self.options["path"]).group(int(self.options.get("dg", 0)), int(self.options.get("cg", 0)))
        names = unique_names(g)
        fields = [T.StructField("idx", T.LongType())]
        for c in g.channels:
            fields += [T.StructField(names[c.cn], column_type(c)), T.StructField(f"{names[c.cn]}__valid", T.BooleanType())]
        return T.StructType(fields)

    def simpleStreamReader(self, schema: T.StructType) -> GrowingReader:
        return GrowingReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingSource)


def chunks(df: DataFrame, size: int, order: Sequence[str] = ("idx",)) -> Iterator[pd.DataFrame]:
    """Windows of at most ``size`` rows in order. Tasks hand over Arrow batches of at most a window, and the
    driver holds a few of them and a window at a time."""
    if size <= 0:
        raise ValueError("a window needs at least one row")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema) as w:
                    w.write_batch(b.slice(at, size))
                yield pa.record_batch([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch"])

    held: list[pa.Table] = []
    rows = 0
    for row in df.orderBy(*order).mapInArrow(packed, "batch binary").toLocalIterator(prefetchPartitions=True):
        held.append(pa.ipc.open_stream(row["batch"]).read_all())
        rows += held[-1].num_rows
        while rows >= size:
            whole = pa.concat_tables(held)
            yield whole.slice(0, size).to_pandas()
            held, rows = [whole.slice(size)], rows - size
    if rows:
        yield pa.concat_tables(held).to_pandas()


def aligned_chunks(spark: SparkSession, path: str, names: Sequence[str], size: int) -> Iterator[pd.DataFrame]:
    """Windows of several channels of one group with their axis: the same samples of each in every window."""
    f = Mdf4.open(path)
    places = [(g.dg, g.cg) for g in f.groups if set(names) <= {c.name for c in g.channels}]
    if not places:
        raise MdfError(f"no group holds {', '.join(names)}")
    yield from chunks(read_group(spark, path, *places[0], list(names)), size)


def windowed_stats(stream: DataFrame, width: str, lateness: str, key: str = "series", ts: str = "ts") -> DataFrame:
    """Count, mean, least and greatest value of each key and time window; late rows beyond the watermark
    are dropped by the engine, the state is one row a key and open window."""
    return (
        stream.withWatermark(ts, lateness).groupBy(F.window(ts, width), key)
        .agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
        .select(key, F.col("window.start").alias("start"), "n", "mean", "min", "max")
    )


def held(stream: DataFrame, key: str = "series") -> DataFrame:
    """Each sample with the value before it in arrival order, over any number of micro-batches."""
    kinds = f"{key} string, t double, v double, before double"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for g in frames:
            g = g.sort_values("t")
            before = g["v"].shift(1)
            if len(g):
                before.iloc[0] = last
                last = float(g["v"].iloc[-1])
            yield pd.DataFrame({key: k[0], "t": g["t"], "v": g["v"], "before": before})
        if last is not None:
            state.update((last,))

    return stream.groupBy(key).applyInPandasWithState(step, kinds, "last double", "append", "NoTimeout")
