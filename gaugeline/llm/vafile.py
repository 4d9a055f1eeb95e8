"""Exact top-k by vector-approximation files.

Vectors are scaled to integers. The approximation file holds, for each vector, the numbers of its cells (one
byte a component: ``2**BITS`` equal cells of the component's range over all vectors) and nothing else.

1. Query blocks meet blocks of the approximation file by key. A meeting bounds every inner product from above
   and below by the cells, keeps the candidates whose upper bound reaches the k-th largest lower bound there,
   and sends their two bounds.
2. The k-th largest lower bound over all of a query's meetings is shared, and drops candidates of every block.
3. Exact vectors are read in the order of the bounds: first of the k candidates with the largest upper bounds,
   whose k-th exact score is certain, then of those left whose upper bound reaches it; no other vector is read.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part;
vectors of other lengths than the query's are no candidates; equal scores go to the smaller id,
repeated ids are rows of their own and only a row's own id is left out; fewer candidates than k give
them all; an empty table gives an empty result; other columns are left out, whatever their names. Components
beyond 2**24 in size after scaling are multiplied as exact Python integers, and a score beyond the range of a
long is cut to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeline.llm.common import read, small_side, written

K = 10
SCALE = 1024
BITS = 6
QUERY_EVERY = 100
#: Rows of a block of the file and of a query block: bounds of a meeting's memory.
CANDIDATES = 32_768
QUERIES = 4_096
#: Candidates or query vectors that are shipped to every executor at most; more are shuffled.
SHIPPED_ROWS = 100_000
#: Share of the terms' sizes that bounds are moved apart by, above any rounding of their sums.
_SLACK = 1e-12


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(id, dim, v array<long>) of the rows that take part."""
    x = F.col(vec_col).cast("array<double>")
    ok = x.isNotNull() & (F.size(x) > 0) & F.col(id_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c * scale).cast("long"))
    return df.where(ok).select(F.col(id_col).cast("long").alias("id"), F.size(x).alias("dim"), v.alias("v"))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of a list column."""
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.values.to_numpy()[offsets[0] : offsets[-1]]


def cell_bounds(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(low, width) of the cells of each component over all vectors, as long as the longest vector.

    A task sends a row of two bounds for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            offsets, values = _lists(b.column(0))
            for d in np.unique(np.diff(offsets)):
                first = offsets[:-1][np.diff(offsets) == d]
                x = values[first[:, None] + np.arange(d)]
                if d > len(low):
                    more = d - len(low)
                    low, high = np.append(low, np.full(more, np.iinfo(np.int64).max)), np.append(high, np.full(more, np.iinfo(np.int64).min))
                low[:d], high[:d] = np.minimum(low[:d], x.min(0)), np.maximum(high[:d], x.max(0))
        yield pa.record_batch([pa.array(np.arange(len(low), dtype=np.int32)), pa.array(low), pa.array(high)], names=["at", "low", "high"])

    got = vectors.select("v").mapInArrow(run, "at int, low long, high long").groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("at").toPandas()
    low, high = (got[c].to_numpy(np.int64) for c in ("low", "high"))
    span = high.view(np.uint64) - low.view(np.uint64)  # as unsigned numbers no difference overflows
    return low, (span >> np.uint64(BITS)).astype(np.int64) + 1


def approximation_file(vectors: DataFrame, bounds: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(rid, id, dim, cells): a byte for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, width = (x.view(np.uint64) for x in bounds)
        for b in batches:
            offsets, values = _lists(b.column(3))
            at = np.arange(len(values)) - np.repeat(offsets[:-1], np.diff(offsets))
            cells = ((values.view(np.uint64) - low[at]) // width[at]).astype(np.uint8)
            held = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(cells.tobytes())])
            yield pa.record_batch([*b.columns[:3], held], names=["rid", "id", "dim", "cells"])

    return written(vectors.select("rid", "id", "dim", "v").mapInArrow(run, "rid long, id long, dim int, cells binary"), "approximation-file")


def scan(cells: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, bounds: tuple[np.ndarray, np.ndarray], k: int = K) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(query's place, places, lower bounds, upper bounds) of the candidates of a block that can be among the k best."""
    d = queries.shape[1]
    low, width = (x[:d].astype(float) for x in bounds)
    q, c = queries.astype(float), cells.astype(float)
    scaled, base = q * width, q @ low
    more, less = np.maximum(q, 0) @ (width - 1), np.minimum(q, 0) @ (width - 1)
    slack = _SLACK * (np.abs(q) @ (np.abs(low) + width * (1 << BITS)))
    for at in range(0, len(q), 64):
        middle = scaled[at : at + 64] @ c.T + base[at : at + 64, None]
        for j in range(len(middle)):
            i = at + j
            upper, lower = middle[j] + more[i] + slack[i], middle[j] + less[i] - slack[i]
            others = np.flatnonzero(ids != query_ids[i])
            if len(others) > k:
                floor = np.partition(lower[others], len(others) - k)[len(others) - k]
                others = others[upper[others] >= floor]
            yield i, others, lower[others], upper[others]


def _scores(candidates: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, vec_id, score): the candidates' exact vectors are read and multiplied."""
    chosen = written(candidates.select("qrid", "query_id", "rid", "id"), "to-read")
    found = vectors.select("rid", "v").join(small_side(chosen, chosen.count(), SHIPPED_ROWS), "rid")
    both = found.join(small_side(queries.select(F.col("rid").alias("qrid"), F.col("v").alias("q")), queries.count(), SHIPPED_ROWS // 10), "qrid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            (offsets, v), (_, q) = _lists(b.column(2)), _lists(b.column(3))
            longest = int(np.diff(offsets).max())
            biggest = max(int(np.abs(v.astype(float)).max()), int(np.abs(q.astype(float)).max()), 1)
            if longest * biggest * biggest < 1 << 62:
                scores = np.add.reduceat(v * q, offsets[:-1]).tolist()
            else:
                exact = v.astype(object) * q.astype(object)
                scores = [max(-(2**63), min(2**63 - 1, sum(exact[a:z].tolist()))) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(scores, pa.int64())], names=["query_id", "vec_id", "score"])

    return both.select("query_id", F.col("id").alias("vec_id"), "v", "q").mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, candidates: int = CANDIDATES, per_query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) for (id, dim, v) tables of integer vectors."""
    vectors = written(vectors.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    queries = written(queries.withColumn("rid", F.monotonically_increasing_id()), "query-vectors")
    bounds = cell_bounds(vectors.select("v").union(queries.select("v")))
    file = approximation_file(vectors, bounds)
    blocks = max(1, -(-vectors.count() // candidates))
    query_blocks = max(1, -(-queries.count() // per_query_block))
    # every block of the file is dealt once to each query block, by key, and the other way round
    right = file.withColumn("c", F.pmod(F.xxhash64("rid"), F.lit(blocks))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    left = queries.withColumn("q", F.pmod(F.xxhash64("rid"), F.lit(query_blocks))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = F.concat_ws(":", "dim", "c", "q").alias("meet")
    left, right = left.select("rid", "id", "v", met), right.select("rid", "id", "cells", met)
    names = ["qrid", "query_id", "rid", "id", "lower", "upper"]

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(q) and len(c):
            asked, rids, ids = np.array(q["v"].tolist(), np.int64), c["rid"].to_numpy(np.int64), c["id"].to_numpy(np.int64)
            cells = np.frombuffer(b"".join(c["cells"]), np.uint8).reshape(len(c), -1)
            qrid, qid = q["rid"].to_numpy(np.int64), q["id"].to_numpy(np.int64)
            for i, at, lower, upper in scan(cells, ids, asked, qid, bounds, k):
                out.append(pd.DataFrame({"qrid": qrid[i], "query_id": qid[i], "rid": rids[at], "id": ids[at], "lower": lower, "upper": upper}, columns=names))
        return pd.concat(out) if out else pd.DataFrame([], columns=names)

    bounded = left.groupBy("meet").cogroup(right.groupBy("meet")).applyInPandas(meet, "qrid long, query_id long, rid long, id long, lower double, upper double")
    own = W.partitionBy("query_id")
    by_lower = F.row_number().over(own.orderBy(F.desc("lower"), "rid", "qrid"))
    shared = F.max(F.when(F.col("r") == k, F.col("lower"))).over(own)
    left_over = bounded.withColumn("r", by_lower).withColumn("kth", shared).where("kth IS NULL OR upper >= kth")
    by_upper = F.row_number().over(own.orderBy(F.desc("upper"), "rid", "qrid"))
    left_over = written(left_over.drop("r", "kth").withColumn("r", by_upper), "bounded")
    first = written(_scores(left_over.where(F.col("r") <= k), vectors, queries), "first-scores")
    certain = first.groupBy("query_id").agg(F.min("score").alias("least"))
    rest = left_over.where(F.col("r") > k).join(certain, "query_id").where("upper >= least")
    every = first.unionByName(_scores(rest, vectors, queries))
    rank = F.row_number().over(own.orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("id") % QUERY_EVERY == 0))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
