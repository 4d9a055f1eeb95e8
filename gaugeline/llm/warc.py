"""WARC fixity by Merkle trees: find the records in which two replicas of an archive differ.

Records lie in files in a fixed order; a record's leaf is the SHA-256 of its bytes. A node covers an
ordered offset range of its file and hashes its children's hashes in order. Ranges are cut at records
whose key's hash says so, one in ``FANOUT`` on the lowest level, one in ``FANOUT`` of those on the next, so a
lost or added record changes the nodes above it and no others. An audit compares the roots of
both replicas file by file, and descends only below nodes that differ, level by level; below the last one
the records are matched by key, and equal keys by content first, so a lost record is one row.

Defined cases: a null payload is an empty one; null ids come first in file -1 and are told apart by their
hash; records with equal ids are ordered by their hash; a record missing in one replica is reported with that
side's offset null; an empty table gives an empty tree and nothing to report; other columns are left out,
whatever their names; records of any length are hashed whole.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeline.llm.common import read, written

FANOUT = 16
#: Levels of nodes between the leaves and a file's root.
LEVELS = 3
RECORDS_PER_FILE = 1_000
_CRLF = "\r\n"


def record(url: Column, payload: Column) -> Column:
    """The bytes of a WARC/1.0 response record."""
    body = F.coalesce(payload, F.lit("")).cast("binary")
    head = F.concat(
        F.lit(f"WARC/1.0{_CRLF}WARC-Type: response{_CRLF}WARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit(f"{_CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(_CRLF * 2),
    )
    return F.concat(head.cast("binary"), body, F.lit(_CRLF * 2).cast("binary"))


def leaves(records: DataFrame, file: str, key: str, content: str, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(file, ord, key, offset, length, hash, starts) of a table of records; offsets run within a file.

    ``starts`` holds, from the lowest level up, the record that begins the leaf's node (null: the file's start).
    """
    hashed = written(
        records.select(F.col(file).alias("file"), F.col(key).alias("key"), F.octet_length(content).cast("long").alias("length"), F.sha2(F.col(content), 256).alias("hash")),
        "leaves",
    )
    order = W.partitionBy("file").orderBy(F.asc_nulls_first("key"), "hash")
    before = F.sum("length").over(order.rowsBetween(W.unboundedPreceding, -1))
    tag = F.coalesce(F.col("key").cast("string"), F.concat(F.lit("#"), F.col("hash")))
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = [F.last(F.when(F.pmod(F.xxhash64(tag), F.lit(fanout**level)) == 0, tag), ignorenulls=True).over(upto) for level in range(1, levels + 1)]
    return hashed.select(
        "file", (F.row_number().over(order) - 1).cast("long").alias("ord"), "key", F.coalesce(before, F.lit(0)).alias("offset"), "length", "hash", F.array(*starts).alias("starts")
    )


def tree(leaf: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """The nodes of each level above the leaves: (file, starts, ord, hash); the last level has a file's root."""
    out, below = [], leaf.select("file", "starts", "ord", "hash")
    for level in range(1, levels + 2):
        children = F.transform(F.array_sort(F.collect_list(F.struct("ord", "hash"))), lambda s: s["hash"])
        above = F.slice("starts", 2 if level > 1 else 1, levels)
        up = below.groupBy("file", above.alias("starts")).agg(F.min("ord").alias("ord"), F.sha2(F.concat_ws("", children).cast("binary"), 256).alias("hash"))
        out.append(written(up, "tree-level"))
        below = out[-1]
    return out


def _under(rows: DataFrame, parents: DataFrame, skip: int) -> DataFrame:
    """The rows whose node is among the parents."""
    same = F.col("file").eqNullSafe(F.col("pf")) & F.slice("starts", 1 + skip, LEVELS + 1).eqNullSafe(F.col("ps"))
    return rows.join(parents, same, "left_semi")


def audit(mine: DataFrame, theirs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(file, ord, key, offset, length, hash, replica_offset, replica_hash) of the records that differ.

    Both sides are leaf tables. Below the roots, a level's rows are joined only where the parents differ.
    """
    mine, theirs = written(mine, "mine"), written(theirs, "theirs")
    parents = None
    for x, y in zip(reversed(tree(mine, levels)), reversed(tree(theirs, levels)), strict=True):
        if parents is not None:
            x, y = (_under(nodes, parents, 1) for nodes in (x, y))
        other = y.select(F.col("file").alias("of"), F.col("starts").alias("os"), F.col("hash").alias("other"))
        met = x.join(other, F.col("file").eqNullSafe(F.col("of")) & F.col("starts").eqNullSafe(F.col("os")), "full")
        found = met.where(~F.col("hash").eqNullSafe(F.col("other")))
        here = F.col("hash").isNotNull()
        parents = written(found.select(F.when(here, F.col("file")).otherwise(F.col("of")).alias("pf"), F.when(here, F.col("starts")).otherwise(F.col("os")).alias("ps")), "differing")
    a, b = (_under(leaf, parents, 0).drop("starts") for leaf in (mine, theirs))
    again = F.row_number().over(W.partitionBy("file", "key", "hash").orderBy("ord"))
    a, b = (written(x.withColumn("again", again), "suspects") for x in (a, b))

    def lone(x: DataFrame, y: DataFrame) -> DataFrame:
        held = y.select(*[F.col(c).alias(f"o_{c}") for c in ("file", "key", "hash", "again")])
        same = [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in ("file", "key", "hash", "again")]
        return x.join(held, same, "left_anti").withColumn("at", F.row_number().over(W.partitionBy("file", "key").orderBy("hash", "ord")))

    ours = lone(a, b)
    other = lone(b, a).select(F.col("file").alias("of"), F.col("key").alias("ok"), F.col("at").alias("oa"), F.col("offset").alias("replica_offset"), F.col("hash").alias("replica_hash"))
    met = ours.join(other, F.col("file").eqNullSafe(F.col("of")) & F.col("key").eqNullSafe(F.col("ok")) & (F.col("at") == F.col("oa")), "full")
    here = F.col("hash").isNotNull()
    file, key = F.when(here, F.col("file")).otherwise(F.col("of")), F.when(here, F.col("key")).otherwise(F.col("ok"))
    return met.select(file.alias("file"), "ord", key.alias("key"), "offset", "length", "hash", "replica_offset", "replica_hash")


def parse(raw: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, payload) of each record of a WARC file, plain or gzipped by record."""
    at = 0
    while at < len(raw):
        if raw[at : at + 2] == b"\x1f\x8b":
            d = zlib.decompressobj(16 + zlib.MAX_WBITS)
            body = d.decompress(raw[at:]) + d.flush()
            size = len(raw) - at - len(d.unused_data)
        else:
            body, size = raw[at:], 0
        head, gap, rest = body.partition(b"\r\n\r\n")
        if not gap or not head.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at offset {at}")
        lines = head.decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(headers["content-length"])
        if len(rest) < n:
            raise ValueError(f"the record at offset {at} is cut short")
        size = size or len(head) + 4 + n + (4 if rest[n : n + 4] == b"\r\n\r\n" else 0)
        yield at, size, headers, rest[:n]
        at += size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, length, type, uri, payload) of the records of WARC files; one task reads a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, raw in zip(b["path"], b["content"], strict=True):
                rows = [(p, o, n, h.get("warc-type"), h.get("warc-target-uri"), body) for o, n, h, body in parse(bytes(raw))]
                yield pd.DataFrame(rows, columns=["path", "offset", "length", "type", "uri", "payload"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, offset long, length long, type string, uri string, payload binary")


def packed_records(bodies: list[tuple[str, bytes]], compress: bool = False) -> bytes:
    """A WARC file of (url, payload) records, for small archives and tests."""
    out = []
    for url, body in bodies:
        raw = f"WARC/1.0{_CRLF}WARC-Type: response{_CRLF}WARC-Target-URI: {url}{_CRLF}Content-Length: {len(body)}{_CRLF * 2}".encode() + body + b"\r\n\r\n"
        out.append(gzip.compress(raw, mtime=0) if compress else raw)
    return b"".join(out)


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's place in the archive, and whether a replica agrees in which a letter rots in every
    97th page and every 389th page is lost; the verdicts come from the audit of the trees."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    file = F.coalesce(F.expr(f"page_id div {RECORDS_PER_FILE}"), F.lit(-1)).alias("file")
    rotten = F.when(F.col("page_id") % 97 == 5, F.translate("html", "e", "3")).otherwise(F.col("html"))
    mine = written(leaves(pages.select(file, "page_id", record(F.col("url"), F.col("html")).alias("raw")), "file", "page_id", "raw"), "archive")
    held = pages.where(F.coalesce(F.col("page_id") % 389 != 7, F.lit(True)))
    theirs = leaves(held.select(file, "page_id", record(F.col("url"), rotten).alias("raw")), "file", "page_id", "raw")
    bad = audit(mine, theirs).where("ord IS NOT NULL").select("file", "ord", F.lit(False).alias("agrees"))
    out = mine.join(bad, ["file", "ord"], "left")
    return out.select(
        F.col("key").alias("page_id"), F.col("file").alias("file_id"), "offset", "length", F.col("hash").alias("record_sha256"), F.coalesce("agrees", F.lit(True)).alias("intact")
    )


OP3_SQL = r"""
WITH r AS (
  SELECT page_id, coalesce(page_id // 1000, -1) AS file_id,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
         || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10)
         || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS raw,
         NOT (coalesce(page_id % 97 = 5, false) AND coalesce(contains(html, 'e'), false)) AND NOT coalesce(page_id % 389 = 7, false) AS intact
  FROM pages
), h AS (SELECT page_id, file_id, octet_length(encode(raw))::BIGINT AS length, sha256(raw) AS record_sha256, intact FROM r)
SELECT page_id, file_id, coalesce(sum(length) OVER (PARTITION BY file_id ORDER BY page_id NULLS FIRST, record_sha256
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", length, record_sha256, intact FROM h
"""
