"""Hierarchical weighted hash tree: region, rack and shard levels, each decided by weighted hash draws.

A shard draws ``-ln(u) / weight`` with ``u`` from a hash of its path and the key. A rack draws the smallest of
its shards' draws, a region the smallest of its racks', which is a draw by the sum of their weights; a key
descends to the smallest draw of each level. No draw depends on a sibling, so a changed weight moves keys
only into or out of the subtree it lies in, and a further shard, wherever it joins, takes keys only into
itself.

Defined cases: null text has size 1 and the CRC of no bytes; a null id is the key ``null``; repeated
rows each get a slot, and rows equal in id and text are told apart by nothing, so any of them may have any of
their slots; texts of any length count whole; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeline.llm.common import read, written

SHARDS = 8
RACKS_PER_REGION = 2
SHARDS_PER_RACK = 2
#: Hexadecimal digits of the slot bucket: 4096 buckets in each shard share the numbering work.
BUCKET_DIGITS = 3


@dataclass(frozen=True)
class Node:
    """A subtree: its path names its draws; leaves carry a shard number."""

    path: str
    weight: float
    shard: int | None = None
    children: tuple[Node, ...] = field(default=())


def shard_tree(weights: Sequence[float], racks: int = RACKS_PER_REGION, per_rack: int = SHARDS_PER_RACK) -> Node:
    """A tree over shards 0..n-1 with the given weights; a node weighs what its children weigh together."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above zero")
    regions: dict[int, dict[int, list[Node]]] = {}
    for i, w in enumerate(weights):
        region, rack = i // (racks * per_rack), i // per_rack % racks
        regions.setdefault(region, {}).setdefault(rack, []).append(Node(f"{region}/{rack}/{i}", float(w), i))
    tops = []
    for r, by_rack in regions.items():
        kids = tuple(Node(f"{r}/{k}", sum(x.weight for x in leaves), None, tuple(leaves)) for k, leaves in by_rack.items())
        tops.append(Node(f"{r}", sum(k.weight for k in kids), None, kids))
    return Node("", sum(t.weight for t in tops), None, tuple(tops))


def _leaf(key: Column, node: Node) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(node.path), key), 11).cast("double") + 0.5) / float(1 << 53)
    return F.struct((-F.ln(u) / node.weight).alias("d"), F.lit(node.shard).alias("i"))


def draw(key: Column, node: Node) -> Column:
    """(d, i): the draw of a subtree and the shard that the descent from it ends in; equal draws go to the
    smaller shard number."""
    if node.shard is not None:
        return _leaf(key, node)
    below = [draw(key, c) for c in node.children]
    return below[0] if len(below) == 1 else F.array_min(F.array(*below))


def descend(key: Column, tree: Node) -> Column:
    """The shard of a key."""
    return draw(key, tree)["i"]


def assign(df: DataFrame, key: Column, tree: Node, name: str = "shard") -> DataFrame:
    return df.withColumn(name, descend(F.coalesce(key.cast("string"), F.lit("null")), tree).cast("int"))


def numbered(rows: DataFrame, shard: str, order: Sequence[str], bucket: Column) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard, ordered by (bucket, order): each bucket numbers its
    own rows and a running sum over the bucket counts gives its first slot, so no task holds a shard."""
    rows = rows.withColumn("_bucket", bucket)
    sums = W.partitionBy(shard).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    firsts = (
        rows.groupBy(shard, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_first", F.coalesce(F.sum("_n").over(sums), F.lit(0)))
        .select(F.col(shard).alias("_s"), F.col("_bucket").alias("_b"), "_first")
    )
    within = W.partitionBy(shard, "_bucket").orderBy(*order)
    out = rows.withColumn("_at", F.row_number().over(within) - 1)
    out = out.join(firsts, (out[shard] == firsts["_s"]) & (out["_bucket"] == firsts["_b"]))
    return out.withColumn("slot", (F.col("_first") + F.col("_at")).cast("long")).drop("_s", "_b", "_first", "_at", "_bucket")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: size, CRC, shard now, slot there, and its shard with one more."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
    )
    rows = assign(rows, F.col("doc_id"), shard_tree([1.0] * shards))
    rows = assign(rows, F.col("doc_id"), shard_tree([1.0] * (shards + 1)), "grown_shard")
    rows = written(rows.withColumn("law", F.lit("key")), "shards")
    bucket = F.substring(F.md5(F.concat_ws(":", F.lit("slot"), F.col("doc_id"), F.col("text_crc32")).cast("binary")), 1, BUCKET_DIGITS)
    out = numbered(rows, "shard", ["doc_id", "text_crc32", "size"], bucket)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))
