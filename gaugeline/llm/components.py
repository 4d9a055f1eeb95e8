"""Connected components of a link table by alternating large-star and small-star steps.

Each round joins every vertex with the smallest vertex it knows; rounds are as many as the logarithm
of a component's size suggests. Every step is written to the shared folder, so no lineage grows and a
lost executor costs a re-read, and both sides of each join are shuffled, so a hub's links can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import written

MAX_ROUNDS = 60


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _smallest(links: DataFrame) -> DataFrame:
    return written(links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "k"), "smallest")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _smallest(both)
    out = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _smallest(down)
    out = down.join(low, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
    return out.select("e.u", "e.v").where("u <> v").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id that has a link to another one; the component is its smallest id."""
    edges = written(links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").distinct(), "links")
    mark = _mark(edges)
    if mark[0]:
        for _ in range(MAX_ROUNDS):
            edges = written(_small_star(written(_large_star(edges), "large-star")), "small-star")
            now = _mark(edges)
            if now == mark:
                break
            mark = now
        else:
            raise RuntimeError("components did not settle")
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
