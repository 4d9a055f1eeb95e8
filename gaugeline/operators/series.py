"""Series: long tables (key..., idx, t, v, valid), one row a sample, ``idx`` dense from 0 in each key.

``valid`` stands beside the value: an invalid sample keeps its stand-in value until it is exported.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ("series",)


class AxisError(ValueError):
    """A time axis that decreases, or holds an invalid or non-finite stamp."""


class StructureError(ValueError):
    """Series, channels or files that do not fit together."""


def series_from(df: DataFrame, key: Column, t: Column, v: Column, order: Sequence[Column | str], valid: Column | None = None, bucket: float | None = None) -> DataFrame:
    """A series table; ``order`` makes the sample order of each key unique.

    With ``bucket`` (seconds), for orders that begin with the time, no task holds a whole series: each bucket
    of time numbers its own samples, behind the running sum of the counts of the buckets before it.
    """
    rows = df.select(key.alias("series"), t.cast("double").alias("t"), v.alias("v"), (F.lit(True) if valid is None else valid).alias("valid"), *[F.col(o).alias(f"_o{i}") if isinstance(o, str) else o.alias(f"_o{i}") for i, o in enumerate(order)])
    w = W.partitionBy("series").orderBy(*[f"_o{i}" for i in range(len(order))])
    if bucket is None:
        return rows.withColumn("idx", (F.row_number().over(w) - 1).cast("long")).select("series", "idx", "t", "v", "valid")
    rows = rows.withColumn("_b", F.floor(F.col("t") / bucket))
    before = W.partitionBy("series").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy("series", "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(W.partitionBy("series", "_b").orderBy(*[f"_o{i}" for i in range(len(order))]))
    rows = rows.withColumn("_at", within).join(counts, ["series", "_b"])
    return rows.select("series", (F.col("_before") + F.col("_at") - 1).cast("long").alias("idx"), "t", "v", "valid")


def series_of(spark, name: str, t: Sequence[float], v: Sequence, valid: Sequence[bool] | None = None) -> DataFrame:
    """A series from samples on the driver; lengths must agree."""
    if len(t) != len(v) or (valid is not None and len(valid) != len(t)):
        raise StructureError(f"{name}: {len(t)} stamps, {len(v)} values and {len(valid) if valid is not None else 'no'} validity flags")
    kind = "string" if v and isinstance(v[0], str) else "double"
    rows = [(name, i, float(a), b if kind == "string" else float(b), True if valid is None else bool(valid[i])) for i, (a, b) in enumerate(zip(t, v, strict=True))]
    return spark.createDataFrame(rows, f"series string, idx long, t double, v {kind}, valid boolean")


def axis_faults(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """The samples whose stamp is invalid, non-finite or below its predecessor, with the reason."""
    before = F.lag("t").over(W.partitionBy(*keys).orderBy("idx"))
    marked = df.withColumn("_b", before).withColumn(
        "reason",
        F.when(~F.coalesce("valid", F.lit(True)), "invalid stamp").when(F.col("t").isNull() | F.isnan("t") | (F.abs("t") == float("inf")), "not finite").when(F.col("t") < F.col("_b"), "decreasing"),
    )
    return marked.where("reason IS NOT NULL").select(*keys, "idx", "t", "reason")


def checked_axis(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """``df`` as it is, or an AxisError naming the first fault; equal stamps are allowed."""
    bad = axis_faults(df.withColumn("valid", F.lit(True)), keys).orderBy(*keys, "idx").limit(1).collect()
    if bad:
        raise AxisError(f"sample {bad[0]['idx']} of {[bad[0][k] for k in keys]}: {bad[0]['reason']}")
    return df


def cut(df: DataFrame, start: float, end: float) -> DataFrame:
    """The samples with start <= t <= end; a start beyond the end gives none."""
    return df.where(F.col("t").between(float(start), float(end)))


def renumbered(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    w = W.partitionBy(*keys).orderBy("idx")
    return df.withColumn("idx", (F.row_number().over(w) - 1).cast("long"))


def attach_axis(values: DataFrame, master: DataFrame | None, keys: Sequence[str] = KEY) -> DataFrame:
    """Values by idx with the master's stamps, or with the index itself where there is no master."""
    if master is None:
        return values.withColumn("t", F.col("idx").cast("double"))
    axis = master.select(*keys, "idx", "t")
    return values.drop("t").join(axis, [*keys, "idx"], "left").withColumn("t", F.coalesce("t", F.col("idx").cast("double")))


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two series tables hold the same samples."""
    cols = a.columns
    return a.exceptAll(b.select(cols)).isEmpty() and b.select(cols).exceptAll(a).isEmpty()


def valid_count(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.sum(F.when(F.coalesce("valid", F.lit(True)), 1).otherwise(0)).cast("long").alias("valid_samples"))


def page(df: DataFrame, start: int, count: int, most: int = 4_096) -> DataFrame:
    """Samples start .. start+count-1 by index, at most ``most``."""
    return df.where(F.col("idx").between(start, start + min(count, most) - 1))


def exported(df: DataFrame) -> DataFrame:
    """Null instead of invalid values."""
    return df.withColumn("v", F.when(F.coalesce("valid", F.lit(True)), F.col("v")))


def element(df: DataFrame, j: int, shape: int | None = None) -> DataFrame:
    """Element j of an array series; NaN where it is missing or the sample is invalid."""
    if shape is not None and not 0 <= j < shape:
        raise IndexError(f"element {j} of {shape}")
    got = F.try_element_at("v", F.lit(j + 1)).cast("double")
    return df.withColumn("v", F.when(F.coalesce("valid", F.lit(True)), F.coalesce(got, F.lit(float("nan")))).otherwise(float("nan")))


def flattened(df: DataFrame, shape: Sequence[int], name: str = "v") -> DataFrame:
    """One column for each element of a fixed shape, row-major, named name[i] or name[i][j]."""
    size = 1
    for s in shape:
        size *= s
    cols = []
    for flat in range(size):
        at, rest = [], flat
        for s in reversed(shape):
            at.insert(0, rest % s)
            rest //= s
        cols.append(F.get(F.col(name), F.lit(flat)).alias(name + "".join(f"[{i}]" for i in at)))
    return df.select(*[c for c in df.columns if c != name], *cols)
