"""Resampling onto rasters and given stamps."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.operators import asof
from gaugeline.operators.series import KEY


#: Points of a raster that one row of bounds stands for before they are made.
STRETCH = 4_096


def _points(span: DataFrame, step: float, names: Sequence[str]) -> DataFrame:
    """(names, t) of the rasters low + i * step up to high over (_l, _h); a span below 1e-15 is one point.

    The tolerance is a millionth of the step added to the number of steps; stamps are never summed up. The rows
    of stretches are dealt out before their points are made, so no row and no task holds a whole raster.
    """
    if not (step > 0 and math.isfinite(step)):
        raise ValueError(f"a raster step must be finite and above zero, not {step}")
    steps = F.when(F.abs(F.col("_h") - F.col("_l")) < 1e-15, F.lit(0)).otherwise(F.floor((F.col("_h") - F.col("_l")) / step + step * 1e-6).cast("long")).cast("long")
    stretches = span.withColumn("_n", steps).withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"_n div {STRETCH}"))))
    first = F.col("_s") * STRETCH
    numbers = F.sequence(first, F.least(F.col("_n"), first + STRETCH - 1))
    return stretches.repartition(*names, "_s").select(*names, "_l", F.explode(numbers).alias("_i")).select(*names, (F.col("_l") + F.col("_i").cast("double") * step).alias("t"))


def raster(df: DataFrame, step: float, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, t): each key's own raster over its first and last stamp."""
    span = df.groupBy(*keys).agg(F.min("t").alias("_l"), F.max("t").alias("_h"))
    return _points(span.where("_l IS NOT NULL"), step, keys)


def common_raster(df: DataFrame, step: float, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, t): one raster over the stamps of all keys, for each key; the span is one row."""
    span = F.broadcast(df.agg(F.min("t").alias("_l"), F.max("t").alias("_h")).withColumn("_one", F.lit(1)))
    names = df.select(*keys).distinct().withColumn("_one", F.lit(1))
    return _points(names.join(span, "_one").where("_l IS NOT NULL"), step, keys)


def resample(df: DataFrame, step: float, mode: str = "hold", keys: Sequence[str] = KEY, common: bool = False, bucket: float | None = None) -> DataFrame:
    """Series on a raster, by ``hold`` or ``linear``; ``common`` gives all keys one raster."""
    targets = (common_raster if common else raster)(df, step, keys)
    return onto(df, targets, mode, keys, bucket)


def onto(df: DataFrame, targets: DataFrame, mode: str = "hold", keys: Sequence[str] = KEY, bucket: float | None = None) -> DataFrame:
    """Series at given stamps (keys, t), in any order."""
    if mode not in ("hold", "linear"):
        raise ValueError(f"unknown mode {mode}")
    return (asof.hold if mode == "hold" else asof.linear)(df, targets, keys, bucket)
