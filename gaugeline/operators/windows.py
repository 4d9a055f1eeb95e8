"""Viewer windows: peak-preserving decimation, label runs, and runs of valid samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeline.functions import ieee
from gaugeline.operators.series import KEY


def _columns(df: DataFrame, t0: float, t1: float, n: int) -> Column:
    width = (t1 - t0) / n
    if width <= 0:
        return F.lit(0)
    return F.least(F.floor((F.col("t") - t0) / width), F.lit(n - 1)).cast("int")


def _picked(df: DataFrame, by: Sequence[str], picks: Sequence[Column], keys: Sequence[str]) -> DataFrame:
    """The rows whose index a group's picks name, each once, in one aggregate over (idx, t, v) structs."""
    got = df.groupBy(*by).agg(F.array_distinct(F.array_compact(F.array(*picks))).alias("rows"))
    return got.select(*keys, F.explode("rows").alias("r")).select(*keys, "r.idx", "r.t", "r.v").distinct()


def _row(when: Column | None = None) -> Column:
    row = F.struct("idx", "t", "v")
    return row if when is None else F.when(when, row)


def decimate_min_max(df: DataFrame, t0: float, t1: float, n: int, keys: Sequence[str] = KEY) -> DataFrame:
    """Each time column's least and greatest sample (the first of equals); keys with at most 2n samples
    in the range pass unchanged."""
    inside = df.where(F.col("t").between(t0, t1)).select(*keys, "idx", "t", "v").withColumn("_c", _columns(df, t0, t1, n))
    counts = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    inside = inside.join(counts, list(keys))
    few = inside.where(F.col("_n") <= 2 * n).select(*keys, "idx", "t", "v")
    many = inside.where(F.col("_n") > 2 * n)
    v = ieee.number(F.col("v"))
    low = F.min_by(_row(), F.when(v.isNotNull(), F.struct(v.alias("a"), F.col("idx").alias("b"))))
    high = F.max_by(_row(), F.when(v.isNotNull(), F.struct(v.alias("a"), (-F.col("idx")).alias("b"))))
    return few.unionByName(_picked(many, [*keys, "_c"], [low, high], keys))


def decimate_curve(df: DataFrame, t0: float, t1: float, n: int, keys: Sequence[str] = KEY) -> DataFrame:
    """Each column's first, least, greatest and last sample; keys with at most 4n samples pass unchanged."""
    inside = df.where(F.col("t").between(t0, t1)).select(*keys, "idx", "t", "v").withColumn("_c", _columns(df, t0, t1, n))
    inside = inside.join(inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), list(keys))
    few = inside.where(F.col("_n") <= 4 * n).select(*keys, "idx", "t", "v")
    many = inside.where(F.col("_n") > 4 * n)
    v = ieee.number(F.col("v"))
    order = F.struct(v.alias("a"), F.col("idx").alias("b"))
    back = F.struct(v.alias("a"), (-F.col("idx")).alias("b"))
    picks = [F.min(_row()), F.min_by(_row(), F.when(v.isNotNull(), order)), F.max_by(_row(), F.when(v.isNotNull(), back)), F.max(_row())]
    return few.unionByName(_picked(many, [*keys, "_c"], picks, keys))


def view_window(df: DataFrame, t0: float, t1: float, max_points: int, keys: Sequence[str] = KEY) -> DataFrame:
    """At most ``max_points`` samples of a window: of each of max_points / 5 columns the first, the least,
    the greatest, the first gap (invalid or NaN) and the last sample; fewer samples pass unchanged.
    Invalid values come as NaN."""
    max_points = min(1_000_000, max(5, max_points))
    n = max(1, max_points // 5)
    shown = F.when(F.coalesce("valid", F.lit(True)), F.col("v").cast("double")).otherwise(float("nan"))
    inside = df.where(F.col("t").between(t0, t1)).select(*keys, "idx", "t", F.coalesce(shown, F.lit(float("nan"))).alias("v")).withColumn("_c", _columns(df, t0, t1, n))
    inside = inside.join(inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), list(keys))
    few = inside.where(F.col("_n") <= max_points).select(*keys, "idx", "t", "v")
    many = inside.where(F.col("_n") > max_points)
    v = ieee.number(F.col("v"))
    order = F.when(v.isNotNull(), F.struct(v.alias("a"), F.col("idx").alias("b")))
    back = F.when(v.isNotNull(), F.struct(v.alias("a"), (-F.col("idx")).alias("b")))
    picks = [F.min(_row()), F.min_by(_row(), order), F.max_by(_row(), back), F.min(_row(F.isnan("v"))), F.max(_row())]
    return few.unionByName(_picked(many, [*keys, "_c"], picks, keys))


def valid_islands(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, run, first_idx, last_idx, n): maximal runs of valid, finite samples."""
    w = W.partitionBy(*keys).orderBy("idx")
    ok = F.coalesce("valid", F.lit(True)) & ieee.finite(F.col("v").cast("double"))
    rows = df.select(*keys, "idx", ok.alias("ok")).withColumn("_new", F.coalesce(F.lag("ok").over(w) != F.col("ok"), F.lit(True)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(w)).where("ok")
    runs = rows.groupBy(*keys, "_run").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count(F.lit(1)).alias("n"))
    return runs.withColumn("run", (F.row_number().over(W.partitionBy(*keys).orderBy("_run")) - 1).cast("long")).select(*keys, "run", "first_idx", "last_idx", "n")


def decimate_gaps(df: DataFrame, t0: float, t1: float, n: int, keys: Sequence[str] = KEY) -> DataFrame:
    """Least and greatest samples of each column and run of valid samples, the columns shared among the
    runs by their length; between two runs stands a NaN sample (the first of the gap)."""
    ok = F.coalesce("valid", F.lit(True)) & ieee.finite(F.col("v").cast("double"))
    w = W.partitionBy(*keys).orderBy("idx")
    rows = df.where(F.col("t").between(t0, t1)).select(*keys, "idx", "t", F.col("v").cast("double").alias("v"), ok.alias("ok"))
    rows = rows.withColumn("_new", F.coalesce(F.lag("ok").over(w) != F.col("ok"), F.lit(True)).cast("int")).withColumn("run", F.sum("_new").over(w))
    gaps = rows.where(~F.col("ok") & (F.col("_new") == 1)).select(*keys, "idx", "t", F.lit(float("nan")).alias("v"))
    runs = W.partitionBy(*keys, "run")
    good = rows.where("ok").withColumn("_n", F.count(F.lit(1)).over(runs)).withColumn("_i", F.row_number().over(runs.orderBy("idx")) - 1)
    total = rows.where("ok").groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    good = good.join(total, list(keys)).withColumn("_cols", F.greatest(F.lit(1), F.floor(F.col("_n") * n / F.col("_all"))))
    few = good.where("_n <= 2 * _cols").select(*keys, "idx", "t", "v")
    many = good.where("_n > 2 * _cols").withColumn("_c", F.floor(F.col("_i") * F.col("_cols") / F.col("_n")))
    low = F.min_by(_row(), F.struct("v", "idx"))
    high = F.max_by(_row(), F.struct(F.col("v").alias("a"), (-F.col("idx")).alias("b")))
    return few.unionByName(_picked(many, [*keys, "run", "_c"], [low, high], keys)).unionByName(gaps)


def label_runs(df: DataFrame, max_points: int | None = None, keys: Sequence[str] = KEY, label: str = "v") -> DataFrame:
    """(keys, idx, t, label, truncated): the samples where the label changes, and the last one.

    With ``max_points``, at most half as many again, the rest cut off and marked.
    """
    w = W.partitionBy(*keys).orderBy("idx")
    rows = df.select(*keys, "idx", "t", F.when(F.coalesce("valid", F.lit(True)), F.col(label)).alias("label"))
    rows = rows.withColumn("_first", F.lag("idx").over(w).isNull()).withColumn("_same", F.lag("label").over(w).eqNullSafe(F.col("label"))).withColumn("_last", F.lead("idx").over(w).isNull())
    kept = rows.where(F.col("_first") | ~F.col("_same") | F.col("_last")).select(*keys, "idx", "t", "label")
    if max_points is None:
        return kept.withColumn("truncated", F.lit(False))
    most = max_points * 3 // 2
    kept = kept.withColumn("_r", F.row_number().over(w)).withColumn("truncated", F.count(F.lit(1)).over(W.partitionBy(*keys)) > most)
    return kept.where(F.col("_r") <= most).drop("_r")


def text_transitions(df: DataFrame, max_points: int, keys: Sequence[str] = KEY, label: str = "v") -> DataFrame:
    """(keys, idx, t, label): every stride-th change of the label, the stride such that at most
    ``max_points`` remain, and the last sample."""
    w = W.partitionBy(*keys).orderBy("idx")
    rows = df.select(*keys, "idx", "t", F.col(label).alias("label"))
    rows = rows.withColumn("_same", (F.lag("label").over(w).eqNullSafe(F.col("label"))) & F.lag("idx").over(w).isNotNull()).withColumn("_end", F.lead("idx").over(w).isNull())
    rows = rows.where(~F.col("_same") | F.col("_end"))
    rows = rows.withColumn("_i", F.when(~F.col("_same"), F.sum(F.when(~F.col("_same"), 1).otherwise(0)).over(w) - 1)).withColumn("_n", F.sum(F.when(~F.col("_same"), 1).otherwise(0)).over(W.partitionBy(*keys)))
    stride = F.greatest(F.lit(1), F.ceil(F.col("_n") / max(1, max_points - 1)))
    return rows.where(F.coalesce(F.col("_i") % stride == 0, F.lit(False)) | F.col("_end")).select(*keys, "idx", "t", "label")
