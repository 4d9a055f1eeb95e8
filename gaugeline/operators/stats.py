"""Statistics of series, windows and labels; all are single aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeline.functions import ieee
from gaugeline.operators import asof
from gaugeline.operators.series import KEY

BINS = 50
FRACTIONS = (0.05, 0.25, 0.75, 0.95)


def _ok():
    return F.coalesce(F.col("valid"), F.lit(True))


def min_max(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Over all samples, invalid ones too; NaN is passed over."""
    v = ieee.number(F.col("v").cast("double"))
    return df.groupBy(*keys).agg(F.min(v).alias("min"), F.max(v).alias("max"))


def mean(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Over all samples, invalid ones too; one NaN makes it NaN."""
    return df.groupBy(*keys).agg(F.avg(F.col("v").cast("double")).alias("mean"))


def series_stats(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Counts over all samples; moments, median and percentiles over the valid, finite ones; the first
    and the last valid value; and the time axis."""
    v = F.col("v").cast("double")
    use = F.when(_ok() & ieee.finite(v), v)
    ok_idx = F.when(_ok(), F.col("idx"))
    n = F.count(F.lit(1))
    span = F.max_by("t", "idx") - F.min_by("t", "idx")
    out = df.groupBy(*keys).agg(
        n.cast("long").alias("samples"),
        F.count(ok_idx).cast("long").alias("valid_samples"),
        (n - F.count(use)).cast("long").alias("excluded"),
        F.count(F.when(_ok() & ~ieee.finite(v), 1)).cast("long").alias("nan_inf"),
        F.min(use).alias("min"),
        F.max(use).alias("max"),
        (F.max(use) - F.min(use)).alias("peak_to_peak"),
        F.avg(use).alias("mean"),
        F.stddev_pop(use).alias("std"),
        F.percentile(use, F.array(F.lit(0.5), *[F.lit(p) for p in FRACTIONS])).alias("_ranked"),  # one pass and one table of values
        F.min_by(F.when(_ok(), v), ok_idx).alias("first"),
        F.max_by(F.when(_ok(), v), ok_idx).alias("last"),
        F.min_by("t", "idx").alias("t_first"),
        F.max_by("t", "idx").alias("t_last"),
        span.alias("duration"),
        F.try_divide((n - 1).cast("double"), F.when(span > 0, span)).alias("rate"),
    )
    ranked = {name: F.get("_ranked", F.lit(i)).alias(name) for i, name in enumerate(["median", *[f"p{round(100 * p)}" for p in FRACTIONS]])}
    shown = [c for c in out.columns if c != "_ranked"]
    return out.select(*shown[: shown.index("first")], *ranked.values(), *shown[shown.index("first") :])


def percentile(df: DataFrame, fraction: float, keys: Sequence[str] = KEY) -> DataFrame:
    """Linear interpolation between order statistics; the fraction is clamped to 0..1."""
    v = F.col("v").cast("double")
    return df.groupBy(*keys).agg(F.percentile(F.when(_ok() & ieee.finite(v), v), F.lit(min(1.0, max(0.0, fraction)))).alias("percentile"))


def histogram(df: DataFrame, keys: Sequence[str] = KEY, bins: int = BINS) -> DataFrame:
    """(keys, bin, low, n): equal bins from the least to the greatest value, the last one closed; empty
    bins count 0; a series of one value has none."""
    v = F.col("v").cast("double")
    used = df.where(_ok() & ieee.finite(v)).select(*keys, v.alias("v"))
    ends = used.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("hi > lo")
    width = (F.col("hi") - F.col("lo")) / bins
    hit = used.join(ends, list(keys)).select(*keys, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = hit.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    frame = ends.select(*keys, "lo", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return frame.join(counts, [*keys, "bin"], "left").select(*keys, "bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def region_stats(df: DataFrame, a: float, b: float, keys: Sequence[str] = KEY) -> DataFrame:
    """Between two stamps in either order, both included; infinities count, invalid and NaN samples are
    excluded; keys without samples there are left out."""
    lo, hi = min(a, b), max(a, b)
    v = F.col("v").cast("double")
    use = F.when(_ok() & ~F.isnan(v), v)
    got = df.where(F.col("t").between(lo, hi)).groupBy(*keys).agg(
        F.count(use).cast("long").alias("n"), (F.count(F.lit(1)) - F.count(use)).cast("long").alias("excluded"), F.min(use).alias("min"), F.max(use).alias("max"), F.avg(use).alias("mean"), F.stddev_pop(use).alias("std")
    )
    return got.where("n > 0")


def window_stats(df: DataFrame, t0: float, t1: float, keys: Sequence[str] = KEY) -> DataFrame:
    """One row a key: count and moments of the valid, finite samples with t0 <= t <= t1; a reversed or
    NaN window counts 0; infinite bounds mean the key's own extent."""
    v = F.col("v").cast("double")
    sane = not (math.isnan(t0) or math.isnan(t1) or t0 > t1)
    inside = F.col("t").between(t0, t1) if sane else F.lit(False)
    fine = inside & _ok() & ieee.finite(v)
    use, at = F.when(fine, v), F.when(fine, F.col("idx"))
    return df.groupBy(*keys).agg(
        F.count(use).cast("long").alias("count"),
        F.count(F.when(inside & ~fine, 1)).cast("long").alias("invalid"),
        F.min(use).alias("min"), F.max(use).alias("max"), F.avg(use).alias("mean"),
        F.min_by(use, at).alias("first"), F.max_by(use, at).alias("last"),
        F.min(F.when(inside, F.col("t"))).alias("t0"), F.max(F.when(inside, F.col("t"))).alias("t1"),
    )


def label_durations(df: DataFrame, keys: Sequence[str] = KEY, label: str = "v") -> DataFrame:
    """(keys, label, samples, seconds): the time from each sample to the next row, if it is later; the
    last one adds none. Null labels and invalid samples are counted under null."""
    ahead = F.lead("t").over(W.partitionBy(*keys).orderBy("idx")) - F.col("t")
    name = F.when(_ok(), F.col(label))
    rows = df.select(*keys, name.alias("label"), F.greatest(F.coalesce(ahead, F.lit(0.0)), F.lit(0.0)).alias("d"))
    return rows.groupBy(*keys, "label").agg(F.count(F.lit(1)).cast("long").alias("samples"), F.sum("d").alias("seconds"))


def cursor(df: DataFrame, a: float, b: float, keys: Sequence[str] = KEY) -> DataFrame:
    """The nearest samples at two cursors, their distance in time, and in value if both are numbers."""
    spots = df.select(*keys).distinct().select(*keys, F.explode(F.array(F.struct(F.lit("a").alias("c"), F.lit(float(a)).alias("t")), F.struct(F.lit("b").alias("c"), F.lit(float(b)).alias("t")))).alias("s")).select(*keys, "s.*")
    marked = df.withColumn("v", F.when(_ok(), ieee.number(F.col("v").cast("double"))))
    got = asof.nearest(marked, spots, keys)
    pick = lambda c, x: F.max(F.when(F.col("c") == c, F.col(x)))
    return got.groupBy(*keys).agg(
        pick("a", "at").alias("ta"), pick("b", "at").alias("tb"), pick("a", "v").alias("va"), pick("b", "v").alias("vb"),
        (pick("b", "at") - pick("a", "at")).alias("dt"), (pick("b", "v") - pick("a", "v")).alias("dv"),
    )


def pre_aggregated(df: DataFrame, interval: float, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, slot, mean, min, max) of each interval of time, as a sample reduction holds them."""
    v = ieee.number(F.col("v").cast("double"))
    return df.groupBy(*keys, F.floor(F.col("t") / interval).alias("slot")).agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))


def catalog_stats(channels: DataFrame) -> DataFrame:
    """Counts of files, groups and channels, and the sum of samples, of a channel catalog."""
    return channels.agg(
        F.countDistinct("file_id").alias("files"), F.countDistinct("file_id", "dg").alias("data_groups"), F.countDistinct("file_id", "dg", "cg").alias("channel_groups"),
        F.count(F.lit(1)).alias("channels"), F.sum("sample_count").alias("samples"),
    )


def uniform_width(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, width): the common length in bytes of all payloads, null where they differ or there are none."""
    n = F.octet_length(column)
    return df.groupBy(*keys).agg(F.when(F.min(n) == F.max(n), F.min(n)).cast("long").alias("width"))


def type_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("type").count().orderBy(F.desc("count"), "type")
