"""As-of lookups: each target row meets the source samples around its stamp.

One backward window answers all of them: sources and targets are sorted together, a source carries
its successor, and a target takes the last source before it. With ``bucket`` the windows are split by
time: each bucket's first and last samples, one row a bucket, are carried across in a second window,
so a single long series is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeline.operators.series import KEY


def _payload(df: DataFrame) -> Column:
    return F.struct("t", "idx", *[c for c in ("v", "valid") if c in df.columns])


def brackets(source: DataFrame, targets: DataFrame, keys: Sequence[str] = KEY, strict: bool = False, bucket: float | None = None) -> DataFrame:
    """``targets`` (keys, t, any other columns) with the source samples ``p``, ``n`` and ``f``.

    p is the last sample at or before the stamp (strictly before, if ``strict``), n the one after p in
    sample order (the first of all, where there is no p), f the first sample of the key. All are null
    for a key without samples.
    """
    s = source.select(*keys, "t", "idx", _payload(source).alias("p"))
    t = targets.select(*keys, "t", F.struct(*targets.columns).alias("_row"))
    ranges = [*keys, "_b"] if bucket else list(keys)
    if bucket:
        s, t = (x.withColumn("_b", F.floor(F.col("t") / bucket)) for x in (s, t))
        sums = s.groupBy(*ranges).agg(F.min(F.struct("t", "idx", "p")).alias("lo"), F.max(F.struct("t", "idx", "p")).alias("hi"))
        sums = sums.unionByName(t.select(*ranges).distinct(), allowMissingColumns=True).groupBy(*ranges).agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"))
        up, down = W.partitionBy(*keys).orderBy("_b"), W.partitionBy(*keys).orderBy(F.desc("_b"))
        past = (W.unboundedPreceding, -1)
        sums = sums.select(
            *ranges,
            F.last(F.col("hi.p"), True).over(up.rowsBetween(*past)).alias("_prev"),
            F.last(F.col("lo.p"), True).over(down.rowsBetween(*past)).alias("_next"),
            F.first(F.col("lo.p"), True).over(up.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("f"),
        )
        s = s.join(sums.select(*ranges, "_next", "f"), ranges)
        t = t.join(sums, ranges)
    after = F.lead("p").over(W.partitionBy(*ranges).orderBy("t", "idx"))
    s = s.withColumn("n", F.coalesce(after, "_next") if bucket else after)
    if not bucket:
        s = s.withColumn("f", F.first("p").over(W.partitionBy(*keys).orderBy("t", "idx")))
    first_after = F.first("_next", True) if bucket else None
    both = s.select(*ranges, "t", F.lit(1 if strict else 0).alias("_q"), "idx", F.struct("p", "n").alias("_s"), "f", F.lit(None).cast(t.schema["_row"].dataType).alias("_row"), *([F.lit(None).cast(t.schema["_prev"].dataType).alias("_prev"), F.lit(None).cast(t.schema["_next"].dataType).alias("_next")] if bucket else []))
    if bucket:
        tt = t.select(*ranges, "t", F.lit(0 if strict else 1).alias("_q"), F.lit(None).cast("long").alias("idx"), F.lit(None).cast(both.schema["_s"].dataType).alias("_s"), "f", "_row", "_prev", "_next")
    else:
        tt = t.select(*ranges, "t", F.lit(0 if strict else 1).alias("_q"), F.lit(None).cast("long").alias("idx"), F.lit(None).cast(both.schema["_s"].dataType).alias("_s"), F.lit(None).cast(both.schema["f"].dataType).alias("f"), "_row")
    u = both.unionByName(tt)
    w = W.partitionBy(*ranges).orderBy("t", "_q", "idx")
    seen = F.last("_s", True).over(w.rowsBetween(W.unboundedPreceding, 0))
    whole = W.partitionBy(*ranges).orderBy("t", "_q", "idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    u = u.withColumn("_g", seen).withColumn("f", F.first("f", True).over(whole))
    if bucket:
        # a bucket's own first sample follows a target that has no sample before it there
        local = F.first("_s", True).over(whole)["p"]
        u = u.withColumn("_l", local)
    u = u.where("_row IS NOT NULL")
    if bucket:
        p = F.coalesce(F.col("_g.p"), "_prev")
        n = F.when(F.col("_g.p").isNotNull(), F.col("_g.n")).otherwise(F.coalesce("_l", "_next"))
    else:
        p, n = F.col("_g.p"), F.when(F.col("_g.p").isNotNull(), F.col("_g.n")).otherwise(F.col("f"))
    del first_after
    return u.select(F.col("_row.*"), p.alias("p"), n.alias("n"), F.col("f"))


def hold_of(field: str = "v") -> Column:
    """The step-hold value of brackets: the last sample at or before the stamp, else the first one."""
    return F.coalesce(F.col(f"p.{field}"), F.col(f"f.{field}"))


def linear_of(t: str = "t") -> Column:
    """The linear value of brackets, clamped at both ends; steps where stamps are alike."""
    p, n, f = F.col("p"), F.col("n"), F.col("f")
    gap = n["t"] - p["t"]
    a = F.when(F.abs(gap) < 1e-15, 0.0).otherwise((F.col(t) - p["t"]) / F.when(gap == 0, 1.0).otherwise(gap))
    return (
        F.when(p.isNull() | (F.col(t) <= f["t"]), f["v"])
        .when(n.isNull(), p["v"])
        .otherwise(p["v"] * (1 - a) + n["v"] * a)
    )


def hold(source: DataFrame, targets: DataFrame, keys: Sequence[str] = KEY, bucket: float | None = None) -> DataFrame:
    """Targets with the step-hold ``v`` and ``valid``; keys without samples give nothing."""
    got = brackets(source, targets.select(*keys, "t"), keys, bucket=bucket).where("f IS NOT NULL")
    return got.select(*keys, "t", hold_of().alias("v"), *([hold_of("valid").alias("valid")] if "valid" in source.columns else []))


def linear(source: DataFrame, targets: DataFrame, keys: Sequence[str] = KEY, bucket: float | None = None) -> DataFrame:
    """Targets with the linear ``v`` and the step-hold ``valid``; only floating values are interpolated."""
    if source.schema["v"].dataType.typeName() not in ("double", "float"):
        return hold(source, targets, keys, bucket)
    got = brackets(source, targets.select(*keys, "t"), keys, bucket=bucket).where("f IS NOT NULL")
    return got.select(*keys, "t", linear_of().alias("v"), *([hold_of("valid").alias("valid")] if "valid" in source.columns else []))


def nearest(source: DataFrame, targets: DataFrame, keys: Sequence[str] = KEY, bucket: float | None = None) -> DataFrame:
    """The nearest sample; of the last one strictly before and the first one at or after, the earlier on a tie."""
    got = brackets(source, targets, keys, strict=True, bucket=bucket).where("f IS NOT NULL")
    early = F.col("p").isNotNull() & (F.col("n").isNull() | (F.col("t") - F.col("p.t") <= F.col("n.t") - F.col("t")))
    at = F.when(early, F.col("p")).otherwise(F.col("n"))
    return got.select(*targets.columns, at["t"].alias("at"), at["idx"].alias("at_idx"), at["v"].alias("v"))


def first_nearest(source: DataFrame, targets: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """The nearest sample, the first recorded on a tie; a non-finite stamp gives null.

    One pass over the joined rows: meant for a handful of targets a key.
    """
    s = source.select(*keys, F.col("t").alias("_t"), "idx", "v")
    far = F.struct(F.abs(F.col("_t") - F.col("t")), F.col("idx"))
    ok = ~F.isnan("t") & (F.abs("t") < float("inf"))
    got = targets.select(*keys, "t").distinct().join(s, list(keys)).groupBy(*keys, "t").agg(F.min_by("v", far).alias("v"), F.min_by("idx", far).alias("at_idx"))
    return got.select(*keys, "t", F.when(ok, F.col("v")).alias("v"), F.when(ok, F.col("at_idx")).alias("at_idx"))


def value_at(source: DataFrame, at: float, keys: Sequence[str] = KEY) -> DataFrame:
    """Each key's last valid number at or before ``at``, null if there is none."""
    fits = F.coalesce("valid", F.lit(True)) & ~F.isnan("v") & (F.col("t") <= at)
    best = F.max_by(F.when(fits, F.struct("t", "v")), F.when(fits, F.col("idx")))
    return source.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.t").alias("t"), F.col("b.v").alias("v"))
