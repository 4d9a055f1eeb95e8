"""Pairs of series: one against the other, and positions on the globe."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.functions import ieee
from gaugeline.operators import asof
from gaugeline.operators.series import KEY, StructureError

SAME = 1e-9


class PairRefused(StructureError):
    """Two series that can't be paired; ``reason`` says why."""

    def __init__(self, reason: str, text: str) -> None:
        super().__init__(text)
        self.reason = reason


def pair(x: DataFrame, y: DataFrame, offset_x: float = 0.0, offset_y: float = 0.0, cross_file: bool = False, absolute: bool = True) -> tuple[DataFrame, DataFrame]:
    """((t, x, y), (dropped)): the X series' stamps with both values.

    Equal rasters pair by position; else Y is interpolated at the X stamps inside the exact overlap.
    Pairs with an invalid or NaN side are dropped and counted.
    """
    if cross_file and not absolute:
        raise PairRefused("own_zero", "series of two files need one absolute axis")
    x, y = x.withColumn("t", F.col("t") + offset_x), y.withColumn("t", F.col("t") + offset_y)
    sides = x.select(F.lit(0).alias("side"), "t").union(y.select(F.lit(1), "t")).groupBy("side").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("n")).collect()
    by_side = {r["side"]: r for r in sides}
    span = [by_side.get(i, {"n": 0}) for i in (0, 1)]  # one job over both sides
    if not span[0]["n"] or not span[1]["n"]:
        raise PairRefused("empty", "a series has no samples")
    lo, hi = max(s["lo"] for s in span), min(s["hi"] for s in span)
    if lo > hi:
        raise PairRefused("no_overlap", "the series do not overlap")
    a = x.select("idx", "t", F.col("v").cast("double").alias("x"), F.coalesce("valid", F.lit(True)).alias("okx"))
    shared = False
    if span[0]["n"] == span[1]["n"]:
        b = y.select("idx", F.col("t").alias("ty"), F.col("v").cast("double").alias("y"), F.coalesce("valid", F.lit(True)).alias("oky"))
        both = a.join(b, "idx")
        shared = both.where(F.abs(F.col("t") - F.col("ty")) > SAME).isEmpty()
    if not shared:
        targets = a.where(F.col("t").between(lo, hi)).withColumn("series", F.lit("s"))
        got = asof.brackets(y.withColumn("series", F.lit("s")), targets, KEY)
        both = got.select("t", "x", "okx", asof.linear_of().alias("y"), asof.hold_of("valid").alias("oky"))
    fine = F.col("okx") & F.coalesce("oky", F.lit(True)) & ~F.isnan("x") & ~F.isnan("y")
    return both.where(fine).select("t", "x", "y"), both.agg(F.count(F.when(~fine, 1)).alias("dropped"))


def point_at(pairs: DataFrame, t: float) -> DataFrame:
    """The pair nearest to a stamp, none outside the pairs' span."""
    span = pairs.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    if span["lo"] is None or not span["lo"] - SAME <= t <= span["hi"] + SAME:
        return pairs.limit(0)
    return pairs.orderBy(F.abs(F.col("t") - t), "t").limit(1)


def gps_track(lat: DataFrame, lon: DataFrame, speed: DataFrame | None = None, most: int = 20_000) -> DataFrame:
    """(idx, t, lat, lon, speed) on the latitude's clock by position, every n-th sample so that at most
    ``most`` remain; a shorter series is filled with NaN, samples without a finite latitude are dropped."""
    n = lat.agg(F.max("idx")).first()[0]
    stride = max(1, -(-((n or 0) + 1) // most))
    out = lat.where(F.col("idx") % stride == 0).select("idx", "t", F.col("v").alias("lat"))
    for name, s in (("lon", lon), ("speed", speed)):
        if s is None:
            out = out.withColumn(name, F.lit(float("nan")))
        else:
            out = out.join(s.where(F.col("idx") % stride == 0).select("idx", F.col("v").alias(name)), "idx", "left").withColumn(name, F.coalesce(name, F.lit(float("nan"))))
    return out.where(ieee.finite(F.col("lat")))


_NOT_GPS = ("accel", "force", "error", "err", "dist", "offset", "slip", "plausib")


#: What may stand before a coordinate's name.
_RECEIVERS = ("gps", "gnss", "position", "pos", "nav", "rt", "vbox", "ins", "can_gps", "vehicle_gps")


def _behind_receiver(low: str, words: str) -> bool:
    """A receiver's name, then a coordinate's, perhaps with its unit or more words."""
    return bool(re.search(rf"^({'|'.join(_RECEIVERS)})[^a-z0-9]*({words})((deg|degrees)?$|_)", low))


def is_latitude(name: str) -> bool:
    """Whether a channel name speaks of a latitude."""
    low = name.lower()
    found = re.search(r"(^|[^a-z])lat($|[^a-z]|itude)|latitude", low) or _behind_receiver(low, "lat|latitude")
    return bool(found) and not any(w in low for w in _NOT_GPS)


def is_longitude(name: str) -> bool:
    low = name.lower()
    found = re.search(r"(^|[^a-z])(lon|lng|long)($|[^a-z]|itude)|longitude", low) or _behind_receiver(low, "lon|lng|long|longitude")
    return bool(found) and not any(w in low for w in _NOT_GPS)


def gps_pairs(channels: Sequence[tuple[str, int, int]]) -> tuple | None:
    """The (name, dg, cg) of a latitude and a longitude: of one group if there is one, else of any."""
    lats, lons = ([c for c in channels if f(c[0])] for f in (is_latitude, is_longitude))
    for a in lats:
        for b in lons:
            if a[1:] == b[1:]:
                return a, b
    return (lats[0], lons[0]) if lats and lons else None
