"""Arithmetic between series on a common time base, and computed channels."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeline.functions import ieee
from gaugeline.operators import asof
from gaugeline.operators.series import KEY, StructureError

_OPS = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": ieee.div}
_TESTS = ("lt", "le", "gt", "ge", "eq", "ne")


def aligned(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, t, va, vb, valid_a, valid_b) on the stamps of both series inside their overlap, both sides linear
    (steps where the values are no floating numbers), validity held.

    One pass: a row for each stamp holds each side's first and last sample there, a forward window carries
    the last samples and a backward one the next.
    """
    sides = []
    for x, n in ((a, "a"), (b, "b")):
        valid = F.col("valid") if "valid" in x.columns else F.lit(True)
        sample = F.struct("idx", "t", F.col("v"), valid.alias("valid"))
        sides.append(x.select(*keys, "t", sample.alias(n)))
    rows = sides[0].unionByName(sides[1], allowMissingColumns=True).groupBy(*keys, "t")
    rows = rows.agg(*[f(n).alias(f"{at}_{n}") for n in "ab" for f, at in ((F.min, "first"), (F.max, "last"))])
    every = W.partitionBy(*keys)
    up = every.orderBy("t").rowsBetween(W.unboundedPreceding, W.currentRow)
    down = every.orderBy(F.desc("t")).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({f"p_{n}": F.last(f"last_{n}", True).over(up) for n in "ab"}).withColumns({f"n_{n}": F.last(f"first_{n}", True).over(down) for n in "ab"})
    ends = {f"{f.__name__}_{n}": f(F.when(F.col(f"last_{n}").isNotNull(), F.col("t"))).over(every) for n in "ab" for f in (F.min, F.max)}
    rows = rows.withColumns(ends).where("t >= greatest(min_a, min_b) AND t <= least(max_a, max_b)")
    out = []
    for x, n in ((a, "a"), (b, "b")):
        p, nxt = F.col(f"p_{n}"), F.col(f"n_{n}")
        value = p["v"]
        if x.schema["v"].dataType.typeName() in ("double", "float"):
            gap = nxt["t"] - p["t"]
            share = F.when(F.abs(gap) < 1e-15, 0.0).otherwise((F.col("t") - p["t"]) / F.when(gap == 0, 1.0).otherwise(gap))
            value = F.when(F.col("t") <= F.col(f"min_{n}"), F.col(f"first_{n}")["v"]).when(nxt.isNull(), p["v"]).otherwise(p["v"] * (1 - share) + nxt["v"] * share)
        out += [value.alias(f"v{n}"), p["valid"].alias(f"valid_{n}")]
    return rows.select(*keys, "t", *out)


def calculation(op: str, a: Column, b: Column | float) -> Column:
    if op in _TESTS:
        return ieee.compare(op, a, b)
    return _OPS[op](a, b if isinstance(b, Column) else F.lit(float(b)))


def combine(a: DataFrame, b: DataFrame, op: str, keys: Sequence[str] = KEY, combine_valid: str = "or") -> DataFrame:
    """(keys, idx, t, v, valid) of ``a op b``; op is add, sub, mul, div or a comparison.

    A result is valid if either side is (``combine_valid="and"``: if both are).
    """
    if len(a.select(F.lit(0)).limit(1).union(b.select(F.lit(1)).limit(1)).collect()) < 2:
        raise StructureError("an operand has no samples")
    got = aligned(a, b, keys)
    valid = F.col("valid_a") | F.col("valid_b") if combine_valid == "or" else F.col("valid_a") & F.col("valid_b")
    out = got.select(*keys, "t", calculation(op, F.col("va"), F.col("vb")).alias("v"), valid.alias("valid"))
    return out.withColumn("idx", (F.row_number().over(W.partitionBy(*keys).orderBy("t")) - 1).cast("long")).select(*keys, "idx", "t", "v", "valid")


def scalar(df: DataFrame, op: str, number: float, swapped: bool = False) -> DataFrame:
    """``v op number`` (or ``number op v``) on the series' own stamps."""
    v, n = F.col("v").cast("double"), F.lit(float(number))
    return df.withColumn("v", calculation(op, n, v) if swapped else calculation(op, v, n))


def neg(df: DataFrame) -> DataFrame:
    return df.withColumn("v", -F.col("v"))


def union_stamps(series: Sequence[DataFrame], keys: Sequence[str] = KEY, gap: float = 1e-9) -> DataFrame:
    """All stamps of several series, those within ``gap`` of the last kept one dropped.

    The greedy rule reads a key's stamps in order; a stamp whose predecessor is ``gap`` or more away
    starts a new run, and only runs of more than one stamp are walked in Python.
    """
    stamps = None
    for s in series:
        part = s.select(*keys, "t")
        stamps = part if stamps is None else stamps.unionByName(part)
    stamps = stamps.distinct()
    w = W.partitionBy(*keys).orderBy("t")
    runs = stamps.withColumn("_new", F.coalesce((F.col("t") - F.lag("t").over(w)) >= gap, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(w))
    many = runs.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys, "_run")))

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        t, kept = np.sort(g["t"].to_numpy()), []
        for x in t:
            if not kept or x - kept[-1] >= gap:
                kept.append(x)
        out = g.iloc[[0] * len(kept)][list(keys)].reset_index(drop=True)
        out["t"] = kept
        return out

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stamps.select(*keys, "t").schema)
    alone = many.where("_n = 1").select(*keys, "t")
    return alone.unionByName(many.where("_n > 1").groupBy(*keys, "_run").applyInPandas(walk, kinds))


def computed(expression: Column, inputs: dict[str, DataFrame], keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, t, v, valid) of an expression over columns named as the inputs.

    Inputs are interpolated onto the union of their stamps, clamped at their ends; a result is valid
    where every input is and it is a number.
    """
    stamps = union_stamps(list(inputs.values()), keys)
    out, valid = stamps, F.lit(True)
    for i, (name, s) in enumerate(inputs.items()):
        got = asof.linear(s, stamps, keys).select(*keys, "t", F.col("v").alias(name), F.col("valid").alias(f"_ok{i}"))
        out = out.join(got, [*keys, "t"])
        valid = valid & F.coalesce(f"_ok{i}", F.lit(True)) & ~F.isnan(name)
    out = out.withColumn("v", expression)
    return out.select(*keys, "t", "v", (valid & ~F.isnan("v")).alias("valid"))


def constant(spark, value: float) -> DataFrame:
    """A computed channel without inputs: two samples at 0 and 1."""
    return spark.createDataFrame([(0.0, float(value), True), (1.0, float(value), True)], "t double, v double, valid boolean")


def computed_on_first(expression: Column, inputs: dict[str, DataFrame], keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, idx, t, v) on the first input's clock, the others by their nearest sample."""
    names = list(inputs)
    out = inputs[names[0]].select(*keys, "idx", "t", F.col("v").alias(names[0]))
    for name in names[1:]:
        out = asof.nearest(inputs[name], out, keys).drop("at", "at_idx").withColumnRenamed("v", name)
    return out.select(*keys, "idx", "t", expression.alias("v"))


def references(names: Sequence[str], catalog: Sequence[str]) -> dict[str, str]:
    """Each referenced name's channel: an exact match, else the first that differs only in case."""
    lower = {}
    for c in catalog:
        lower.setdefault(c.lower(), c)
    out = {}
    for n in names:
        found = n if n in catalog else lower.get(n.lower())
        if found is None:
            raise StructureError(f"no channel named {n}")
        out[n] = found
    return out


def safe_name(name: str) -> str:
    return re.sub(r"\W", "_", name)


class Series:
    """A series table with Python's operators: with a number on its own stamps, with another series on the
    common ones. ``df`` is the table."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    def _with(self, op: str, other: Series | float, swapped: bool = False) -> Series:
        if isinstance(other, Series):
            return Series(combine(self.df, other.df, op))
        return Series(scalar(self.df, op, other, swapped))

    def __add__(self, other: Series | float) -> Series:
        return self._with("add", other)

    def __sub__(self, other: Series | float) -> Series:
        return self._with("sub", other)

    def __mul__(self, other: Series | float) -> Series:
        return self._with("mul", other)

    def __truediv__(self, other: Series | float) -> Series:
        return self._with("div", other)

    def __radd__(self, other: float) -> Series:
        return self._with("add", other, True)

    def __rsub__(self, other: float) -> Series:
        return self._with("sub", other, True)

    def __rmul__(self, other: float) -> Series:
        return self._with("mul", other, True)

    def __rtruediv__(self, other: float) -> Series:
        return self._with("div", other, True)

    def __neg__(self) -> Series:
        return Series(neg(self.df))

    def __lt__(self, other: Series | float) -> Series:
        return self._with("lt", other)

    def __le__(self, other: Series | float) -> Series:
        return self._with("le", other)

    def __gt__(self, other: Series | float) -> Series:
        return self._with("gt", other)

    def __ge__(self, other: Series | float) -> Series:
        return self._with("ge", other)

    def equal(self, other: Series | float) -> Series:
        return self._with("eq", other)

    def differs(self, other: Series | float) -> Series:
        return self._with("ne", other)
