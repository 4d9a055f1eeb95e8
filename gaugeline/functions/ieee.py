"""IEEE arithmetic on columns: Spark raises, gives null or orders NaN last where measurement
algebra wants infinities, NaN and unordered comparisons."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

NAN = float("nan")
INF = float("inf")


def _col(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def div(a: Column | float, b: Column | float) -> Column:
    """a / b with x/0 = ±inf and 0/0 = NaN; the sign of a zero divisor counts."""
    a, b = _col(a).cast("double"), _col(b).cast("double")
    negative_zero = b.cast("string") == "-0.0"
    signed = F.when((a < 0) != negative_zero, F.lit(-INF)).otherwise(F.lit(INF))
    return F.when(b != 0, a / b).when(b.isNull() | a.isNull(), F.lit(None)).when((a == 0) | F.isnan(a), F.lit(NAN)).otherwise(signed)


def compare(op: str, a: Column, b: Column | float) -> Column:
    """1.0 where the comparison holds, else 0.0; NaN equals nothing and is ordered with nothing."""
    b = _col(b)
    ordered = ~F.isnan(a) & ~F.isnan(b)
    test = {"lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b, "eq": a == b, "ne": a == b}[op]
    held = ~(ordered & test) if op == "ne" else ordered & test
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(held, 1.0).otherwise(0.0)


def log(x: Column, base: str = "ln") -> Column:
    """Natural or decimal logarithm with log 0 = -inf and NaN below.

    It is the C library's, to the last bit: the JVM's differs from it there for about one number in forty.
    """
    x, of = _col(x).cast("double"), pc.ln if base == "ln" else pc.log10

    def logs(values: pa.Array) -> pa.Array:
        return of(values)

    return F.when(x < 0, F.lit(NAN)).otherwise(F.arrow_udf(logs, DoubleType())(x))


def rounded(x: Column, digits: int) -> Column:
    """x rounded to decimals in doubles, as the SQL does: scaled, taken to the nearest whole number (halves away from
    zero, the sign of a zero kept) and scaled back; x itself where that is not finite.

    Spark's own round goes by the shortest decimal text, which for some numbers lies on the other side of a half.
    """
    scale = F.lit(10.0**digits)
    scaled = x * scale
    whole = F.when(F.abs(scaled) < 0.5, scaled * 0.0).otherwise(F.round(scaled))
    return F.when(F.abs(scaled) < INF, whole / scale).otherwise(x)


def largest(*xs: Column) -> Column:
    """The largest that is a number; NaN only if none is."""
    return F.coalesce(F.greatest(*[F.nanvl(x, F.lit(None).cast("double")) for x in xs]), xs[0])


def smallest(*xs: Column) -> Column:
    return F.coalesce(F.least(*[F.nanvl(x, F.lit(None).cast("double")) for x in xs]), xs[0])


def number(x: Column) -> Column:
    """Null instead of NaN, so that min and max pass over it."""
    return F.when(~F.isnan(x), x)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INF)
