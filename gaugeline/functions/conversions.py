"""Raw-to-physical conversions compiled to columns.

A conversion is a ``Conversion`` of a kind with its parameters; ``physical`` gives the column. Number
tables become literal arrays searched by higher-order functions, or a chain of conditions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeline.functions import ieee
from gaugeline.functions.expressions import formula

_NAN = float("nan")
BITFIELD_SEPARATOR = " | "


class UnsupportedConversion(ValueError):
    """A conversion that can't be applied; reading it raw would be wrong."""


@dataclass(frozen=True)
class Conversion:
    """``kind`` and its parameters: numbers ``p``, keys, upper bounds, results and a default.

    A result is a number, a text or a nested Conversion.
    """

    kind: str
    p: Sequence[float] = ()
    keys: Sequence = ()
    upper: Sequence[float] = ()
    results: Sequence = ()
    default: object = None
    text: str = ""
    masks: Sequence[int] = ()
    names: Sequence[str] = field(default=())


def _lits(xs: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in xs])


def linear(x: Column, factor: float, offset: float) -> Column:
    return F.lit(float(factor)) * x + F.lit(float(offset))


def rational(x: Column, p: Sequence[float]) -> Column:
    top = float(p[0]) * x * x + float(p[1]) * x + float(p[2])
    return ieee.div(top, float(p[3]) * x * x + float(p[4]) * x + float(p[5]))


def interpolated(x: Column, keys: Sequence[float], values: Sequence[float], slope_form: bool = False) -> Column:
    """Linear between table points, clamped at both ends; NaN stays NaN.

    ``slope_form`` multiplies the slope by the distance instead of weighting both values.
    """
    if not keys:
        return F.lit(_NAN)
    out = F.when(F.isnan(x), F.lit(_NAN)).when(x <= float(keys[0]), F.lit(float(values[0])))
    for i in range(1, len(keys)):
        x0, x1, y0, y1 = (float(v) for v in (keys[i - 1], keys[i], values[i - 1], values[i]))
        if x1 == x0:
            y = F.lit(y1)
        elif slope_form:
            y = F.lit((y1 - y0) / (x1 - x0)) * (x - x0) + y0
        else:
            a = (x - x0) / (x1 - x0)
            y = F.lit(y0) + a * (y1 - y0)
        out = out.when(x <= x1, F.when(x == x1, F.lit(y1)).otherwise(y))
    return out.otherwise(F.lit(float(values[-1])))


def nearest_key(x: Column, keys: Sequence[float], values: Sequence[float], lower_on_tie: bool = False) -> Column:
    """The value of the nearest key; on a tie the earlier entry, or the lower key."""
    if not keys:
        return F.lit(_NAN)
    entries = F.arrays_zip(_lits(keys).alias("k"), F.sequence(F.lit(0), F.lit(len(keys) - 1)).alias("i"), _lits(values).alias("v"))
    ranked = F.transform(entries, lambda e: F.struct(F.abs(e["k"] - x).alias("d"), (e["k"] if lower_on_tie else e["i"].cast("double")).alias("r"), e["v"].alias("v")))
    return F.when(F.isnan(x), F.lit(_NAN)).otherwise(F.array_min(ranked)["v"])


def in_range(x: Column, low: float, high: float, integers: bool) -> Column:
    """Closed for integers; for floats the upper end is open unless the range is one point."""
    if integers or low == high:
        return (x >= float(low)) & (x <= float(high))
    return (x >= float(low)) & (x < float(high))


def _number(value: object, x: Column) -> Column:
    if isinstance(value, Conversion):
        return physical(x, value)
    return F.lit(_NAN) if value is None else F.lit(float(value))


def _text(value: object, x: Column) -> Column:
    if isinstance(value, Conversion):
        out = physical(x, value)
        return out if value.kind in TEXT_KINDS else rendered(out)
    return F.lit("") if value is None else F.lit(str(value))


def rendered(x: Column) -> Column:
    """A number as text, whole numbers without a fraction."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def _chain(cases: Sequence[tuple[Column, Column]], default: Column) -> Column:
    out = None
    for cond, value in cases:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return default if out is None else out.otherwise(default)


def bitfield(x: Column, c: Conversion) -> Column:
    """The masked flags' texts joined by a bar; an entry without its bits is left out. A value that is no
    whole number from 0 on gives the empty text."""
    raw = x.cast("bigint")
    parts = []
    for i, mask in enumerate(c.masks):
        entry = c.results[i]
        masked = raw.bitwiseAND(F.lit(int(mask)))
        if entry is c:
            raise UnsupportedConversion("a bitfield that holds itself")
        if isinstance(entry, Conversion):
            value = physical(masked.cast("double"), entry)
            text = value if entry.kind in TEXT_KINDS else F.when(F.isnan(value), "").otherwise(rendered(value))
            name = c.names[i] if i < len(c.names) else ""
            parts.append(F.when(text != "", F.concat(F.lit(f"{name} = " if name else ""), text)))
        elif entry:
            parts.append(F.when(masked != 0, F.lit(str(entry))))
    sane = ieee.finite(x) & (x >= 0) & (x == F.floor(x)) & (x < float(2**63))
    return F.when(sane, F.concat_ws(BITFIELD_SEPARATOR, *parts)).otherwise("")


TEXT_KINDS = {"value_to_text", "range_to_text", "text_to_text", "bitfield", "value_to_text3", "range_to_text3"}


def physical(x: Column, c: Conversion, integers: bool = False) -> Column:
    """The physical value of a raw column (a text column for the kinds that start from text)."""
    k, p = c.kind, list(c.p)
    number = x.cast("double") if k not in ("text_to_value", "text_to_text", "identity") else x
    if k == "identity" or k == "linear" and p == [1.0, 0.0]:
        return x
    if k == "linear":
        return linear(number, p[0], p[1])
    if k == "rational":
        return rational(number, p)
    if k == "formula":
        return formula(c.text, number)
    if k == "interpolated":
        return interpolated(number, c.keys, c.results)
    if k == "nearest":
        return nearest_key(number, c.keys, c.results)
    if k == "range_to_value":
        cases = [(in_range(number, lo, hi, integers), _number(r, number)) for lo, hi, r in zip(c.keys, c.upper, c.results, strict=True)]
        return _chain(cases[::-1], _number(c.default, number))
    if k == "value_to_text":
        cases = [(number == float(key), _text(r, number)) for key, r in zip(c.keys, c.results, strict=True)]
        return _chain(cases, _text(c.default, number))
    if k == "range_to_text":
        cases = [(in_range(number, lo, hi, integers), _text(r, number)) for lo, hi, r in zip(c.keys, c.upper, c.results, strict=True)]
        return _chain(cases[::-1], _text(c.default, number))
    if k == "text_to_value":
        return _chain([(x == F.lit(key), F.lit(float(r))) for key, r in zip(c.keys, c.results, strict=True)], F.lit(_NAN if c.default is None else float(c.default)))
    if k == "text_to_text":
        return _chain([(x == F.lit(key), F.lit(str(r))) for key, r in zip(c.keys, c.results, strict=True)], F.lit("" if c.default is None else str(c.default)))
    if k == "bitfield":
        return bitfield(number, c)
    return _old(number, c, k, p)


def _old(x: Column, c: Conversion, k: str, p: list[float]) -> Column:
    """The kinds of versions 2 and 3 of the format."""
    if k == "linear3":
        return x * float(p[0]) + float(p[1])
    if k == "interpolated3":
        return interpolated(x, c.keys, c.results, slope_form=True)
    if k == "nearest3":
        return nearest_key(x, c.keys, c.results, lower_on_tie=True)
    if k == "polynomial3":
        p1, p2, p3, p4, p5, p6 = p
        if p2 == p3 == p5 == p6 == 0:
            return x if p1 == p4 else ieee.div(F.lit(p4) * x, p1)
        s = x - p5 - p6
        return ieee.div(F.lit(p2) - F.lit(p4) * s, F.lit(p3) * s - p1)
    if k in ("exponential3", "logarithmic3"):
        p1, p2, p3, p4, p5, p6, p7 = p
        f = F.exp if k == "exponential3" else ieee.log
        shifted = x - p7
        if p4 == 0:
            return ieee.div(f(ieee.div(shifted * p6 - p3, p1)), p2)
        return ieee.div(f(ieee.div(ieee.div(F.lit(p3), shifted) - p6, p4)), p5)
    if k == "rational3":
        p1, p2, p3, p4, p5, p6 = p
        # proportional forms, which the quotient would make 0/0 at x = 0
        if not (p1 or p3 or p4 or p5):
            return x if p2 == p6 else ieee.div(x * p2, p6) if p6 == 0 else x * (p2 / p6)
        if not (p2 or p3 or p4 or p6):
            return x if p1 == p5 else ieee.div(x * p1, p5) if p5 == 0 else x * (p1 / p5)
        return rational(x, p)
    if k == "formula3":
        return formula(c.text, x)
    if k == "value_to_text3":
        return _chain([(x == float(key), F.lit(str(r))) for key, r in zip(c.keys, c.results, strict=True)], F.lit(""))
    if k == "range_to_text3":
        # a value counts for a range only if exactly one range holds it
        started = F.size(F.filter(_lits(c.keys), lambda v: v <= x)) if c.keys else F.lit(0)
        ended = F.size(F.filter(_lits(c.upper), lambda v: v < x)) if c.upper else F.lit(0)
        default = F.lit("" if c.default is None else str(c.default))
        if not c.results:
            return default
        return F.when((started > 0) & (started - 1 == ended), F.get(F.array(*[F.lit(str(r)) for r in c.results]), ended)).otherwise(default)
    raise UnsupportedConversion(f"conversion {k} is not supported")


def applies_to_text(c: Conversion) -> bool:
    """Whether a conversion starts from text; others are ignored on text channels."""
    return c.kind in ("text_to_value", "text_to_text")


def described(c: Conversion) -> str:
    """One line about a conversion."""
    if c.kind == "linear":
        return f"{c.p[0]:g} * x + {c.p[1]:g}"
    if c.kind in ("formula", "formula3"):
        return c.text
    if c.kind == "rational":
        return "({:g} x^2 + {:g} x + {:g}) / ({:g} x^2 + {:g} x + {:g})".format(*c.p)
    n = len(c.keys) or len(c.masks)
    return f"{c.kind.replace('_', ' ')}, {n} entries" if n else c.kind.replace("_", " ")
