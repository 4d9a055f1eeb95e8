"""Text expressions compiled to columns: conversion formulas and computed channels.

One small grammar serves the three dialects: sums and products, unary signs, powers where the dialect
has them, calls, numbers and names. Compilation happens once, on the driver; rows see columns only.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeline.functions import ieee


class ExpressionError(ValueError):
    """Text that is no expression of its dialect."""


_NAN = float("nan")


def _divide_guarded(a: Column, b: Column) -> Column:
    """NaN where the divisor is closer to zero than 1e-15."""
    return F.when(F.abs(b) < 1e-15, F.lit(_NAN)).otherwise(ieee.div(a, b))


@dataclass(frozen=True)
class Dialect:
    """What an expression may hold beside sums, products, signs and parentheses."""

    divide: Callable[[Column, Column], Column]
    functions: dict[str, tuple[int, Callable[..., Column]]]
    power: bool = False
    quoted: bool = False
    constants: dict[str, float] | None = None
    depth: int = 32


#: Conversion formulas: one variable, powers, and these functions of one argument.
FORMULA = Dialect(
    divide=ieee.div,
    functions={
        **{n: (1, getattr(F, n)) for n in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "exp", "sqrt", "abs")},
        "log": (1, lambda x: ieee.log(x)), "ln": (1, lambda x: ieee.log(x)), "log10": (1, lambda x: ieee.log(x, "log10")),
    },
    power=True,
    constants={"pi": 3.141592653589793},
)

#: Computed channels of the desktop viewer: arithmetic over quoted or bare names.
COMPUTED = Dialect(divide=_divide_guarded, functions={}, quoted=True)

#: Computed channels of the browser viewer: IEEE division and four functions.
COMPUTED_WEB = Dialect(
    divide=ieee.div,
    functions={"abs": (1, F.abs), "sqrt": (1, F.sqrt), "min": (2, ieee.smallest), "max": (2, ieee.largest)},
    quoted=True,
)

_TOKEN = re.compile(
    r"""\s*(?:(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<quoted>\[[^\]]*\]|\{[^}]*\}|"[^"]*"|'[^']*')"""
    r"""|(?P<name>[^\W\d][\w.]*)|(?P<op>\*\*|[-+*/^(),]))""",
    re.UNICODE,
)


class _Parser:
    def __init__(self, text: str, dialect: Dialect, variable: Callable[[str], Column]) -> None:
        self.d, self.variable = dialect, variable
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ExpressionError(f"unexpected {text[at:].strip()[:10]!r} at {at}")
            self.tokens.append((m.lastgroup or "", m[m.lastgroup or 0]))
            at = m.end()
        self.at = 0
        self.level = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" else ""

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise ExpressionError("the expression ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def expect(self, op: str) -> None:
        if self.peek() != op:
            raise ExpressionError(f"{op!r} is missing")
        self.at += 1

    def whole(self) -> Column:
        out = self.sum()
        if self.at != len(self.tokens):
            raise ExpressionError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def sum(self) -> Column:
        self.level += 1
        if self.level > self.d.depth:
            raise ExpressionError(f"nested deeper than {self.d.depth}")
        out = self.product()
        while (op := self.peek()) in ("+", "-") and op:
            self.at += 1
            right = self.product()
            out = out + right if op == "+" else out - right
        self.level -= 1
        return out

    def product(self) -> Column:
        out = self.unary()
        while (op := self.peek()) in ("*", "/") and op:
            self.at += 1
            right = self.unary()
            out = out * right if op == "*" else self.d.divide(out, right)
        return out

    def unary(self) -> Column:
        signs = 0
        minus = False
        while (op := self.peek()) in ("+", "-") and op:
            self.at += 1
            signs += 1
            minus ^= op == "-"
            if signs > self.d.depth:
                raise ExpressionError(f"nested deeper than {self.d.depth}")
        out = self.power()
        return -out if minus else out

    def power(self) -> Column:
        base = self.primary()
        if self.d.power and self.peek() in ("^", "**"):
            self.at += 1
            return F.pow(base, self.unary())
        return base

    def primary(self) -> Column:
        kind, text = self.take()
        if kind == "num":
            return F.lit(float(text))
        if kind == "op" and text == "(":
            out = self.sum()
            self.expect(")")
            return out
        if kind == "quoted" and self.d.quoted:
            return self.variable(text[1:-1])
        if kind == "name":
            low = text.lower()
            if self.peek() == "(":
                if low not in self.d.functions:
                    raise ExpressionError(f"no function named {text}")
                self.at += 1
                arity, f = self.d.functions[low]
                args = [self.sum()]
                while self.peek() == ",":
                    self.at += 1
                    args.append(self.sum())
                self.expect(")")
                if len(args) != arity:
                    raise ExpressionError(f"{text} takes {arity} arguments, not {len(args)}")
                return f(*args)
            if low in (self.d.constants or {}):
                return F.lit(self.d.constants[low])
            return self.variable(text)
        raise ExpressionError(f"unexpected {text!r}")


def formula(text: str, x: Column) -> Column:
    """A conversion formula of one variable, named X or X1 in either case."""

    def variable(name: str) -> Column:
        if name.lower() not in ("x", "x1"):
            raise ExpressionError(f"no variable named {name}")
        return x

    return _Parser(text, FORMULA, variable).whole()


def compiled(text: str, columns: dict[str, str] | Callable[[str], Column], dialect: Dialect = COMPUTED) -> Column:
    """A computed channel over columns; ``columns`` maps the names used to column names."""

    def variable(name: str) -> Column:
        if callable(columns):
            return columns(name)
        if name not in columns:
            raise ExpressionError(f"no channel named {name}")
        return F.col(f"`{columns[name]}`")

    return _Parser(text, dialect, variable).whole()


def names_in(text: str, dialect: Dialect = COMPUTED) -> list[str]:
    """The names an expression refers to, in the order of their first use."""
    found: dict[str, None] = {}
    for m in _Parser(text, dialect, lambda n: F.lit(0.0)).tokens:
        if m[0] == "quoted":
            found.setdefault(m[1][1:-1])
        elif m[0] == "name" and m[1].lower() not in dialect.functions and m[1].lower() not in (dialect.constants or {}):
            found.setdefault(m[1])
    return list(found)
