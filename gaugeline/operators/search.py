"""Names and tables: searching, filtering, sorting, finding channels."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeline.operators.series import StructureError


def wildcard(pattern: str) -> str:
    """The regular expression of a whole-string pattern with ? and *."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([\\.^$|()\[\]{}+])", r"\\\1", c) for c in pattern) + "$"


def names(catalog: DataFrame, pattern: str, mode: str = "plain", column: str = "name") -> DataFrame:
    """The distinct names that match, sorted: ``plain`` and ``case_insensitive`` look for the text within,
    ``wildcard`` matches the whole name in its case, ``exact`` compares."""
    c = F.col(column)
    test = {
        "plain": lambda: c.contains(pattern),
        "wildcard": lambda: c.rlike("(?s)" + wildcard(pattern)),
        "case_insensitive": lambda: F.lower(c).contains(pattern.lower()),
        "exact": lambda: c == pattern,
    }
    if mode not in test:
        raise ValueError(f"unknown mode {mode}")
    return catalog.where(test[mode]()).select(column).distinct().orderBy(column)


def matches(c: Column, pattern: str, mode: str = "substring") -> Column:
    """The viewer's search: case never counts, an empty pattern matches all; regular expressions have no
    alternatives and no groups."""
    if not pattern:
        return F.lit(True)
    if mode == "substring":
        return F.lower(c).contains(pattern.lower())
    if mode == "wildcard":
        return c.rlike("(?is)" + wildcard(pattern))
    if mode == "regex":
        if re.search(r"(?<!\\)[|()]", pattern):
            raise ValueError("alternatives and groups are not supported")
        return c.rlike("(?i)" + pattern)
    raise ValueError(f"unknown mode {mode}")


def locate(catalog: DataFrame, name: str) -> DataFrame:
    """All places (dg, cg, cn) of a name."""
    return catalog.where(F.col("name") == name).orderBy("dg", "cg", "cn")


def find(catalog: DataFrame, name: str) -> DataFrame:
    """The first channel of a name."""
    return locate(catalog, name).limit(1)


def find_by_reference(catalog: DataFrame, name: str) -> DataFrame:
    """The first channel of that name, else the first that differs only in case."""
    ranked = catalog.where(F.lower("name") == name.lower()).withColumn("_tier", (F.col("name") != name).cast("int"))
    return ranked.orderBy("_tier", "dg", "cg", "cn").limit(1).drop("_tier")


def select_channels(catalog: DataFrame, selectors: Sequence[str | tuple]) -> list:
    """Catalog rows in the order asked for: a name (which has to be unique), (name, group) or (dg, cg, cn)."""
    rows = catalog.select("name", "dg", "cg", "cn").collect()  # a catalog is driver-sized: one row a channel
    out = []
    for s in selectors:
        if isinstance(s, str):
            hits = [r for r in rows if r["name"] == s]
        elif len(s) == 2:
            hits = [r for r in rows if r["name"] == s[0] and r["dg"] == s[1]]
        else:
            hits = [r for r in rows if (r["dg"], r["cg"], r["cn"]) == tuple(s)]
        if not hits:
            raise StructureError(f"no channel {s}")
        if len(hits) > 1 and isinstance(s, str):
            raise StructureError(f"{s} names {len(hits)} channels")
        out.append(hits[0])
    return out


def channels_matching(catalog: DataFrame, predicate: Callable[[dict], bool]) -> DataFrame:
    """Channels that a Python predicate accepts; the catalog is small."""
    keep = [r for r in catalog.collect() if predicate(r.asDict())]
    return catalog.sparkSession.createDataFrame(keep, catalog.schema)


def tree_filter(catalog: DataFrame, text: str) -> DataFrame:
    """Channels whose name or unit holds the text in any case."""
    return catalog.where(matches(F.col("name"), text) | matches(F.coalesce("unit", F.lit("")), text))


def filter_rows(df: DataFrame, query: str) -> DataFrame:
    """Rows with a cell that holds the query in any case; null cells never match, an empty query keeps all."""
    if not query:
        return df
    hit = F.lit(False)
    for c in df.columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(query.lower()), F.lit(False))
    return df.where(hit)


def sort_keys(c: Column, descending: bool = False, text: bool = False) -> list[Column]:
    """Order of a table column: nulls last either way, text without regard to case."""
    key = F.lower(c) if text else c
    return [key.desc_nulls_last() if descending else key.asc_nulls_last()]


def sorted_rows(df: DataFrame, column: str, descending: bool = False, tie: str = "idx") -> DataFrame:
    """A stable sort: numbers before text, invalid cells last in both directions, ties as recorded."""
    c = F.col(column)
    if df.schema[column].dataType.typeName() != "string":
        return df.orderBy(*sort_keys(c, descending), tie)
    number = F.expr(f"try_cast(`{column}` AS double)")
    kind = F.when(c.isNull(), None).when(number.isNotNull(), 0).otherwise(1)
    keys = [kind.desc_nulls_last(), number.desc(), F.lower(c).desc()] if descending else [kind.asc_nulls_last(), number.asc(), F.lower(c).asc()]
    return df.orderBy(*keys, tie)


def table_view(df: DataFrame, query: str, column: str, descending: bool = False, tie: str = "idx") -> DataFrame:
    return sorted_rows(filter_rows(df, query), column, descending, tie)


def latest_ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in an order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")
