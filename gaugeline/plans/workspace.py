"""Named series, computed channels and attached databases: decisions made before Spark sees a plan.

Operands that come from one table of records (the same channel group) stay columns of one row: their
arithmetic is a projection, with no union of stamps, no as-of lookup and no shuffle. An expression over one
series keeps its samples. Other operands are aligned on the union of their stamps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.functions.expressions import COMPUTED, COMPUTED_WEB, Dialect, compiled, names_in
from gaugeline.operators import algebra, bus
from gaugeline.operators.series import KEY, StructureError
from gaugeline.sources.database import Database


@dataclass(frozen=True)
class Channel:
    """A column of a group's table, or a series of its own (group and column None)."""

    name: str
    series: DataFrame
    group: str | None = None


class Workspace:
    """The channels that expressions may name."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.channels: dict[str, Channel] = {}
        self.groups: dict[str, DataFrame] = {}
        self.attached: dict[str, list[str]] = {}

    def add_series(self, name: str, series: DataFrame) -> None:
        """A series (series, idx, t, v, valid)."""
        self.channels[name] = Channel(name, series.withColumn("series", F.lit("s")))

    def add_group(self, name: str, table: DataFrame, time: str) -> None:
        """A wide table (idx, time, channels and their __valid columns): every channel becomes a name."""
        self.groups[name] = table
        for c in table.columns:
            if c in ("idx", time) or c.endswith("__valid"):
                continue
            valid = F.col(f"`{c}__valid`") if f"{c}__valid" in table.columns else F.lit(True)
            self.channels[c] = Channel(c, table.select(F.lit("s").alias("series"), "idx", F.col(f"`{time}`").cast("double").alias("t"), F.col(f"`{c}`").alias("v"), valid.alias("valid")), f"{name}\0{time}")

    def attach(self, label: str, frames: DataFrame, db: Database) -> list[str]:
        """Decoded signals as channels named message.signal; ``detach`` takes them away again."""
        decoded = bus.decode_frames(frames, db)
        names = []
        for m in db.messages:
            for s in m.signals:
                name = f"{m.name}.{s.name}"
                mine = decoded.where((F.col("message") == m.name) & (F.col("signal") == s.name))
                self.add_series(name, mine.select(F.lit("s").alias("series"), "idx", "t", "v", F.lit(True).alias("valid")))
                names.append(name)
        self.attached[label] = names
        return names

    def detach(self, label: str) -> None:
        for name in self.attached.pop(label, []):
            self.channels.pop(name, None)

    def define(self, name: str, text: str, web: bool = False) -> DataFrame:
        """Adds a computed channel; a name that is taken, or unknown references, are errors."""
        if name in self.channels:
            raise StructureError(f"{name} is a channel already")
        out = self.evaluate(text, web)
        self.add_series(name, out)
        return out

    def remove(self, name: str) -> None:
        if self.channels.pop(name, None) is None:
            raise StructureError(f"no channel {name}")

    def evaluate(self, text: str, web: bool = False) -> DataFrame:
        """(series, idx, t, v, valid) of an expression; constants are two samples at 0 and 1."""
        dialect: Dialect = COMPUTED_WEB if web else COMPUTED
        found = algebra.references(names_in(text, dialect), list(self.channels))
        if not found:
            value = self.spark.range(1).select(compiled(text, {}, dialect).alias("v")).first()["v"]
            return algebra.constant(self.spark, value).select(F.lit("s").alias("series"), F.col("t").cast("long").alias("idx"), "t", "v", "valid")
        channels = {used: self.channels[real] for used, real in found.items()}
        one = {c.group for c in channels.values()}
        if len(one) == 1 and None not in one:
            return self._projected(text, dialect, channels, one.pop())
        if not web and len({c.name for c in channels.values()}) == 1:
            return self._alone(text, dialect, channels)
        inputs = {f"c{i}": c.series.withColumn("v", F.col("v").cast("double")) for i, c in enumerate(channels.values())}
        columns = {used: f"c{i}" for i, used in enumerate(channels)}
        if web:
            got = algebra.computed_on_first(compiled(text, columns, dialect), inputs).withColumn("valid", F.lit(True))
        else:
            got = algebra.computed(compiled(text, columns, dialect), inputs)
            got = got.withColumn("idx", F.row_number().over(algebra.W.partitionBy(*KEY).orderBy("t")).cast("long") - 1)
        return got.select("series", "idx", "t", "v", "valid")

    def _alone(self, text: str, dialect: Dialect, channels: dict[str, Channel]) -> DataFrame:
        """An expression over one series stays on its samples: those that share a stamp all count."""
        series = next(iter(channels.values())).series.withColumn("_x", F.col("v").cast("double"))
        v = compiled(text, dict.fromkeys(channels, "_x"), dialect)
        valid = F.coalesce("valid", F.lit(True)) & ~F.isnan("_x")
        got = series.select("series", F.row_number().over(algebra.W.partitionBy(*KEY).orderBy("t", "idx")).cast("long").alias("at"), "t", v.alias("v"), valid.alias("_ok"))
        return got.select("series", (F.col("at") - 1).alias("idx"), "t", "v", (F.col("_ok") & ~F.isnan("v")).alias("valid"))

    def _projected(self, text: str, dialect: Dialect, channels: dict[str, Channel], group: str) -> DataFrame:
        name, time = group.split("\0")
        table, valid = self.groups[name], F.lit(True)
        for c in channels.values():
            if f"{c.name}__valid" in table.columns:
                valid = valid & F.col(f"`{c.name}__valid`")
            valid = valid & ~F.isnan(F.col(f"`{c.name}`").cast("double"))
        table = table.withColumns({f"_x{i}": F.col(f"`{c.name}`").cast("double") for i, c in enumerate(channels.values())})
        v = compiled(text, {used: f"_x{i}" for i, used in enumerate(channels)}, dialect)
        return table.select(F.lit("s").alias("series"), "idx", F.col(f"`{time}`").cast("double").alias("t"), v.alias("v"), valid.alias("_ok")).select("series", "idx", "t", "v", (F.col("_ok") & ~F.isnan("v")).alias("valid"))
