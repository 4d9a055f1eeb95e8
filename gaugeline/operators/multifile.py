"""Several recordings as one: concatenation behind each other, and stacking side by side."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeline.operators.series import KEY, StructureError

SINGLE_STEP = 0.001


def offsets(starts_ns: Sequence[int], absolute: bool = True) -> dict[int, float]:
    """Seconds from the earliest start to each file's, by file index; none moves back before zero."""
    first = min(starts_ns, default=0)
    return {i: max(0.0, (s - first) / 1e9) if absolute else 0.0 for i, s in enumerate(starts_ns)}


def compare_offset(start_a: int, start_b: int, absolute: bool) -> float:
    """Seconds that the second file's axis moves against the first one's; absolute needs both starts."""
    if not absolute:
        return 0.0
    if not start_a or not start_b:
        raise StructureError("an absolute comparison needs the start time of both files")
    return (start_b - start_a) / 1e9


def check_structure(catalogs: Sequence[Sequence[Sequence[str]]]) -> None:
    """The files' groups of channel names: as many groups, and the same names in each, in any order."""
    first = catalogs[0]
    for i, other in enumerate(catalogs[1:], 1):
        if len(other) != len(first):
            raise StructureError(f"file {i} has {len(other)} groups, the first has {len(first)}")
        for g, (a, b) in enumerate(zip(first, other, strict=True)):
            if Counter(a) != Counter(b):
                raise StructureError(f"group {g} of file {i} has other channels: {sorted((Counter(a) - Counter(b)) + (Counter(b) - Counter(a)))}")


def shifts(df: DataFrame, by_file: dict[int, float], keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, file_index, shift): a file starts where its header says, but not before its predecessor's
    last sample: then one step of its own later.

    The carry from file to file is folded over each key's files, one small row a file.
    """
    order = F.struct("idx", "t")
    per = df.groupBy(*keys, "file_index").agg(F.min(order)["t"].alias("a"), F.min(F.when(F.col("idx") > 0, order))["t"].alias("b"), F.max("t").alias("z"))
    starts = F.create_map(*[F.lit(x) for i, s in by_file.items() for x in (i, float(s))])
    per = per.withColumn("s", F.coalesce(F.element_at(starts, F.col("file_index")), F.lit(0.0)))
    files = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("file_index", "a", "b", "z", "s"))).alias("fs"))
    step = lambda f: F.coalesce(f["b"] - f["a"], F.lit(SINGLE_STEP))

    def carry(acc, f):
        clear = acc["end"].isNull() | (f["a"] + f["s"] > acc["end"])
        shift = F.when(clear, f["s"]).otherwise(acc["end"] + step(f) - f["a"])
        return F.struct((f["z"] + shift).alias("end"), F.array_append(acc["out"], F.struct(f["file_index"].alias("file_index"), shift.alias("shift"))).alias("out"))

    empty = F.struct(F.lit(None).cast("double").alias("end"), F.array().cast("array<struct<file_index:int,shift:double>>").alias("out"))
    return files.select(*keys, F.explode(F.aggregate("fs", empty, carry, lambda acc: acc["out"])).alias("x")).select(*keys, "x.file_index", "x.shift")


def concatenate(df: DataFrame, by_file: dict[int, float] | None = None, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, idx, t, v, valid) of series that carry ``file_index``; a missing validity means all valid."""
    moved = df.join(shifts(df, by_file or {}, keys), [*keys, "file_index"])
    w = W.partitionBy(*keys).orderBy("file_index", "idx")
    valid = F.coalesce("valid", F.lit(True)) if "valid" in df.columns else F.lit(True)
    return moved.select(*keys, (F.row_number().over(w) - 1).cast("long").alias("idx"), (F.col("t") + F.col("shift")).alias("t"), "v", valid.alias("valid"))


def stack(df: DataFrame, by_file: dict[int, float] | None = None) -> DataFrame:
    """The series of all files side by side, each moved to its start; nothing is merged."""
    if not by_file:
        return df
    starts = F.create_map(*[F.lit(x) for i, s in by_file.items() for x in (i, float(s))])
    return df.withColumn("t", F.col("t") + F.coalesce(F.element_at(starts, F.col("file_index")), F.lit(0.0)))


def batch(spark, paths: Sequence[str], operation) -> DataFrame:
    """(path, ok, detail) of an operation on every file; a failure is an outcome, not the end."""
    rows = []
    for p in paths:
        try:
            rows.append((p, True, str(operation(p) or "")))
        except Exception as e:  # noqa: BLE001 - every failure becomes an outcome
            rows.append((p, False, f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(rows, "path string, ok boolean, detail string")
