"""Bus frames of recordings: the groups that hold them, and tables of their fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.functions import bits
from gaugeline.sources.mdf4 import Group, Mdf4, MdfError, read_group

PREFIXES = {"can": "CAN_DataFrame", "lin": "LIN_Frame", "eth": "ETH_Frame", "flexray": "FLX_Frame"}


def frame_groups(f: Mdf4, bus: str) -> list[Group]:
    """The groups that hold a bus's frames: with an id (Ethernet: a type) and data bytes."""
    prefix = PREFIXES[bus]
    needed = {f"{prefix}.{'EtherType' if bus == 'eth' else 'ID'}", f"{prefix}.DataBytes"}
    return [g for g in f.groups if needed <= {c.name for c in g.channels}]


def frames(spark: SparkSession, path: str, bus: str) -> DataFrame:
    """(grp, idx, t, id, bus, data, ...) of all frames of a bus; absent fields are null, an unrecorded bus 0."""
    f = Mdf4.open(path)
    prefix, out = PREFIXES[bus], None
    for n, g in enumerate(frame_groups(f, bus)):
        have = {c.name for c in g.channels}
        df = read_group(spark, path, g.dg, g.cg, raw=True)
        get = lambda name, kind, have=have: F.col(f"`{prefix}.{name}`").cast(kind) if f"{prefix}.{name}" in have else F.lit(None).cast(kind)
        axis = F.col(f"`{g.master.name}`").cast("double") if g.master else F.col("idx").cast("double")
        length = F.coalesce(get("DataLength", "long"), F.octet_length(F.col(f"`{prefix}.DataBytes`")).cast("long"))
        base = [F.lit(n).alias("grp"), F.col("idx"), axis.alias("t"), F.coalesce(get("BusChannel", "int"), F.lit(0)).alias("bus"), bits.trimmed(F.col(f"`{prefix}.DataBytes`"), length).alias("data")]
        flag = lambda name: get(name, "long") != 0
        if bus == "can":
            more = [bits.masked_id(get("ID", "long")).alias("id"), flag("IDE").alias("extended")]
        elif bus == "lin":
            more = [get("ID", "long").bitwiseAND(F.lit(0x3F)).alias("id"), F.lit(False).alias("extended")]
        elif bus == "eth":
            more = [get("Source", "binary").alias("src"), get("Destination", "binary").alias("dst"), get("EtherType", "int").alias("ether_type")]
        else:
            more = [
                get("ID", "int").bitwiseAND(F.lit(0x7FF)).alias("frame_id"), get("CycleCount", "int").bitwiseAND(F.lit(0x3F)).alias("cycle"),
                flag("NullFrameFlag").alias("null_frame"), flag("SyncFrameFlag").alias("sync_frame"), flag("StartupFrameFlag").alias("startup"),
            ]
        part = df.select(*base, *more)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise MdfError(f"the file holds no {bus} frames")
    return out
