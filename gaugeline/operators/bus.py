"""Bus frames: matching identifiers, decoding signals, filtering.

``decode_frames`` is one pass over the frames without a shuffle: the database goes to the executors and
an Arrow batch is decoded message by message in numpy. ``matched`` and ``value_labels`` are the same
lookups as joins with the database's tables, for plans that stay in SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions import bits
from gaugeline.sources.database import Database, MessageDef, SignalDef, selected

SIGNALS = "bus int, message string, signal string, unit string, grp int, idx long, t double, v double, label string"


def matched(frames: DataFrame, messages: DataFrame, matching: str = "exact") -> DataFrame:
    """Frames with ``msg_idx`` and ``message``; those without a message are dropped.

    Messages are a database's (driver-built, hence small) table: the lookups are broadcast joins. Of
    messages with one id the last counts, of those with one group the first.
    """
    exact = messages.groupBy("id").agg(F.max("msg_idx").alias("_exact")).withColumnRenamed("id", "_id")
    out = frames.withColumn("_mid", bits.masked_id(F.col("id")))
    out = out.join(F.broadcast(exact), F.col("_mid") == F.col("_id"), "left").drop("_id")
    found = [F.col("_exact")]
    if matching == "pgn_source":
        by = messages.groupBy("pgn", "source").agg(F.min("msg_idx").alias("_src")).withColumnsRenamed({"pgn": "_p", "source": "_s"})
        out = out.join(F.broadcast(by), (bits.pgn(F.col("_mid")) == F.col("_p")) & (bits.source_address(F.col("_mid")) == F.col("_s")), "left").drop("_p", "_s")
        found.append(F.col("_src"))
    if matching != "exact":
        by = messages.groupBy("pgn").agg(F.min("msg_idx").alias("_pgn")).withColumnRenamed("pgn", "_p")
        out = out.join(F.broadcast(by), bits.pgn(F.col("_mid")) == F.col("_p"), "left").drop("_p")
        found.append(F.col("_pgn"))
    out = out.withColumn("msg_idx", F.coalesce(*found) if len(found) > 1 else found[0]).where("msg_idx IS NOT NULL")
    names = messages.select(F.col("msg_idx").alias("_m"), F.col("name").alias("message"))
    return out.join(F.broadcast(names), F.col("msg_idx") == F.col("_m")).drop("_m", "_mid", "_exact", "_src", "_pgn")


def value_labels(values: DataFrame, signals: DataFrame) -> DataFrame:
    """``label`` of (msg_idx, sig_idx, raw) rows from the signals' value tables; null where there is none."""
    tables = signals.select("msg_idx", "sig_idx", "labels")
    return values.join(F.broadcast(tables), ["msg_idx", "sig_idx"], "left").withColumn("label", F.try_element_at("labels", F.col("raw"))).drop("labels")


def _matrix(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in data])
    out = np.zeros((len(data), int(lengths.max(initial=0)) + 9), np.uint8)
    for i, x in enumerate(data):
        out[i, : len(x)] = np.frombuffer(x, np.uint8)
    return out, lengths


def _raw(m: np.ndarray, lengths: np.ndarray, s: SignalDef) -> tuple[np.ndarray, np.ndarray]:
    """(raw values, present) of a field in every payload."""
    zero = np.zeros(len(m), np.uint64)
    if not 1 <= s.size <= 64:
        return zero, np.zeros(len(m), bool)
    if s.big_endian:
        first = s.start_bit // 8 * 8 + 7 - s.start_bit % 8
        last = first + s.size - 1
        order, shift, end = range(last // 8, first // 8 - 1, -1), 7 - last % 8, last // 8
    else:
        end = (s.start_bit + s.size - 1) // 8
        order, shift = range(s.start_bit // 8, end + 1), s.start_bit % 8
    fits = lengths > end
    if not fits.any():
        return zero, fits
    value = zero.copy()
    for i, at in enumerate(order):
        b = m[:, at].astype(np.uint64)
        move = 8 * i - shift
        value |= b << np.uint64(move) if 0 <= move < 64 else b >> np.uint64(-move) if move < 0 else 0
    if s.size < 64:
        value &= np.uint64((1 << s.size) - 1)
    return value, fits


def _present(message: MessageDef, s: SignalDef, raws: dict) -> np.ndarray:
    """Where a signal is selected, for all payloads at once."""
    n = len(next(iter(raws.values()))[0])
    if s.mux.kind in ("none", "switch"):
        return np.ones(n, bool)
    above = next((x for x in message.signals if (x.mux.kind == "switch" if s.mux.kind == "selected" else x.name == s.mux.multiplexor)), None)
    if above is None:
        return np.zeros(n, bool)
    value, fits = raws[above.name]
    if s.mux.kind == "selected":
        hit = value == np.uint64(s.mux.value)
    else:
        hit = np.zeros(n, bool)
        for a, b in s.mux.ranges:
            hit |= (value >= np.uint64(a)) & (value <= np.uint64(b))
    return hit & fits & _present(message, above, raws)


def _values(raw: np.ndarray, s: SignalDef) -> tuple[np.ndarray, np.ndarray]:
    """(signed raw as the label's key, physical value)."""
    if s.signed:
        up = np.uint64(64 - s.size)
        n = ((raw << up).view(np.int64) >> np.int64(64 - s.size)) if s.size < 64 else raw.view(np.int64)
        return n, n.astype(np.float64) * s.factor + s.offset
    return raw, raw.astype(np.float64) * s.factor + s.offset


def decode_frames(frames: DataFrame, db: Database) -> DataFrame:
    """One row for each signal present in a frame: keyed by (bus, message, signal).

    Frames are (grp, idx, t, id, bus, data); grp and idx are kept so that arrival order stays known.
    """
    for m in db.messages:
        for s in m.signals:
            selected(m, s, lambda x: None)  # walks the chain once: a circle ends here, not on an executor
    columns = [F.col("id").cast("long").alias("id"), F.coalesce(F.col("bus").cast("int"), F.lit(0)).alias("bus"), F.col("t"), F.col("data")]
    columns += [(F.col(c) if c in frames.columns else F.lit(0)).cast(k).alias(c) for c, k in (("grp", "int"), ("idx", "long"))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, int] = {}
        for b in batches:
            b = b[b["data"].notna() & b["id"].notna()]
            ids = b["id"].to_numpy(np.int64)
            for i in np.unique(ids):
                if int(i) not in known:
                    found = db.find(int(i))
                    known[int(i)] = -1 if found is None else found
            which = np.array([known[int(i)] for i in ids], np.int64)
            for mi in np.unique(which[which >= 0]):
                part, message = b[which == mi], db.messages[mi]
                m, lengths = _matrix([bytes(x) for x in part["data"]])
                raws = {s.name: _raw(m, lengths, s) for s in message.signals}
                for s in message.signals:
                    raw, fits = _raw(m, lengths, s)
                    take = fits & _present(message, s, raws)
                    if not take.any():
                        continue
                    keys, values = _values(raw[take], s)
                    rows, labels = part[take], dict(s.labels)
                    yield pd.DataFrame({
                        "bus": rows["bus"], "message": message.name, "signal": s.name, "unit": s.unit, "grp": rows["grp"], "idx": rows["idx"], "t": rows["t"], "v": values,
                        "label": pd.Series([labels.get(int(k)) for k in keys] if labels else [None] * len(rows), dtype=object, index=rows.index),
                    })

    return frames.select(*columns).mapInPandas(run, SIGNALS)


def find_series(signals: DataFrame, name: str) -> DataFrame:
    """All series of a signal name, over buses and messages."""
    return signals.where(F.col("signal") == name)


def distinct_buses(frames: DataFrame) -> DataFrame:
    return frames.select("bus").distinct().orderBy("bus")


def parsed_id(text: str) -> int | None:
    """0x... or decimal, else None."""
    text = text.strip()
    try:
        return int(text[2:], 16) if text.lower().startswith("0x") else int(text)
    except ValueError:
        return None


def filter_frames(frames: DataFrame, query: str = "", bus: int | None = None, db: Database | None = None) -> DataFrame:
    """Frames of one bus whose id is the query, or whose message name holds it in any case."""
    out = frames if bus is None else frames.where(F.col("bus") == bus)
    query = query.strip()
    if not query:
        return out
    number = parsed_id(query)
    if number is not None:
        return out.where(F.col("id") == number)
    if db is None:
        return out.where(F.lit(False))
    names = [(m.id, m.name) for m in db.messages if query.lower() in m.name.lower()]
    hits = [i for i, _ in names]
    if db.matching == "exact":
        return out.where(bits.masked_id(F.col("id")).isin(hits)) if hits else out.where(F.lit(False))
    messages, _ = db.tables(out.sparkSession)
    return matched(out, messages, db.matching).where(F.lower("message").contains(query.lower())).select(*frames.columns)


def locate(frames: DataFrame, t: float) -> DataFrame:
    """The frame nearest to a stamp, the earlier on a tie."""
    return frames.orderBy(F.abs(F.col("t") - t), "t", *[c for c in ("grp", "idx") if c in frames.columns]).limit(1)


def hex_bytes(data) -> Column:
    """Upper-case bytes separated by spaces."""
    return F.trim(F.regexp_replace(F.hex(data), "(..)", "$1 "))


def mac_text(data) -> Column:
    return F.rtrim(F.lower(F.regexp_replace(F.hex(data), "(..)", "$1:")), F.lit(":"))
