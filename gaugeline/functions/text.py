"""Text and time: decoding, rendering, and the calendar records of CANopen."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days from 1970-01-01 to 1984-01-01, where CANopen times begin.
CANOPEN_DAYS = 5_113
NANOS = 1_000_000_000


def decoded(data: Column, charset: str) -> Column:
    """Bytes as text up to the first NUL; charsets latin-1, utf-8, utf-16-le, utf-16-be."""
    name = {"latin-1": "ISO-8859-1", "utf-8": "UTF-8", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE"}[charset]
    text = F.try_to_binary(F.hex(data), F.lit("hex"))
    return F.substring_index(F.decode(text, name), "\0", 1)


def headed(name: str, unit: str | None) -> str:
    return f"{name} [{unit}]" if unit else name


def csv_cell(x: Column) -> Column:
    """A cell with quotes where commas, quotes or line ends ask for them."""
    return F.when(x.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def parsed_id(x: Column) -> Column:
    """0x... or decimal text as a number, else null."""
    s = F.trim(x)
    hexed = F.when(F.lower(s).rlike("^0x[0-9a-f]+$"), F.conv(F.substring(s, 3, 40), 16, 10).cast("bigint"))
    return F.coalesce(hexed, s.try_cast("bigint"))


def displayed(x: Column) -> Column:
    """About six significant digits."""
    size = F.floor(F.log10(F.abs(x)))
    step = F.pow(F.lit(10.0), size - 5)
    return F.when(x == 0, "0").when(x.isNull() | F.isnan(x), "—").otherwise(F.regexp_replace((F.round(x / step) * step).cast("string"), r"\.0$", ""))


def iso_time(ns: Column) -> Column:
    """Nanoseconds since 1970 as ISO 8601 in UTC."""
    whole = F.date_format(F.timestamp_micros(F.floor(ns / NANOS).cast("bigint") * 1_000_000), "yyyy-MM-dd'T'HH:mm:ss")
    rest = F.lpad(F.pmod(ns, F.lit(NANOS)).cast("string"), 9, "0")
    return F.concat(whole, F.when(F.pmod(ns, F.lit(NANOS)) == 0, "").otherwise(F.concat(F.lit("."), F.regexp_replace(rest, "0+$", ""))), F.lit("Z"))


def unix_seconds(ns: Column) -> Column:
    """Nanoseconds since 1970 as seconds."""
    return ns.cast("double") / float(NANOS)


def absolute_seconds(relative: Column, start_ns: Column) -> Column:
    """Seconds since 1970 of a stamp that counts from the recording's start."""
    return unix_seconds(start_ns) + relative


def utc_offset_minutes(zone: Column, summer: Column) -> Column:
    """The whole offset from UTC: that of the zone and that of summer time."""
    return zone + summer


def absolute_label(ms: Column) -> Column:
    """Milliseconds since 1970 as YYYY-MM-DD HH:MM:SS.mmm in UTC, by calendar arithmetic."""
    day = F.floor(ms / 86_400_000)
    left = F.pmod(ms, F.lit(86_400_000))
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")), "yyyy-MM-dd")
    two = lambda x: F.lpad(x.cast("bigint").cast("string"), 2, "0")
    return F.concat(date, F.lit(" "), two(F.floor(left / 3_600_000)), F.lit(":"), two(F.floor(left / 60_000) % 60), F.lit(":"), two(F.floor(left / 1000) % 60), F.lit("."), F.lpad((left % 1000).cast("string"), 3, "0"))


def canopen_date_nanos(year: Column, month: Column, day: Column, hour: Column, minute: Column, ms: Column) -> Column:
    """A calendar record in nanoseconds since 1970."""
    days = F.unix_date(F.make_date(year, month, day)).cast("bigint")
    return ((days * 86_400 + hour * 3_600 + minute * 60) * 1_000 + ms) * 1_000_000


def canopen_time_nanos(ms: Column, days: Column) -> Column:
    return ((days.cast("bigint") + CANOPEN_DAYS) * 86_400_000 + ms) * 1_000_000


def sample_json(t: Column, v: Column) -> Column:
    """{"t":..., "v":...} with null for what is no finite number."""
    sane = F.when(v.cast("double").isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")), v)
    return F.to_json(F.struct(t.alias("t"), sane.alias("v")), {"ignoreNullFields": "false"})


def metadata_map(xml: str) -> dict[str, str]:
    """Paths and texts of a comment's XML; repeated names are numbered from the second on."""
    out: dict[str, str] = {}
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return {"": xml}

    def walk(e: ET.Element, path: str) -> None:
        text = (e.text or "").strip()
        name = e.attrib.get("name")
        here = f"{path}/{name}" if name else path
        if text:
            key, n = here, 2
            while key in out:
                key, n = f"{here}#{n}", n + 1
            out[key] = text
        for child in e:
            walk(child, f"{here}/{child.tag.rpartition('}')[2]}")

    walk(root, root.tag.rpartition("}")[2])
    return out


def comment_text(xml: str) -> str:
    """The TX part of a comment, or the text itself."""
    if not xml.lstrip().startswith("<"):
        return xml
    found = metadata_map(xml)
    return next((v for k, v in found.items() if k.endswith("/TX")), "")
