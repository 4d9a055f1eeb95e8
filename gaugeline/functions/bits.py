"""Bit fields of byte strings, as columns.

A field's bytes are read into one or two longs by ``conv`` of their hexadecimal digits; shifts and masks
do the rest inside code generation. Fields of 64 bits come as decimals where they are unsigned.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_MASK = 0x1FFFFFFF


def _byte(data: Column, at: int) -> Column:
    """Byte ``at`` (from 0) as a long; null beyond the end."""
    one = F.substring(data, at + 1, 1)
    return F.when(F.octet_length(data) > at, F.conv(F.hex(one), 16, 10).cast("bigint"))


def _assembled(data: Column, order: list[int]) -> Column:
    """The bytes at the places of ``order``, most significant first, as an unsigned decimal or a long."""
    digits = F.concat(*[F.hex(F.substring(data, i + 1, 1)) for i in order])
    return F.conv(digits, 16, 10)


def unsigned_field(data: Column, start_bit: int, size: int, big_endian: bool = False) -> Column:
    """The raw field as decimal(20,0); null where it does not fit the data or has no 1 to 64 bits.

    Little-endian: ``start_bit`` is the least significant bit, bits counted from the first byte's lowest.
    Big-endian: it is the most significant bit.
    """
    none = F.lit(None).cast("decimal(20,0)")
    if not 1 <= size <= 64 or start_bit < 0:
        return none
    if big_endian:
        first = (start_bit // 8) * 8 + 7 - start_bit % 8  # distance of the top bit from the first byte's top
        last_bit = first + size - 1
        first_byte, last_byte = first // 8, last_bit // 8
        order = list(range(first_byte, last_byte + 1))
        shift = 7 - last_bit % 8
    else:
        first_byte, last_byte = start_bit // 8, (start_bit + size - 1) // 8
        order = list(range(last_byte, first_byte - 1, -1))
        shift = start_bit % 8
    fits = F.octet_length(data) > last_byte
    if len(order) <= 7 or len(order) == 8 and size + shift <= 63:
        raw = F.conv(F.concat(*[F.hex(F.substring(data, i + 1, 1)) for i in order]), 16, 10).cast("decimal(20,0)").cast("bigint") if len(order) <= 7 else None
        if raw is None:
            raw = _two_halves(data, order)
            value = F.shiftrightunsigned(raw, shift).bitwiseAND(F.lit((1 << size) - 1)).cast("decimal(20,0)")
        else:
            value = F.shiftright(raw, shift).bitwiseAND(F.lit((1 << size) - 1)).cast("decimal(20,0)")
        return F.when(fits, value)
    # up to nine bytes: the value is split at 32 bits and put together as a decimal
    low_bytes = order[-5:]
    low = F.shiftright(_long(data, low_bytes), shift).bitwiseAND(F.lit(0xFFFFFFFF))
    rest = size - 32
    bits_before = 40 - shift - 32  # bits of the five low bytes that are above the low half
    high_low = F.shiftright(_long(data, low_bytes), shift + 32)
    high = high_low + F.shiftleft(_long(data, order[:-5]), bits_before) if order[:-5] else high_low
    high = high.bitwiseAND(F.lit((1 << rest) - 1))
    return F.when(fits, high.cast("decimal(20,0)") * F.lit(4294967296).cast("decimal(20,0)") + low.cast("decimal(20,0)")).cast("decimal(20,0)")


def _long(data: Column, order: list[int]) -> Column:
    return F.conv(F.concat(*[F.hex(F.substring(data, i + 1, 1)) for i in order]), 16, 10).cast("bigint")


def _two_halves(data: Column, order: list[int]) -> Column:
    """Eight bytes as the bits of a long."""
    return F.shiftleft(_long(data, order[:4]), 32).bitwiseOR(_long(data, order[4:]))


def signed(raw: Column, size: int) -> Column:
    """Two's complement of a raw field of ``size`` bits, as a long."""
    if size >= 64:
        big = raw.cast("decimal(20,0)")
        return F.when(big >= F.lit("9223372036854775808").cast("decimal(20,0)"), big - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(big).cast("bigint")
    n = raw.cast("bigint")
    return F.shiftright(F.shiftleft(n, 64 - size), 64 - size)


def scaled(raw: Column, factor: float, offset: float) -> Column:
    return raw.cast("double") * F.lit(float(factor)) + F.lit(float(offset))


def masked_id(can_id: Column) -> Column:
    return can_id.bitwiseAND(F.lit(ID_MASK))


def pgn(can_id: Column) -> Column:
    """The J1939 parameter group: a PDU format below 240 drops its destination byte."""
    raw = F.shiftright(masked_id(can_id.cast("bigint")), 8)
    page = raw.bitwiseAND(F.lit(0x3FFFF))
    return F.when(F.shiftright(page, 8).bitwiseAND(F.lit(0xFF)) < 240, page.bitwiseAND(F.lit(0x3FF00))).otherwise(page)


def source_address(can_id: Column) -> Column:
    return can_id.bitwiseAND(F.lit(0xFF))


def trimmed(data: Column, length: Column) -> Column:
    """The first ``length`` bytes of a payload, or all of it."""
    return F.when(length >= F.octet_length(data), data).otherwise(F.substring(data, F.lit(1), F.greatest(length, F.lit(0)).cast("int")))
