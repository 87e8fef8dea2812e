"""Bytes, ids, bit fields, clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fix_utf8_truncation(raw: Column, max_len: int) -> Column:
    """Text of a byte string that may have been cut inside its last character.

    Valid text stays. Invalid text of exactly ``max_len`` bytes loses a partial last character whose
    first byte is one of the last two bytes; what is left must be valid. NULL otherwise.
    """
    def at(position: int) -> Column:  # 1-based byte as a number
        return F.conv(F.hex(F.substring(raw, position, 1)), 16, 10).cast("int")

    def starts_character(position: int) -> Column:
        return at(position).bitwiseAND(0xC0) != 0x80

    def cut(length: int) -> Column:
        head = F.substring(raw, 1, length)
        return F.when(F.is_valid_utf8(head.cast("string")), head.cast("string"))

    shortened = F.when(starts_character(max_len), cut(max_len - 1))
    if max_len > 1:
        shortened = shortened.when(starts_character(max_len - 1), cut(max_len - 2))
    return (F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
            .when(F.octet_length(raw) == max_len, shortened))


def hex_id(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def id_bytes(text: Column) -> Column:
    return F.unhex(text)


def trim_nul(text: Column) -> Column:
    return F.substring_index(text, "\0", 1)


def build_id_or_hash(build_id: Column, file_id: Column) -> Column:
    """``(build_id, build_id_type)``: the linker's id, else the hash of the file."""
    has_id = F.coalesce(build_id, F.lit("")) != ""
    return F.struct(
        F.when(has_id, build_id).otherwise(file_id).alias("build_id"),
        F.when(has_id, F.lit("gnu")).otherwise(F.lit("hash")).alias("build_id_type"))


def probe_cookie(spec_id: Column, main_thread_only: Column, min_duration_ms: Column) -> Column:
    low = F.shiftleft(min_duration_ms.cast("long").bitwiseAND(0x7FFFFFFF), 1).bitwiseOR(main_thread_only.cast("long"))
    return F.shiftleft(spec_id.cast("long"), 32).bitwiseOR(low)


def unpack_probe_cookie(cookie: Column) -> Column:
    return F.struct(
        F.shiftrightunsigned(cookie, 32).alias("spec_id"),
        (cookie.bitwiseAND(1) == 1).alias("main_thread_only"),
        F.shiftrightunsigned(cookie, 1).bitwiseAND(0x7FFFFFFF).alias("min_duration_ms"))


def metric_name(field: Column) -> Column:
    return F.replace(field, F.lit("."), F.lit("_"))


def next_power_of_two(value: Column) -> Column:
    number = value.cast("long")
    return F.when(number <= 1, F.lit(1).cast("long")).otherwise(
        F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(number - 1))))


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts)


def ns_to_ts(ts_ns: Column) -> Column:
    return F.timestamp_micros(floor_div(ts_ns, 1000))


def floor_div(value: Column, divisor: int) -> Column:
    """Integer division that rounds down, also below zero."""
    number = value.cast("long")
    rest = F.pmod(number, F.lit(divisor).cast("long"))
    return F.call_function("div", number - rest, F.lit(divisor).cast("long"))


def int_div(value: Column, divisor: Column | int) -> Column:
    """Integer division towards zero; NULL for a zero divisor."""
    by = F.lit(divisor) if isinstance(divisor, int) else divisor
    return F.call_function("div", value, F.nullif(by, F.lit(0)))


def wrapping_minus(left: Column, right: Column) -> Column:
    """64-bit difference that wraps instead of failing."""
    wide = left.cast("decimal(20,0)") - right.cast("decimal(20,0)")
    span = F.lit(str(2**64)).cast("decimal(20,0)")
    top, bottom = F.lit(2**63 - 1), F.lit(str(-(2**63))).cast("decimal(20,0)")
    return (F.when(wide > top, wide - span).when(wide < bottom, wide + span).otherwise(wide)).cast("long")


def content_id(parts: list[Column]) -> Column:
    """128-bit content hash (32 hex digits) of several values.

    Each value carries its length, so different value lists never give the same text.
    """
    pieces = []
    for part in parts:
        text = part.cast("string")
        pieces.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.md5(F.concat_ws(",", *pieces))
