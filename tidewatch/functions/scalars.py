"""Scalar expressions. All are built from native functions, so they stay inside generated code."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: Crockford base-32 digits (no I, L, O, U).
ULID_DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"

EARTH_RADIUS_KM = 6371.0


def key_material(key: str) -> bytes:
    """64 hex digits stand for 32 bytes; any other text is hashed down to 32 bytes."""
    if len(key) == 64 and all(c in "0123456789abcdefABCDEF" for c in key):
        return bytes.fromhex(key)
    return hashlib.sha256(key.encode("utf-8")).digest()


def hmac_pads(key: str) -> tuple[bytes, bytes]:
    """Inner and outer pad of HMAC-SHA256 (block of 64 bytes)."""
    block = key_material(key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac_sha256(value: Column, key: str) -> Column:
    """Hex HMAC-SHA256 of a value; null counts as the empty string."""
    inner_pad, outer_pad = hmac_pads(key)
    message = F.encode(F.coalesce(value.cast("string"), F.lit("")), "UTF-8")
    inner = F.unhex(F.sha2(F.concat(F.lit(inner_pad), message), 256))
    return F.sha2(F.concat(F.lit(outer_pad), inner), 256)


def ulid(ts_ms: Column, *row_key: Column) -> Column:
    """Time-ordered 26-character id: 10 digits of event time, 16 digits of a hash of the row key.

    The same row always gets the same id, whatever the partitioning and however often a task is retried.
    """

    def digits(number: Column, width: int) -> Column:
        return F.lpad(F.conv(number.cast("string"), 10, 32), width, "0")

    parts = [F.coalesce(part.cast("string"), F.lit("\\N")) for part in row_key]
    hashed = F.md5(F.concat_ws("|", *parts))
    halves = [F.conv(F.substring(hashed, at, 10), 16, 10) for at in (1, 11)]  # 40 bits each
    text = F.concat(digits(ts_ms.cast("long"), 10), *[digits(h, 8) for h in halves])
    # conv counts on from A to V; the letters of an id leave out four of them
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUV", ULID_DIGITS[10:])


def to_cents(amount: Column) -> Column:
    """Money to integer minor units, half to even on the double (``round`` would go half up)."""
    return F.rint(amount.cast("double") * F.lit(100.0)).cast("long")


def number_or_null(text: Column) -> Column:
    """Lenient numeric parse: what is not a number becomes null."""
    return text.try_cast("double")


def number_or_zero(text: Column) -> Column:
    """Lenient numeric parse for stored feature values: missing or unparsable becomes 0."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def nan_to_null(number: Column) -> Column:
    return F.when(~F.isnan(number), number)


def text_or_blank(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def device_text(*parts: Column) -> Column:
    """Parts joined by ``|``; a missing part stays as an empty one."""
    return F.concat_ws("|", *[text_or_blank(p) for p in parts])


def enum_map(value: Column, mapping: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(value, F.lit(""))), F.lit(default))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low)))


def seconds_2(milliseconds: Column) -> Column:
    """Milliseconds as seconds with two decimals, rounded as the binary value demands.

    Only ...5 ms can be a tie. ``format_number`` looks at the exact double there; ``round`` would go half up.
    """
    seconds = milliseconds / F.lit(1000.0)
    return F.when(F.pmod(milliseconds, F.lit(10)) == 5, round_2(seconds)).otherwise(F.round(seconds, 2))


def round_2(number: Column) -> Column:
    """Two decimals, rounded as the binary value demands (dearer than ``round``, which looks at the decimal text)."""
    return F.call_function("format_number", number, F.lit("0.00")).cast("double")


def money_text(amount_minor: Column) -> Column:
    """``$1,234.50``"""
    return F.concat(F.lit("$"), F.format_number(amount_minor / F.lit(100.0), 2))


def clock_text(ts_ms: Column) -> Column:
    """``HH:mm:ss`` of an epoch-millisecond instant, in UTC whatever the session time zone."""
    second = F.pmod(F.floor(ts_ms / F.lit(1000)), F.lit(86400))
    return F.concat_ws(
        ":",
        *[
            F.lpad(F.floor(F.pmod(second / F.lit(unit), F.lit(size))).cast("string"), 2, "0")
            for unit, size in ((3600, 24), (60, 60), (1, 60))
        ],
    )


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if any coordinate is."""
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(half_dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_dlon), 2)
    # least() skips nulls, so the check for them comes first
    return F.when(h.isNotNull(), F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.sqrt(h), F.lit(1.0))))


def hash_unit(*parts: Column) -> Column:
    """A repeatable draw from [0, 1) out of the given columns, independent of partitioning."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def hash_normal(*parts: Column) -> Column:
    """A repeatable standard normal draw (Box-Muller on two hashed uniforms)."""
    u = F.lit(1.0) - hash_unit(F.lit("u"), *parts)
    v = hash_unit(F.lit("v"), *parts)
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2 * math.pi) * v)
