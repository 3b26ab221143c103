"""Identities and buckets from hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\u0000"


def content_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256))


def stable_id(prefix: str, length: int, *parts: Column) -> Column:
    """``prefix`` and the first hexadecimal digits of the parts' hash, joined by NUL; null parts are empty."""
    whole = F.concat_ws(NUL, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(whole.cast("binary"), 256), 1, length))


def first_uint32(c: Column) -> Column:
    return F.conv(F.substring(F.sha2(c.cast("binary"), 256), 1, 8), 16, 10).cast("long")


def rollout_percent(c: Column) -> Column:
    """A stable place from 0 to 100 for a key."""
    return first_uint32(c) / F.lit(4294967296.0) * 100


def in_rollout(c: Column, percent: float) -> Column:
    return F.when(F.lit(percent) >= 100, True).when(F.lit(percent) <= 0, False).otherwise(rollout_percent(c) < percent)


def answer_digest(c: Column) -> Column:
    """URL-safe base64 of the text's hash, without padding."""
    return F.rtrim(F.translate(F.base64(F.unhex(F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256))), "+/", "-_"), F.lit("="))


def hmac_sha256(key: Column, message: Column) -> Column:
    """Hexadecimal HMAC of a message, from the built-in hash: keys of at most 64 bytes (longer ones are hashed first)."""
    raw = F.when(F.octet_length(key) > 64, F.unhex(F.sha2(key.cast("binary"), 256))).otherwise(key.cast("binary"))
    padded = F.rpad(F.hex(raw), 128, "0")
    byte = lambda mask: F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex(F.conv(F.substring(padded, i * 2 + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(F.lit(mask))), 2, "0")), ""))
    inner = F.unhex(F.sha2(F.concat(byte(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(byte(0x5C), inner), 256)
