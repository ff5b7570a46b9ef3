"""Numeric, hash and redaction scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054
#: Markers of a name that holds a secret (fixed values).
SECRET_MARKERS = ("SECRET", "TOKEN", "PASSWORD", "PASSWD", "API_KEY", "APIKEY", "PRIVATE", "CREDENTIAL", "AUTH")


def hmac16(value: Column, key: str) -> Column:
    """First 16 hex digits of HMAC-SHA256 in the JVM; the key must not be empty."""
    import hashlib

    if not key:
        raise ValueError("a key is needed")
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)
    first = F.sha2(F.concat(F.lit(inner), F.encode(value, "utf-8")), 256)
    return F.substring(F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256), 1, 16)


def wilson(successes: Column, trials: Column) -> Column:
    """struct(lo, hi): 95 % Wilson interval to 4 decimals; (0, 1) without trials, null where successes are out of range."""
    n, s = trials.cast("double"), successes.cast("double")
    p = s / n
    d = 1 + Z95 * Z95 / n
    mid = (p + Z95 * Z95 / (2 * n)) / d
    half = Z95 * F.sqrt(p * (1 - p) / n + Z95 * Z95 / (4 * n * n)) / d
    lo, hi = F.round(F.greatest(F.lit(0.0), mid - half), 4), F.round(F.least(F.lit(1.0), mid + half), 4)
    return F.when((s < 0) | (s > n), None).otherwise(F.struct(F.when(n == 0, 0.0).otherwise(lo).alias("lo"), F.when(n == 0, 1.0).otherwise(hi).alias("hi")))


def entropy_bits(text: Column) -> Column:
    """Shannon entropy per character; 0 for empty text."""
    chars = F.split(text, "")
    n = F.length(text).cast("double")
    kinds = F.array_distinct(chars)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.when(F.length(text) == 0, 0.0).otherwise(F.aggregate(kinds, F.lit(0.0), lambda acc, c: acc - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c)))))


def high_entropy(text: Column, least: int = 20, bits: float = 4.0) -> Column:
    return F.coalesce((F.length(text) >= least) & ~text.contains(" ") & (entropy_bits(text) >= bits), F.lit(False))


def is_secret_name(name: Column) -> Column:
    return F.coalesce(F.upper(name).rlike("|".join(SECRET_MARKERS)), F.lit(False))


def value_class(name: Column, value: Column) -> Column:
    """What may be kept of a configured value: opaque, secret, url, boolean, number, hostname or enum."""
    v = F.trim(value)
    return (
        F.when(v.isNull() | (v == ""), "opaque")
        .when(is_secret_name(name), "secret")
        .when(v.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), "url")
        .when(high_entropy(v), "secret")
        .when(F.lower(v).isin("true", "false", "yes", "no", "on", "off"), "boolean")
        .when(v.rlike(r"^-?\d+(\.\d+)?$"), "number")
        .when(v.rlike(r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+(:\d+)?$"), "hostname")
        .when(v.rlike(r"^[A-Za-z][A-Za-z0-9_-]{0,31}$"), "enum")
        .otherwise("opaque")
    )


def chain_discount(confidence: Column, hops: Column) -> Column:
    return F.when(hops > 1, F.round(F.pow(confidence, hops), 4)).otherwise(confidence)


def noisy_or(confidences: Column, cap: float = 0.99) -> Column:
    """min(cap, 1 - product(1 - c)) of an array."""
    return F.least(F.lit(cap), 1 - F.aggregate(confidences, F.lit(1.0), lambda acc, c: acc * (1 - c)))


def path_confidence(points: Column) -> Column:
    """struct(product, weakest) over the confidences of a path, to 4 decimals; zeros for an empty path."""
    return F.struct(
        F.when(F.size(points) == 0, 0.0).otherwise(F.round(F.aggregate(points, F.lit(1.0), lambda a, c: a * c), 4)).alias("product"), F.when(F.size(points) == 0, 0.0).otherwise(F.round(F.array_min(points), 4)).alias("weakest")
    )
