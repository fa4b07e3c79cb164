"""Portable deterministic randomness.

``uniform(seed, k1, k2, ...)`` is a pure function of its arguments: it hashes
the text ``"seed:k1:k2"`` with MD5 and reads the first 13 hex digits (52 bits,
exact in a double) as a fraction of 2**52. It does not depend on partitioning,
task order or re-execution, so a lost executor recomputes the same value, and
DuckDB computes the identical number (``uniform_sql``), which makes seeded
operators checkable against an SQL oracle. Never use ``rand()`` for this.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = 4503599627370496.0


def _key(seed, parts) -> Column:
    cols = [F.lit(str(seed))] + [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(":", *cols)


def uniform(seed, *parts) -> Column:
    """Uniform in [0, 1) keyed by (seed, parts...)."""
    return F.conv(F.substring(F.md5(_key(seed, parts)), 1, 13), 16, 10).cast("bigint") / F.lit(TWO_52)


def normal(seed, *parts) -> Column:
    """Standard normal by Box-Muller from two portable uniforms."""
    u1 = uniform(seed, *parts, "a")
    u2 = uniform(seed, *parts, "b")
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def uniform_sql(seed, *parts: str) -> str:
    """DuckDB twin of ``uniform``; ``parts`` are SQL expressions."""
    key = " || ':' || ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"(('0x' || substr(md5({key}), 1, 13))::BIGINT / 4503599627370496.0)"


def normal_sql(seed, *parts: str) -> str:
    u1 = uniform_sql(seed, *parts, "'a'")
    u2 = uniform_sql(seed, *parts, "'b'")
    return f"(sqrt(-2.0 * ln(1.0 - {u1})) * cos({2.0 * math.pi!r} * {u2}))"


def rnd(col, digits: int) -> Column:
    """``r6`` at another precision, for large magnitudes (e.g. money sums at 2 digits)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c + F.lit(1e-9), int(digits)) + F.lit(0.0)


def rnd_sql(expr: str, digits: int) -> str:
    return f"(round(({expr}) + 1e-9, {int(digits)}) + 0.0)"


def r6(col) -> Column:
    """Round for cross-engine comparison: nudge by 1e-9, then 6 digits.

    Values with few decimals land exactly on a rounding tie, where two
    engines' last-ulp differences pick different sides; the nudge moves exact
    ties off the boundary the same way in both engines.
    """
    c = F.col(col) if isinstance(col, str) else col
    # "+ 0.0" turns a negative zero into a positive one
    return F.round(c + F.lit(1e-9), 6) + F.lit(0.0)


def r6_sql(expr: str) -> str:
    return f"(round(({expr}) + 1e-9, 6) + 0.0)"


# Integer-keyed portable uniform for per-element draws (one per token).
# 31-bit modulus and the multiplier of a public integer-hash finaliser.
_P31 = 1 << 31
_MIX_MULT = 0x45D9F3B


def _mix31(x: Column) -> Column:
    # x in [0, 2^31): xor-shift / multiply rounds; products stay below 2^58 (no overflow)
    def r(v):
        return v.bitwiseXOR(F.shiftright(v, 16))

    x = r(x)
    x = (x * F.lit(_MIX_MULT)) % F.lit(_P31)
    x = r(x)
    x = (x * F.lit(_MIX_MULT)) % F.lit(_P31)
    return r(x)


def uniform_int(seed: int, a: Column, b: Column) -> Column:
    """Uniform in [0, 1) from two non-negative integer keys (e.g. sequence id, position).

    About ten integer operations, evaluated inside whole-stage codegen — far
    cheaper than an MD5 per element — and bit-identical in DuckDB
    (``uniform_int_sql``). 31 bits of resolution.
    """
    a = a.cast("bigint")
    b = b.cast("bigint")
    h = _mix31(F.lit(int(seed) % _P31).cast("bigint"))
    h = _mix31(h.bitwiseXOR(a % F.lit(_P31)))
    h = _mix31(h.bitwiseXOR(F.shiftright(a, 31) % F.lit(_P31)))
    h = _mix31(h.bitwiseXOR(b % F.lit(_P31)))
    return h.cast("double") / F.lit(float(_P31))


def _mix31_sql(x: str) -> str:
    def r(v):
        return f"xor({v}, ({v}) >> 16)"

    x = r(x)
    x = f"((({x}) * {_MIX_MULT}) % {_P31})"
    x = r(x)
    x = f"((({x}) * {_MIX_MULT}) % {_P31})"
    return r(x)


def uniform_int_sql(seed: int, a: str, b: str) -> str:
    a = f"CAST({a} AS BIGINT)"
    b = f"CAST({b} AS BIGINT)"
    h = _mix31_sql(f"CAST({int(seed) % _P31} AS BIGINT)")
    h = _mix31_sql(f"xor({h}, {a} % {_P31})")
    h = _mix31_sql(f"xor({h}, ({a} >> 31) % {_P31})")
    h = _mix31_sql(f"xor({h}, {b} % {_P31})")
    return f"(CAST({h} AS DOUBLE) / {float(_P31)!r})"


def epoch_micros(col: str, dtype) -> Column:
    """Microseconds since the epoch, independent of the session time zone for
    ``TIMESTAMP_NTZ`` (wall clock read as UTC, like DuckDB's naive timestamps)."""
    name = dtype.typeName()
    if name == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`)")
    return F.unix_micros(F.col(col).cast("timestamp"))
