"""Counter-based draws: a value depends on its key only, never on partitioning or order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def hash_key(*parts) -> Column:
    """md5 text of the parts joined by ':'."""
    return F.md5(F.concat_ws(":", *[_text(p) for p in parts]))


def uniform(*parts) -> Column:
    """Uniform in [0, 1) with 52 bits."""
    return F.conv(F.substring(hash_key(*parts), 1, 13), 16, 10).cast("bigint") / F.lit(4503599627370496.0)


def stream(*parts) -> Column:
    """A 60-bit number for a stream of draws; its parts are hashed once, not for every draw."""
    return F.conv(F.substring(hash_key(*parts), 1, 15), 16, 10).cast("bigint")


def draw(key: Column, *numbers: Column) -> Column:
    """Uniform in [0, 1) with 53 bits for whole numbers in the stream of a key: one 64-bit hash."""
    return F.shiftrightunsigned(F.xxhash64(key, *[n.cast("bigint") for n in numbers]), 11) / F.lit(9007199254740992.0)


def uniform_between(low, high, *parts) -> Column:
    return F.lit(low) + uniform(*parts) * (F.lit(high) - F.lit(low))


def normal(*parts) -> Column:
    """Standard normal by Box-Muller from two independent uniforms of the same key."""
    u1 = F.lit(1.0) - uniform(*parts, "r")
    u2 = uniform(*parts, "a")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def block_digits(rows: int, block_rows: int = 100_000) -> int:
    """Hex digits of a hash that cut ``rows`` into blocks of about ``block_rows`` or fewer."""
    digits = 1
    while 16 ** digits * block_rows < rows and digits < 13:
        digits += 1
    return digits


def hash_block(key: Column, digits: int) -> Column:
    """Leading hex digits of a hash as a block number; blocks keep the order of the hash."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("bigint")
