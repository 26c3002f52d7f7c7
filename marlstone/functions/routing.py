"""Which shard a key belongs to: FNV-1a over the key's bytes, modulo the number of shards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the 64-bit FNV-1a hash
OFFSET = 14695981039346656037
PRIME = 1099511628211

#: The prime is 2**40 + 0x1B3, so a product modulo 2**64 comes from 32-bit halves without overflow.
LOW_PRIME, MASK = 0x1B3, 0xFFFFFFFF


def shard_of_key(key: str, shards: int) -> int:
    """For one key on the driver."""
    h = OFFSET
    for byte in key.encode():
        h = (h ^ byte) * PRIME % (1 << 64)
    return h % max(1, shards)


def shard_of(key: Column, shards: int) -> Column:
    """For a column of keys, in built-in functions only."""
    digits = F.hex(F.encode(key, "UTF-8"))
    octets = F.transform(F.filter(F.sequence(F.lit(0), F.length(digits)), lambda i: (i % 2 == 1)), lambda i: F.conv(digits.substr(i, F.lit(2)), 16, 10).cast("long"))

    def step(state: Column, octet: Column) -> Column:
        high, low = state["high"], state["low"].bitwiseXOR(octet)
        product = low * LOW_PRIME
        carry = F.shiftright(product, 32)
        new_high = (high * LOW_PRIME + carry + F.shiftleft(low.bitwiseAND(0xFFFFFF), 8)).bitwiseAND(F.lit(MASK))
        return F.struct(new_high.alias("high"), product.bitwiseAND(F.lit(MASK)).alias("low"))

    start = F.struct(F.lit(OFFSET >> 32).cast("long").alias("high"), F.lit(OFFSET & MASK).cast("long").alias("low"))
    n = max(1, shards)
    return F.aggregate(octets, start, step, lambda s: ((s["high"] % n) * ((1 << 32) % n) + s["low"]) % n).cast("int")
