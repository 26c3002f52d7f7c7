"""Minimax contiguous partition of groups of equal texts, in DataFrame functions only.

All rows of one text form an atomic group. Groups are ordered by the 64-bit hash
of their text, and the smallest capacity for which greedy filling needs no more
than the wanted number of shards is found by binary search. A greedy check needs
group sizes only around its cuts, so the driver never holds them all: it starts
with the totals of a few thousand ranges of hashes, brackets the capacity (ranges
taken as unbreakable, ranges taken as divisible) and asks Spark to split only the
ranges in which a cut may lie, until the bracket closes.

A group at least as large as an even share gets a shard of its own and the rest
are spread over the other shards; without this, one group holding a third of the
bytes would set the capacity and leave shards empty.

Edge cases: a null text has no bytes, CRC 0 and shares the group of empty texts.
Null, repeated and tied ids are fine: slots stay gapless, in an order of hashes that
spreads repeated rows too. An empty table gives an empty result. Two texts with the same 64-bit
hash would merely share a group. Extra columns of the input are not carried.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import settle

#: Hash bits that each refinement adds.
BITS_A_LEVEL = 12
#: Rows of a shard are numbered in so many cells, each a window of its own.
CELLS = 1024


@dataclass(frozen=True)
class Range:
    """Groups whose hash has the given leading bits; ``bits`` of 64 means one group."""

    first: int
    bits: int
    total: int
    largest: int
    groups: int


class Ranges:
    def __init__(self, ranges: list[Range]):
        self.ranges = sorted(ranges, key=lambda r: r.first)
        self.ends = []
        for r in self.ranges:
            self.ends.append((self.ends[-1] if self.ends else 0) + r.total)
        self.total = self.ends[-1] if self.ends else 0
        self.largest = max((r.largest for r in self.ranges), default=0)

    def reach(self, start: int, capacity: int, divisible: bool) -> int:
        """The furthest end of a shard that begins at ``start``."""
        i = bisect_right(self.ends, start + capacity)
        end = self.ends[i - 1] if i else 0
        if divisible and i < len(self.ranges) and self.ranges[i].groups > 1:
            return start + capacity
        return max(end, start)

    def cuts(self, capacity: int, shards: int, divisible: bool) -> list[int]:
        out, at = [], 0
        for _ in range(shards):
            at = self.reach(at, capacity, divisible)
            out.append(at)
        return out

    def smallest(self, shards: int, divisible: bool) -> int:
        low, high = max(self.largest, -(-self.total // shards)), self.total
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, divisible)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def unclear(self, low: int, high: int, shards: int) -> list[Range]:
        """Ranges in which a cut may lie for a capacity between ``low`` and ``high``."""
        near, far = self.cuts(low, shards, False), self.cuts(high, shards, True)
        out = []
        for i, r in enumerate(self.ranges):
            begin, end = self.ends[i] - r.total, self.ends[i]
            if r.groups > 1 and any(begin < b and a < end for a, b in zip(near, far)):
                out.append(r)
        return out


def bucket(bits: int):
    return F.shiftright(F.col("_key"), 64 - bits) if bits < 64 else F.col("_key")


def range_totals(groups: DataFrame, bits: int) -> list[Range]:
    rows = groups.groupBy(bucket(bits).alias("b")).agg(F.sum("_bytes").alias("t"), F.max("_bytes").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    return [Range(r["b"] << (64 - bits), bits, r["t"], r["m"], r["n"]) for r in rows]


def cut_keys(groups: DataFrame, shards: int) -> list[int]:
    """The first hash of every shard but the first. ``groups``: ``_key``, ``_bytes``."""
    known = Ranges(range_totals(groups, BITS_A_LEVEL))
    if not known.total:
        return []
    while True:
        low, high = known.smallest(shards, True), known.smallest(shards, False)
        split = known.unclear(low, high, shards) if low < high else []
        if not split:
            break
        by_bits: dict[int, list[int]] = {}
        for r in split:
            by_bits.setdefault(r.bits, []).append(r.first >> (64 - r.bits))
        fresh = [r for r in known.ranges if r not in set(split)]
        for bits, firsts in by_bits.items():
            fresh += range_totals(groups.where(bucket(bits).isin(firsts)), min(64, bits + BITS_A_LEVEL))
        known = Ranges(fresh)
    ends = known.cuts(high, shards, False)
    starts = {known.ends[i] - r.total: r.first for i, r in enumerate(known.ranges)}
    return sorted({starts[e] for e in ends if e < known.total})


def shard(df: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot (gapless from 0 in each shard).

    The id keeps its name, unless that is one of the others: then it is called ``id``.
    """
    text = F.col(f"`{text_col}`")
    rows = settle(
        df.select(
            F.col(f"`{id_col}`").alias("_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(F.coalesce(text, F.lit(""))).alias("_key"),
            F.pmod(F.monotonically_increasing_id(), F.lit(CELLS)).cast("int").alias("_turn"),  # tells repeated rows apart
        ),
        "shard-rows",
    )
    groups = settle(rows.groupBy("_key").agg(F.sum("size").alias("_bytes")), "shard-groups")
    top = groups.orderBy(F.desc("_bytes"), "_key").limit(shards).collect()
    rest = groups.agg(F.sum("_bytes")).first()[0] or 0
    alone: list[int] = []
    while len(alone) < min(len(top), shards - 1) and top[len(alone)]["_bytes"] * (shards - len(alone)) >= rest:
        rest -= top[len(alone)]["_bytes"]
        alone.append(top[len(alone)]["_key"])
    left = groups.where(~F.col("_key").isin(alone)) if alone else groups
    cuts = cut_keys(left, shards - len(alone))
    number = F.lit(len(alone))
    for cut in cuts:
        number = number + (F.col("_key") >= cut).cast("int")
    for i, key in enumerate(alone):
        number = F.when(F.col("_key") == key, F.lit(i)).otherwise(number)
    placed = rows.withColumns({"shard": number.cast("int"), "_cell": F.pmod(F.xxhash64("_id", "_key", "_turn"), F.lit(CELLS)).cast("int")})
    cells = placed.groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("_n"))  # at most shards * CELLS rows
    before = cells.selectExpr("shard", "_cell", "sum(_n) over (partition by shard order by _cell) - _n as _before")
    ranked = placed.selectExpr("*", "row_number() over (partition by shard, _cell order by _id, _key) as _rank")
    return ranked.join(F.broadcast(before), ["shard", "_cell"]).select(
        F.col("_id").alias("id" if id_col in ("size", "text_crc32", "shard", "slot") else id_col), "size", "text_crc32", "shard", (F.col("_before") + F.col("_rank") - 1).cast("long").alias("slot")
    )
