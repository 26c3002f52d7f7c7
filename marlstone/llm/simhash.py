"""SimHash near-duplicates by exact, tiled comparison of all fingerprints.

Distinct fingerprints are cut into blocks of similar population count. Every pair
of blocks whose counts can lie within the radius is compared in one task, tile by
tile, with numpy exclusive-or and bit counts; tile pairs whose population counts
(of the whole and of its eight parts) differ beyond the radius are skipped. Each
task returns only a spanning forest of the links it found, so a group of many
near copies never becomes all its pairs, and no link is lost.

Edge cases: null and empty texts have fingerprint zero and are linked like any
other; a text with fewer words than a shingle is one shingle. Repeated rows and
ids give one output row each. A null id is never the smallest of its component
(a component of null ids only has id null).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.components import components
from marlstone.llm.shared import clash_free, discard, renamed, restored, settle
from marlstone.llm.words import M1, find_words, mix, pieces, shingle_hashes, shingle_words, space_joined, xxh64

SEED = 42
#: Fingerprints in a block at least. Blocks grow with the input; there are about as many as give four tasks to a core.
BLOCK, LEAST_BLOCKS, MOST_BLOCKS = 4096, 16, 256
#: A block is never larger than this, so with very many fingerprints there are more blocks.
BLOCK_BYTES = 16 << 20
TILE = 256
PARTS = 8
#: Shingles in a part of a candidate group whose pairs are verified, and the parts that a group has between these sizes.
LEAST_OF_PART, MOST_OF_PART, PARTS_OF_GROUP = 1 << 15, 1 << 21, 16


#: One in every byte.
BYTES = np.uint64(0x0101010101010101)


def standard_shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle, text by text, and where texts begin: what fingerprints of ``near_duplicates`` are defined by."""
    words = find_words(texts, lower=True)
    data, start, end = space_joined(words)
    one, last, first = shingle_words(words, size)
    return xxh64(data, start[one], end[last] - start[one], SEED), first


def distinct_shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The set of each text's shingles, ascending, and where sets begin."""
    hashes, first = shingle_hashes(find_words(texts, lower=True), size)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        own = np.sort(hashes[a:b])
        sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if b > a else own)
    return np.concatenate([hashes[:0], *sets]), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def votes(hashes: np.ndarray, first: np.ndarray, lanes: int) -> np.ndarray:
    """A row of ``lanes`` 64-bit words for each text; a bit is 1 if set in over half the shingle hashes. Lane 0 uses the hashes themselves.

    Eight bit positions are counted at a time, one in each byte, over runs of 255 hashes.
    """
    sizes = np.diff(first)
    out = np.zeros((len(sizes), lanes), dtype=np.uint64)
    held = np.flatnonzero(sizes)
    if not len(held):
        return out
    runs = -(-sizes[held] // 255)
    begin = np.cumsum(runs) - runs
    at = np.repeat(first[held], runs) + 255 * (np.arange(runs.sum()) - np.repeat(begin, runs))
    for lane in range(lanes):
        h = hashes if lane == 0 else mix(hashes + np.uint64(int(M1) * lane % (1 << 64)))
        counts = np.empty((len(held), 8, 8), dtype=np.int64)
        for k in range(8):
            sums = np.add.reduceat((h >> np.uint64(k)) & BYTES, at)
            counts[:, :, k] = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8), begin, axis=0, dtype=np.int64)
        bits = counts.reshape(-1, 64) * 2 > sizes[held][:, None]
        out[held, lane] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(df: DataFrame, text_col: str, size: int, lanes: int, keep: list[str], sets: bool = False) -> DataFrame:
    """``keep`` columns of every row with ``_print`` (big-endian bytes) and ``_ones``.

    With ``sets``, repeated shingles vote once, and ``_set`` (a hash of the set of shingles) and ``_size`` are added.
    """
    schema = df.select(*keep).schema
    kept = [c for c in keep]
    added = ["_print", "_ones", "_set", "_size"] if sets else ["_print", "_ones"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "_text"):
                texts = batch.column(batch.schema.get_field_index("_text"))
                hashes, first = distinct_shingles(texts, size) if sets else standard_shingles(texts, size)
                found = votes(hashes, first, lanes)
                ones = np.bitwise_count(found).sum(axis=1, dtype=np.int32)
                prints = pa.array([row.tobytes() for row in found.astype(">u8")], type=pa.binary())
                more = []
                if sets:
                    names = [xxhash.xxh3_128_digest(hashes[a:b].tobytes()) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                    more = [pa.array(names, pa.binary()), pa.array(np.diff(first))]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + [prints, pa.array(ones), *more], names=kept + added)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_text"))
    return rows.mapInArrow(run, f"{fields}, _print binary, _ones int" + ", _set binary, _size long" * sets)


def plan_blocks(counts: dict[int, int], radius: int, cores: int, lanes: int = 1) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """Blocks (least count, greatest count, part, parts) and the pairs of blocks to compare."""
    wanted = min(MOST_BLOCKS, max(LEAST_BLOCKS, int((8 * cores) ** 0.5)))
    size = min(BLOCK_BYTES // (8 * lanes), max(BLOCK, -(-sum(counts.values()) // wanted)))
    blocks, low, held = [], None, 0
    ordered = sorted(counts)
    for i, ones in enumerate(ordered):
        low, held = ones if low is None else low, held + counts[ones]
        if i + 1 == len(ordered) or held + counts[ordered[i + 1]] > size:
            parts = -(-held // size)
            blocks += [(low, ones, part, parts) for part in range(parts)]
            low, held = None, 0
    pairs = [(i, j) for j in range(len(blocks)) for i in range(j + 1) if blocks[j][0] - blocks[i][1] <= radius]
    return blocks, pairs


class Forest:
    """Labels of local rows; equal labels mean linked."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.parent[i], self.parent[j]
        apart = a != b
        if not apart.any():
            return
        lo, hi = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
        parent = self.parent
        for x, y in np.unique(np.stack([lo, hi], axis=1), axis=0).tolist():
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        self.parent = parent


def part_counts(prints: np.ndarray) -> np.ndarray:
    octets = np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), PARTS, -1)
    return np.bitwise_count(octets).sum(axis=2, dtype=np.int16)


def tiles_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in an order that keeps part counts close, and the least and greatest part counts of each tile."""
    parts = part_counts(prints)
    order = np.lexsort(tuple(parts.T[::-1]))
    parts = np.concatenate([parts[order], parts.sum(axis=1, dtype=np.int16)[order, None]], axis=1)
    edges = np.arange(0, len(prints), TILE)
    return order, np.minimum.reduceat(parts, edges), np.maximum.reduceat(parts, edges), edges


def most_of(seen: int, lanes: int, radius: int, screen: int) -> int:
    """Differing bits that a pair may have in its first lanes: ``screen`` in two, ``radius`` in all, and between these as many deviations more than the mean."""
    if seen >= lanes or lanes <= 2:
        return radius
    share = (seen - 2) / (lanes - 2)
    mean = lambda n: radius * n / lanes
    return math.ceil(mean(seen) + (1 - share) * max(0.0, screen - mean(2)) * math.sqrt(seen / 2))


def linked_rows(left: np.ndarray, right: np.ndarray | None, radius: int, screen: int) -> np.ndarray:
    """Labels over the rows of ``left`` and then ``right`` (None: within ``left``).

    Rows are linked if all their bits differ in ``radius`` at most, the first 128 in ``screen`` at most and those between as ``most_of`` says.
    """
    a_order, a_low, a_high, a_at = tiles_of(left)
    a = np.ascontiguousarray(left[a_order].T)  # by lane, so that bits are compared side by side
    if right is None:
        b_order, b_low, b_high, b_at, b, base = a_order, a_low, a_high, a_at, a, 0
    else:
        b_order, b_low, b_high, b_at = tiles_of(right)
        b, base = np.ascontiguousarray(right[b_order].T), len(left)
    forest = Forest(len(left) + (0 if right is None else len(right)))
    lanes = len(a)
    apart, (count, more), screened = np.empty((TILE, TILE), dtype=np.uint64), np.empty((2, TILE, TILE), dtype=np.uint8), np.empty((TILE, TILE), dtype=bool)
    for i, ai in enumerate(a_at):
        gap = np.maximum(0, np.maximum(a_low[i] - b_high, b_low - a_high[i]))
        near = (gap[:, :PARTS].sum(axis=1) <= radius) & (gap[:, PARTS] <= radius)
        rows = a[:, ai : ai + TILE]
        for j in np.flatnonzero(near):
            if right is None and j < i:
                continue
            cols = b[:, b_at[j] : b_at[j] + TILE]
            bits, far, hit, second = (x[: rows.shape[1], : cols.shape[1]] for x in (apart, count, screened, more))
            np.bitwise_count(np.bitwise_xor(rows[0][:, None], cols[0], out=bits), out=far)
            if lanes > 1:
                np.bitwise_count(np.bitwise_xor(rows[1][:, None], cols[1], out=bits), out=second)
                np.add(far, second, out=far)
            if not np.less_equal(far, min(radius, screen), out=hit).any():
                continue
            x, y = np.divmod(np.flatnonzero(hit), cols.shape[1])
            total = far[x, y].astype(np.int32)
            for lane in range(2, lanes):  # few pairs are left to look at
                total += np.bitwise_count(rows[lane][x] ^ cols[lane][y])
                close = total <= most_of(lane + 1, lanes, radius, screen)
                x, y, total = x[close], y[close], total[close]
                if not len(x):
                    break
            if len(x):
                forest.link(a_order[ai + x], base + b_order[b_at[j] + y])
    return forest.parent


def smallest_members(label: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that share a label with others, without the one of the smallest fingerprint, and that one: tasks that see one group name one root."""
    rows = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1)
    rows = rows[np.lexsort((*prints[rows].T[::-1], label[rows]))]
    head = np.flatnonzero(np.diff(label[rows], prepend=-1))
    least = np.repeat(rows[head], np.diff(np.append(head, len(rows))))
    return rows[rows != least], least[rows != least]


def links(prints: DataFrame, lanes: int, radius: int, screen: int) -> DataFrame:
    """``prints``: distinct ``_print``, ``_ones``. A forest with the components of all pairs within the radius."""
    spark = prints.sparkSession
    counts = {r["_ones"]: r["n"] for r in prints.groupBy("_ones").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks, pairs = plan_blocks(counts, radius, spark.sparkContext.defaultParallelism, lanes)
    if not blocks:
        return spark.createDataFrame([], "a binary, b binary")
    n = len(blocks)
    start, parts_of = [0] * (max(counts) + 1), [1] * (max(counts) + 1)  # by population count: its first block, and its parts
    for number, (low, high, part, parts) in enumerate(blocks):
        if part == 0:
            start[low : high + 1], parts_of[low : high + 1] = [number] * (high + 1 - low), [parts] * (high + 1 - low)
    ones = F.col("_ones") + 1
    block = (F.element_at(F.lit(start), ones) + F.pmod(F.xxhash64("_print"), F.element_at(F.lit(parts_of), ones))).cast("int")
    width = lanes * 8

    def to_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            numbers, column = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary())
            at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset]
            ones = np.frombuffer(column.buffers()[2], dtype=np.uint8)[at : at + width * len(column)].reshape(-1, width)
            for number in np.unique(numbers).tolist():
                held.setdefault(number, []).append(ones[numbers == number])
        for number, ones in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([np.concatenate(ones).tobytes()], pa.binary())], names=["block", "blob"])

    blobs = settle(prints.select(block.alias("block"), "_print").repartition(len(blocks), "block").mapInArrow(to_blobs, "block int, blob binary"), "blocks")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, bytes] = {}
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if number % n == number // n:
                    sides = [blob]
                elif number in held:
                    sides = [held.pop(number), blob]
                else:
                    held[number] = blob
                    continue
                arrays = [np.frombuffer(s, dtype=">u8").reshape(-1, lanes).astype(np.uint64) for s in sides]
                both = np.concatenate(arrays)
                child, least = smallest_members(linked_rows(arrays[0], arrays[1] if len(arrays) > 1 else None, radius, screen), both)
                if len(child):
                    yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in both[rows].astype(">u8")], pa.binary()) for rows in (child, least)], names=["a", "b"])

    # a block goes to its pairs with those blocks whose population counts are near enough
    low, high = F.lit([b[0] for b in blocks]), F.lit([b[1] for b in blocks])
    near = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda other: F.element_at(low, F.greatest("block", other) + 1) - F.element_at(high, F.least("block", other) + 1) <= radius)
    dealt = blobs.select("blob", "block", F.explode(near).alias("other")).select((F.greatest("block", "other") * n + F.least("block", "other")).alias("pair"), "blob")
    return dealt.repartition(2 * len(pairs), "pair").sortWithinPartitions("pair").mapInArrow(compare, "a binary, b binary")


@clash_free
def near_duplicates(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, lanes: int = 1, radius: int = 4, screen: int = 128, keep: list[str] | None = None
) -> DataFrame:
    """``keep`` columns (default: all) of every row with ``_print`` and ``component_id``, the smallest id its fingerprint reaches."""
    rows = settle(fingerprints(df, text_col, shingle, lanes, list(dict.fromkeys([id_col, *keep]))), "prints")
    distinct = settle(rows.groupBy("_print", "_ones").agg(F.min(F.col(f"`{id_col}`")).alias("_least")), "distinct-prints")
    roots = components(links(distinct.select("_print", "_ones"), lanes, radius, screen))
    linked = settle(distinct.join(roots, distinct["_print"] == roots["node"]).select("_print", "_least", "root"), "linked-prints")
    smallest = settle(linked.groupBy("root").agg(F.min("_least").alias("_of_root")), "smallest")  # so that a large component can be split
    known = linked.join(smallest, "root").select(F.col("_print").alias("_linked"), "_of_root", "root")
    named = settle(
        distinct.join(known, distinct["_print"] == known["_linked"], "left").select(
            F.col("_print").alias("_named"), F.when(F.col("_linked").isNull(), F.col("_least")).otherwise(F.col("_of_root")).alias("component_id"), F.coalesce("root", "_print").alias("_root")
        ),
        "named-prints",
    )
    discard(distinct, linked, smallest)
    return rows.join(named, rows["_print"] == named["_named"]).drop("_named", "_ones", "_root")


def linked_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Labels (the first member) of the components of all pairs of ``sets`` whose Jaccard similarity is high enough.

    A member that was reached is compared with those not yet reached only, so a group
    of near copies takes few comparisons.
    """
    label = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values, codes = np.unique(np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]), return_inverse=True)
    ends = np.cumsum(sizes)
    of = lambda i: codes[ends[i] - sizes[i] : ends[i]]
    waiting = sizes > 0
    held = pool = None
    marks = np.zeros(len(values), dtype=bool)
    for first in range(len(sets)):
        if not waiting[first]:
            continue
        waiting[first] = False
        todo = [first]
        while todo:
            one = todo.pop()
            if held is None or 4 * waiting[held].sum() < 3 * len(held):
                held = np.flatnonzero(waiting)
                pool = np.concatenate([*map(of, held), np.zeros(0, dtype=codes.dtype)])
                begins = np.cumsum(sizes[held]) - sizes[held]
            if not len(held):
                break
            marks[of(one)] = True
            shared = np.add.reduceat(marks[pool], begins, dtype=np.int64)
            marks[of(one)] = False
            near = held[(shared / (sizes[held] + sizes[one] - shared) >= similarity) & waiting[held]]
            waiting[near] = False
            label[near] = first
            todo += near.tolist()
    return label


def verified(df: DataFrame, id_col: str, text_col: str, hash_col: str, candidates: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links ``a``, ``b`` between sets of ``candidates`` with the components of all pairs within a ``_group`` that are alike enough.

    ``candidates``: ``_set``, ``_size``, ``_group`` and ``_best``, the row whose text has the set.
    Groups are cut into parts by the hash of the set, and each pair of parts is compared in
    one task; a row goes to fewer than ``PARTS_OF_GROUP`` tasks until parts reach ``MOST_OF_PART`` shingles.
    """
    totals = candidates.groupBy("_group").agg(F.sum(F.col("_size") + 1).alias("_total"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    totals = settle(totals, "groups")  # so that a large group can be split
    parts = F.ceil(F.col("_total") / F.least(F.lit(MOST_OF_PART), F.greatest(F.lit(LEAST_OF_PART), F.col("_total") / PARTS_OF_GROUP))).cast("long")
    members = candidates.join(totals, "_group").select("_set", "_group", parts.alias("_parts"), F.col("_best.i").alias("_i"), F.col("_best.h").alias("_h"))
    rows = df.select(F.col(id_col), F.col(hash_col), F.col(text_col).alias("_text"))
    rows = rows.join(members, rows[id_col].eqNullSafe(members["_i"]) & (rows[hash_col] == members["_h"])).select("_set", "_group", "_parts", "_text")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "_text"):
                hashes, first = distinct_shingles(batch.column(3), shingle)
                blobs = [hashes[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(blobs, pa.binary())], names=["_set", "_group", "_parts", "_blob"])

    own = F.pmod(F.xxhash64("_set"), F.col("_parts"))
    others = F.when(F.col("_parts") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array_remove(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1), own))
    sets = rows.mapInArrow(to_sets, "_set binary, _group binary, _parts long, _blob binary").select("_set", "_group", "_parts", "_blob", own.alias("_own"), F.explode(others).alias("_other"))
    dealt = sets.select("_group", (F.least("_own", "_other") * F.col("_parts") + F.greatest("_own", "_other")).alias("_pair"), "_set", "_blob")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links_of(held: dict[bytes, bytes]) -> Iterator[pa.RecordBatch]:
            names = sorted(held)  # the first member is the label of its group
            label = linked_sets([np.frombuffer(held[name], dtype=np.uint64) for name in names], similarity)
            child = np.flatnonzero(label != np.arange(len(names)))
            if len(child):
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in rows.tolist()], pa.binary()) for rows in (child, label[child])], names=["a", "b"])

        now, held = None, {}
        for batch in batches:
            for group, pair, name, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if (group, pair) != now:
                    yield from links_of(held)
                    now, held = (group, pair), {}
                held[name] = blob
        yield from links_of(held)

    return dealt.repartition("_group", "_pair").sortWithinPartitions("_group", "_pair").mapInArrow(compare, "a binary, b binary")


def deduplicate(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, lanes: int = 8, radius: int = 140, screen: int = 48, similarity: float = 0.8
) -> DataFrame:
    """Rows of ``df`` without near copies: of each component the row with the smallest id stays, of repeated rows one.

    Texts are linked if the sets of their shingles have a Jaccard similarity of
    ``similarity`` at least, which is computed from the sets (of 64-bit hashes).
    Fingerprints only say which pairs to look at: with 512 bits of distinct shingles,
    texts at 0.8 differ in 78 bits on average with a standard deviation of 8, and in 19
    of the first 128 with one of 4 (very short texts in 96 and 24 at worst); unrelated
    texts differ in 256 and 64. Within a candidate component all pairs are compared.
    """
    plain, names = renamed(df)
    ident, text = names[id_col], names[text_col]
    marked = plain.withColumn("_text_hash", F.xxhash64(text))
    rows = settle(fingerprints(marked, text, shingle, lanes, [ident, "_text_hash"], sets=True), "prints")
    best = F.min(F.struct(F.col(ident).isNull().alias("n"), F.col(ident).alias("i"), F.col("_text_hash").alias("h"))).alias("_best")
    sets = settle(rows.groupBy("_set", "_size", "_print", "_ones").agg(best), "sets")
    prints = settle(sets.select("_print", "_ones").distinct(), "distinct-prints")
    roots = components(links(prints, lanes, radius, screen))
    candidates = settle(sets.join(roots, sets["_print"] == roots["node"], "left").select("_set", "_size", "_best", F.coalesce("root", "_print").alias("_group")), "candidates")
    linked = components(verified(marked, ident, text, "_text_hash", candidates, shingle, similarity))
    named = candidates.join(linked, candidates["_set"] == linked["node"], "left").select("_best", F.coalesce("root", "_set").alias("_of"))
    chosen = settle(named.groupBy("_of").agg(F.min("_best").alias("best")).select(F.col("best.n").alias("_n"), F.col("best.i").alias("_i"), F.col("best.h").alias("_h")), "kept")
    discard(rows, sets, prints, candidates)
    # equal rows meet as partial aggregates, and the join is on the same key: texts are dealt once
    first = F.first(F.struct(*plain.columns)).alias("_row")
    once = marked.groupBy(F.col(ident).isNull().alias("_null"), F.coalesce(F.col(ident), F.lit(0).cast(marked.schema[ident].dataType)).alias("_known"), "_text_hash").agg(first)
    here = once.join(chosen, (once["_null"] == chosen["_n"]) & (once["_known"] == F.coalesce(chosen["_i"], F.lit(0).cast(marked.schema[ident].dataType))) & (once["_text_hash"] == chosen["_h"]), "left_semi")
    return restored(here.select("_row.*"), names)
