"""Benchmark passages in documents by spaced-seed hashing.

Fixed masks pick words of a window and ignore the rest. The hashes of all masks
at all positions of the benchmark are joined with those of the documents; each
hit names a diagonal (an alignment without gaps) of a document and an item. On it
the longest stretch with enough equal words is found by comparing all words
around the hit; it counts as a leak if it is long enough. Unequal words at its
ends count too; they are left out of what is reported if it stays long enough.

No overlap of 13 words, 80 % of them equal, is without a hit: ``k`` unequal words
leave ``k + 1`` runs of equal ones, and one has four words, except where 15 words
fall into four runs of three, which the mask ``xxx_xxx`` finds. Items of fewer
words have to be found whole; shorter runs are looked up where they need them.

The benchmark goes to the tasks in pieces of at most ``piece_words`` words, one
job over the documents for each piece, so what is broadcast has a fixed bound and
benchmarks of any size are searched whole; texts with leaks are put together from
the written results of the jobs.

Words are lower-cased (A-Z) and stripped of ASCII punctuation. Edge cases: null
texts have no words; items with fewer than ``least_words`` words (by default: none)
are left out, for users to whom an overlap of so few words is chance; items with equal words are reported under their
smallest id; an item with a null id is searched and reported with id null if no
equal item has an id. Documents are kept one for one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import clash_free, discard, renamed, restored, settle
from marlstone.llm.words import M1, SPACE_OR_MARK, U64, Words, find_words, mix, pieces

#: Positions that each mask looks at.
MASKS = ((0,), (0, 1), (0, 1, 2), (0, 1, 2, 3), (0, 1, 2, 4, 5, 6))
#: By mask: whether items of so many words need it.
NEEDED = (lambda n: n == 1, lambda n: (n == 2) | (n == 5), lambda n: np.isin(n, (3, 6, 7, 10, 11)), lambda n: (n == 4) | (n >= 8), lambda n: n >= 15)
LEAST_WORDS = 1
OVERLAP_WORDS = 13
SIMILARITY = 0.8
PIECE_WORDS = 1 << 20
FILTER_BITS = 22
#: Hits are widened to pairs of positions so many at a time.
PAIRS = 1 << 20
LEAK = pa.struct([("item_id", pa.int64()), ("doc_start", pa.int32()), ("item_start", pa.int32()), ("length", pa.int32()), ("matches", pa.int32())])


def seeds(names: np.ndarray, text: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the mask at all positions where it lies in one text, and those positions."""
    n = len(names) - mask[-1]
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    out = np.zeros(n, dtype=np.uint64)
    for number, offset in enumerate(mask):
        out += names[offset : offset + n] * U64((2 * number + 1) * int(M1) % (1 << 64))
    at = np.flatnonzero(text[:n] == text[mask[-1] :])
    return mix(out[at] + U64(mask[-1])), at


@dataclass
class Index:
    """A piece of the benchmark: ``names`` are word hashes, item ``k`` has ``first[k]:first[k+1]``."""

    ids: list
    names: np.ndarray
    first: np.ndarray
    hashes: list[np.ndarray]
    places: list[np.ndarray]
    screen: np.ndarray

    @staticmethod
    def of(ids: list, sequences: list[np.ndarray]) -> Index:
        names = np.concatenate(sequences) if sequences else np.zeros(0, dtype=np.uint64)
        first = np.concatenate([[0], np.cumsum([len(s) for s in sequences])]).astype(np.int64)
        item = np.repeat(np.arange(len(ids)), np.diff(first))
        hashes, places, screen = [], [], np.zeros(1 << FILTER_BITS, dtype=bool)
        sizes = np.diff(first)
        for mask, needed in zip(MASKS, NEEDED):
            h, at = seeds(names, item, mask)
            use = needed(sizes)[item[at]]
            h, at = h[use], at[use]
            order = np.argsort(h, kind="stable")
            hashes.append(h[order])
            places.append(at[order])
            screen[h >> U64(64 - FILTER_BITS)] = True
        return Index(ids, names, first, hashes, places, screen)


def longest_stretch(same: np.ndarray, similarity: float) -> tuple[int, int]:
    """The longest stretch that has the share of equal words asked for."""
    score = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - similarity, -similarity))])
    low = np.minimum.accumulate(score)
    # the earliest start whose score is no greater than the end's
    start = np.searchsorted(-low, -(score + 1e-9), side="left")
    size = np.arange(len(score)) - start
    end = int(np.argmax(size))
    return (int(start[end]), end) if size[end] > 0 else (0, 0)


def longest_overlap(same: np.ndarray, similarity: float) -> tuple[int, int]:
    """The longest stretch without the unequal words at its ends."""
    start, end = longest_stretch(same, similarity)
    hits = np.flatnonzero(same[start:end])
    if not len(hits):
        return 0, 0
    return int(start + hits[0]), int(start + hits[-1] + 1)


def leaks_of(words: Words, index: Index, overlap: int, similarity: float) -> list[list[dict]]:
    """By text: the best overlap with each item that has one."""
    out: list[list[dict]] = [[] for _ in range(len(words.first) - 1)]
    names = words.hashes()
    text = np.repeat(np.arange(len(out)), np.diff(words.first))
    diagonals = set()
    for mask, hashes, places in zip(MASKS, index.hashes, index.places):
        if not len(hashes):
            continue
        h, at = seeds(names, text, mask)
        near = np.flatnonzero(index.screen[h >> U64(64 - FILTER_BITS)])
        h, at = h[near], at[near]
        low, high = np.searchsorted(hashes, h, side="left"), np.searchsorted(hashes, h, side="right")
        found = np.flatnonzero(high > low)
        at, low, count = at[found], low[found], (high - low)[found]
        total = np.cumsum(count)
        begin = 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS)))
            c = count[begin:end]
            where = np.repeat(at[begin:end], c)
            place = places[np.repeat(low[begin:end] - np.cumsum(c) + c, c) + np.arange(c.sum())]
            item = np.searchsorted(index.first, place, side="right") - 1
            rows = np.stack([text[where], item, where - words.first[text[where]] - (place - index.first[item])], axis=1)
            diagonals.update(map(tuple, np.unique(rows, axis=0).tolist()))
            begin = end
    best: dict[tuple[int, int], tuple] = {}
    for t, k, shift in sorted(diagonals):
        doc = names[words.first[t] : words.first[t + 1]]
        item = index.names[index.first[k] : index.first[k + 1]]
        a, b = max(0, -shift), min(len(item), len(doc) - shift)
        same = doc[a + shift : b + shift] == item[a:b]
        least = min(overlap, len(item))
        if len(same) < least or same.sum() < similarity * least - 1e-9:
            continue
        s, e = longest_overlap(same, similarity)
        if e - s < least:
            s, e = longest_stretch(same, similarity)
        if e - s >= least:
            matches = int(same[s:e].sum())
            if (t, k) not in best or (matches, s - e) > best[t, k][:2]:
                best[t, k] = (matches, s - e, {"item_id": index.ids[k], "doc_start": a + s + shift, "item_start": a + s, "length": e - s, "matches": matches})
    for (t, _), row in best.items():
        out[t].append(row[2])
    return out


def benchmark_pieces(benchmark: DataFrame, id_col: str, text_col: str, piece_words: int, least_words: int) -> Iterator[Index]:
    """Items of equal words once, in pieces of at most ``piece_words`` words or one item."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").alias("t")).groupBy("t").agg(F.min("i").alias("i")).orderBy(F.col("i").asc_nulls_last(), "t")
    ids: list = []
    sequences: list[np.ndarray] = []
    seen: set[bytes] = set()
    for row in items.toLocalIterator():
        names = find_words(pa.array([row["t"]], pa.large_string()), lower=True, gaps=SPACE_OR_MARK).hashes()
        if len(names) < least_words or names.tobytes() in seen:
            continue
        if sequences and sum(map(len, sequences)) + len(names) > piece_words:
            yield Index.of(ids, sequences)
            ids, sequences, seen = [], [], set()
        seen.add(names.tobytes())
        ids.append(row["i"])
        sequences.append(names)
    if sequences:
        yield Index.of(ids, sequences)


@clash_free
def find_leaks(
    df: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: list[str] | None = None,
    overlap: int = OVERLAP_WORDS, similarity: float = SIMILARITY, piece_words: int = PIECE_WORDS, least_words: int = LEAST_WORDS,
) -> DataFrame:
    """``keep`` columns (default: all) of every row with ``_leaks``: item, first words in text and item, length and equal words."""
    kind = "array<struct<item_id:long,doc_start:int,item_start:int,length:int,matches:int>>"
    spark, indexes = df.sparkSession, benchmark_pieces(benchmark, item_col, item_text, piece_words, least_words)
    text = F.col(f"`{text_col}`")
    first, second = next(indexes, None), next(indexes, None)
    if first is None:
        return df.select(*[F.col(f"`{c}`") for c in keep], F.array().cast(kind).alias("_leaks"))
    if second is None:
        rows = df.select(*[F.col(f"`{c}`") for c in keep], text.alias("_text"))
        fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
        return rows.mapInArrow(searcher(spark.sparkContext.broadcast(first), keep, overlap, similarity), (fields + ", " if fields else "") + f"_leaks {kind}")
    # a benchmark of several pieces: one pass for each, of which only texts with leaks are kept, under 128 bits of hash
    names = {"_one": F.xxhash64(text), "_other": F.xxhash64(F.lit(1), text)}
    texts = df.select(*[c.alias(n) for n, c in names.items()], text.alias("_text"))
    found = []
    for index in chain([first, second], indexes):
        shared = spark.sparkContext.broadcast(index)
        found.append(settle(texts.mapInArrow(searcher(shared, list(names), overlap, similarity), f"_one long, _other long, _leaks {kind}").where(F.size("_leaks") > 0).distinct(), "leaks"))
        shared.destroy()
    each = reduce(DataFrame.unionByName, found).groupBy(F.col("_one").alias("_first"), F.col("_other").alias("_second")).agg(F.flatten(F.collect_list("_leaks")).alias("_found"))
    each = settle(each, "leaks-of-texts")
    discard(*found)
    rows = df.select(*[F.col(f"`{c}`") for c in keep], *[c.alias(n) for n, c in names.items()])
    met = rows.join(each, (rows["_one"] == each["_first"]) & (rows["_other"] == each["_second"]), "left")
    return met.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("_found", F.array().cast(kind)).alias("_leaks"))


def searcher(shared, keep: list[str], overlap: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "_text"):
                column = lambda name: batch.column(batch.schema.get_field_index(name))
                found = leaks_of(find_words(column("_text"), lower=True, gaps=SPACE_OR_MARK), shared.value, overlap, similarity)
                yield pa.RecordBatch.from_arrays([*map(column, keep), pa.array(found, pa.list_(LEAK))], names=[*keep, "_leaks"])

    return run


def decontaminate(df: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """Rows of ``df`` in which no benchmark passage was found."""
    plain, names = renamed(df)
    return restored(find_leaks(plain, benchmark, text_col=names[text_col], **options).where(F.size("_leaks") == 0), names)
