"""Long repeated word sequences by recompression.

Words are named by 64-bit hashes. A first round names runs of equal words, and
further rounds name pairs: each round splits all symbols into a left and a right
class by a bit of their name, and a left symbol followed by a right one becomes
their pair. Names are hashes of what they stand for, so they are global without a
dictionary, and whether two symbols join depends on a few words around them only.
Equal sequences therefore have equal symbols but for a margin at either end.

Every window of ``window`` words is represented by the smallest high-level symbol
that starts in its middle; the margins are wide enough for that choice to depend
on the window's words alone. Consecutive windows with one representative form a
segment. A segment's key is the hash of the words that all its windows share
around the symbol; windows with equal words have equal keys. Spark groups equal
segments, which settles all windows of a segment that is the only one of its key.
Where segments of one key differ, their windows are compared one by one by hash.
Equality of stretches is thus decided on pairs (key, hash) that are made from the
64-bit names of words with different bases; words are told apart by these names.

A window is dropped in all documents but those with the smallest id among the
documents that hold it. Edge cases: null texts have no words; documents shorter
than a window keep everything; rows with equal ids don't drop each other's words,
and a repeated row gets the same result each time; a row with a null id neither
drops words nor loses any.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import clash_free, discard, renamed, restored, settle
from marlstone.llm.words import M1, U64, Words, find_words, mix, pair, pieces, sliding_min

#: The low bits of a value to minimise hold its position, so ties go to the leftmost.
POSITION_BITS = U64(30)
BASE, SECOND_BASE = U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)


@dataclass(frozen=True)
class Shape:
    """Rounds for a window: a symbol has at most ``longest`` words and depends on ``margin`` words to either side."""

    window: int
    pair_rounds: int
    longest: int
    margin: int
    run_round: bool = True

    @property
    def starts(self) -> int:
        """Positions of a window at which its representative may start."""
        return self.window - 2 * self.margin - self.longest + 1


def shape_for(window: int) -> Shape:
    """As many rounds as leave every window with a symbol in its middle: the run round, then pair rounds.

    A run is named if it has exactly two words, which shows within three words; runs
    that are longer stay single words, since their ends may lie outside a window.
    """
    best, longest, margin, rounds = Shape(window, 0, 1, 0, run_round=False), 2, 3, 0
    while True:
        shape = Shape(window, rounds, longest, margin)
        if shape.starts < shape.longest:
            return best
        best, margin, longest, rounds = shape, margin + longest, 2 * longest, rounds + 1


def symbols(names: np.ndarray, text: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """High-level symbols over all texts: their names and the positions of their first words."""
    at = np.arange(len(names))
    if not shape.run_round:
        return names, at
    same = np.zeros(len(names) + 1, dtype=bool)
    same[1:-1] = (names[1:] == names[:-1]) & (text[1:] == text[:-1])
    double = same[1:-1] & ~same[:-2] & ~same[2:] if len(names) > 1 else np.zeros(0, dtype=bool)
    names, at = join(names, at, double, 1)
    for number in range(2, shape.pair_rounds + 2):
        left = (mix(names + U64(int(M1) * number % (1 << 64))) & U64(1)).astype(bool)
        meets = left[:-1] & ~left[1:] & (text[at[:-1]] == text[at[1:]])
        names, at = join(names, at, meets, number)
    return names, at


def join(names: np.ndarray, at: np.ndarray, meets: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    if not meets.any():
        return names, at
    first = np.flatnonzero(meets)
    names = names.copy()
    names[first] = pair(names[first] + U64(number), names[first + 1])
    keep = np.ones(len(names), dtype=bool)
    keep[first + 1] = False
    return names[keep], at[keep]


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base`` to the powers 0 to ``n - 1``."""
    return np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(max(0, n - 1), base)]))


class Sequences:
    """Hashes of any stretches of the words, from one prefix sum."""

    def __init__(self, names: np.ndarray, base: np.uint64 = BASE):
        self.down = powers(U64(pow(int(base), -1, 1 << 64)), len(names) + 1)
        self.sums = np.zeros(len(names) + 1, dtype=np.uint64)
        np.cumsum(names * powers(base, len(names)), out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * M1)


def second_sequences(names: np.ndarray) -> Sequences:
    """Other hashes than those of keys: of other names, with another base."""
    return Sequences(mix(names ^ M1), SECOND_BASE)


def text_of_words(words: Words) -> np.ndarray:
    return np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))


@dataclass
class Segments:
    text: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    key: np.ndarray
    whole: np.ndarray


def segments(words: Words, shape: Shape) -> Segments:
    """``start``: a segment's first window, as a position in its text; ``windows``: how many it has."""
    names = words.hashes()
    n, w = len(names), shape.window
    empty = np.zeros(0, dtype=np.int64)
    if n < w:
        return Segments(empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64))
    text = text_of_words(words)
    high, at = symbols(names, text, shape)
    value = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    value[at] = (mix(high) >> POSITION_BITS << POSITION_BITS) | at.astype(np.uint64)
    least = sliding_min(value[shape.margin : n - shape.window + shape.margin + shape.starts], shape.starts)
    chosen = (least & U64((1 << int(POSITION_BITS)) - 1)).astype(np.int64)  # for the window at each position
    p = np.flatnonzero(text[: n - w + 1] == text[w - 1 :])
    chosen = chosen[p]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (p[1:] != p[:-1] + 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(p)))
    start, symbol = p[head], chosen[head]
    key = Sequences(names).hash(symbol - shape.margin, symbol + shape.longest + shape.margin)
    whole = second_sequences(names).hash(start, start + count + w - 1)
    return Segments(text[start], start - words.first[text[start]], count, key, whole)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def repeats(df: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """For each text that loses words: ``_id``, ``_hash``, ``_cuts`` (start, count of dropped windows)."""
    shape = shape_for(window)
    ident = F.col(f"`{id_col}`")
    texts = df.select(ident.alias("_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("_hash"), F.col(f"`{text_col}`").alias("_text"))
    id_type = texts.schema["_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "_text"):
                found = segments(find_words(column(batch, "_text")), shape)
                rows = pa.array(found.text)
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "_id").take(rows), column(batch, "_hash").take(rows), pa.array(found.start.astype(np.int32)), pa.array(found.windows.astype(np.int32)), signed(found.key), signed(found.whole)],
                    names=["_id", "_hash", "_start", "_windows", "_key", "_whole"],
                )

    found = settle(texts.where("_id is not null").mapInArrow(find, f"_id {id_type}, _hash long, _start int, _windows int, _key long, _whole long"), "segments")
    # a key seen in one document only repeats nothing; no more than key and id is dealt to find out
    repeated = found.groupBy("_key").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last").select(F.col("_key").alias("_of"))
    repeated = settle(repeated, "repeated")  # so that the join deals both sides itself and a key of very many segments can be split
    shared = settle(found.join(repeated, found["_key"] == repeated["_of"]).drop("_of"), "shared")
    discard(found, repeated)
    alike = shared.groupBy("_key", "_whole").agg(F.min("_id").alias("_least"))
    kinds = alike.groupBy("_key").agg((F.count(F.lit(1)) > 1).alias("_open")).withColumnRenamed("_key", "_of")
    least = settle(alike.join(kinds, alike["_key"] == kinds["_of"]).drop("_of"), "alike")
    # repeated rows are judged once
    judged = settle(shared.join(least, ["_key", "_whole"]).where("_open OR _least < _id").select("_id", "_hash", "_start", "_windows", "_key", "_open").distinct(), "judged")
    discard(shared, least)
    opened = judged.where("_open").groupBy("_id", "_hash").agg(F.collect_list(F.struct("_start", "_windows", "_key")).alias("_spans"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "_text"):
                words = find_words(column(batch, "_text"))
                sequences = second_sequences(words.hashes())
                spans = column(batch, "_spans")
                row = np.repeat(np.arange(batch.num_rows), spans.value_lengths().to_numpy(zero_copy_only=False))
                flat = spans.flatten()
                start, count, key = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                each = np.repeat(np.arange(len(start)), count)
                inside = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                place = start[each] + inside
                at = words.first[row[each]] + place
                rows = pa.array(row[each])
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "_id").take(rows), column(batch, "_hash").take(rows), pa.array(place.astype(np.int32)), pa.array(key[each]), signed(sequences.hash(at, at + window))],
                    names=["_id", "_hash", "_start", "_key", "_whole"],
                )

    once = texts.where("_id is not null").join(opened, ["_id", "_hash"]).select("_id", "_hash", "_text", "_spans")
    single = settle(once.mapInArrow(compare, f"_id {id_type}, _hash long, _start int, _key long, _whole long"), "windows")
    least = settle(single.groupBy("_key", "_whole").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most")).where("_least < _most").drop("_most"), "shared-windows")
    later = single.join(least, ["_key", "_whole"]).where("_least < _id").select("_id", "_hash", "_start", F.lit(1).alias("_windows")).distinct()
    cuts = judged.where("not _open").select("_id", "_hash", "_start", "_windows").unionByName(later)
    done = settle(cuts.groupBy("_id", "_hash").agg(F.collect_list(F.struct("_start", "_windows")).alias("_cuts")), "cuts")
    discard(judged, single, least)
    return done


def dropped(words: Words, row: np.ndarray, start: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
    """Which words are covered by a dropped window."""
    edge = np.zeros(len(words.start) + 1, dtype=np.int64)
    first = words.first[row] + start
    np.add.at(edge, first, 1)
    np.add.at(edge, first + count + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0


@clash_free
def without_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) of every row, with ``_new_text``, ``_n_words``, ``_n_removed`` and ``_kept_sha256``.

    ``_new_text`` is the text without the dropped words and the space before each;
    a text that loses nothing stays as it is, byte for byte. ``_kept_sha256`` is the
    digest of the kept words joined by single spaces.
    """
    cuts = repeats(df, id_col, text_col, window).select(F.col("_id").alias("_cut_id"), F.col("_hash").alias("_cut_hash"), "_cuts")
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{id_col}`").alias("_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("_hash"), F.col(f"`{text_col}`").alias("_text"))
    met = rows.join(cuts, (rows["_id"] == cuts["_cut_id"]) & (rows["_hash"] == cuts["_cut_hash"]), "left").select(*[F.col(f"`{c}`") for c in keep], "_text", "_cuts")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[F.col(f"`{c}`") for c in keep]).schema)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "_text"):
                words = find_words(column(batch, "_text"))
                cut = column(batch, "_cuts").fill_null([])
                row = np.repeat(np.arange(batch.num_rows), cut.value_lengths().to_numpy(zero_copy_only=False))
                start, count = (cut.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
                out = dropped(words, row, start, count, window)
                lost = np.concatenate([[0], np.cumsum(out)])
                n_removed = lost[words.first[1:]] - lost[words.first[:-1]]
                texts, digests = [], []
                for i, text in enumerate(column(batch, "_text")):
                    a, b = words.first[i], words.first[i + 1]
                    raw = words.data[words.text_start[i] : words.text_start[i + 1]]
                    if n_removed[i]:
                        kept, raw = cut_out(words.data, words.text_start[i], words.text_start[i + 1], words.start[a:b], words.end[a:b], out[a:b])
                        digests.append(hashlib.sha256(kept).hexdigest())
                        texts.append(raw.decode())
                    else:
                        digests.append(hashlib.sha256(b" ".join(raw.split())).hexdigest())
                        texts.append(text.as_py())
                yield pa.RecordBatch.from_arrays(
                    [column(batch, c) for c in keep] + [pa.array(texts, pa.string()), pa.array(np.diff(words.first)), pa.array(n_removed), pa.array(digests, pa.string())],
                    names=[*keep, "_new_text", "_n_words", "_n_removed", "_kept_sha256"],
                )

    return met.mapInArrow(rewrite, f"{fields}, _new_text string, _n_words long, _n_removed long, _kept_sha256 string")


def cut_out(data: bytes, low: int, high: int, start: np.ndarray, end: np.ndarray, out: np.ndarray) -> tuple[bytes, bytes]:
    """The kept words joined by spaces, and the text without the dropped words and what precedes each."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ~out, [False]]).astype(np.int8)))
    stretches = [(int(start[a]), int(end[b - 1])) for a, b in edge.reshape(-1, 2)]
    kept = b" ".join(b" ".join(data[a:b].split()) for a, b in stretches)
    new = b" ".join(data[a:b] for a, b in stretches)
    if stretches:
        new = (data[low : int(start[0])] if not out[0] else b"") + new + (data[int(end[-1]) : high] if not out[-1] else b"")
    return kept, new


def deduplicate(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """``df`` with the repeated words cut out of its texts; all rows and other columns stay."""
    plain, names = renamed(df)
    done = without_repeats(plain, id_col=names[id_col], text_col=names[text_col], window=window)
    return restored(done.withColumn(names[text_col], F.col("_new_text")), names)
