"""An interpolated modified Kneser-Ney bigram model over whole corpora.

Words are counted in Spark and numbered by the order of their hashes. Bigrams of
word numbers are counted in Spark too: tasks merge what they see, send sorted
blocks of keys and counts to buckets of the key's hash, and each bucket's task
adds them up. The hash spreads every word's bigrams evenly, so no frequent word
makes a task large. The model is stored as sorted hash arrays in files, which
workers map into memory to score texts: word hashes with their counts, discounted
probabilities and back-off weights, and bigrams as 32 bits of their hash in
buckets of the leading bits, with counts. Tasks write their buckets' parts of the
files; the driver holds how many entries each bucket has, and no more.

A text is a sentence: its words, lower-cased (A-Z), then an end. Bigrams that
begin a text have a context of their own. Continuation counts give the unigram
level, which is interpolated with the uniform distribution over all known words
and one unknown one. Logarithms have base 10.

Edge cases: null and empty texts are just the end. Without training rows every
token is unknown and has probability 1. Null ids count as empty text for the fold.
Rows are kept one for one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.hasharrays import Gatherer, Reader, Store, find, merge, pack, unpack
from marlstone.llm.shared import clash_free, discard, settle
from marlstone.llm.words import U64, Words, find_words, mix, pieces

#: The hash of the end of a text; no word has a known hash, so it is as good as any.
END = U64(0x5851F42D4C957F2D)
#: Kinds of blocks.
WORDS, BIGRAMS, CONTEXTS, ENDINGS, TALLY, SIZES = range(6)
BLOCKS = "kind int, bucket int, block binary"
PIECE = 4 << 20


def sentences(words: Words, values: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """Values of the words of each text followed by ``end``, and where texts begin."""
    first = words.first + np.arange(len(words.first))
    out = np.full(len(values) + len(words.first) - 1, end, dtype=values.dtype)
    at = np.arange(len(values)) + np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    out[at] = values
    return out, first


def block(kind: int, bucket: int, *arrays: np.ndarray) -> tuple[int, int, bytes]:
    return kind, bucket, pack(*arrays)


def rows_of(blocks: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds, buckets, blobs = zip(*blocks) if blocks else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], names=["kind", "bucket", "block"])


def dealt(arrays: list[np.ndarray], bucket: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    """The arrays cut into blocks by bucket; keys stay in order."""
    order = np.argsort(bucket, kind="stable")
    sorted_buckets = bucket[order]
    edges = np.flatnonzero(np.concatenate([[True], sorted_buckets[1:] != sorted_buckets[:-1], [True]])) if len(order) else np.zeros(1, dtype=int)
    for a, b in zip(edges[:-1], edges[1:]):
        yield rows_of([block(kind, int(sorted_buckets[a]), *(x[order[a:b]] for x in arrays))])


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Merged blocks by kind and bucket; the rows come sorted by both."""
    now, parts = None, []
    for batch in batches:
        for kind, bucket, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if (kind, bucket) != now and parts:
                yield (*now, merge(parts))
                parts = []
            now = kind, bucket
            parts.append(unpack(blob))
    if parts:
        yield (*now, merge(parts))


def discounts(counts: dict[int, int]) -> np.ndarray:
    """What modified Kneser-Ney takes from counts 0, 1, 2 and more, from the numbers of counts 1 to 4."""
    n = [0] + [counts.get(i, 0) for i in range(1, 5)]
    if min(n[1:]) <= 0:
        return np.array([0, 0.5, 1.0, 1.5])
    y = n[1] / (n[1] + 2 * n[2])
    return np.array([0.0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.01), i) for i in range(1, 4)])


def tally(counts: np.ndarray) -> list[np.ndarray]:
    small = np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5]
    return [np.arange(1, 5, dtype=np.uint64), small.astype(np.uint64)]


@dataclass
class Model:
    files: Reader
    tokens: int
    types: int
    word_bits: int
    bigram_bits: int
    steps: np.ndarray
    unknown: float


def word_numbers(model_files: Reader, bits: int, hashes: np.ndarray) -> np.ndarray:
    return find(model_files["words"], model_files["word_starts"], bits, hashes, hashes)


def train(df: DataFrame, *, text_col: str = "text", buckets: int | None = None, mounted: bool | None = None) -> Model:
    """Counts all rows of ``df``."""
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket_bits = max(6, (4 * partitions if buckets is None else buckets).bit_length())  # buckets grow with the partitions asked for
    texts = df.select(F.col(f"`{text_col}`").alias("_text"))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gatherer()
        for whole in batches:
            for batch in pieces(whole, "_text", PIECE):
                words = find_words(batch.column(0), lower=True)
                keys, counts = np.unique(words.hashes(), return_counts=True)
                ends = np.array([batch.num_rows], dtype=np.uint64)
                if held.add(*merge([[keys, counts.astype(np.uint64)], [np.array([END]), ends]])):
                    arrays = held.take()
                    yield from dealt(arrays, (arrays[0] >> U64(64 - bucket_bits)).astype(np.int64), 0)
        if arrays := held.take():
            yield from dealt(arrays, (arrays[0] >> U64(64 - bucket_bits)).astype(np.int64), 0)

    def merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, bucket, arrays in gathered(batches):
            yield rows_of([block(WORDS, bucket, *arrays), block(SIZES, bucket, np.arange(2, dtype=np.uint64), np.array([len(arrays[0]), arrays[1].sum()], dtype=np.uint64))])

    def settled(blocks: DataFrame, task, label: str) -> DataFrame:
        return settle(blocks.repartition(max(partitions, 1), "kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(task, BLOCKS), label)

    vocabulary = settled(texts.mapInArrow(count_words, BLOCKS), merge_words, "vocabulary")
    store = Store(spark, "kneser-ney", mounted)
    sizes = sizes_of(vocabulary)
    types, tokens = (sum(x[i] for x in sizes.values()) for i in range(2))
    word_bits = max(bucket_bits, (types // 4).bit_length())
    width, at = 1 << (word_bits - bucket_bits), places(sizes)
    for name, kind, n in (("words", "<u8", types), ("word_counts", "<u8", types), ("word_starts", "<i8", (1 << word_bits) + 1)):
        store.make(name, kind, n)

    def word_parts(bucket: int, blob: bytes) -> Iterator[tuple[str, int, np.ndarray]]:
        keys, counts = unpack(blob)
        yield "words", at[bucket], keys
        yield "word_counts", at[bucket], counts
        local = (keys >> U64(64 - word_bits)).astype(np.int64) - bucket * width
        yield "word_starts", bucket * width + 1, at[bucket] + np.cumsum(np.bincount(local, minlength=width))

    store.fill(vocabulary.where(F.col("kind") == WORDS), word_parts)
    fill_gaps(store, "word_starts", sizes, at, types, 1 << bucket_bits, width)
    discard(vocabulary)
    if types >= 1 << 32:
        raise ValueError(f"{types} distinct words; word numbers have 32 bits")
    reader = store.reader(spark)
    bigram_bits = max(bucket_bits, (tokens // 32).bit_length())
    begin = types  # the number of the context that begins a text

    def count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gatherer()
        for whole in batches:
            for batch in pieces(whole, "_text", PIECE):
                found = find_words(batch.column(0), lower=True)
                names, first = sentences(found, found.hashes(), END)
                number = word_numbers(reader, word_bits, names).astype(np.uint64)
                before = np.empty_like(number)
                before[1:] = number[:-1]
                before[first[:-1]] = begin
                keys, counts = np.unique(before << U64(32) | number, return_counts=True)
                if held.add(keys, counts.astype(np.uint64)):
                    arrays = held.take()
                    yield from dealt(arrays, (mix(arrays[0]) >> U64(64 - bucket_bits)).astype(np.int64), BIGRAMS)
        if arrays := held.take():
            yield from dealt(arrays, (mix(arrays[0]) >> U64(64 - bucket_bits)).astype(np.int64), BIGRAMS)

    # every task of bigrams has something for all ranges of word numbers, so these are fewer than the buckets of bigrams
    span = -(-(types + 1) // (1 << max(5, bucket_bits - 5)))

    def merge_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, endings, small = Gatherer(), Gatherer(), []
        for _, bucket, (keys, counts) in gathered(batches):
            h = mix(keys)
            order = np.argsort(h)
            local = ((h[order] >> U64(64 - bigram_bits)) - (U64(bucket) << U64(bigram_bits - bucket_bits))).astype(np.int64)
            held = np.bincount(local, minlength=1 << (bigram_bits - bucket_bits)).astype("<u4")
            low = (h[order] << U64(bigram_bits) >> U64(32)).astype("<u4")
            c = counts[order]
            over = np.flatnonzero(c >= 255)
            blob = b"".join(np.int64(len(x)).tobytes() + x.tobytes() for x in (held.view(np.uint8), low.view(np.uint8), np.minimum(c, 255).astype(np.uint8), over.astype("<i8").view(np.uint8), c[over].astype("<i8").view(np.uint8)))
            yield rows_of([(BIGRAMS, bucket, blob), block(SIZES, bucket, np.arange(2, dtype=np.uint64), np.array([len(c), len(over)], dtype=np.uint64))])
            left = keys >> U64(32)
            head = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
            contexts.add(left[head], *(np.add.reduceat(x, head) for x in (counts, *((counts == i).astype(np.uint64) for i in (1, 2)), (counts >= 3).astype(np.uint64))))
            right, kinds = np.unique(keys & U64(0xFFFFFFFF), return_counts=True)
            endings.add(right, kinds.astype(np.uint64))
            small.append(tally(counts))
        for held, kind in ((contexts, CONTEXTS), (endings, ENDINGS)):
            if arrays := held.take():
                yield from dealt(arrays, (arrays[0] // U64(span)).astype(np.int64), kind)
        if small:
            yield rows_of([block(TALLY, 0, *merge(small))])

    bigrams = settled(texts.mapInArrow(count_bigrams, BLOCKS), merge_bigrams, "bigrams")

    def merge_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, bucket, arrays in gathered(batches):
            yield rows_of([block(kind, bucket, *arrays)])
            if kind == ENDINGS:
                yield rows_of([block(TALLY, 1, *tally(arrays[1])), block(TALLY, 2, np.arange(2, dtype=np.uint64), np.array([arrays[1].sum(), (arrays[1] >= 3).sum()], dtype=np.uint64))])

    statistics = settled(bigrams.where(F.col("kind").isin(CONTEXTS, ENDINGS, TALLY)), merge_statistics, "statistics")
    tallies: dict[int, dict[int, int]] = {0: {}, 1: {}, 2: {}}
    for row in statistics.where(F.col("kind") == TALLY).toLocalIterator():
        for k, n in zip(*(x.tolist() for x in unpack(row["block"]))):
            tallies[row["bucket"]][k] = tallies[row["bucket"]].get(k, 0) + n
    steps, lower = discounts(tallies[0]), discounts(tallies[1])
    all_endings = tallies[2].get(0, 0)

    taken = sum(lower[i] * tallies[1].get(i, 0) for i in (1, 2)) + lower[3] * tallies[2].get(1, 0)
    unknown = taken / all_endings / (types + 1) if all_endings else 1 / (types + 1)
    defaults = {"lower": unknown, "totals": 0.0, "backoffs": 1.0}
    for name in defaults:
        store.make(name, "<f8", types + 1)

    def word_statistics(names: list[str], bucket: int, keys: np.ndarray, values: list[np.ndarray]) -> Iterator[tuple[str, int, np.ndarray]]:
        first = bucket * span
        for name, own in zip(names, values):
            out = np.full(min(span, types + 1 - first), defaults[name])
            out[(keys - U64(first)).astype(np.int64)] = own
            yield name, first, out

    def ending_parts(bucket: int, blob: bytes) -> Iterator[tuple[str, int, np.ndarray]]:
        keys, n = unpack(blob)
        yield from word_statistics(["lower"], bucket, keys, [unknown + (n - lower[np.minimum(n, 3).astype(np.int64)]) / all_endings])

    def context_parts(bucket: int, blob: bytes) -> Iterator[tuple[str, int, np.ndarray]]:
        keys, total, *n = unpack(blob)
        yield from word_statistics(["totals", "backoffs"], bucket, keys, [total, sum(steps[i + 1] * n[i] for i in range(3)) / total])

    for kind, parts, names in ((ENDINGS, ending_parts, ["lower"]), (CONTEXTS, context_parts, ["totals", "backoffs"])):
        blocks = statistics.where(F.col("kind") == kind)
        there = {r["bucket"] for r in blocks.select("bucket").collect()}
        for bucket in set(range(-(-(types + 1) // span))) - there:  # ranges of words that nothing is known of
            for name in names:
                store.put(name, bucket * span, np.full(min(span, types + 1 - bucket * span), defaults[name]))
        store.fill(blocks, parts)
    sizes = sizes_of(bigrams)
    pairs_at, many_at = places(sizes), places(sizes, 1)
    number, many = (sum(x[i] for x in sizes.values()) for i in range(2))
    width = 1 << (bigram_bits - bucket_bits)
    for name, kind, n in (("bigram_starts", "<i8", (1 << bigram_bits) + 1), ("bigrams", "<u4", number), ("bigram_counts", "u1", number), ("many_at", "<i8", many), ("many", "<i8", many)):
        store.make(name, kind, n)

    def bigram_parts(bucket: int, blob: bytes) -> Iterator[tuple[str, int, np.ndarray]]:
        held, low, counts, over, more = (np.frombuffer(x, dtype=t) for x, t in zip(raw_parts(blob), ("<u4", "<u4", "u1", "<i8", "<i8")))
        yield "bigram_starts", bucket * width + 1, pairs_at[bucket] + np.cumsum(held, dtype=np.int64)
        yield "bigrams", pairs_at[bucket], low
        yield "bigram_counts", pairs_at[bucket], counts
        yield "many_at", many_at[bucket], over + pairs_at[bucket]
        yield "many", many_at[bucket], more

    store.fill(bigrams.where(F.col("kind") == BIGRAMS), bigram_parts)
    fill_gaps(store, "bigram_starts", sizes, pairs_at, number, 1 << bucket_bits, width)
    discard(bigrams, statistics)
    return Model(store.reader(spark), tokens, types, word_bits, bigram_bits, steps, unknown)


def sizes_of(blocks: DataFrame) -> dict[int, list[int]]:
    """By bucket: its numbers of entries. Two numbers for each bucket are all that is collected."""
    return {r["bucket"]: unpack(r["block"])[1].tolist() for r in blocks.where(F.col("kind") == SIZES).collect()}


def places(sizes: dict[int, list[int]], which: int = 0) -> dict[int, int]:
    """By bucket: entries in earlier buckets."""
    out, at = {}, 0
    for bucket in sorted(sizes):
        out[bucket] = at
        at += sizes[bucket][which]
    return out


def fill_gaps(store: Store, name: str, sizes: dict[int, list[int]], at: dict[int, int], total: int, buckets: int, width: int) -> None:
    """First positions for buckets that hold nothing: where the next one begins."""
    following = total
    for bucket in range(buckets - 1, -1, -1):
        if bucket in sizes:
            following = at[bucket]
        else:
            store.put(name, bucket * width + 1, np.full(width, following))


def raw_parts(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(blob[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def token_scores(model: Model, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By token: training count, log10 probability of the base model and of this one; and where texts begin."""
    names, first = sentences(words, words.hashes(), END)
    if not model.types:
        return np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names)), first
    files = model.files
    number = word_numbers(files, model.word_bits, names)
    known = number >= 0
    safe = np.where(known, number, 0)
    count = np.where(known, files["word_counts"][safe], 0)
    base = np.log10((count + 1.0) / (model.tokens + model.types + 1))
    lower = np.where(known, files["lower"][safe], model.unknown)
    before = np.empty_like(number)
    before[1:] = number[:-1]
    before[first[:-1]] = model.types
    context = np.maximum(before, 0)
    total = np.where(before >= 0, files["totals"][context], 0)
    key = mix(context.astype(np.uint64) << U64(32) | safe.astype(np.uint64))
    low = (key << U64(model.bigram_bits) >> U64(32)).astype(np.uint32)
    at = find(files["bigrams"], files["bigram_starts"], model.bigram_bits, key, low)
    at = np.where(known & (before >= 0), at, -1)
    pairs = np.where(at >= 0, files["bigram_counts"][np.maximum(at, 0)], 0).astype(np.int64)
    big = np.flatnonzero(pairs == 255)
    if len(big):
        pairs[big] = files["many"][np.searchsorted(files["many_at"], at[big])]
    taken = pairs - model.steps[np.minimum(pairs, 3)]
    seen = total > 0
    p = np.where(seen, taken / np.where(seen, total, 1) + files["backoffs"][context] * lower, lower)
    return count, base, np.log10(p), first


@clash_free
def score(df: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) of every row with _n_tokens, _n_known, _base_score, _score; perplexity is 10 ** (-_score / _n_tokens)."""
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_text"))
    fields = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "_text"):
                names = batch.schema.names
                words = find_words(batch.column(names.index("_text")), lower=True)
                count, base, own, first = token_scores(model, words)
                sums = [np.add.reduceat(x, first[:-1]) for x in ((count > 0).astype(np.int64), base, own)]
                columns = [batch.column(names.index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(first)), *map(pa.array, sums)], names=[*keep, "_n_tokens", "_n_known", "_base_score", "_score"])

    return rows.mapInArrow(run, f"{fields}_n_tokens long, _n_known long, _base_score double, _score double")


def in_fold(ident: Column, folds: int, fold: int) -> Column:
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % folds == fold
