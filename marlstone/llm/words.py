"""Words of Arrow string columns as numpy arrays: no Python object per word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which is the
pattern ``[^\\x20\\x09-\\x0D]+`` on UTF-8 text. Word hashes are 64-bit, equal for
equal words everywhere, and computed eight bytes at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: As above, with ASCII punctuation: for tokens without marks around them.
SPACE_OR_MARK = SPACE.copy()
SPACE_OR_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
#: Masks that keep the first 0 to 8 bytes of a little-endian lane.
KEEP = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=U64)
M1, M2, M3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Words that are hashed at once.
PART = 1 << 18
#: Longer words are hashed one by one; they are rare, and a lane loop over them would be long.
LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * M2
    x ^= x >> U64(27)
    x *= M3
    x ^= x >> U64(31)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a + M1) * M1 + b)


#: By word of a shingle: odd numbers.
STEPS = [U64((2 * k + 1) * int(M1) % (1 << 64)) for k in range(64)]


@dataclass
class Words:
    """Words of some texts: bytes ``start[i]:end[i]`` of ``data`` are word ``i``; text ``t`` has words ``first[t]:first[t+1]``."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    text_start: np.ndarray

    def hashes(self) -> np.ndarray:
        return by_part(lambda a, b: word_hashes(self.data, self.start[a:b], self.end[a:b]), len(self.start))


def by_part(make: Callable[[int, int], np.ndarray], n: int) -> np.ndarray:
    """What ``make`` makes of words ``a`` to ``b``, for all ``n``, some at a time."""
    if n <= PART:
        return make(0, n)
    out = np.empty(n, dtype=U64)
    for a in range(0, n, PART):
        out[a : a + PART] = make(a, min(n, a + PART))
    return out


def text_bytes(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """All texts in one piece of UTF-8 and their offsets; null counts as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return b"", np.zeros(1, dtype=np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return b"", np.zeros(len(texts) + 1, dtype=np.int64)
    return data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes(), at - at[0]


def find_words(texts: pa.Array, lower: bool = False, gaps: np.ndarray = SPACE) -> Words:
    data, offsets = text_bytes(texts)
    if lower:
        data = data.lower()  # of bytes: A-Z only
    codes = np.frombuffer(data, dtype=np.uint8)
    inside = ~gaps[codes]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(codes))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, offsets), offsets)


def word_hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    out = mix(size.astype(U64) + M1)
    if not len(size):
        return out
    lanes = np.ndarray((len(data) + 1,), dtype="<u8", buffer=data + bytes(9), strides=(1,))
    top = int(min(size.max(), LONG_WORD))
    active, at, left = None, start, size
    for _ in range(0, top, 8):
        lane = lanes[at] & KEEP[np.minimum(left, 8)]
        if active is None:
            out = mix(out ^ lane) * M1
        else:
            out[active] = mix(out[active] ^ lane) * M1
        go = left > 8
        active = np.flatnonzero(go) if active is None else active[go]
        at, left = at[go] + 8, left[go] - 8
        if not len(active):
            break
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = U64(xxhash.xxh3_64_intdigest(data[start[i] : end[i]]))
    return out


def prefix_hashes(words: Words, size: int) -> np.ndarray:
    """A hash of the first ``size`` bytes (8 at most) of each word; shorter words hash as they are."""
    lanes = np.ndarray((len(words.data) + 1,), dtype="<u8", buffer=words.data + bytes(9), strides=(1,))
    return by_part(lambda a, b: mix((lanes[words.start[a:b]] & KEEP[np.minimum(words.end[a:b] - words.start[a:b], size)]) + U64(size)), len(words.start))


#: Bytes of text that numpy works on at once: what is made for so many words stays in a core's cache.
PIECE = 1 << 20


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``size`` consecutive words of a text (all words of a shorter one), text by text, and where texts begin."""
    names, count = words.hashes(), np.diff(words.first)
    n = len(names) - size + 1
    whole = np.zeros(max(n, 0), dtype=U64)
    for k in range(size if n > 0 else 0):
        whole += names[k : k + n] * STEPS[k]
    short = np.flatnonzero((count > 0) & (count < size))
    at, _, first = shingle_words(words, size)
    out = np.zeros(len(at), dtype=U64)
    inside = np.ones(len(at), dtype=bool)
    inside[first[short]] = False
    out[inside] = whole[at[inside]]
    for k in range(size - 1):
        some = short[count[short] > k]
        out[first[some]] += names[words.first[some] + k] * STEPS[k]
    return mix(out), first


def shingle_words(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word of every shingle, text by text, and where texts begin. A text of fewer words is one shingle, an empty one none."""
    count = np.diff(words.first)
    sizes = np.where(count < size, np.minimum(count, 1), count - size + 1)
    first = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(words.first[:-1] - first[:-1], sizes) + np.arange(first[-1])
    return at, at + np.repeat(np.minimum(count, size), sizes) - 1, first


def space_joined(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The bytes of all words with one space after each, and where words begin and end in them."""
    codes = np.frombuffer(words.data, dtype=np.uint8)
    if not len(words.start) or (np.diff(np.append(words.start, words.end[-1] + 1)) == words.end - words.start + 1).all() and (codes[words.end[:-1]] == 0x20).all():
        return words.data, words.start, words.end
    size = words.end - words.start
    end = np.cumsum(size + 1) - 1
    start = end - size
    out = np.full(int(end[-1]) + 1, 0x20, dtype=np.uint8)
    inside = np.ones(len(out), dtype=bool)
    inside[end] = False
    taken = np.zeros(len(codes) + 1, dtype=np.int8)
    taken[words.start] = 1
    taken[words.end] -= 1
    out[inside] = codes[np.cumsum(taken[:-1], dtype=np.int8).view(bool)]
    return out.tobytes(), start, end


# fixed values: the primes of XXH64
P1, P2, P3, P4, P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << U64(bits) | x >> U64(64 - bits)


def xxh64(data: bytes, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of stretches of ``data``, those of one size at a time."""
    out = np.empty(len(start), dtype=U64)
    padded = data + bytes(9)
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    fours = np.ndarray((len(data) + 1,), dtype="<u4", buffer=padded, strides=(1,))
    ones = np.frombuffer(padded, dtype=np.uint8)
    order = np.argsort(np.minimum(size, LONG_WORD + 1).astype(np.uint16), kind="stable")
    edges = np.flatnonzero(np.diff(np.minimum(size[order], LONG_WORD + 1), prepend=-1, append=-1))
    step = lambda held, lane: turned(held + lane * P2, 31) * P1
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        which = order[a:b]
        at, n = start[which], int(size[which[0]])
        if n > LONG_WORD:
            out[which] = [xxhash.xxh64_intdigest(data[x : x + y], seed) for x, y in zip(at.tolist(), size[which].tolist())]
            continue
        if n >= 32:
            held = [np.full(len(at), U64((seed + int(x)) % (1 << 64))) for x in (int(P1) + int(P2), P2, 0, -int(P1))]
            for _ in range(n // 32):
                held = [step(x, eights[at + 8 * i]) for i, x in enumerate(held)]
                at = at + 32
            h = turned(held[0], 1) + turned(held[1], 7) + turned(held[2], 12) + turned(held[3], 18)
            for x in held:
                h = (h ^ step(U64(0), x)) * P1 + P4
        else:
            h = np.full(len(at), U64((seed + int(P5)) % (1 << 64)))
        h = h + U64(n)
        for _ in range(n % 32 // 8):
            h = turned(h ^ step(U64(0), eights[at]), 27) * P1 + P4
            at = at + 8
        if n % 8 >= 4:
            h = turned(h ^ fours[at].astype(U64) * P1, 23) * P2 + P3
            at = at + 4
        for _ in range(n % 4):
            h = turned(h ^ ones[at].astype(U64) * P5, 11) * P1
            at = at + 1
        h = (h ^ h >> U64(33)) * P2
        h = (h ^ h >> U64(29)) * P3
        out[which] = h ^ h >> U64(32)
    return out


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of the batch of whole rows with about ``limit`` bytes of text each, to bound memory."""
    column_index = batch.schema.get_field_index(column)
    sizes = pc.binary_length(batch.column(column_index)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    row = 0
    while row < batch.num_rows:
        base = ends[row] - sizes[row]
        stop = max(row + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(row, stop - row)
        row = stop


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:]) if step < len(out) else out[:0]
        done += step
    return out
