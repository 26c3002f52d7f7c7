"""Packing of token ids into training sequences.

Each task packs the documents of its own partition in buffers of bounded size, so
nothing is shuffled and no task sees more than a buffer at once. Sequence numbers
hold the partition's number in their upper bits; a task that runs again makes the
same sequences.

``pack_tiers``: hierarchical packing to several lengths. A document goes to the
shortest tier that holds it (whole windows are cut off first); each tier opens a
window for each of its pieces, longest first, and fills the gap with the best
fitting pieces of shorter tiers, cutting one where none fits. Windows are exactly
full; what a task has left in the end, less than a window, is cut to sequences of
powers of two, which may be shorter than the least tier, so that nothing is padded.

``pack_best_fit``: best-fit-decreasing packing into windows of one length. A
segment tree over free capacities finds the fullest window that a piece fits in.
Only documents longer than a window are cut. Rows are windows of padded ids with
cumulative segment lengths and positions that restart with each segment.

Edge cases: null and empty texts are just the end id. Repeated rows and null ids
are packed like any others. An empty table gives no sequences.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marlstone.llm.shared import clash_free
from marlstone.llm.tokenizing import encoder
from marlstone.llm.words import pieces

END = 1
CONTEXT = 2048
LEAST_TIER = 256
BUFFER_TOKENS = 1 << 20
STEP_CONTEXTS = 16

#: A piece of a document: length, document number in the buffer, first token.
Piece = tuple[int, int, int]


def fill_tiers(lengths: list[int], context: int, least: int, carried: list[Piece] = ()) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full sequences (tier, pieces) and the pieces left over. Document ``i`` has ``lengths[i]`` tokens; ``carried`` pieces come first."""
    out, pool = [], list(carried)
    for doc, n in enumerate(lengths):
        whole = n - n % context
        out += [(context, [(context, doc, at)]) for at in range(0, whole, context)]
        if n > whole:
            pool.append((n - whole, doc, whole))
    pool.sort()
    tier = context
    while pool:
        while tier > least and pool[-1][0] * 2 <= tier:
            tier //= 2
        size, doc, at = pool.pop()
        used, gap = [(size, doc, at)], tier - size
        while gap and pool:
            k = bisect_right(pool, gap, key=lambda p: p[0])
            if k:
                used.append(pool.pop(k - 1))
            else:
                n, doc, at = pool.pop(0)
                used.append((gap, doc, at))
                insort(pool, (n - gap, doc, at + gap))
            gap -= used[-1][0]
        if gap:
            return out, used
        out.append((tier, used))
    return out, []


def powers(left: list[Piece]) -> list[tuple[int, list[Piece]]]:
    """The pieces in sequences of powers of two, longest first."""
    total = sum(n for n, _, _ in left)
    out, queue = [], list(left)[::-1]
    for bit in range(total.bit_length() - 1, -1, -1):
        if not total >> bit & 1:
            continue
        room, used = 1 << bit, []
        while room:
            n, doc, at = queue.pop()
            take = min(n, room)
            used.append((take, doc, at))
            if n > take:
                queue.append((n - take, doc, at + take))
            room -= take
        out.append((1 << bit, used))
    return out


def balanced(sizes: list[int], budget: int) -> list[int]:
    """A group for each sequence; groups hold about ``budget`` tokens and differ by one sequence at most."""
    groups = max(1, round(sum(sizes) / budget))
    heap = [(0, g) for g in range(groups)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        held, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (held + sizes[i], g))
    return out


class Capacities:
    """A segment tree over free capacities: the least capacity that holds a piece, in logarithmic time."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def change(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def least_holding(self, size: int) -> int | None:
        node = self.leaves + size
        if self.count[node]:
            return size
        while node > 1:  # up, until the subtree to the right holds something
            if not node & 1 and self.count[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return None
        while node < self.leaves:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.leaves


def fill_best(lengths: list[int], context: int) -> list[list[Piece]]:
    parts = [(min(context, n - at), doc, at) for doc, n in enumerate(lengths) for at in range(0, n, context)]
    parts.sort(key=lambda p: (-p[0], p[1], p[2]))
    tree, free, out = Capacities(context), {}, []
    for part in parts:
        capacity = tree.least_holding(part[0])
        if capacity is None:
            number, capacity = len(out), context
            out.append([])
        else:
            number = free[capacity].pop()
            tree.change(capacity, -1)
        out[number].append(part)
        if capacity > part[0]:
            free.setdefault(capacity - part[0], []).append(number)
            tree.change(capacity - part[0], 1)
    return out


def buffers(batches: Iterator[pa.RecordBatch], keep: list[str], path: str, limit: int, end: int) -> Iterator[tuple[list[tuple], list[np.ndarray], bool]]:
    """Kept values and ids of documents, about ``limit`` tokens at a time; the last buffer is marked."""
    encode = encoder(path)
    rows: list[tuple] = []
    ids: list[np.ndarray] = []
    held = 0
    for whole in batches:
        for batch in pieces(whole, "_text"):
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in keep]
            for i, text in enumerate(batch.column(batch.schema.get_field_index("_text"))):
                one = np.append(encode(text.as_py() or ""), np.uint32(end))
                rows.append(tuple(c[i] for c in columns))
                ids.append(one)
                held += len(one)
                if held >= limit:
                    yield rows, ids, False
                    rows, ids, held = [], [], 0
    yield rows, ids, True


def numbered() -> int:
    return TaskContext.get().partitionId() << 33


@clash_free
def pack_tiers(
    df: DataFrame, tokenizer: str, *, text_col: str = "text", keep: list[str] | None = None, context: int = CONTEXT, least: int = LEAST_TIER,
    end: int = END, buffer_tokens: int = BUFFER_TOKENS, step_contexts: int = STEP_CONTEXTS,
) -> DataFrame:
    """One row per piece: ``keep`` columns (default: all), _start, _length, _ids (little-endian 32-bit), _doc_tokens, _sequence_id, _offset, _tier, _step."""
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_text"))
    kinds = [to_arrow_type(rows.schema[c].dataType) for c in keep]
    fields = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    names = [*keep, "_start", "_length", "_ids", "_doc_tokens", "_sequence_id", "_offset", "_tier", "_step"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = step = numbered()
        left: list[tuple[tuple, np.ndarray, Piece]] = []  # kept values, ids and piece
        for values, ids, last in buffers(batches, keep, tokenizer, buffer_tokens, end):
            carried = [(n, len(values) + k, at) for k, (_, _, (n, _, at)) in enumerate(left)]
            lengths = [len(x) for x in ids]
            values, ids = values + [x[0] for x in left], ids + [x[1] for x in left]
            full, rest = fill_tiers(lengths, context, least, carried)
            left = [(values[doc], ids[doc], (n, doc, at)) for n, doc, at in rest]
            if last:
                full += powers(rest)
            if not full:
                continue
            groups = balanced([tier for tier, _ in full], step_contexts * context)
            out = []
            for (tier, used), group in zip(full, groups):
                offset = 0
                for n, doc, at in used:
                    out.append((*values[doc], at, n, ids[doc][at : at + n].astype("<u4").tobytes(), len(ids[doc]), sequence, offset, tier, step + group))
                    offset += n
                sequence += 1
            step += max(groups) + 1
            types = [*kinds, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return rows.mapInArrow(run, f"{fields}_start long, _length long, _ids binary, _doc_tokens long, _sequence_id long, _offset long, _tier int, _step long")


def pack_best_fit(
    df: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, end: int = END, pad: int = 0, buffer_tokens: int = BUFFER_TOKENS
) -> DataFrame:
    """One row per window: sequence_id, ids (binary row of ``context`` little-endian 32-bit ids), n_tokens, cu_seqlens, position_ids (binary), doc_ids, doc_starts."""
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    id_type, id_kind = rows.schema["_id"].dataType.simpleString(), to_arrow_type(rows.schema["_id"].dataType)
    names = ["sequence_id", "ids", "n_tokens", "cu_seqlens", "position_ids", "doc_ids", "doc_starts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = numbered()
        for values, ids, _ in buffers(batches, ["_id"], tokenizer, buffer_tokens, end):
            full = fill_best([len(x) for x in ids], context)
            for begin in range(0, len(full), 256):
                out = []
                for used in full[begin : begin + 256]:
                    matrix, positions = np.full(context, pad, dtype="<u4"), np.zeros(context, dtype="<u4")
                    edges = np.concatenate([[0], np.cumsum([n for n, _, _ in used])])
                    for a, (n, doc, at) in zip(edges, used):
                        matrix[a : a + n] = ids[doc][at : at + n]
                        positions[a : a + n] = np.arange(n)
                    out.append((sequence, matrix.tobytes(), int(edges[-1]), edges.tolist(), positions.tobytes(), [values[d][0] for _, d, _ in used], [at for _, _, at in used]))
                    sequence += 1
                types = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.list_(id_kind), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    schema = f"sequence_id long, ids binary, n_tokens int, cu_seqlens array<int>, position_ids binary, doc_ids array<{id_type}>, doc_starts array<long>"
    return rows.mapInArrow(run, schema)


def write_matrices(packed: DataFrame, path: str, *, rows: int = 256) -> None:
    """Write windows as Parquet, one record per matrix of up to ``rows`` windows: ids and positions row by row, segment lengths one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                get = lambda name: part.column(part.schema.get_field_index(name)).to_pylist()
                edges = get("cu_seqlens")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([get("sequence_id")]), pa.array([b"".join(get("ids"))], pa.binary()), pa.array([b"".join(get("position_ids"))], pa.binary()), pa.array([edges], pa.list_(pa.list_(pa.int32())))],
                    names=["sequence_ids", "ids", "position_ids", "cu_seqlens"],
                )

    packed.mapInArrow(run, "sequence_ids array<long>, ids binary, position_ids binary, cu_seqlens array<array<int>>").write.parquet(path)
