"""Sorted hash arrays: packed for shuffles, stored in files, memory-mapped and searched by workers."""

from __future__ import annotations

import os
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.shared import shared_dir


def squeeze(values: np.ndarray) -> bytes:
    """Byte planes of 64-bit values, compressed: bytes that are mostly zero take next to no room."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def widen(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=8 * n + 1), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel() if n else np.zeros(0, dtype=np.uint64)


def pack(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Ascending keys, as differences, and columns of counts."""
    parts = [squeeze(np.diff(keys, prepend=np.uint64(0)))] + [squeeze(c) for c in columns]
    return struct.pack(f"<{len(parts) + 2}q", len(keys), len(parts), *map(len, parts)) + b"".join(parts)


def unpack(blob: bytes) -> list[np.ndarray]:
    n, parts = struct.unpack_from("<2q", blob)
    sizes = struct.unpack_from(f"<{parts}q", blob, 16)
    at, out = 16 + 8 * parts, []
    for size in sizes:
        out.append(widen(blob[at : at + size], n))
        at += size
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def merge(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Columns summed by key; keys ascend."""
    if len(parts) == 1:
        return parts[0]
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    sums = [np.add.reduceat(np.concatenate([p[c] for p in parts])[order], head) if len(keys) else parts[0][c] for c in range(1, len(parts[0]))]
    return [keys[head], *sums]


class Gatherer:
    """Keys and counts as they come, merged whenever many have come together, to bound memory."""

    def __init__(self, limit: int = 1 << 21):
        self.parts: list[list[np.ndarray]] = []
        self.limit, self.held = limit, 0

    def add(self, *arrays: np.ndarray) -> bool:
        """True if even merged there are more than half the limit: time to pass them on."""
        self.parts.append(list(arrays))
        self.held += len(arrays[0])
        if self.held > self.limit:
            self.parts = [merge(self.parts)]
            self.held = len(self.parts[0][0])
        return self.held > self.limit // 2 and len(self.parts) == 1

    def take(self) -> list[np.ndarray] | None:
        out = merge(self.parts) if self.parts else None
        self.parts, self.held = [], 0
        return out


class Store:
    """Arrays in files that every worker maps, filled part by part in any order.

    They lie in the shared folder where that is a mounted file system: tasks write
    their parts there themselves, each at its own place, so a task that runs again
    writes the same bytes. Where the folder can be reached through Spark only, the
    driver writes the parts to local files and Spark sends these to each executor.
    """

    def __init__(self, spark: SparkSession, label: str, mounted: bool | None = None):
        place = urlparse(shared_dir(spark))
        self.mounted = place.scheme in ("", "file") if mounted is None else mounted
        self.name = f"{label}-{uuid.uuid4().hex}"
        if self.mounted:
            self.folder = os.path.join(place.path, "marlstone", spark.sparkContext.applicationId, self.name)
        else:
            self.folder = os.path.join(tempfile.mkdtemp(prefix="marlstone-"), self.name)
        os.makedirs(self.folder)
        self.kinds: dict[str, str] = {}

    def make(self, name: str, kind: str, size: int) -> None:
        """A file of ``size`` zeros."""
        self.kinds[name] = np.dtype(kind).str
        with open(os.path.join(self.folder, self.file(name)), "wb") as f:
            f.truncate(size * np.dtype(kind).itemsize)

    def put(self, name: str, at: int, values: np.ndarray) -> None:
        """Write ``values`` from place ``at`` on."""
        values = np.ascontiguousarray(values, dtype=self.kinds[name])
        handle = os.open(os.path.join(self.folder, self.file(name)), os.O_WRONLY)
        try:
            data, done = memoryview(values).cast("B"), 0
            while done < len(data):
                done += os.pwrite(handle, data[done:], at * values.itemsize + done)
        finally:
            os.close(handle)

    def fill(self, blocks: DataFrame, parts: Callable[[int, bytes], Iterator[tuple[str, int, np.ndarray]]]) -> None:
        """Put all that ``parts`` (name, place, values) makes of each row (bucket, block)."""

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done = 0
            for batch in batches:
                for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for part in parts(bucket, block):
                        self.put(*part)
                    done += 1
            yield pa.RecordBatch.from_arrays([pa.array([done])], names=["n"])

        blocks = blocks.select("bucket", "block")
        if self.mounted:
            blocks.mapInArrow(write, "n long").agg({"n": "sum"}).collect()
        else:
            for row in blocks.toLocalIterator():
                for part in parts(row["bucket"], bytes(row["block"])):
                    self.put(*part)

    def file(self, name: str) -> str:
        return f"{self.name}-{name}"

    def reader(self, spark: SparkSession) -> Reader:
        if not self.mounted:
            for name in self.kinds:
                spark.sparkContext.addFile(os.path.join(self.folder, self.file(name)))
        return Reader(self.folder if self.mounted else None, {n: (self.file(n), kind) for n, kind in self.kinds.items()})


class Reader:
    """What tasks are given: it maps a file when first asked for it."""

    def __init__(self, folder: str | None, files: dict[str, tuple[str, str]]):
        self.folder, self.files = folder, files

    def __getitem__(self, name: str) -> np.ndarray:
        file, kind = self.files[name]
        if file not in MAPPED:
            if self.folder:
                path = os.path.join(self.folder, file)
            else:
                from pyspark import SparkFiles

                path = SparkFiles.get(file)
            MAPPED[file] = np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.zeros(0, dtype=kind)
        return MAPPED[file]


MAPPED: dict[str, np.ndarray] = {}


def bucket_starts(hashes: np.ndarray, bits: int) -> np.ndarray:
    """First positions of ascending hashes by their leading bits, with an end."""
    return np.concatenate([[0], np.cumsum(np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits))]).astype(np.int64)


def find(stored: np.ndarray, starts: np.ndarray, bits: int, hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions of ``wanted`` among ``stored``, which ascends within buckets of the hashes' leading bits; -1 if absent."""
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    low, high = starts[bucket], starts[bucket + 1]
    end = high
    if not len(stored) or not len(hashes):
        return np.full(len(hashes), -1, dtype=np.int64)
    for _ in range(int((high - low).max()).bit_length()):
        mid = (low + high) >> 1
        less = (stored[np.minimum(mid, len(stored) - 1)] < wanted) & (mid < high)
        low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
    hit = (low < end) & (stored[np.minimum(low, len(stored) - 1)] == wanted)
    return np.where(hit, low, -1)
