"""Texts as byte arrays: words, their hashes and the hashes of word windows, many texts at a time.

A word is a run of characters other than space and U+0009 to U+000D. All of these are single bytes in UTF-8, so
words are found in the bytes that Arrow hands over, without a Python object for each word.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SPACES = bytes((0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D))
CHUNK_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application, whatever folder they start in."""
    context = spark.sparkContext
    if getattr(context, "_hindcast_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = os.path.join(tempfile.mkdtemp(prefix="hindcast-"), "hindcast_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, Path(package.name, path.relative_to(package)))
    context.addPyFile(archive)
    context._hindcast_shipped = True


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about `limit` bytes of `column`, so that working memory depends on neither batch nor file size.

    A longer text is a slice of its own. Null texts become empty ones. A worker is used again by later tasks: what earlier
    batches took is given back to the system, not kept for it.
    """
    pool = pa.default_memory_pool()
    for batch in batches:
        pool.release_unused()
        at = batch.schema.get_field_index(column)
        texts = batch.column(at)
        if texts.null_count:
            texts = pc.fill_null(texts, "")
            batch = batch.set_column(at, batch.schema.field(at), texts)
        ends = offsets_of(texts)
        start = 0
        while start < len(texts):
            stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), len(texts))
            yield batch.slice(start, stop - start)
            start = stop


def offsets_of(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.zeros(1, np.int64)
    found = np.frombuffer(texts.buffers()[1], kind)
    return found[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each text begins (one entry more than texts)."""
    offsets = offsets_of(texts)
    buffer = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, extended as longer inputs come."""

    base = 0x9FB21C651E98DF25
    up = down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = n + (256 << 10)
            cls.up = cls._grow(cls.base, size)
            cls.down = cls._grow(pow(cls.base, -1, 1 << 64), size)
        return cls.up[:n], cls.down[:n]

    @staticmethod
    def _grow(base: int, size: int) -> np.ndarray:
        out = np.ones(size, np.uint64)
        done = 1
        while done < size:
            more = min(done, size - done)
            np.multiply(out[:more], np.uint64(pow(base, done, 1 << 64)), out=out[done : done + more])
            done += more
        return out


_TABLES: dict[int, np.ndarray] = {}


def _table(seed: int) -> np.ndarray:
    """A random number per byte value."""
    if seed not in _TABLES:
        _TABLES[seed] = np.random.default_rng(seed).integers(1, 2**64, 256, dtype=np.uint64)
    return _TABLES[seed]


def running(values: np.ndarray) -> np.ndarray:
    """Sums of values[i] * base^i over all places before each place, modulo 2^64."""
    total = np.zeros(len(values) + 1, np.uint64)
    if len(values):
        np.multiply(values, _Powers.reach(len(values))[0], out=total[1:])
        np.cumsum(total[1:], out=total[1:])
    return total


def shifted(sums: np.ndarray, places: np.ndarray | slice, n: int) -> np.ndarray:
    """Sums of spans that begin at `places`, as if each span began at 0; mixed."""
    return mix(sums * _Powers.reach(n)[1][places])


def byte_sums(data: np.ndarray, seed: int) -> np.ndarray:
    return running(_table(seed)[data])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Words:
    """Where the words of each text lie: `starts` and `ends` in bytes; text i has words first[i] to first[i + 1]."""

    def __init__(self, texts: pa.Array, gaps: np.ndarray | None = None):
        self.data, self.offsets = bytes_of(texts)
        n = len(self.data)
        if gaps is None:
            gaps = np.zeros(256, bool)
            gaps[list(SPACES)] = True
        inside = ~gaps[self.data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edge = self.offsets[:-1]
        edge = edge[edge < n]
        begins[edge] = inside[edge]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edge = self.offsets[1:] - 1
        edge = edge[edge >= 0]
        last[edge] = inside[edge]
        self.inside = inside
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, seed: int = 1) -> np.ndarray:
        """A 64-bit hash of each word's bytes; seeds give independent hashes."""
        total = byte_sums(self.data, seed)
        return shifted(total[self.ends] - total[self.starts], self.starts, len(total))

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of `size` words inside one text, and a 64-bit hash of each window."""
        text = self.texts
        at = np.flatnonzero(text[: max(len(text) - size + 1, 0)] == text[size - 1 :])
        return at, rolling(hashes, size)[at]

    def whole(self, hashes: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the word sequence of each text."""
        total = running(hashes)
        own = total[self.first[1:]] - total[self.first[:-1]]
        return mix(shifted(own, self.first[:-1], len(total)) + self.counts.astype(np.uint64))


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of hashes[i : i + size] for every i, whatever texts they belong to."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = running(hashes)
    return shifted(total[size:] - total[:n], slice(0, n), len(total))


def grouped(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from batches sorted by them; runs may go over batches."""
    held: list[pa.RecordBatch] = []
    last = None
    pool = pa.default_memory_pool()
    for batch in batches:
        if not batch.num_rows:
            continue
        pool.release_unused()
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        new[0] = last is not None and tuple(c[0] for c in columns) != last
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        start = 0
        for at in np.flatnonzero(new).tolist():
            if at > start:
                held.append(batch.slice(start, at - start))
            yield pa.Table.from_batches(held)
            held, start = [], at
        held.append(batch.slice(start))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def free_names(columns: Iterable[str], n: int) -> list[str]:
    """Names that none of `columns` has."""
    taken = {c.lower() for c in columns}
    return [name for name in (f"own_{i}" for i in range(n + len(taken))) if name not in taken][:n]
