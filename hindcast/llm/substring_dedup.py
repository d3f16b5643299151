"""Removal of word windows that occur more than once in a corpus, behind a count-min prefilter.

Texts are first put into a table of chunks, a few MB of whole documents each; a chunk is written once and keeps its number.

1. Sketch. Every window holds a representative gram: of its word 18-grams the one with the smallest hash. Equal windows
   have equal representatives, so the number of places of a gram is at least the number of any window it stands for.
   Each chunk counts its representatives in a sparse sketch; the sketches are merged block by block (the hash space is
   cut into blocks, so no task and no broadcast holds the whole sketch) into a count-min sketch of two rows.
   A chunk gets back one bit per gram: estimated once, or repeated.
2. Exact count. Only windows whose representative is estimated repeated send their 96-bit hash, once per chunk, to be
   grouped exactly; the chunk gets back one bit per window. An estimate is never too small, so no repeat is lost.
3. Words covered by repeated windows are removed, chunk by chunk.

Chunks send each hash at most once, so a passage that a third of all documents share is one entry per chunk, and all
blocks are of even size whatever the texts hold. Both exchanges carry packed arrays and bits, not rows per window.

Null text has no words. Repeated rows repeat each other's windows. A text shorter than a window is kept whole. An empty
table gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import through_storage
from .text import Words, batch_of, chunks, rolling, ship

CHUNK = 2 << 20
#: Bytes of text for which the sketch and the exact count get one block more.
BLOCK_TEXT = 32 << 20
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
TEXTS = pa.schema([("doc_id", pa.int64()), ("kept", pa.string())])
SENT = pa.schema([("block", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary())])


def _write_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 32
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for i, batch in enumerate(chunks(batches, "text", CHUNK)):
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, batch.schema, options=options) as stream:
            stream.write_batch(batch)
        yield pa.RecordBatch.from_arrays(
            [pa.array([first + i]), pa.array([batch.nbytes]), pa.array([out.getvalue().to_pybytes()], pa.binary())],
            names=["chunk", "n_bytes", "blob"],
        )


def chunk_table(docs: DataFrame) -> DataFrame:
    """Whole documents in rows of a few MB: chunk (its number), n_bytes, blob (a compressed Arrow stream)."""
    packed = docs.select("doc_id", "text").mapInArrow(_write_chunks, "chunk long, n_bytes long, blob binary")
    return through_storage(packed, "chunks")


def _sliding(values: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """pick over values[i : i + size] for every i."""
    done, out = 1, values
    while 2 * done <= size:
        out = pick(out[: len(out) - done], out[done:])
        done *= 2
    return pick(out[: len(out) - (size - done)], out[size - done :]) if done < size else out


class _Chunk:
    """The documents of a chunk, and the hashes that its windows and their representatives have."""

    def __init__(self, blob: bytes, size: int, gram: int):
        self.docs = pa.ipc.open_stream(blob).read_next_batch()
        self.words = Words(self.docs.column(1))
        self.size, self.gram = size, gram
        self.hashes = self.words.hashes(1)
        inner = size - gram + 1
        self.starts, self.first_hash = self.words.windows(self.hashes, size)
        self.least = np.zeros(0, np.uint64)
        grams = np.zeros(0, np.uint64)
        if len(self.starts):
            # Grams over the end of a text are never looked at: a window lies within one text, and so do its grams.
            values = np.maximum(rolling(self.hashes, gram), np.uint64(1))  # 0 marks grams that stand for no window
            self.least = _sliding(values, inner, np.minimum)[self.starts]
            reached = np.zeros(len(values) + inner - 1, np.uint64)
            reached[self.starts + inner - 1] = self.least
            grams = values[_sliding(reached, inner, np.maximum) == values]
        self.grams, counts = np.unique(grams, return_counts=True)
        self.known = counts > 1

    def suspected(self, estimated: np.ndarray) -> np.ndarray:
        """Which windows have a representative that is estimated repeated."""
        if not len(self.starts):
            return np.zeros(0, bool)
        return (estimated | self.known)[np.searchsorted(self.grams, self.least)]

    def keys(self, suspected: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """96-bit keys of the suspected windows, each once, in order; the key of each such window; repeated here."""
        first = self.first_hash[suspected]
        second = (self.words.windows(self.words.hashes(2), self.size)[1][suspected] >> np.uint64(32)).astype(np.uint32)
        return _distinct(first, second)


def _distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((second, first))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0)
    keys = np.zeros(int(new.sum()), [("first", "<u8"), ("second", "<u4")])
    keys["first"], keys["second"] = first[order][new], second[order][new]
    which = np.zeros(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return keys, which, np.bincount(which, minlength=len(keys)) > 1


def _by_block(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """Where each block begins among sorted hashes."""
    of = ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    return np.searchsorted(of, np.arange(blocks + 1, dtype=np.uint64))


def _send(chunk: int, hashes: np.ndarray, keys: np.ndarray, blocks: int) -> pa.RecordBatch:
    edges = _by_block(hashes, blocks)
    full = np.flatnonzero(np.diff(edges))
    parts = [keys[edges[b] : edges[b + 1]].tobytes() for b in full]
    return batch_of(SENT, [full, np.full(len(full), chunk), parts])


def _told(answers: list, hashes: np.ndarray, blocks: int) -> np.ndarray:
    """The bits that came back for the sorted hashes."""
    out = np.zeros(len(hashes), bool)
    edges = _by_block(hashes, blocks)
    for answer in answers or ():
        start, stop = edges[answer["block"]], edges[answer["block"] + 1]
        out[start:stop] = np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=stop - start)
    return out


def _sketch(batches, size: int, gram: int, blocks: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob"), strict=True):
            grams = _Chunk(blob.as_py(), size, gram).grams
            yield _send(chunk, grams, grams.astype(np.uint32), blocks)


def _answer(frame: pd.DataFrame, repeated: np.ndarray, sizes: list[int]) -> pd.DataFrame:
    parts = np.split(repeated, np.cumsum(sizes)[:-1])
    bits = [np.packbits(p).tobytes() for p in parts]
    return pd.DataFrame({"chunk": frame["chunk"], "block": frame["block"], "bits": bits})


def _estimate(frame: pd.DataFrame) -> pd.DataFrame:
    """Merge the sketches of one block; the answer of a cell is the smaller count of its two rows."""
    keys = np.frombuffer(b"".join(frame["keys"]), "<u4")
    bits = max(10, (4 * len(keys)).bit_length())
    rows = [(keys * np.uint32(odd)) >> np.uint32(max(32 - bits, 0)) for odd in (0x9E3779B1, 0x85EBCA77)]
    least = np.minimum(*(np.bincount(row)[row] for row in rows))
    return _answer(frame, least > 1, [len(k) // 4 for k in frame["keys"]])


def _suspects(batches, size: int, gram: int, sketch_blocks: int, blocks: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            chunk = _Chunk(row["blob"], size, gram)
            suspected = chunk.suspected(_told(row["answers"], chunk.grams, sketch_blocks))
            keys, _, _ = chunk.keys(suspected)
            yield _send(row["chunk"], keys["first"], keys, blocks)


def _count(frame: pd.DataFrame) -> pd.DataFrame:
    """Which keys of one block come from more than one chunk."""
    keys = np.frombuffer(b"".join(frame["keys"]), [("first", "<u8"), ("second", "<u4")])
    _, which, repeated = _distinct(keys["first"], keys["second"])
    return _answer(frame, repeated[which], [len(k) // 12 for k in frame["keys"]])


def _cover(batches, size: int, gram: int, sketch_blocks: int, blocks: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            chunk = _Chunk(row["blob"], size, gram)
            suspected = chunk.suspected(_told(row["answers"], chunk.grams, sketch_blocks))
            keys, which, here = chunk.keys(suspected)
            repeated = (_told(row["counted"], keys["first"], blocks) | here)[which]
            yield _kept(chunk, chunk.starts[suspected][repeated], texts)


def _kept(chunk: _Chunk, starts: np.ndarray, texts: bool) -> pa.RecordBatch:
    """What is left of each document once the words of the windows at `starts` are gone."""
    words = chunk.words
    n = len(words)
    change = np.bincount(starts, minlength=n + 1) - np.bincount(starts + chunk.size, minlength=n + 1)
    keep = np.cumsum(change)[:n] == 0
    removed = np.concatenate([[0], np.cumsum(~keep)])[words.first]
    # The kept words' bytes, and a space before each kept word but the first of its document.
    kept = np.flatnonzero(keep)
    step = np.zeros(len(words.data) + 1, np.int8)
    step[words.starts[kept]] += 1
    step[words.ends[kept]] -= 1
    shown = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    of = words.texts[kept]
    later = np.flatnonzero(of[1:] == of[:-1]) + 1
    spaces = words.starts[kept[later]] - 1
    data = words.data.copy()
    data[spaces] = 0x20
    shown[spaces] = True
    ends = np.concatenate([[0], np.cumsum(shown)])[words.offsets]
    out = memoryview(data[shown].tobytes())
    left = [out[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    ids = chunk.docs.column(0)
    if texts:
        return batch_of(TEXTS, [ids, [str(x, "utf-8") for x in left]])
    return batch_of(RESULT, [ids, words.counts, np.diff(removed), [hashlib.sha256(x).hexdigest() for x in left]])


def _answers(sent: DataFrame, merge, name: str) -> DataFrame:
    merged = sent.groupBy("block").applyInPandas(merge, "chunk long, block long, bits binary")
    return merged.groupBy("chunk").agg(F.collect_list(F.struct("block", "bits")).alias(name))


def _passes(docs: DataFrame, size: int, gram: int, texts: bool, schema: str) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    table = chunk_table(docs)
    n_bytes = table.agg(F.sum("n_bytes")).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // BLOCK_TEXT)
    how = {"size": size, "gram": gram}
    sketches = table.select("chunk", "blob").mapInArrow(partial(_sketch, blocks=blocks, **how), "block long, chunk long, keys binary")
    answers = through_storage(_answers(sketches, _estimate, "answers"), "estimated")
    told = table.select("chunk", "blob").join(answers, "chunk", "left")
    how["sketch_blocks"] = blocks
    suspects = told.mapInArrow(partial(_suspects, blocks=blocks, **how), "block long, chunk long, keys binary")
    counted = through_storage(_answers(suspects, _count, "counted"), "counted")
    return told.join(counted, "chunk", "left").mapInArrow(partial(_cover, blocks=blocks, texts=texts, **how), schema)


def repeated_windows(docs: DataFrame, size: int = 35, gram: int = 18) -> DataFrame:
    """doc_id, n_words, n_removed, and kept_sha256 of the kept words joined by one space, one row per document."""
    return _passes(docs, size, gram, False, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, size: int = 35, gram: int = 18) -> DataFrame:
    """doc_id and `kept`, the text that is left of each document."""
    return _passes(docs, size, gram, True, "doc_id long, kept string")
