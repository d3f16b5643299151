"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

1. Each document becomes token ids, closed by one end id, and pieces of at most `capacity` ids.
2. Only the counts per piece length decide the plan, at most `capacity` numbers whatever the corpus. Exact complements
   come first: for each length, from the longest down, the gap to the capacity is looked up among the sums of one, two
   and three available lengths, and such combinations are consumed as often as the counts allow. What is left is
   packed best-fit, longest first. Equal pieces are placed together, so the plan is a short list of runs.
3. Every piece has a rank among the pieces of its length; rank and run give sequence and offset.

Ranks are taken within hashed slices of a length and shifted by the sizes of the slices before, so that a crowded length
is no single task's work.

Null text is an empty document (one piece: the end id). Repeated rows are packed each for itself, an empty table gives an
empty result, and columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import through_storage
from .text import batch_of, bytes_of, chunks, ship

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Words remembered by a worker; the memory is emptied when full.
REMEMBERED = 250_000
SLICE_ROWS = 2_000

# Latin letters whose lower case is one letter and which are their own normal form, then ASCII signs other than "'".
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in that byte-level vocabularies use for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordIds(dict):
    """Token ids of space-separated words, as little-endian bytes, filled by the tokenizer at the first sight of a word.

    The tokenizer never joins text across white space, so a document's ids are those of its words in a row. Plain
    words skip the normaliser: their lower case goes to the tokenizer's model at once, letters and signs apart.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        found = _PLAIN.fullmatch(word)
        if found is None:
            ids = self._whole(word)
        else:
            core, signs = found[1].lower(), found[2]
            if core == word:
                spelt = core if core.isascii() else "".join(map(self.letters.__getitem__, core.encode()))
                ids = np.array([t.id for t in self.model.tokenize(spelt)], "<u4").tobytes()
            else:
                ids = self[core] + (self[signs] if signs else b"")
        self[word] = ids
        return ids


_WORD_IDS: dict[str, WordIds] = {}
_SPLIT = re.compile(r"[\x20\t-\r]+")


def _pieces(batches: Iterable[pa.RecordBatch], tokenizer: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    known = _WORD_IDS.get(tokenizer) or _WORD_IDS.setdefault(tokenizer, WordIds(tokenizer))
    ids_of = known.__getitem__
    end = np.array([end_id], "<u4").tobytes()
    for batch in chunks(batches, "text"):
        data, _ = bytes_of(batch.column(1))
        # str.split() also splits at U+001C to U+001F, which the tokenizer keeps.
        split = _SPLIT.split if ((data >= 0x1C) & (data <= 0x1F)).any() else str.split
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = b"".join([ids_of(w) for w in split(text) if w]) + end
            n = len(ids) // 4
            for piece, start in enumerate(range(0, n, capacity)):
                part = ids[4 * start : 4 * (start + capacity)]
                rows.append((doc, piece, start, len(part) // 4, zlib.crc32(part)))
        yield batch_of(PIECES, list(zip(*rows, strict=True)) if rows else [[]] * 5)
        if len(known) > REMEMBERED:
            known.clear()


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length, ids_crc32."""
    ship(docs.sparkSession)
    run = partial(_pieces, tokenizer=tokenizer, capacity=capacity, end_id=end_id)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Run(NamedTuple):
    """Pieces of one length with ranks from `first` on: `each` of them in every one of `sequences` sequences in a row."""

    length: int
    first: int
    sequences: int
    each: int
    sequence: int
    offset: int


def plan(counts: dict[int, int], capacity: int = 2048) -> list[Run]:
    """Runs that place every piece once; the number of runs depends on the capacity, not on the number of pieces."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    used, runs, sequence = Counter(), [], 0

    def place(pattern: list[tuple[int, int]], times: int) -> None:
        nonlocal sequence
        offset = 0
        for length, each in pattern:
            runs.append(Run(length, used[length], times, each, sequence, offset))
            used[length] += times * each
            left[length] -= times * each
            offset += length * each
        sequence += times

    def consume(*lengths: int) -> None:
        each = Counter(lengths)
        times = min(int(left[length]) // n for length, n in each.items())
        if times > 0:
            place(sorted(each.items(), reverse=True), times)

    if left[capacity]:
        place([(capacity, 1)], int(left[capacity]))
    for length in range(capacity - 1, (capacity - 1) // 2, -1):
        if left[length]:
            consume(length, capacity - length)

    def pairs(total: int, least: int, most: int) -> np.ndarray:
        """The smaller parts of available pairs with this sum."""
        small = np.arange(max(least, total - most), total // 2 + 1)
        return small[(left[small] > 0) & (left[total - small] > 0)] if len(small) else small

    for length in range(capacity - 2, (capacity - 1) // 3, -1):
        gap = capacity - length
        for small in pairs(gap, 1, min(length, gap - 1)) if left[length] else ():
            consume(length, gap - int(small), int(small))
            if not left[length]:
                break
    for length in range(capacity - 3, (capacity - 1) // 4, -1):
        gap = capacity - length
        for least in range(max(1, gap - 2 * length), gap // 3 + 1) if left[length] else ():
            if not left[least]:
                continue
            for small in pairs(gap - least, least, min(length, gap - 2 * least)):
                consume(length, gap - least - int(small), int(small), least)
            if not left[length]:
                break

    # Best fit, longest first. Sequences with the same content so far are kept as one entry with their number.
    open_gaps: list[int] = []
    by_gap: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}

    def keep(gap: int, pattern: list[tuple[int, int]], times: int) -> None:
        if times:
            if gap not in by_gap:
                by_gap[gap] = []
                insort(open_gaps, gap)
            by_gap[gap].append((pattern, times))

    for length in range(capacity - 1, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(open_gaps, length)
            if at < len(open_gaps):
                gap = open_gaps[at]
                pattern, times = by_gap[gap].pop()
                if not by_gap[gap]:
                    del by_gap[gap], open_gaps[at]
            else:
                gap, pattern = capacity, []
                times = -(-n // (capacity // length))
            each = gap // length
            full = min(times, n // each)
            keep(gap - each * length, [*pattern, (length, each)], full)
            n -= full * each
            if full < times:
                if n:
                    keep(gap - n * length, [*pattern, (length, n)], 1)
                keep(gap, pattern, times - full - bool(n))
                n = 0
    for entries in by_gap.values():
        for pattern, times in entries:
            if pattern:
                place(pattern, times)
    return sorted(runs)


def _place(batches: Iterable[pa.RecordBatch], runs: list[Run]) -> Iterator[pa.RecordBatch]:
    length, first, _, each, sequence, offset = (np.array(x, np.int64) for x in zip(*runs, strict=True))
    keys = (length << 48) | first
    for batch in batches:
        own, rank = (batch.column(i).to_numpy() for i in (3, 5))
        at = np.searchsorted(keys, (own << 48) | rank, side="right") - 1
        among = rank - first[at]
        placed = [sequence[at] + among // each[at], offset[at] + among % each[at] * own]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:5], *map(pa.array, placed)], names=[f.split()[0] for f in PLACED.split(", ")]
        )


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (gapless from 0)."""
    cut = through_storage(pieces(docs, tokenizer, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return cut.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    slices = max(16, sum(counts.values()) // SLICE_ROWS)
    cut = cut.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)))
    within = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("length", "slice").agg(F.count("*").alias("n"))
    shifts = sizes.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    ranked = cut.withColumn("row", F.row_number().over(within) - 1).join(shifts, ["length", "slice"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("row") + F.col("shift")).alias("rank"))
    return ranked.mapInArrow(partial(_place, runs=plan(counts, capacity)), PLACED)
