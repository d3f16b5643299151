"""Bloom filters over columns of 64-bit numbers, merged by Spark tasks in segments.

A filter lets tasks keep the few rows that may meet another table, before these are shuffled to meet it in an exact join.
One that is too small lets more rows through and changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import batch_of, grouped

SEGMENT = pa.schema([("segment", pa.int64()), ("bits", pa.binary())])
#: Bytes of the filter that are merged as one row.
SEGMENT_BYTES = 1 << 16
#: Odd multipliers, one per bit that a seed sets in the filter.
PROBES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def _bit(seeds: np.ndarray, probe: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte of the filter and mask in it."""
    place = (seeds * np.uint64(probe)) >> np.uint64(64 - bits)
    return (place >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (place & np.uint64(7)).astype(np.uint8))


def _set_bits(batches: Iterable[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    table = np.zeros(1 << (bits - 3), np.uint8)
    for batch in batches:
        seeds = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for probe in PROBES:
            np.bitwise_or.at(table, *_bit(seeds, probe, bits))
    parts = [(n, table[at : at + SEGMENT_BYTES]) for n, at in enumerate(range(0, len(table), SEGMENT_BYTES))]
    parts = [(n, part.tobytes()) for n, part in parts if part.any()]
    if parts:
        yield batch_of(SEGMENT, list(zip(*parts, strict=True)))


def _merge_bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in grouped(batches, ["segment"]):
        merged = None
        for row in group.column("bits"):
            bits = np.frombuffer(row.as_buffer(), np.uint8)
            merged = bits.copy() if merged is None else np.bitwise_or(merged, bits, out=merged)
        yield batch_of(SEGMENT, [[group.column("segment")[0].as_py()], [merged.tobytes()]])


class Filter:
    """A Bloom filter of all seeds; it takes at most 2 ** `most_bits` bits, however many seeds there are."""

    def __init__(self, seeds: DataFrame, most_bits: int):
        # The Spark column `seed` holds each seed's 64 bits as a signed number.
        self.bits = min(most_bits, max(12, (32 * seeds.count()).bit_length()))
        segments = seeds.mapInArrow(partial(_set_bits, bits=self.bits), "segment long, bits binary")
        segments = segments.repartition("segment").sortWithinPartitions("segment")
        self.table = np.zeros(1 << (self.bits - 3), np.uint8)
        for row in segments.mapInArrow(_merge_bits, "segment long, bits binary").collect():
            part = np.frombuffer(row["bits"], np.uint8)
            self.table[row["segment"] * SEGMENT_BYTES :][: len(part)] = part

    def may_hold(self, seeds: np.ndarray) -> np.ndarray:
        """Places of the seeds that may be among those of the filter."""
        found = np.arange(len(seeds))
        for probe in PROBES:
            byte, mask = _bit(seeds[found], probe, self.bits)
            found = found[(self.table[byte] & mask) != 0]
        return found


def among(seen: Filter) -> Callable[[Column], Column]:
    """Whether a key (long, not null) may be in the filter. Only keys travel to Python, not the rows they stand for."""

    @F.arrow_udf("boolean")
    def met(keys: pa.Array) -> pa.Array:
        out = np.zeros(len(keys), bool)
        out[seen.may_hold(keys.to_numpy(zero_copy_only=False).view(np.uint64))] = True
        return pa.array(out)

    return met
