"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item are compared as sequences of tokens (lower-cased runs without white space and ASCII
punctuation). Running Karp-Rabin hashes of `least` tokens give the seeds that the two share; seeds on one diagonal
grow into maximal matches. The longest match whose tokens are still free on both sides becomes a tile; a match that
has lost tokens to earlier tiles goes back with its free parts of at least `least` tokens. This repeats until no match
is left, so moved and reordered passages are found too. A document is contaminated by an item if tiles cover at least
`coverage` of the item's tokens, or if one tile has `passage` tokens, however long the item is. Of equally long matches the
one that starts first in the item, then in the document, becomes a tile first.

Items with fewer than `least` tokens, which any text may hold by chance, contaminate the documents that consist of them:
the sequence of such a text is its only seed. Equal 64-bit seeds count as equal tokens.

The benchmark is a table of items with their seeds; it never passes through the driver. A Bloom filter of its seeds, of
at most 2 ** `most_bits` bits, goes to all tasks, and one pass over the documents keeps the few places whose seed may
be in the benchmark; a filter that is too small lets more through and changes no result. These places meet the items'
seeds in a join, and are gathered by document and item, so the largest group is one document's places. Neither copies
nor passages that many documents share are compared in one task.

Seeds that repeat in a very long text and in an item are expanded in parts of `PART` pairs, of which only the ends of
matches stay. Null text, like text without tokens, is empty and matches nothing. Repeated rows of either table each
count for themselves. Empty tables give an empty result. Only the ids and texts of both tables are read; other columns
may have any names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.sources.sinks import through_storage

from .membership import Filter
from .text import SPACES, Words, chunks, free_names, ship

RESULT = "n_tiles long, tiled_tokens long, item_tokens long, coverage double"
ITEM = pa.schema([("item_id", pa.int64()), ("item_tokens", pa.int64()), ("item_seeds", pa.list_(pa.int64()))])
#: Pairs of places that are held at a time.
PART = 1 << 20

GAPS = np.zeros(256, bool)
GAPS[list(SPACES)] = True
GAPS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True


class _Seeds:
    """The seeds of many texts: `values`, the text `of` each and its place there; `tokens` per text."""

    def __init__(self, texts: pa.Array, least: int):
        words = Words(pc.utf8_lower(texts), GAPS)
        hashes = words.hashes(1)
        at, values = words.windows(hashes, least)
        of = words.texts[at]
        self.tokens = words.counts
        short = np.flatnonzero((self.tokens > 0) & (self.tokens < least))
        of = np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        self.of = of[order]
        self.values = np.concatenate([values, words.whole(hashes)[short]])[order]
        self.places = np.concatenate([at, words.first[short]])[order] - words.first[self.of]


def _lists(of: np.ndarray, n: int, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list per text from the values of all texts, sorted by text."""
    offsets = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values).cast(kind))


def _items(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        seeds = _Seeds(batch.column("text"), least)
        listed = _lists(seeds.of, batch.num_rows, seeds.values.view(np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(seeds.tokens, pa.int64()), listed], schema=ITEM)


def _hits(batches: Iterable[pa.RecordBatch], seen: Filter, least: int, keys: int) -> Iterator[pa.RecordBatch]:
    """Documents with the seeds that may be in the benchmark and their places."""
    for batch in chunks(batches, "text"):
        seeds = _Seeds(batch.column("text"), least)
        found = seen.may_hold(seeds.values)
        if not len(found):
            continue
        of = seeds.of[found]
        some = np.unique(of)
        rows = np.searchsorted(some, of)
        columns = [batch.column(i).take(pa.array(some)) for i in range(keys)]
        columns.append(_lists(rows, len(some), seeds.values[found].view(np.int64), pa.int64()))
        columns.append(_lists(rows, len(some), seeds.places[found], pa.int32()))
        names = [*batch.schema.names[:keys], "seeds", "places"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def matches(item: np.ndarray, seeds: np.ndarray, places: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal matches (length, start in item, start in document) from an item's seeds and the shared ones of a document.

    `item` holds the seed of each place of the item; a document's `seeds` come with their places, in ascending order.
    """
    order = np.argsort(item, kind="stable")
    low, high = (np.searchsorted(item[order], seeds, side) for side in ("left", "right"))
    upto = np.concatenate([[0], np.cumsum(high - low)])
    # The seeds next to each place of the document, where its neighbour is shared too.
    beside = places[1:] == places[:-1] + 1
    before, after = np.zeros((2, len(places)), bool)
    before[1:] = after[:-1] = beside
    firsts, lasts = [], []
    done = 0
    while done < len(seeds):
        stop = max(int(np.searchsorted(upto, upto[done] + PART, "right")) - 1, done + 1)
        row = np.repeat(np.arange(done, stop), (high - low)[done:stop])
        i = order[np.arange(upto[done], upto[stop]) - upto[row] + low[row]]
        shift = places[row] - i
        joined = before[row] & (i > 0)
        joined[joined] = seeds[row[joined] - 1] == item[i[joined] - 1]
        firsts.append((shift[~joined], i[~joined]))
        joined = after[row] & (i < len(item) - 1)
        joined[joined] = seeds[row[joined] + 1] == item[i[joined] + 1]
        lasts.append((shift[~joined], i[~joined]))
        done = stop
    ends = []
    for part in (firsts, lasts):
        shift, i = (np.concatenate(column) for column in zip(*part, strict=True))
        ends.append((shift, i, np.lexsort((i, shift))))
    (shift, i, first), (_, j, last) = ends
    start = i[first]
    return j[last] - start + least, start, start + shift[first]


def _runs(free: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Start and length of all runs of at least `least` free places."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
    for start, stop in edges.reshape(-1, 2).tolist():
        if stop - start >= least:
            yield start, stop - start


def tiles(item: np.ndarray, seeds: np.ndarray, places: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, start in item, start in document) of an item and a document that share seeds."""
    if not len(seeds):
        return []
    length, i, j = matches(item, seeds, places, least)
    order = np.lexsort((j, i, -length))
    shift = int(j.min())
    free_item, free_doc = np.ones(len(item) + least - 1, bool), np.ones(int((j + length).max()) - shift, bool)
    again: list[tuple[int, int, int]] = []
    out, at = [], 0
    while at < len(order) or again:
        whole = order[at] if at < len(order) else None
        best = None if whole is None else (-int(length[whole]), int(i[whole]), int(j[whole]))
        if best is None or again and again[0] < best:
            best = heapq.heappop(again)
        else:
            at += 1
        size, a, b = -best[0], best[1], best[2]
        free = free_item[a : a + size] & free_doc[b - shift : b - shift + size]
        if free.all():
            out.append((size, a, b))
            free_item[a : a + size] = free_doc[b - shift : b - shift + size] = False
            if not any(_runs(free_item, least)):
                break
            continue
        for start, run in _runs(free, least):
            heapq.heappush(again, (-run, a + start, b + start))
    return out


def _tiled(batches: Iterable[pa.RecordBatch], keys: int, least: int, coverage: float, passage: int) -> Iterator[pa.RecordBatch]:
    """Pairs that are contaminated, from pairs that share a seed."""
    for batch in batches:
        item_seeds, shared = batch.column("item_seeds"), batch.column("shared")
        picked, rows = [], []
        for row, tokens in enumerate(batch.column("item_tokens").to_pylist()):
            item = item_seeds[row].values.to_numpy()
            seeds, places = (shared[row].values.field(name).to_numpy(zero_copy_only=False) for name in ("seed", "place"))
            if tokens < least:
                found = [(tokens, 0, 0)]
            else:
                alike = int(np.isin(item, seeds).sum())
                if least * alike < coverage * tokens and alike <= passage - least:
                    continue  # even tiles that overlap nowhere could not cover enough, and none is long enough
                order = np.argsort(places)
                found = tiles(item, seeds[order], places[order].astype(np.int64), least)
            covered = sum(size for size, _, _ in found)
            if covered >= coverage * tokens or found and max(found)[0] >= passage:
                picked.append(row)
                rows.append((len(found), covered, tokens, covered / tokens))
        if rows:
            ids = [batch.column(k).take(pa.array(picked)) for k in range(keys + 1)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
            told = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            names = [*batch.schema.names[: keys + 1], "n_tiles", "tiled_tokens", "item_tokens", "coverage"]
            yield pa.RecordBatch.from_arrays([*ids, *told], names=names)


def _pairs(
    docs: DataFrame, benchmark: DataFrame, least: int, coverage: float, passage: int, most_bits: int
) -> DataFrame:
    """Contaminated pairs of the rows of `docs` (columns of type long, then the text) and the items."""
    ship(docs.sparkSession)
    keys = docs.columns[:-1]
    kinds = "".join(f"{k} long, " for k in keys)
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    items = texts.mapInArrow(partial(_items, least=least), "item_id long, item_tokens long, item_seeds array<long>")
    # Numbers tell repeated rows apart; once written they are the same for all that follows.
    items = through_storage(items.where("item_tokens > 0").withColumn("item", F.monotonically_increasing_id()), "items")
    owned = items.select("item", F.explode("item_seeds").alias("seed")).distinct()
    seen = Filter(owned.select("seed").distinct(), most_bits)
    hits = docs.mapInArrow(
        partial(_hits, seen=seen, least=least, keys=len(keys)), f"{kinds}seeds array<long>, places array<int>"
    )
    hits = through_storage(hits.withColumn("doc", F.monotonically_increasing_id()), "hits")
    places = hits.select("doc", *keys, F.explode(F.arrays_zip("seeds", "places")).alias("at"))
    places = places.select("doc", *keys, F.col("at.seeds").alias("seed"), F.col("at.places").alias("place"))
    shared = places.join(owned, "seed").groupBy("doc", *keys, "item").agg(F.collect_list(F.struct("seed", "place")).alias("shared"))
    pairs = shared.join(items, "item").select(*keys, "item_id", "item_tokens", "item_seeds", "shared")
    run = partial(_tiled, keys=len(keys), least=least, coverage=coverage, passage=passage)
    return pairs.mapInArrow(run, f"{kinds}item_id long, {RESULT}")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    least: int = 5,
    coverage: float = 0.6,
    passage: int = 50,
    most_bits: int = 27,
) -> DataFrame:
    """Pairs of a contaminated document and an item: doc_id, item_id, n_tiles, tiled_tokens, item_tokens, coverage."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _pairs(rows, benchmark, least, coverage, passage, most_bits)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    least: int = 5,
    coverage: float = 0.6,
    passage: int = 50,
    most_bits: int = 27,
) -> DataFrame:
    """The rows of `docs`, with all their columns, that no item contaminates.

    Two hashes of the text stand for it, so rows that share an id are judged apart, and the documents meet only two
    numbers for each contaminated text.
    """
    marks = free_names(docs.columns, 2)
    text = F.coalesce("text", F.lit(""))
    marked = docs.withColumns({marks[0]: F.xxhash64(text), marks[1]: F.xxhash64(F.lit(1), text)})
    found = _pairs(marked.select(*marks, "text"), benchmark, least, coverage, passage, most_bits)
    found = through_storage(found.select(*marks).distinct(), "contaminated-texts")
    return marked.join(found, marks, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
