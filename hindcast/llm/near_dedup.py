"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

Shingles are `words` consecutive words; a shorter text is one shingle. A shingle weighs its count in the text times
1 + min(1, ln(N / df) / ln(1 / share)): full weight for shingles in at most `share` of the N texts, down to half of it
for one that stands in every text. So only shingles more frequent than that need a document frequency, and there are at
most (mean shingles of a text) / share of them, whatever N is.

1. Frequent shingles. A shingle in `share` of all texts is in half that share of the texts of some part at least; parts
   report such shingles, the few survivors are counted exactly over all texts.
2. Samples. 64 consistent weighted samples per text (Ioffe 2010). Heavy texts are thinned first: on level l > 0 a shingle
   of weight w stays if its hash, as a number from 0 to 1, is under w / 2^(l + 1), and then weighs at least 2^(l + 1). A text
   whose partners may be one level up has samples on both levels. Equal texts are one from here on.
3. Bands of four samples. Texts that share a band and agree in at least `agree` of the samples are linked in a
   candidate graph; per band only one link per text leaves the task. Its connected components are the candidate groups.
4. Inside a candidate group, pairs with enough agreement that are not yet in one class are verified by their weighted
   Jaccard similarity over all shingles, `similar` or more. Classes are the components of the verified links.

Bands and groups beyond `block` members are cut into blocks, and every pair of blocks is a task's work of bounded size,
so that no pair is skipped and no task holds an unbounded group. No pairs are written: only links of a text to the
smallest text of its class.

Null text has no words; all texts without words are equal. Rows with equal text share a class; the class id is the
smallest doc_id in it. Rows that share an id share their class. Rows without an id form no class id (null). Empty tables
give an empty result; only the id and the text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import through_storage
from .components import components
from .membership import Filter, among
from .text import Words, batch_of, chunks, free_names, grouped, mix, ship

SAMPLES, BAND = 64, 4
#: Texts lighter than twice this are sampled over all their shingles.
LIGHT = 256.0
BLOCK = 1024
#: A filter of keys takes at most 2 ** this many bits.
MOST_BITS = 27
COUNTS = pa.schema([("shingle", pa.int64()), ("texts", pa.int64()), ("excess", pa.float64())])
ENTRIES = pa.schema(
    [
        ("doc_id", pa.int64()), ("key1", pa.int64()), ("key2", pa.int64()), ("entry", pa.int32()), ("weight", pa.float64()),
        ("samples", pa.binary()), ("bands", pa.list_(pa.int64())),
    ]
)
ENTRY = "doc_id long, key1 long, key2 long, entry int, weight double, samples binary, bands array<long>"
STARS = pa.schema([("u", pa.int64()), ("v", pa.int64())])
VECTORS = pa.schema([("doc_id", pa.int64()), ("root", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary()), ("weights", pa.binary())])
VECTOR = "doc_id long, root long, n long, hashes binary, weights binary"


class Frequent:
    """The frequent shingles and what a shingle weighs."""

    def __init__(self, n: int, share: float, counted: dict[int, int]):
        self.hashes = np.array(sorted(counted), np.uint64)
        log = math.log(1 / share)
        self.idf = np.array([1 + min(1.0, max(0.0, math.log(n / counted[int(h)])) / log) for h in self.hashes])
        self.bits = min(22, max(12, (16 * len(self.hashes)).bit_length()))
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[self._low(self.hashes)] = True

    def _low(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of frequent shingles among `hashes`, and which ones they are."""
        at = np.flatnonzero(self.maybe[self._low(hashes)])
        if not len(at) or not len(self.hashes):
            return at[:0], at[:0]
        which = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        hit = self.hashes[which] == hashes[at]
        return at[hit], which[hit]

    def weigh(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        weights = counts * 2.0
        at, which = self.find(hashes)
        weights[at] = counts[at] * self.idf[which]
        return weights


class Texts:
    """The distinct shingles of each text of a batch, sorted, with their counts; `edges` is where each text's begin."""

    def __init__(self, texts: pa.Array, words: int):
        found = Words(texts)
        hashes = found.hashes(1)
        n = found.counts
        # A text of fewer words counts as one shingle: all its words.
        own = found.whole(hashes)
        at, shingles = found.windows(hashes, words)
        per = np.maximum(n - words + 1, 0)
        ends = np.concatenate([[0], np.cumsum(per)]).tolist()
        parts, counts, sizes = [], [], []
        for i, short in enumerate(((n > 0) & (n < words)).tolist()):
            part = np.sort(shingles[ends[i] : ends[i + 1]]) if not short else own[i : i + 1]
            if len(part):
                new = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                counts.append(np.diff(np.append(new, len(part))))
                part = part[new]
                parts.append(part)
            sizes.append(len(part))
        self.hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.keys = own, found.whole(found.hashes(2))


def _report(batches: Iterable[pa.RecordBatch], words: int, share: float) -> Iterator[pa.RecordBatch]:
    """Shingles in at least half of `share` of the texts of a part, and by how many texts they exceed that."""
    held, texts, size = [], 0, 0

    def report() -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64),) * 2
        excess = counts.astype(float) - share / 2 * texts
        ok = excess >= 0
        return batch_of(COUNTS, [found[ok].view(np.int64), counts[ok].astype(np.int64), excess[ok]])

    for batch in chunks(batches, "text"):
        held.append(Texts(batch.column(1), words).hashes)
        texts += batch.num_rows
        size += len(held[-1])
        if size > 2_000_000 and texts > 1000 or size > 8_000_000:
            yield report()
            held, texts, size = [], 0, 0
    yield report()


def _count(batches: Iterable[pa.RecordBatch], words: int, suspects: Frequent) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(suspects.hashes), np.int64)
    for batch in chunks(batches, "text"):
        _, which = suspects.find(Texts(batch.column(1), words).hashes)
        total += np.bincount(which, minlength=len(total))
    ok = total > 0
    yield batch_of(COUNTS, [suspects.hashes[ok].view(np.int64), total[ok], np.zeros(int(ok.sum()))])


def frequent_shingles(docs: DataFrame, words: int, share: float) -> Frequent:
    """Exact document frequencies of all shingles in more than `share` of the texts."""
    n = docs.count()
    kind = "shingle long, texts long, excess double"
    reported = docs.select("doc_id", "text").mapInArrow(partial(_report, words=words, share=share), kind)
    likely = reported.groupBy("shingle").agg(F.sum("excess").alias("excess"))
    rows = likely.where(F.col("excess") >= share / 2 * n - 1e-6 * max(n, 1)).select("shingle").collect()
    unsigned = lambda x: x & (1 << 64) - 1
    suspects = Frequent(1, share, {unsigned(r["shingle"]): 1 for r in rows})
    counted = docs.select("doc_id", "text").mapInArrow(partial(_count, words=words, suspects=suspects), kind)
    rows = counted.groupBy("shingle").agg(F.sum("texts").alias("df")).where(F.col("df") > share * n).collect()
    return Frequent(max(n, 1), share, {unsigned(r["shingle"]): r["df"] for r in rows})


def _gamma_two(n: int) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2: where 1 - (1 + x) exp(-x) is (i + 1/2) / n."""
    goal = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        middle = (low + high) / 2
        under = 1 - (1 + middle) * np.exp(-middle) < goal
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return high


_GAMMA: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _GAMMA:
        _GAMMA["r"] = _gamma_two(1 << 12).astype(np.float32)
        _GAMMA["ln_c"] = np.log(_gamma_two(1 << 16)).astype(np.float32)
    return _GAMMA["r"], _GAMMA["ln_c"]


def consistent_samples(hashes: np.ndarray, weights: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """SAMPLES weighted samples of each of the sets between `edges` (none empty), as 32-bit hashes of (shingle, t).

    Per shingle and sample, r and c are gamma distributed and b is uniform, all drawn from the shingle's hash:
    t = floor(ln(w) / r + b), ln y = r (t - b), ln a = ln c - ln y - r; the shingle of the smallest a is the sample.
    """
    r_table, ln_c_table = _tables()
    ln_w = np.log(weights).astype(np.float32)
    out = np.zeros((len(edges) - 1, SAMPLES), np.uint32)
    place = np.arange(len(hashes), dtype=np.int64)
    odd = np.random.default_rng(11).integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for k in range(SAMPLES):
        bits = hashes * odd[k]
        bits ^= bits >> np.uint64(29)
        bits *= np.uint64(0xBF58476D1CE4E5B9)
        r = r_table[(bits >> np.uint64(52)).view(np.int64)]
        b = ((bits >> np.uint64(36)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(ln_w / r + b)
        ln_a = ln_c_table[((bits >> np.uint64(20)) & np.uint64(0xFFFF)).view(np.int64)] - r * (t - b) - r
        # Positive floats sort like their bits, so the minimum of (a, place) finds the place.
        packed = ((ln_a + np.float32(1000)).view(np.int32).astype(np.int64) << 32) | place
        at = np.minimum.reduceat(packed, edges[:-1]) & 0xFFFFFFFF
        out[:, k] = (mix(hashes[at] + t[at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    return out


def levels_of(weight: float, similar: float) -> list[int]:
    """The level of a text, and the next one if a heavier text similar to it may stand there."""
    level = lambda w: max(0, math.floor(math.log2(max(w, 1.0) / LIGHT)))
    return list(range(level(weight), level(weight / similar * (1 + 1e-9)) + 1))


def thinned(hashes: np.ndarray, weights: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the shingles that stay on a level, and their weights there. The expected total stays the same."""
    if not level:
        return np.arange(len(hashes)), weights
    point = (mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(11)) * 2.0**-53
    unit = 2.0 ** (level + 1)
    places = np.flatnonzero(point * unit < weights)
    return places, np.maximum(weights[places], unit)


class Sampled:
    """Weights and samples of the texts of a batch: one entry per text and level."""

    def __init__(self, texts: Texts, frequent: Frequent, similar: float):
        weights = frequent.weigh(texts.hashes, texts.counts)
        self.total = np.diff(np.concatenate([[0.0], np.cumsum(weights)])[texts.edges])
        self.rows: list[tuple[int, int]] = []
        parts = []
        for i, (a, b) in enumerate(zip(texts.edges[:-1].tolist(), texts.edges[1:].tolist(), strict=True)):
            for level in levels_of(float(self.total[i]), similar) if a < b else ():
                places, own = thinned(texts.hashes[a:b], weights[a:b], level)
                if len(places):
                    self.rows.append((i, level))
                    parts.append((texts.hashes[a:b][places], own))
        self.samples = np.zeros((0, SAMPLES), np.uint32)
        if parts:
            edges = np.concatenate([[0], np.cumsum([len(h) for h, _ in parts])]).astype(np.int64)
            self.samples = consistent_samples(*(np.concatenate(x) for x in zip(*parts, strict=True)), edges)

    def bands(self) -> np.ndarray:
        levels = np.array([level for _, level in self.rows], np.uint64)
        out = np.zeros((len(self.rows), SAMPLES // BAND), np.int64)
        for b in range(out.shape[1]):
            h = levels * np.uint64(64) + np.uint64(b)
            for k in range(b * BAND, b * BAND + BAND):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + self.samples[:, k])
            out[:, b] = h.view(np.int64)
        return out


def _entries(batches, words: int, similar: float, frequent: Frequent) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        texts = Texts(batch.column(1), words)
        sampled = Sampled(texts, frequent, similar)
        bands = sampled.bands().tolist()
        ids = batch.column(0).to_pylist()
        key1, key2 = (k.view(np.int64).tolist() for k in texts.keys)
        seen: dict[int, int] = {}
        rows = []
        for (i, _), samples, own in zip(sampled.rows, sampled.samples, bands, strict=True):
            seen[i] = seen.get(i, -1) + 1
            rows.append((ids[i], key1[i], key2[i], seen[i], float(sampled.total[i]), samples.tobytes(), own))
        rows += [(ids[i], key1[i], key2[i], 0, float(sampled.total[i]), b"", []) for i in range(len(ids)) if i not in seen]
        yield batch_of(ENTRIES, list(zip(*rows, strict=True)) if rows else [[]] * 7)


def _of_shared_bands(batches: Iterable[pa.RecordBatch], seen: Filter) -> Iterator[pa.RecordBatch]:
    """Texts with the bands that others may share; `bands` is the last column."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        of, bands = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists).to_numpy()
        found = seen.may_hold(bands.view(np.uint64))
        some, rows = np.unique(of[found], return_inverse=True)
        ends = np.searchsorted(rows, np.arange(len(some) + 1)).astype(np.int32)
        kept = batch.take(pa.array(some, pa.int64())).columns[:-1]
        yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[found]))], names=batch.schema.names)


class _Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)


def _stars(ids: np.ndarray, union: _Union) -> pa.RecordBatch:
    """Links of each text to the smallest of its set; `ids` are sorted."""
    roots = np.array([union.find(i) for i in range(len(ids))])
    own = np.flatnonzero(roots != np.arange(len(ids)))
    return batch_of(STARS, [ids[own], ids[roots[own]]])


def _agreeing(batches, agree: float, similar: float) -> Iterator[pa.RecordBatch]:
    """Per band, links between texts whose samples agree."""
    for group in grouped(batches, ["band", "low", "high"]):
        group = group.sort_by("doc_id")
        ids, weight = group["doc_id"].to_numpy(), group["weight"].to_numpy()
        samples = np.frombuffer(b"".join(group["samples"].to_pylist()), np.uint32).reshape(len(ids), SAMPLES)
        union = _Union(len(ids))
        for i in range(len(ids) - 1):
            same = np.count_nonzero(samples[i + 1 :] == samples[i], axis=1) >= agree * SAMPLES
            near = np.minimum(weight[i + 1 :], weight[i]) >= similar * np.maximum(weight[i + 1 :], weight[i]) * (1 - 1e-9)
            for j in np.flatnonzero(same & near).tolist():
                union.join(i, i + 1 + j)
        yield _stars(ids, union)


def _vectors(batches, words: int, frequent: Frequent) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        texts = Texts(batch.column(1), words)
        weights = frequent.weigh(texts.hashes, texts.counts)
        spans = list(zip(texts.edges[:-1].tolist(), texts.edges[1:].tolist(), strict=True))
        rows = [[x[a:b].tobytes() for a, b in spans] for x in (texts.hashes, weights)]
        yield batch_of(VECTORS, [batch.column(0), batch.column(2), batch.column(3), *rows])


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller weights over sum of the larger ones; shingles are sorted."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = float(np.minimum(a[1][i], b[1][j]).sum())
    most = float(a[1].sum() + b[1].sum()) - least
    return least / most if most else 1.0


def _verify(batches, agree: float, similar: float) -> Iterator[pa.RecordBatch]:
    """Per group, verified links. Pairs of one class already are not compared again."""
    for group in grouped(batches, ["root", "low", "high"]):
        group = group.sort_by("doc_id")
        ids = group["doc_id"].to_numpy()
        hashes = [np.frombuffer(x, np.uint64) for x in group["hashes"].to_pylist()]
        weights = [np.frombuffer(x, np.float64) for x in group["weights"].to_pylist()]
        total = np.array([w.sum() for w in weights])
        samples = _Levels(hashes, weights, total, similar)
        union = _Union(len(ids))
        for i in range(len(ids) - 1):
            near = np.minimum(total[i + 1 :], total[i]) >= similar * np.maximum(total[i + 1 :], total[i]) * (1 - 1e-9)
            some = i + 1 + np.flatnonzero(near)
            if len(ids) > 32:  # for few texts comparing them is cheaper than choosing
                some = some[samples.agreement(i, some) >= agree]
            for j in some.tolist():
                if union.find(i) != union.find(j):
                    if weighted_jaccard((hashes[i], weights[i]), (hashes[j], weights[j])) >= similar - 1e-12:
                        union.join(i, j)
        yield _stars(ids, union)


class _Levels:
    """Samples of a group's texts on their own level and on the next, to compare texts on a common one."""

    def __init__(self, hashes: list, weights: list, total: np.ndarray, similar: float):
        n = len(hashes)
        if n <= 32:
            return
        self.level = np.array([levels_of(float(t), similar)[0] for t in total])
        self.at = []
        for up in (0, 1):
            out = np.zeros((n, SAMPLES), np.uint32)
            kept, rows = [], []
            for i in range(n):
                places, own = thinned(hashes[i], weights[i], int(self.level[i]) + up)
                if len(places):
                    kept.append((hashes[i][places], own))
                    rows.append(i)
            if rows:
                edges = np.concatenate([[0], np.cumsum([len(h) for h, _ in kept])]).astype(np.int64)
                out[rows] = consistent_samples(*(np.concatenate(x) for x in zip(*kept, strict=True)), edges)
            self.at.append(out)

    def agreement(self, i: int, others: np.ndarray) -> np.ndarray:
        step = self.level[others] - self.level[i]
        out = np.zeros(len(others))
        for own, other, when in ((0, 0, step == 0), (1, 0, step == 1), (0, 1, step == -1)):
            rows = others[when]
            out[when] = np.count_nonzero(self.at[other][rows] == self.at[own][i], axis=1) / SAMPLES
        return out


def _in_blocks(rows: DataFrame, n: str) -> DataFrame:
    """Each row once for every pair of blocks it belongs to (once in all for a group of one block): low, high."""
    blocks = F.ceil(F.col(n) / BLOCK).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.select("*", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).drop("own", "other")


def _in_groups(rows: DataFrame, key: str, run: Callable, schema: str) -> DataFrame:
    keys = [key, "low", "high"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, words: int = 5, similar: float = 0.8, share: float = 0.01, agree: float = 0.5) -> DataFrame:
    """doc_id, class_id (the smallest id among its near duplicates) and kept (it is that one), one row per document."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    frequent = frequent_shingles(docs, words, share)
    run = partial(_entries, words=words, similar=similar, frequent=frequent)
    entries = through_storage(docs.mapInArrow(run, ENTRY), "samples")
    # One text of equal ones; ids are compared first, so all entries of a text come from the same row.
    unnamed = F.col("doc_id").isNull().alias("unnamed")
    first = F.min(F.struct(unnamed, "doc_id", "weight", "samples", "bands")).alias("s")
    texts = entries.groupBy("key1", "key2", "entry").agg(first).select("key1", "key2", "entry", "s.*")
    texts = through_storage(texts.drop("unnamed"), "texts")
    banded = texts.where("doc_id IS NOT NULL").select("doc_id", "entry", F.explode("bands").alias("band"))
    shared = through_storage(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "bands")
    # Only what may meet is shuffled to meet: texts in a shared band, then documents in a candidate group.
    likely = texts.where("doc_id IS NOT NULL").select("doc_id", "entry", "weight", "samples", "bands")
    seen = Filter(shared.select(F.col("band").alias("seed")), MOST_BITS)
    likely = likely.mapInArrow(partial(_of_shared_bands, seen=seen), "doc_id long, entry int, weight double, samples binary, bands array<long>")
    likely = through_storage(likely, "likely")
    members = likely.select("doc_id", "entry", F.explode("bands").alias("band")).join(shared, "band")
    members = members.join(likely.select("doc_id", "entry", "weight", "samples"), ["doc_id", "entry"])
    members = _in_blocks(members.select("band", "n", "doc_id", "weight", "samples"), "n")
    agreeing = _in_groups(members, "band", partial(_agreeing, agree=agree, similar=similar), "u long, v long")
    groups = components(agreeing)
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"))
    groups = through_storage(groups.join(sizes, "root").select(F.col("node").alias("doc_id"), "root", "n"), "groups")
    met = among(Filter(groups.select(F.col("doc_id").alias("seed")), MOST_BITS))
    candidates = docs.where("doc_id IS NOT NULL").where(met(F.col("doc_id").cast("long")))
    # Equal rows would fill a block with copies of one text.
    vectors = candidates.join(groups, "doc_id").select("doc_id", "text", "root", "n").distinct()
    vectors = _in_blocks(vectors.mapInArrow(partial(_vectors, words=words, frequent=frequent), VECTOR), "n")
    verified = _in_groups(vectors, "root", partial(_verify, agree=agree, similar=similar), "u long, v long")
    classes = components(verified)
    copies = texts.where("entry = 0").select("key1", "key2", F.col("doc_id").alias("node"))
    named = copies.join(classes, "node", "left").select("key1", "key2", F.coalesce("root", "node").alias("class_id"))
    named = through_storage(named, "classes")
    rows = entries.where("entry = 0").select("doc_id", "key1", "key2").join(named, ["key1", "key2"])
    return rows.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs`, with all their columns, without near duplicates: one row of each class stays.

    Classes are those of the texts, whatever ids their rows have: of two texts under one id each is judged for itself.
    The row with the smallest id stays; of rows with that id and different texts or other columns, one by their hashes;
    of fully equal rows, one. Rows without an id stay only if their class has no other. Columns may have any names.
    """
    one, content = free_names(docs.columns, 2)
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    # A hash of the row and its text stands for the id, so that ids play no part in the classes and copies differ.
    keyed = docs.withColumn(content, F.xxhash64(*plain)).withColumn(one, F.xxhash64(content, F.coalesce("text", F.lit(""))))
    texts = near_duplicates(keyed.select(F.col(one).alias("doc_id"), "text"), **how)
    classes = texts.select(F.col("doc_id").alias(one), F.col("class_id").alias("class")).distinct()
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col(content).alias("row"))
    rows = keyed.select(one, order.alias("at")).groupBy(one, "at").agg(F.count("*").alias("n"))
    rows = through_storage(rows.join(classes, one).select("class", "at", "n"), "rows-of-classes")
    first = rows.groupBy("class").agg(F.min("at").alias("first"))
    # One number per row that goes is all that the documents have to meet, and only those that may be such a row do.
    goes = rows.join(first, "class").where("at.row <> first.row").select(F.col("at.row").alias(content)).distinct()
    goes = through_storage(goes, "going")
    repeated = through_storage(rows.where("n > 1").select(F.col("at.row").alias(content)), "repeated-rows")
    seen = Filter(goes.unionAll(repeated).select(F.col(content).alias("seed")), MOST_BITS)

    met = among(seen)
    stay, kept = keyed.where(~met(content)), keyed.where(met(content)).join(goes, content, "left_anti")
    if not repeated.isEmpty():
        once = kept.join(repeated, content, "left_semi").dropDuplicates([content])
        kept = kept.join(repeated, content, "left_anti").unionByName(once)
    kept = stay.unionByName(kept)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
