"""Jaccard join of documents over their n-grams, as a blocked sparse matrix product.

A document's set holds its different shingles of `words` consecutive words, A-Z in lower case; a shorter text is one
shingle, all its words. Two documents are linked if their sets are alike by `percent` or more of their union.

The overlaps of all pairs are the product of the document by n-gram incidence matrix with its own transpose. Bounds
derived from set sizes leave out, without loss, what cannot count: a partner of a set of n shingles has at least
least(n) = ceil(n * percent / 100) shingles, and shares as many with it.

1. Rows. Order the shingles of all sets alike (here by hash). The first n - least(n) + k shingles of two linked sets,
   their heads, share k shingles. Heads with k = a tenth of the set leave each chunk of documents once, packed; blocks of
   the key space count the sets that hold a key, and tell the chunks. A set whose head shares too few keys has no partner.
2. Columns. The same exchange counts all shingles of the sets that are left. A set needs least(n) shingles that others
   hold too. Ordered from the rarest on, only the first n - least(n) + 1 shingles of a set are columns of the product
   that can show it a partner: columns that very many sets hold are hardly ever among them.
3. Blocks. Sets that share such a column are connected to its first set, and the connected ones form the diagonal blocks
   of the matrix. A block beyond `BLOCK` sets is cut: all parts are multiplied with themselves and with the first part;
   where this leaves more than one class, the sets outside the largest class are multiplied with all parts.
4. Product. Within a block the overlaps of a set with all others are accumulated over the lists of its columns; pairs of
   sizes too different, and pairs of one class already, are left out. Linked sets form classes; classes are connected.

Equal sets are one from the first exchange on. No pairs are written, only links of a set to one of its class; no column
is dropped, whatever number of sets holds it; a column is one entry per chunk in the exchanges. Keys of the exchanges
are cut to 32 bits within a block, which can only keep a set too much in 1 and change the order of the rarest in 2 alike
for all sets. Sets are compared by 64-bit hashes of their shingles.

Null text has no words. A text without words has an empty set and is linked with nothing. Repeated rows are linked, as
equal sets are. Rows without an id take part; they are never a component's id (null if no row of it has one). Ties do
not occur. A very long text is a chunk of its own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import through_storage
from .components import components
from .near_dedup import Texts
from .text import batch_of, chunks, grouped, mix, ship

BLOCK = 1024
#: Bytes of text in a chunk at least and at most, and for which the exchanges get one block more.
CHUNK, LARGEST, BLOCK_TEXT = 4 << 20, 256 << 20, 64 << 20
#: A chunk has so many bytes of text for each block, so that it has several keys for each.
PER_BLOCK = 2 << 10

CHUNKS = "chunk long, texts binary"
SETS = "chunk long, rows binary, sets binary"
SENT = pa.schema([("block", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("holders", pa.binary())])
TOLD = "chunk long, block long, holders binary"
ROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64())])
SET = pa.schema([("node", pa.int64()), ("hashes", pa.binary())])
COLUMNS = pa.schema([("key", pa.int64()), ("node", pa.int64())])
LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def least(n: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles a set of n shares with a partner at least; a partner has no fewer."""
    return -(-n * percent // 100)


def head(n: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles the head of a set of n has."""
    return np.minimum(n, n - least(n, percent) + _shared(n))


def _shared(n: np.ndarray) -> np.ndarray:
    return -(-n // 10)


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles the heads of a set of n and of its smallest partner share at least."""
    return _shared(least(n, percent))


def _packed(batches: Iterable[pa.RecordBatch]) -> bytes:
    out = pa.BufferOutputStream()
    stream = None
    for batch in batches:
        stream = stream or pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
        stream.write_batch(batch)
    if stream:
        stream.close()
    return out.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> Iterator[pa.RecordBatch]:
    return iter(pa.ipc.open_stream(blob)) if blob else iter(())


def _chunked(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Documents in rows of about `size` bytes of text, each a stream of slices that are small enough to work on."""
    first = TaskContext.get().partitionId() << 32
    held, held_bytes, n = [], 0, 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([first + n]), pa.array([_packed(held)], pa.binary())], names=["chunk", "texts"])

    for batch in chunks(batches, "text"):
        if held and held_bytes + batch.nbytes > size:
            yield row()
            held, held_bytes, n = [], 0, n + 1
        held.append(batch)
        held_bytes += batch.nbytes
    if held:
        yield row()


def chunk_table(docs: DataFrame) -> tuple[DataFrame, int]:
    """The documents in chunks, and into how many blocks the exchanges cut the key space."""
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_bytes // BLOCK_TEXT)
    size = min(LARGEST, max(CHUNK, blocks * PER_BLOCK))
    return through_storage(docs.mapInArrow(partial(_chunked, size=size), CHUNKS), "chunks"), blocks


def _sets(blob: bytes, words: int) -> Iterator[tuple[pa.RecordBatch, Texts, np.ndarray, np.ndarray]]:
    """Per slice its rows, its shingles, the key of each row's set, and which sets stand here for the first time."""
    seen: set[int] = set()
    for batch in _unpacked(blob):
        texts = Texts(pc.ascii_lower(batch.column(1)), words)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(texts.hashes * np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64)])
        sizes = np.diff(texts.edges)
        nodes = mix(sums[texts.edges[1:]] - sums[texts.edges[:-1]] + sizes.astype(np.uint64)).view(np.int64)
        new = np.zeros(len(nodes), bool)
        for i, node in enumerate(nodes.tolist()):
            if sizes[i] and node not in seen:
                seen.add(node)
                new[i] = True
        yield batch, texts, nodes, new


def _spread(hashes: np.ndarray) -> np.ndarray:
    """The keys of the exchanges: even over the key space, though heads have small hashes."""
    return mix(hashes ^ np.uint64(0xA0761D6478BD642F))


def _heads(blob: bytes, words: int, percent: int) -> np.ndarray:
    """The keys of the heads of the different sets in a chunk."""
    found = [np.zeros(0, np.uint64)]
    for _, texts, _, new in _sets(blob, words):
        n = np.diff(texts.edges)
        rank = np.arange(len(texts.hashes)) - np.repeat(texts.edges[:-1], n)
        found.append(texts.hashes[(rank < np.repeat(head(n, percent), n)) & np.repeat(new, n)])
    return _spread(np.concatenate(found))


def _all_shingles(blob: bytes) -> np.ndarray:
    return _spread(np.frombuffer(b"".join(h.as_py() for batch in _unpacked(blob) for h in batch.column(1)), np.uint64))


def _edges(keys: np.ndarray, blocks: int) -> np.ndarray:
    """Where each block begins among sorted keys."""
    of = ((keys >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    return np.searchsorted(of, np.arange(blocks + 1, dtype=np.uint64))


def _send(batches: Iterable[pa.RecordBatch], keys_of: Callable[[bytes], np.ndarray], blocks: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            keys, holders = np.unique(keys_of(blob.as_py()), return_counts=True)
            edges = _edges(keys, blocks)
            full = np.flatnonzero(np.diff(edges))
            low, few = keys.astype("<u4"), np.minimum(holders, 255).astype(np.uint8)
            spans = [(edges[b], edges[b + 1]) for b in full]
            yield batch_of(SENT, [full, np.full(len(full), chunk), *([x[a:b].tobytes() for a, b in spans] for x in (low, few))])


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    """How many sets hold each key of a block, up to 255, told to every chunk that sent it."""
    keys = np.frombuffer(b"".join(frame["keys"]), "<u4")
    _, which = np.unique(keys, return_inverse=True)
    total = np.bincount(which, np.frombuffer(b"".join(frame["holders"]), np.uint8))
    told = np.minimum(total, 255).astype(np.uint8)[which]
    ends = np.cumsum([len(k) // 4 for k in frame["keys"]])[:-1]
    return pd.DataFrame({"chunk": frame["chunk"], "block": frame["block"], "holders": [x.tobytes() for x in np.split(told, ends)]})


def _told(answers: list | None, keys: np.ndarray, blocks: int) -> np.ndarray:
    """How many sets hold each of the sorted keys."""
    out = np.ones(len(keys), np.uint8)
    edges = _edges(keys, blocks)
    for answer in answers or ():
        out[edges[answer["block"]] : edges[answer["block"] + 1]] = np.frombuffer(answer["holders"], np.uint8)
    return out


def with_holders(table: DataFrame, blob: str, keys_of: Callable[[bytes], np.ndarray], blocks: int, name: str) -> DataFrame:
    """The rows of `table` (chunk, blob) with what the blocks tell about the keys of the blob."""
    kind = "block long, chunk long, keys binary, holders binary"
    sent = table.select("chunk", blob).mapInArrow(partial(_send, keys_of=keys_of, blocks=blocks), kind)
    told = sent.groupBy("block").applyInPandas(_merge, TOLD).groupBy("chunk")
    told = through_storage(told.agg(F.collect_list(F.struct("block", "holders")).alias("told")), name)
    return table.select("chunk", blob).join(told, "chunk", "left")


def _likely(batches: Iterable[pa.RecordBatch], words: int, percent: int, blocks: int) -> Iterator[pa.RecordBatch]:
    """Per chunk its documents with size and key of their sets, and the sets that may have a partner."""
    for batch in batches:
        for row in batch.to_pylist():
            keys = np.unique(_heads(row["texts"], words, percent))
            holders = _told(row["told"], keys, blocks)
            rows, sets = [], []
            for docs, texts, nodes, new in _sets(row["texts"], words):
                n = np.diff(texts.edges)
                owner = np.repeat(np.arange(len(n)), n)
                rank = np.arange(len(texts.hashes)) - texts.edges[:-1][owner]
                at = np.flatnonzero((rank < head(n, percent)[owner]) & new[owner])
                shared = holders[np.searchsorted(keys, _spread(texts.hashes[at]))] > 1
                got = np.bincount(owner[at][shared], minlength=len(n))
                likely = np.flatnonzero(new & (got >= needed(n, percent)))
                rows.append(batch_of(ROW, [docs.column(0), n, pa.array(nodes, mask=n == 0)]))
                held = [texts.hashes[texts.edges[i] : texts.edges[i + 1]].tobytes() for i in likely.tolist()]
                sets.append(batch_of(SET, [nodes[likely], held]))
            packed = [pa.array([x], pa.binary()) for x in (_packed(rows), _packed(sets))]
            yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]]), *packed], names=["chunk", "rows", "sets"])


def _candidates(batches: Iterable[pa.RecordBatch], percent: int, blocks: int) -> Iterator[pa.RecordBatch]:
    """The columns of each set that can show it a partner."""
    for batch in batches:
        for row in batch.to_pylist():
            keys = np.unique(_all_shingles(row["sets"]))
            holders = _told(row["told"], keys, blocks)
            for sets in _unpacked(row["sets"]):
                found, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for node, hashes in zip(sets.column(0).to_pylist(), sets.column(1), strict=True):
                    own = np.sort(_spread(np.frombuffer(hashes.as_py(), np.uint64)))
                    n, count = len(own), holders[np.searchsorted(keys, own)]
                    bound = int(least(np.int64(n), percent))
                    if np.count_nonzero(count > 1) < bound:
                        continue
                    first = np.argsort(count, kind="stable")[: n - bound + 1]
                    first = first[count[first] > 1]
                    found.append(own[first])
                    nodes.append(np.full(len(first), node))
                yield batch_of(COLUMNS, [np.concatenate(found).view(np.int64), np.concatenate(nodes)])


def _streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(0):
            yield from _unpacked(blob.as_py())


def _rows_of(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ..., sizes[k] of them, for every k."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)


def product_classes(sets: list[np.ndarray], side: np.ndarray, known: np.ndarray, percent: int) -> np.ndarray:
    """A class for each set: linked sets share it, and so do sets whose `known` class is the same.

    Only sets of different sides are compared, or all if there is one side.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes, side, labels = sizes[order], side[order], np.unique(known[order], return_inverse=True)[1]
    one_side = bool((side == side[0]).all())
    edges = np.concatenate([[0], np.cumsum(sizes)])
    _, column, holders = np.unique(np.concatenate([sets[i] for i in order.tolist()]), return_inverse=True, return_counts=True)
    # The lists of the columns: which rows hold each.
    rows = np.repeat(np.arange(len(sets)), sizes)[np.argsort(column, kind="stable")]
    first = np.cumsum(holders) - holders
    widest = np.searchsorted(sizes, sizes * 100 // percent, side="right")
    for i, stop in enumerate(widest.tolist()):
        others = slice(i + 1, stop)
        open_ = labels[others] != labels[i]
        if not one_side:
            open_ &= side[others] != side[i]
        if not open_.any():
            continue
        own = column[edges[i] : edges[i + 1]]
        own = own[holders[own] > 1]
        overlap = np.bincount(rows[_rows_of(first[own], holders[own])], minlength=len(sets))[others]
        alike = open_ & (100 * overlap >= percent * (sizes[i] + sizes[others] - overlap))
        for label in np.unique(labels[others][alike]).tolist():
            labels[labels == label] = labels[i]
    out = np.zeros(len(sets), np.int64)
    out[order] = labels
    return out


def _products(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links of sets to the smallest of their class within a pair of parts."""
    for group in grouped(batches, ["root", "low", "high"]):
        group = group.sort_by("node")
        nodes = group["node"].to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in group["hashes"]]
        classes = product_classes(sets, group["own"].to_numpy(), group["known"].to_numpy(), percent)
        _, first, which = np.unique(classes, return_index=True, return_inverse=True)
        head_of = nodes[first[which]]
        yield batch_of(LINKS, [nodes[nodes != head_of], head_of[nodes != head_of]])


def _multiplied(sets: DataFrame, own: Column, others: Column, percent: int) -> DataFrame:
    """`sets` (root, node, known, hashes) in the pairs of parts that `others` lists, multiplied."""
    keys = ["root", "low", "high"]
    parts = sets.withColumn("own", own.cast("int")).withColumn("other", F.explode(others.cast("array<int>")))
    parts = parts.select(
        "root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "known", "hashes"
    )
    parts = parts.repartition(*keys).sortWithinPartitions(*keys)
    return parts.mapInArrow(partial(_products, percent=percent), "u long, v long")


def _part(n: Column) -> Column:
    return F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1)))


def links(sets: DataFrame, groups: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (u, v) that connect the sets (node, hashes) of each group (node, root) as all pairs would."""
    parts = lambda n: F.ceil(F.col(n) / block).cast("long")
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"))
    groups = groups.join(sizes, "root")
    held = sets.join(groups, "node").dropDuplicates(["node"])
    held = through_storage(held.select("root", "n", "node", F.col("node").alias("known"), "hashes"), "candidates")
    own = _part(parts("n"))
    others = F.when(own == 0, F.sequence(F.lit(0), parts("n") - 1)).otherwise(F.array(F.lit(0).cast("long"), own))
    found = through_storage(_multiplied(held, own, others, percent), "links")
    large = held.where(F.col("n") > block)
    if large.isEmpty():
        return found
    classes = components(found).withColumnRenamed("root", "class")
    large = large.join(classes, "node", "left").withColumn("known", F.coalesce("class", "node"))
    counts = large.groupBy("root", "known").agg(F.count("*").alias("members"))
    most = counts.groupBy("root").agg(F.max(F.struct("members", "known")).alias("most"), F.sum("members").alias("n"))
    most = most.select("root", F.col("most.known").alias("largest"), F.col("most.members").alias("inside"), "n")
    most = most.where(F.col("inside") < F.col("n")).withColumn("outside", F.col("n") - F.col("inside"))
    rest = large.select("root", "node", "known", "hashes").join(most, "root")
    # Parts of the largest class come first; a pair of two of them needs no product.
    is_in = F.col("known") == F.col("largest")
    own = F.when(is_in, _part(parts("inside"))).otherwise(parts("inside") + _part(parts("outside")))
    last = parts("inside") + parts("outside") - 1
    others = F.sequence(F.when(is_in, parts("inside")).otherwise(F.lit(0).cast("long")), last)
    return found.unionAll(_multiplied(rest, own, others, percent))


def similar_documents(docs: DataFrame, words: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links, one row per document."""
    ship(docs.sparkSession)
    table, blocks = chunk_table(docs.select("doc_id", "text"))
    told = with_holders(table, "texts", partial(_heads, words=words, percent=percent), blocks, "heads")
    likely = partial(_likely, words=words, percent=percent, blocks=blocks)
    table = through_storage(told.mapInArrow(likely, SETS), "sets")
    told = with_holders(table, "sets", _all_shingles, blocks, "shingles")
    columns = told.mapInArrow(partial(_candidates, percent=percent, blocks=blocks), "key long, node long").distinct()
    columns = through_storage(columns, "columns")
    first = columns.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("last")).where("v < last")
    groups = components(columns.join(first, "key").where("node > v").select(F.col("node").alias("u"), "v"))
    sets = table.select("sets").mapInArrow(_streamed, "node long, hashes binary")
    classes = components(links(sets, groups, percent, block))
    rows = table.select("rows").mapInArrow(_streamed, "doc_id long, n long, node long")
    least_id = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(classes, "node", "left")
    least_id = least_id.select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    named = least_id.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = least_id.join(named, "root").select("node", "component_id")
    rows = rows.join(named, "node", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
