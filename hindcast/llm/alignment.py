"""Alignment of two tokenizers' tokens by diagonal run skipping, and links between their ids.

A document is its text behind one space. Both tokenizers cut its bytes; where a token of A and one of B end at the same
byte, a group ends. Within a group every token of A is linked with every token of B.

1. Tokens. Neither tokenizer joins bytes over the border between a character that is no white space and a space, so
   documents are cut there into units, and a worker asks the tokenizers once for each different unit it remembers.
   Whether this holds for the vocabulary of B is looked up in it; if it does not, whole documents are asked for.
2. Alignment. The ends of the tokens are two ascending arrays. At the shift that was last in step, blocks of 1, 2, 4, ...
   ends are compared; a block that differs is halved down to its first difference. So one-to-one stretches are jumped
   over, whatever their length. At a difference the array that is behind is moved on until both are in step again: an
   irregular group, after which the shift is that of the new place.
3. Counts. The documents of a few MB of text, a chunk, are one row of a stored table: the pairs of ids linked in it,
   each once, with the number of its documents that hold the pair, and per document which pairs it holds how often.
   Counts are summed over chunks, so a pair that every document holds is one row per chunk, not per document.
4. Every chunk gets the counts of its own pairs back and sums them per document.

The counts of all pairs stay a table; nothing is collected or broadcast by force. Groups of very many tokens are linked
by their different ids, not token by token, so memory follows the number of different pairs.

Null and empty texts, and texts whose joined token bytes differ from the space and the text, have no tokens. Rows that
share an id are documents each for itself, repeated rows too. Of equally frequent B ids all are best. An empty table
gives an empty result. A very long text is a chunk of its own. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import through_storage
from .text import CHUNK_BYTES, batch_of, byte_sums, bytes_of, chunks, mix, ship, shifted

CHUNK = 4 << 20
#: Units remembered by a worker; the memory is emptied when full.
REMEMBERED = 500_000
#: Groups with more links than this are linked by their different ids.
MANY_LINKS = 4096

ALIGNED = pa.schema(
    [("doc_id", pa.int64()), *((c, pa.list_(pa.int32())) for c in ("a_ids", "b_ids", "a_ends", "b_ends"))]
)
LINKED = pa.schema([("chunk", pa.int64()), ("pairs", pa.binary()), ("holders", pa.binary()), ("docs", pa.binary())])
PAIRS = pa.schema([("chunk", pa.int64()), ("place", pa.int32()), ("pair", pa.int64()), ("holders", pa.int64())])
DOCS = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
        ("groups_sha256", pa.string()), ("steps", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())),
    ]
)
RESULT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
        ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string()),
    ]
)


def in_step(a: list[int], b: list[int]) -> list[tuple[int, int, int, int]]:
    """The groups that are not one to one, as (first of a, first of b, end in a, end in b); both arrays end together."""
    irregular = []
    i = j = 0
    n = len(a)
    while True:
        width = 1
        while i < n and a[i : i + width] == b[j : j + width]:
            i += width
            j += width
            width += width
        if i >= n:
            return irregular
        while width > 1:
            width >>= 1
            if a[i : i + width] == b[j : j + width]:
                i += width
                j += width
        first, other = i, j
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i += 1
        j += 1
        irregular.append((first, other, i, j))


def _byte_level(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    out = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        out[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return out


class _Side:
    """One tokenizer: the bytes of its ids, and the ids of the units in the memory, unit after unit."""

    def __init__(self, of_ids: list[bytes]):
        self.lengths = np.array([len(t) for t in of_ids], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(of_ids), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.ids = np.zeros(0, np.int32)
        self.first, self.count = np.zeros((2, 0), np.int64)

    def learn(self, found: list[list[int]], data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Remember the ids of units whose bytes, `sizes` each, follow each other in `data`; whether they spell them."""
        count = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(count.sum()))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, ids])
        unit = np.repeat(np.arange(len(found)), count)
        spelled = np.bincount(unit, self.lengths[ids], minlength=len(found)).astype(np.int64)
        ok = spelled == sizes
        ids = ids[ok[unit]]
        same = self.bytes[_rows_of(self.begins[ids], self.lengths[ids])] == data[np.repeat(ok, sizes)]
        ok[np.repeat(np.flatnonzero(ok), sizes[ok])[~same]] = False
        return ok


class Tokenizers:
    """Both tokenizers, and the units a worker has met, found by the hash of their bytes."""

    def __init__(self, a: str, b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_a = _byte_level(self.a)
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.sides = _Side(self.bytes_a), _Side(self.bytes_b)
        # Units are sound if no piece goes on with a space after anything else.
        self.by_unit = not any("▁" in p.lstrip("▁") for p in pieces)
        # The space that ends a text is a unit of its own, to which B adds nothing.
        self.last_space = self.b.encode("a ")[len(self.b.encode("a")) :]
        self.clear()

    def clear(self) -> None:
        self.hashes, self.order, self.ok = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
        for side in self.sides:
            side.clear()

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the units with these hashes, and which of them are known."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.order[at], self.hashes[at] == hashes

    def learn(self, hashes: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Units of which the bytes begin and end there in `data`; different ones, and new."""
        raw = data.tobytes()
        units = [raw[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)]
        texts = [u.decode() for u in units]
        a = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        for i in [i for i, u in enumerate(units) if u == b" "]:
            b[i] = self.last_space
        sizes = end - begin
        data = np.frombuffer(b"".join(units), np.uint8)
        ok = np.logical_and(*(side.learn(ids, data, sizes) for side, ids in zip(self.sides, (a, b), strict=True)))
        hashes = np.concatenate([self.hashes, hashes])
        by_hash = np.argsort(hashes, kind="stable")
        self.hashes, self.order = hashes[by_hash], np.concatenate([self.order, len(self.ok) + np.arange(len(units))])[by_hash]
        self.ok = np.concatenate([self.ok, ok])


_TOKENIZERS: dict[tuple[str, str], Tokenizers] = {}


def tokenizers_of(a: str, b: str) -> Tokenizers:
    return _TOKENIZERS.get((a, b)) or _TOKENIZERS.setdefault((a, b), Tokenizers(a, b))


def _unit_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Documents begin at `starts`; units begin there and at a space behind a character that is no white space.

    White space beyond ASCII is told by its last bytes; where other characters look alike, the unit just goes on.
    """
    p1, p2, p3 = (np.concatenate([np.zeros(k, np.uint8), data[:-k]]) if len(data) > k else np.zeros(len(data), np.uint8) for k in (1, 2, 3))
    at = np.flatnonzero((data == 0x20) & (p1 > 0x20))
    p1, p2, p3 = p1[at], p2[at], p3[at]
    wide = (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))
    wide |= (p3 == 0xE1) & (p2 == 0x9A) | (p3 == 0xE2) & ((p2 == 0x80) | (p2 == 0x81)) | (p3 == 0xE3) & (p2 == 0x80)
    return np.unique(np.concatenate([at[~wide], starts]))


def _rows_of(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ..., sizes[k] of them, for every k."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)


class _Tokens(NamedTuple):
    """Ids of a chunk's documents in a row; document i has ids edges[i] to edges[i + 1]."""

    ids: np.ndarray
    edges: np.ndarray


def _tokens(texts: pa.Array, known: Tokenizers) -> tuple[_Tokens, _Tokens]:
    data, offsets = bytes_of(texts)
    full = np.flatnonzero(np.diff(offsets))
    data = np.insert(data, offsets[full], 0x20)
    starts = offsets[full] + np.arange(len(full))
    begin = _unit_starts(data, starts) if known.by_unit else starts
    end = np.append(begin[1:], len(data))
    total = byte_sums(data, 1)
    hashes = shifted(total[end] - total[begin], begin, len(total)) + mix((end - begin).astype(np.uint64))
    different, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    if not known.by_unit or len(known.ok) > REMEMBERED:
        known.clear()
    at, met = known.find(different)
    if not met.all():
        new = first[~met]
        known.learn(different[~met], data, begin[new], end[new])
        at, _ = known.find(different)
    at = at[which]
    bad = ~known.ok[at]
    owner = np.searchsorted(starts, begin, side="right") - 1
    spoilt = np.zeros(len(full), bool)
    spoilt[owner[bad]] = True
    out = []
    for side in known.sides:
        own = np.where(spoilt[owner], 0, side.count[at])
        per = np.zeros(len(texts), np.int64)
        per[full] = np.bincount(owner, own, minlength=len(full)).astype(np.int64)
        out.append(_Tokens(side.ids[_rows_of(side.first[at], own)], np.concatenate([[0], np.cumsum(per)])))
    return out[0], out[1]


class Aligned:
    """Tokens of a chunk's documents and the groups they form; group g ends before token a_ends[g] and b_ends[g]."""

    def __init__(self, texts: pa.Array, known: Tokenizers):
        self.a, self.b = _tokens(texts, known)
        ends = [np.cumsum(sizes[t.ids]) for t, sizes in zip((self.a, self.b), (side.lengths for side in known.sides), strict=True)]
        irregular = np.array(in_step(ends[0].tolist(), ends[1].tolist()), np.int64).reshape(-1, 4)
        self.a_ends = self._ends(len(self.a.ids), irregular[:, 0], irregular[:, 2])
        self.b_ends = self._ends(len(self.b.ids), irregular[:, 1], irregular[:, 3])
        # Documents end where groups end: edges[i] to edges[i + 1] are the groups of document i.
        self.edges = np.searchsorted(self.a_ends, self.a.edges, side="right")

    @staticmethod
    def _ends(n: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        inner = np.zeros(n, bool)
        inner[_rows_of(first, end - first - 1)] = True
        return np.flatnonzero(~inner) + 1


def _aligned(batches: Iterable[pa.RecordBatch], a: str, b: str) -> Iterator[pa.RecordBatch]:
    known = tokenizers_of(a, b)
    for batch in chunks(batches, "text"):
        found = Aligned(batch.column(1), known)

        def lists(values: np.ndarray, edges: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, pa.int32()))

        ends = [
            lists(of - np.repeat(t.edges[:-1], np.diff(found.edges)), found.edges)
            for of, t in ((found.a_ends, found.a), (found.b_ends, found.b))
        ]
        columns = [batch.column(0), lists(found.a.ids, found.a.edges), lists(found.b.ids, found.b.edges), *ends]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, ALIGNED, strict=True)], schema=ALIGNED)


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, a_ids, b_ids, and the groups: group g ends before a_ids[a_ends[g]] and b_ids[b_ends[g]]."""
    ship(docs.sparkSession)
    kind = "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>"
    return docs.select("doc_id", "text").mapInArrow(partial(_aligned, a=a, b=b), kind)


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The digits of 0 to n - 1, each in a row of its own, and how many there are."""
    shown = np.array([str(i).encode() for i in range(n)])
    table = np.ascontiguousarray(shown).view(np.uint8).reshape(n, shown.dtype.itemsize)
    return table, np.count_nonzero(table, axis=1)


_DECIMALS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def spelled(found: Aligned, n_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """`a1,a2|b1;a3|b2,b3;` of all documents as bytes, and where each document begins; a group closes with `;`."""
    table, digits = _DECIMALS.get(n_ids) or _DECIMALS.setdefault(n_ids, _decimals(n_ids))
    n = len(found.a.ids) + len(found.b.ids)
    ids, mark = np.zeros(n, np.int32), np.full(n, ord(","), np.uint8)
    # In the text a group's tokens of A come first: they stand behind all tokens of B of the groups before.
    a_first, b_first = (np.concatenate([[0], e[:-1]]) if len(e) else e for e in (found.a_ends, found.b_ends))
    a_place = np.arange(len(found.a.ids)) + np.repeat(b_first, found.a_ends - a_first)
    b_place = np.arange(len(found.b.ids)) + np.repeat(found.a_ends, found.b_ends - b_first)
    ids[a_place], ids[b_place] = found.a.ids, found.b.ids
    mark[a_place[found.a_ends - 1]], mark[b_place[found.b_ends - 1]] = ord("|"), ord(";")
    size = digits[ids]
    end = np.cumsum(size + 1)
    out = np.zeros(end[-1] if n else 0, np.uint8)
    out[end - 1] = mark
    begin = end - size - 1
    for d in range(table.shape[1]):
        some = np.flatnonzero(size > d)
        out[begin[some] + d] = table[ids[some], d]
    return out, np.concatenate([[0], end])[found.a.edges + found.b.edges]


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the weights of each."""
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(weights, new) if len(new) else weights


def links(found: Aligned, n_b: int, many: int = MANY_LINKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of ids (a * n_b + b) linked in each document, each pair once, how often, and the document's number.

    Sorted by document and pair.
    """
    per_a, per_b = np.diff(found.a_ends, prepend=0), np.diff(found.b_ends, prepend=0)
    doc = np.repeat(np.arange(len(found.edges) - 1), np.diff(found.edges))
    some = np.flatnonzero(per_a * per_b <= many)
    # Every token of A in the group once for each of the group's tokens of B.
    a_at = _rows_of((found.a_ends - per_a)[some], per_a[some])
    wide = np.repeat(per_b[some], per_a[some])
    pair = np.repeat(found.a.ids[a_at].astype(np.int64) * n_b, wide)
    pair += found.b.ids[_rows_of(np.repeat((found.b_ends - per_b)[some], per_a[some]), wide)]
    pair |= np.repeat(doc[some] << 32, per_a[some] * per_b[some])
    pair, times = np.unique(pair, return_counts=True)
    parts = [(pair, times)]
    for g in np.flatnonzero(per_a * per_b > many).tolist():
        a, n_of_a = np.unique(found.a.ids[found.a_ends[g] - per_a[g] : found.a_ends[g]], return_counts=True)
        b, n_of_b = np.unique(found.b.ids[found.b_ends[g] - per_b[g] : found.b_ends[g]], return_counts=True)
        own = (a.astype(np.int64)[:, None] * n_b + b).ravel() | int(doc[g]) << 32
        parts.append((own, np.outer(n_of_a, n_of_b).ravel()))
    if len(parts) > 1:
        pair, times = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    return pair & 0xFFFFFFFF, times, pair >> 32


def _described(batch: pa.RecordBatch, known: Tokenizers) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """The columns of DOCS up to the digest; pairs, their number and the edges of the documents among them."""
    n_a, n_b = (len(side.lengths) for side in known.sides)
    found = Aligned(batch.column(1), known)
    pair, times, doc = links(found, n_b)
    text, begin = spelled(found, max(n_a, n_b))
    shown = memoryview(text)
    hashes = [hashlib.sha256(shown[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
    edges = np.searchsorted(doc, np.arange(len(batch) + 1))
    n_links = np.diff(np.concatenate([[0], np.cumsum(times)])[edges])
    counts = [np.diff(found.a.edges), np.diff(found.b.edges), np.diff(found.edges), n_links]
    return [batch.column(0), *map(pa.array, counts), pa.array(hashes, pa.string())], pair, times, edges


def _linked(batches: Iterable[pa.RecordBatch], a: str, b: str, size: int) -> Iterator[pa.RecordBatch]:
    known = tokenizers_of(a, b)
    if len(known.bytes_a) * len(known.bytes_b) > 1 << 32:
        raise ValueError("a pair of ids must fit 32 bits")
    first = TaskContext.get().partitionId() << 32
    for i, slices in enumerate(_together(chunks(batches, "text", min(size, CHUNK_BYTES)), size)):
        parts = [_described(batch, known) for batch in slices]
        different, place, holders = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True, return_counts=True)
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, DOCS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            done = 0
            for columns, pair, times, edges in parts:
                own = place[done : done + len(pair)]
                done += len(pair)
                # Places ascend within a document; their steps are small numbers, which compress well.
                steps = np.diff(own, prepend=0)
                begins = edges[:-1][edges[:-1] < edges[1:]]
                steps[begins] = own[begins]
                lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x, pa.int32())) for x in (steps, times)]
                stream.write_batch(pa.record_batch([*columns, *lists], schema=DOCS))
        packed = [different.astype("<u4").tobytes(), holders.astype("<u4").tobytes(), out.getvalue().to_pybytes()]
        yield batch_of(LINKED, [[first + i], *([p] for p in packed)])


def _together(slices: Iterable[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    """Slices in lists of about `size` bytes."""
    held, n_bytes = [], 0
    for batch in slices:
        if held and n_bytes + batch.nbytes > size:
            yield held
            held, n_bytes = [], 0
        held.append(batch)
        n_bytes += batch.nbytes
    if held:
        yield held


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, pairs, holders in zip(*(batch.column(k) for k in range(3)), strict=True):
            pairs, holders = (np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in (pairs, holders))
            yield batch_of(PAIRS, [np.full(len(pairs), chunk.as_py()), np.arange(len(pairs), dtype=np.int32), pairs, holders])


def _scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = batch.column(batch.schema.get_field_index("scores"))
        for k in range(batch.num_rows):
            # A chunk without any tokens gets no scores.
            own = scores[k].values if scores[k].is_valid else None
            count, best = np.zeros((2, len(own) if own is not None else 0), np.int64)
            if own is not None:
                place = own.field("place").to_numpy()
                count[place], best[place] = own.field("count").to_numpy(), own.field("best").to_numpy(zero_copy_only=False)
            for docs in pa.ipc.open_stream(batch.column("docs")[k].as_py()):
                edges = docs.column("steps").offsets.to_numpy()
                steps, times = (docs.column(c).values.to_numpy().astype(np.int64) for c in ("steps", "times"))
                # Steps add up from the first of each document.
                run = np.concatenate([[0], np.cumsum(steps)])
                place = run[1:] - np.repeat(run[edges[:-1]], np.diff(edges))
                sums = [np.diff(np.concatenate([[0], np.cumsum(times * x[place])])[edges]) for x in (best, count)]
                columns = {c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
                columns |= {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
                yield pa.RecordBatch.from_arrays([columns[f.name] for f in RESULT], schema=RESULT)


def link_counts(chunk_rows: DataFrame) -> DataFrame:
    """pair, count (documents that hold it linked) and best (no pair with the same A id counts more)."""
    counts = chunk_rows.groupBy("pair", "a").agg(F.sum("holders").alias("count"))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment_digests(docs: DataFrame, a: str, b: str, chunk: int = CHUNK) -> DataFrame:
    """Per document n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 (see the module)."""
    ship(docs.sparkSession)
    n_b = len(tokenizers_of(a, b).bytes_b)
    kind = "chunk long, pairs binary, holders binary, docs binary"
    table = through_storage(docs.select("doc_id", "text").mapInArrow(partial(_linked, a=a, b=b, size=chunk), kind), "linked")
    pairs = table.select("chunk", "pairs", "holders").mapInArrow(_pairs, "chunk long, place int, pair long, holders long")
    pairs = pairs.withColumn("a", F.floor(F.col("pair") / n_b))
    counts = through_storage(link_counts(pairs), "link-counts")
    scores = pairs.join(counts, "pair").groupBy("chunk").agg(F.collect_list(F.struct("place", "count", "best")).alias("scores"))
    told = table.select("chunk", "docs").join(scores, "chunk", "left")
    kind = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return told.select("chunk", "docs", "scores").mapInArrow(_scored, kind)
