"""Token counts under a unigram vocabulary, by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a word with the vocabulary's word mark in front. Its segmentation is the one with the largest sum of piece
scores; a byte that no piece covers is a token of its own, ten below the rarest piece. The score of a prefix does not
depend on what follows, so distinct words go into a trie and each shared prefix is scored once; a word's count is kept at
its terminal node. Words are taken in sorted order, where a node is the first word with that prefix, and the trie is
scored level by level for all words at once.

A worker remembers the counts of words it has met (up to `REMEMBERED`, then it starts again), so a frequent word is
scored about once per worker however often it occurs. Texts are counted one by one, whole, without a shuffle.

Words beyond `LONG` bytes share no prefix worth a trie: each is scored by itself, forward over the pieces found in it, in
time linear in its length and with the last scores only in memory. Both ways give the same sums in the same order. Of
segmentations with equal scores the one with the shorter last piece wins, at every prefix.

The vocabulary file carries ranks, not probabilities: a piece's score is the Zipf log probability of its rank.

Null text has no words and no tokens. Repeated rows are counted alike; an empty table gives an empty result; only the id
and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import Words, batch_of, byte_sums, chunks, shifted, ship

RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])
REMEMBERED = 2_000_000
#: Bytes from which on a word is scored by itself, and places at which it then looks for pieces at once.
LONG, PLACES = 256, 1 << 16
MARK = "▁".encode()


def pieces(path: str) -> dict[bytes, float]:
    """Score of each ordinary piece of a sentencepiece vocabulary, and of each single byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = [
        i for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    ]
    norm = np.log(np.sum(1.0 / np.arange(1, len(ordinary) + 1)))
    scores = {model.id_to_piece(i).encode(): float(-np.log(rank + 1) - norm) for rank, i in enumerate(ordinary)}
    least = min(scores.values()) - 10
    return {bytes([b]): least for b in range(256)} | scores


def _hash(data: bytes) -> int:
    return int(shifted(byte_sums(np.frombuffer(data, np.uint8), 21)[-1:], slice(0, 1), 1)[0])


class Vocabulary:
    """Pieces by hash, one table per length, and the counts of words met so far."""

    def __init__(self, scores: dict[bytes, float]):
        by_length: dict[int, list[tuple[int, float]]] = {}
        for piece, score in scores.items():
            by_length.setdefault(len(piece), []).append((_hash(piece), score))
        self.tables = {}
        for length, entries in sorted(by_length.items()):
            entries.sort()
            hashes = np.array([h for h, _ in entries], np.uint64)
            bits = max(8, (16 * len(entries)).bit_length())
            maybe = np.zeros(1 << bits, bool)
            maybe[(hashes & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
            self.tables[length] = hashes, np.array([s for _, s in entries]), maybe, np.uint64((1 << bits) - 1)
        self.longest = max(self.tables)
        self.forget()

    def forget(self) -> None:
        self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def find(self, length: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of pieces of this length among the hashes, and their scores."""
        known, scores, maybe, mask = self.tables[length]
        at = np.flatnonzero(maybe[(hashes & mask).astype(np.int64)])
        which = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
        hit = known[which] == hashes[at]
        return at[hit], scores[which[hit]]

    def segment(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each of the distinct, sorted words."""
        n = len(words)
        size = np.array([len(w) for w in words])
        offset = np.concatenate([[0], np.cumsum(size)])[:-1]
        data = np.frombuffer(b"".join(words), np.uint8)
        total = byte_sums(data, 21)
        shared = np.array([0, *map(_common, words[:-1], words[1:])])
        out = np.zeros(n, np.int64)
        place = np.arange(n)
        # Of the last levels: which word stands for each word's node, the node's best score, its number of tokens.
        levels = {0: (np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64))}
        alive = place
        for depth in range(1, int(size.max()) + 1 if n else 0):
            alive = alive[size[alive] >= depth]
            node = np.zeros(n, bool)
            node[alive] = shared[alive] < depth
            own = np.flatnonzero(node)
            best, tokens = np.full(len(own), -np.inf), np.zeros(len(own), np.int64)
            end = offset[own] + depth
            for length in self.tables:
                if length > depth:
                    break
                hashes = shifted(total[end] - total[end - length], end - length, len(total))
                at, scores = self.find(length, hashes)
                stand, score, count = levels[depth - length]
                before = stand[own[at]]
                scores = score[before] + scores
                better = scores > best[at]
                at, before = at[better], before[better]
                best[at], tokens[at] = scores[better], count[before] + 1
            stand = np.maximum.accumulate(np.where(node, place, 0))
            score, count = np.zeros(n), np.zeros(n, np.int64)
            score[own], count[own] = best, tokens
            levels[depth] = stand, score, count
            levels.pop(depth - self.longest, None)
            done = alive[size[alive] == depth]
            out[done] = count[stand[done]]
        return out

    def segment_long(self, word: bytes) -> int:
        """Tokens of one word of any length."""
        total, n = byte_sums(np.frombuffer(word, np.uint8), 21), len(word)
        base, best, tokens = 0, [0.0], [0]  # scores of the prefixes from `base` bytes on
        for start in range(0, n, PLACES):
            stop = min(n, start + PLACES)
            found = []
            for length in self.tables:
                if length > stop:
                    break
                end = np.arange(max(start + 1, length), stop + 1)
                at, scores = self.find(length, shifted(total[end] - total[end - length], end - length, len(total)))
                found.append((end[at], np.full(len(at), length), scores))
            ends, lengths, scores = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((lengths, ends))
            best += [float("-inf")] * (stop - start)
            tokens += [0] * (stop - start)
            for end, length, score in zip((ends[order] - base).tolist(), lengths[order].tolist(), scores[order].tolist(), strict=True):
                score += best[end - length]
                if score > best[end]:
                    best[end], tokens[end] = score, tokens[end - length] + 1
            base, best, tokens = max(base, stop - self.longest), best[-self.longest - 1 :], tokens[-self.longest - 1 :]
        return tokens[-1]

    def count(self, words: Words) -> np.ndarray:
        """Tokens of each word of the texts."""
        hashes = words.hashes(22)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        new = self.known[at] != distinct if len(self.known) else np.ones(len(distinct), bool)
        counts = self.counts[at] if len(self.known) else np.zeros(len(distinct), np.int64)
        if new.any():
            raw = words.data.tobytes()
            spans = zip(words.starts[first[new]].tolist(), words.ends[first[new]].tolist(), strict=True)
            found = [MARK + raw[a:b] for a, b in spans]
            order = sorted((i for i, w in enumerate(found) if len(w) <= LONG), key=found.__getitem__)
            tokens = np.zeros(len(found), np.int64)
            if order:
                tokens[order] = self.segment([found[i] for i in order])
            for i in (i for i, w in enumerate(found) if len(w) > LONG):
                tokens[i] = self.segment_long(found[i])
            counts[new] = tokens
            if len(self.known) > REMEMBERED:
                self.forget()
            known = np.concatenate([self.known, distinct[new]])
            order = np.argsort(known, kind="stable")
            self.known, self.counts = known[order], np.concatenate([self.counts, tokens])[order]
        return counts[which]


def _common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while low < n:  # halve the range that holds the first difference
        middle = (low + n) // 2
        if a[: middle + 1] == b[: middle + 1]:
            low = middle + 1
        else:
            n = middle
    return low


_VOCABULARIES: dict[str, Vocabulary] = {}


def _count(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    vocabulary = _VOCABULARIES.get(path) or _VOCABULARIES.setdefault(path, Vocabulary(pieces(path)))
    for batch in chunks(batches, "text"):
        words = Words(batch.column(1))
        tokens = np.concatenate([[0], np.cumsum(vocabulary.count(words))])[words.first]
        yield batch_of(RESULT, [batch.column(0), words.counts, np.diff(tokens)])


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens, one row per document; `path` names a sentencepiece vocabulary."""
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(partial(_count, path=path), "doc_id long, n_words long, n_tokens long")
