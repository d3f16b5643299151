import random
import re

import pyarrow as pa
import pytest

from hindcast.llm import queries, token_counts
from hindcast.llm.text import Words
from tests.llm.tables import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(word, scores):
    """Tokens of the best segmentation of one word by itself."""
    data = token_counts.MARK + word.encode()
    best, tokens = [0.0], [0]
    lengths = sorted({len(p) for p in scores})
    for end in range(1, len(data) + 1):
        top, n = float("-inf"), 0
        for length in lengths:
            if length <= end and data[end - length : end] in scores:
                score = best[end - length] + scores[data[end - length : end]]
                if score > top:
                    top, n = score, tokens[end - length] + 1
        best.append(top)
        tokens.append(n)
    return tokens[-1]


def texts(seed):
    rng = random.Random(seed)
    stems = ["token", "count", "über", "prefix", "pre", "pretoken", "日本語", "a", "e", "💬x", "THE", "100%", "ne'er", "\x00", "ing", "s"]
    make = lambda: "".join(rng.choices(stems, k=rng.randint(1, 4)))
    out = [rng.choice([" ", "\n", "\t "]).join(make() for _ in range(rng.randint(0, 60))) for _ in range(60)]
    return [*out, None, "", "  ", "x" * 700, "same " * 5000, out[0]]


def test_counts_equal_scoring_each_word_alone(spark):
    path = queries.piece_bpe()
    scores = token_counts.pieces(path)
    corpus = texts(1)
    known = {}
    rows = {r.doc_id: r for r in token_counts.token_counts(documents(spark, corpus, extra=True), path).collect()}
    assert len(rows) == len(corpus)
    for i, text in enumerate(corpus):
        words = WORD.findall(text or "")
        for w in words:
            if w not in known:
                known[w] = brute(w, scores)
        assert (rows[i].n_words, rows[i].n_tokens) == (len(words), sum(known[w] for w in words)), i


@pytest.mark.parametrize("seed", range(5))
def test_small_vocabularies_and_forgetting(seed, monkeypatch):
    rng = random.Random(seed)
    scores = {bytes([b]): -20.0 for b in range(256)}
    scores |= {"".join(rng.choices("abc", k=rng.randint(1, 5))).encode(): -rng.uniform(1, 9) for _ in range(30)}
    scores |= {token_counts.MARK: -2.0, token_counts.MARK + b"ab": -3.0}
    monkeypatch.setattr(token_counts, "REMEMBERED", 20)
    vocabulary = token_counts.Vocabulary(scores)
    for _ in range(6):
        words = ["".join(rng.choices("abcd", k=rng.randint(1, 9))) for _ in range(40)]
        got = vocabulary.count(Words(pa.array([" ".join(words[:7]), " ".join(words[7:])])))
        assert got.tolist() == [brute(w, scores) for w in words]


def test_empty_table(spark):
    assert token_counts.token_counts(documents(spark, ["a"]).limit(0), queries.piece_bpe()).collect() == []


def test_common_beginnings():
    rng = random.Random(2)
    for _ in range(300):
        a, b = (bytes(rng.choices(b"ab", k=rng.randint(0, 9))) for _ in range(2))
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert token_counts._common(a, b) == n


def test_long_words_equal_the_trie(monkeypatch):
    rng = random.Random(3)
    scores = token_counts.pieces(queries.piece_bpe())
    vocabulary = token_counts.Vocabulary(scores)
    words = ["".join(rng.choices(["token", "ing", "é", "日", "x", "0", "pre", "="], k=rng.randint(1, 300))) for _ in range(20)]
    expected = [brute(w, scores) for w in words]
    for places in (7, 60, 1 << 16):
        monkeypatch.setattr(token_counts, "PLACES", places)
        assert [vocabulary.segment_long(token_counts.MARK + w.encode()) for w in words] == expected
    ordered = sorted(token_counts.MARK + w.encode() for w in words)
    assert vocabulary.segment(ordered).tolist() == [vocabulary.segment_long(w) for w in ordered]


def test_a_word_of_a_megabyte():
    rng = random.Random(4)
    vocabulary = token_counts.Vocabulary(token_counts.pieces(queries.piece_bpe()))
    word = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=1 << 20))
    halves = Words(pa.array([word, f"{word[:300]} {word}", "short"], pa.string()))
    whole, start, again, short = vocabulary.count(halves).tolist()
    assert whole == again > (1 << 20) / 4 and 0 < start < 300 and short >= 1
