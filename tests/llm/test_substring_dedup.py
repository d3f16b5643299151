import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from hindcast.llm import substring_dedup
from tests.llm.tables import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, size):
    """(n_words, n_removed, kept text) of each text, by comparing the windows themselves."""
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def corpus(seed, size):
    """Texts that share passages just under, at and over the size of a window."""
    rng = random.Random(seed)
    vocabulary = ["é" * rng.randint(0, 2) + "".join(rng.choices("abcd", k=rng.randint(1, 3))) for _ in range(60)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [say(size + d) for d in (-1, 0, 1, 7)]
    texts = []
    for _ in range(60):
        parts = [say(rng.randint(0, 2 * size))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(shared), say(rng.randint(0, 9))]
        gap = rng.choice([" ", "\n", "  \t", "\x0b\r"])
        texts.append(gap.join(w for p in parts for w in p))
    return [*texts, texts[3], " " + texts[4] + " ", None, "", " \n ", "loop " * (3 * size), "x" * 5000]


@pytest.mark.parametrize("size, gram", [(35, 18), (6, 3), (4, 1), (3, 3)])
def test_equals_comparing_all_windows(spark, size, gram, monkeypatch):
    texts = corpus(size, size)
    want = brute(texts, size)
    docs = documents(spark, texts, extra=True)
    got = {r.doc_id: r for r in substring_dedup.repeated_windows(docs, size, gram).collect()}
    assert len(got) == len(texts)
    for i, (n, removed, kept) in enumerate(want):
        assert (got[i].n_words, got[i].n_removed) == (n, removed), i
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert 0 < sum(w[1] for w in want) < sum(w[0] for w in want)
    left = {r.doc_id: r.kept for r in substring_dedup.without_repeats(docs, size, gram).collect()}
    assert [left[i] for i in range(len(texts))] == [w[2] for w in want]


def test_repeated_rows_and_empty_table(spark):
    docs = documents(spark, ["a b c d e", "f g h"])
    rows = substring_dedup.repeated_windows(docs.union(docs.where("doc_id = 0")), 4, 2).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(0, 5), (0, 5), (1, 0)]
    assert substring_dedup.repeated_windows(docs.limit(0)).collect() == []


def test_sliding():
    values = np.random.default_rng(1).integers(0, 99, 40)
    for size in (1, 2, 3, 7, 18, 40):
        want = [values[i : i + size].min() for i in range(len(values) - size + 1)]
        assert substring_dedup._sliding(values, size, np.minimum).tolist() == want
