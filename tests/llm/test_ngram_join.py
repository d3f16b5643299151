import random
import re

import numpy as np
import pytest

from hindcast.llm import ngram_join, queries
from hindcast.llm.text import read_table
from tests.llm.tables import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, words=5):
    found = WORD.findall((text or "").translate(LOWER))
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}


def brute(rows, words=5, percent=80):
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows, by comparing all pairs."""
    sets = [shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                same = len(a & b)
                if 100 * same >= percent * (len(a) + len(b) - same):
                    root[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc)
    name = {r: min((x for x in of if x is not None), default=None) for r, of in ids.items()}
    return [(doc, len(s), name[find(i)] if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))]


def corpus(seed):
    """Chains of edits, groups of near copies, shared passages, cases, short texts."""
    rng = random.Random(seed)
    vocabulary = ["é" * rng.randint(0, 2) + "".join(rng.choices("abcdE", k=rng.randint(1, 4))) for _ in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [say(40) for _ in range(3)]
    texts = []
    for _ in range(25):
        base = say(rng.choice([3, 5, 8, 30, 80, 200])) + rng.choice([[], rng.choice(passages)])
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 2, 8])):
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n", "\t "]).join(base))
            if rng.random() < 0.2:
                texts.append(texts[-1].upper())
    return [*texts, None, "", " \n", None, "One two", "one TWO", "É x", "é x", texts[0], "loop " * 300, "loop " * 5]


def result(df):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=key)


@pytest.mark.parametrize("words, percent, block", [(5, 80, 1024), (5, 80, 3), (2, 60, 4), (1, 100, 2)])
def test_equals_comparing_all_pairs(spark, words, percent, block):
    texts = corpus(words * percent + block)
    docs = documents(spark, texts, extra=True)
    want = brute(list(enumerate(texts)), words, percent)
    assert result(ngram_join.similar_documents(docs, words, percent, block)) == want
    assert 20 < sum(1 for d, n, c in want if d != c) < len(texts) - 20


def test_equals_sql_on_whole_table(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    assert result(queries.op13_ngram_join(spark, "/root/testdata/sf0.001")) == brute(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = documents(spark, ["a b c d e f", "A b c d e f", "x y", None, "x y", "z"])
    rows = docs.union(docs.where("doc_id = 0")).selectExpr("nullif(nullif(doc_id, 1), 5) AS doc_id", "text", "'' AS node", "1 AS n")
    assert result(ngram_join.similar_documents(rows)) == [
        (None, 1, None), (None, 2, 0), (0, 2, 0), (0, 2, 0), (2, 1, 2), (3, 0, 3), (4, 1, 2)
    ]
    assert ngram_join.similar_documents(docs.limit(0)).collect() == []


def test_bounds_hold_for_all_pairs_of_linked_sets():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = set(rng.choice(10_000, n, replace=False).tolist())
        b = set(a)
        for x in rng.choice(sorted(a), int(rng.integers(0, n // 4 + 1)), replace=False).tolist():
            b.discard(x)
            if rng.random() < 0.5:
                b.add(int(rng.integers(10_000, 20_000)))
        same = len(a & b)
        if not b or 100 * same < 80 * len(a | b):
            continue
        heads = [set(sorted(s)[: int(ngram_join.head(np.int64(len(s)), 80))]) for s in (a, b)]
        for s in (a, b):
            assert same >= ngram_join.least(np.int64(len(s)), 80)
            assert len(heads[0] & heads[1]) >= ngram_join.needed(np.int64(len(s)), 80)


def test_product_classes_equals_pairs():
    rng = random.Random(2)
    for _ in range(60):
        base = rng.sample(range(1000), 40)
        sets = [np.array(sorted(set(base[: rng.randint(1, 40)]) | set(rng.sample(range(1000), rng.randint(0, 6)))), np.uint64) for _ in range(20)]
        side = np.array([rng.randint(0, 1) for _ in sets])
        got = ngram_join.product_classes(sets, side, np.arange(20), 80)
        root = list(range(20))
        for i in range(20):
            for j in range(i):
                same = len(np.intersect1d(sets[i], sets[j]))
                if (side[i] != side[j] or len(set(side.tolist())) == 1) and 100 * same >= 80 * (len(sets[i]) + len(sets[j]) - same):
                    old, new = root[i], root[j]
                    root = [new if r == old else r for r in root]
        assert len({*zip(got.tolist(), root, strict=True)}) == len(set(root)) == len(set(got.tolist()))
