import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hindcast.llm import line_quality
from hindcast.llm.text import read_table
from tests.llm.tables import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    n, repeated = len(words), len(covered)
    failed = n < 20 or 100 * repeated > 30 * n
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated, failed)


def corpus():
    rng = random.Random(3)
    vocabulary = ["the", "of", "é", "ß!", "#tag", "a&b", "|", "100%", "WORD", "日本", "x" * 30]
    texts = []
    for _ in range(150):
        lines = []
        for _ in range(rng.randint(0, 12)):
            lines.append(" ".join(rng.choices(vocabulary, k=rng.randint(0, 15))))
            if rng.random() < 0.3:
                lines.append(rng.choice(lines))
        texts.append(rng.choice(["\n", "\n\n", "\r\n", "\n \t\n"]).join(lines))
    return [*texts, None, "", "\n\n", " \x0b ", "a", "\n x", "go on " * 4000, "\n".join(["same line here"] * 3000), "y" * 100_000]


def test_base_counts_equal_plain_ones(spark):
    texts = corpus()
    docs = documents(spark, texts, extra=True)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in line_quality.judge(docs, labels).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        r = rows[i]
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute(text), (i, text and text[:80])
        assert r.kept == (not r.base_failed)  # nothing learnt: every line is content
    kept = line_quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in rows if rows[i].kept)
    assert line_quality.judge(docs.limit(0), labels).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_decoding_finds_the_best_labels(seed):
    rng = np.random.default_rng(seed)
    field = line_quality.Field(pairs=rng.normal(size=(2, 2)))
    scores = rng.normal(size=rng.integers(0, 9)).tolist()

    def total(labels):
        return sum(s for s, y in zip(scores, labels) if y) + sum(field.pairs[a, b] for a, b in zip(labels, labels[1:]))

    best = max((total(y) for y in itertools.product((0, 1), repeat=len(scores))), default=0)
    assert total([int(x) for x in field.decode(scores)]) == pytest.approx(best)


def test_gradient_fits_separable_lines():
    """Also the marginals: the fitted chain must give both labels back."""
    rng = np.random.default_rng(1)
    texts, labels = [], []
    for _ in range(60):
        y = int(rng.integers(0, 2))
        rows = rng.integers(0, 3, (int(rng.integers(1, 9)), len(line_quality.EDGES)))
        rows[:, 1] = 5 * (1 - y)
        texts.append((rows + np.arange(len(line_quality.EDGES)) * line_quality.WIDTH).astype(np.uint8))
        labels.append(y)
    field = line_quality.fit(texts, labels)
    for t, y in zip(texts, labels):
        assert all(x == bool(y) for x in field.decode(field.emissions(t).tolist()))
    assert line_quality.fit([], []).weights.any() == line_quality.fit(texts[:1], labels[:1]).weights.any() == False  # noqa: E712


def test_held_out_accuracy(spark):
    """Fitted on 300 documents of either quality, judged on the labelled ones that were not among them."""
    sf = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    field = line_quality.train(docs, labels, sample=100)
    good = labels.where("quality = 1 AND doc_id % 7 = 0").join(docs, "doc_id").select("text").collect()
    bad = labels.where("quality = 0 AND doc_id % 3 = 0").join(docs, "doc_id").select("text").collect()
    kept = [line_quality._verdicts(pa.array([r.text for r in rows]), field, 0.5)[2] for rows in (good, bad)]
    base = [np.array([brute(r.text)[5] for r in rows]) for rows in (good, bad)]
    assert kept[0][~base[0]].mean() > 0.98
    assert kept[1].mean() < 0.05


def test_the_fit_is_bounded_by_lines_and_rows_of_one_id_count_once(spark):
    rng = random.Random(9)
    good = lambda n: "\n".join("The committee met in the old town and spoke about the new bridge." for _ in range(n))
    bad = lambda n: "\n".join(rng.choice(["Home | Login | Cart", "Share >> Tweet", "$$$ 50% OFF"]) for _ in range(n))
    texts = [good(5), bad(6), good(100_000), bad(3)] * 3
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, i % 2 ^ 1) for i in range(len(texts))], "doc_id long, quality int")
    field = line_quality.train(docs, labels)
    again = line_quality.train(docs.unionAll(docs), labels)
    assert np.allclose(field.weights, again.weights) and np.allclose(field.pairs, again.pairs) and field.weights.any()
    features = np.arange(12, dtype=np.uint8).reshape(6, 2)
    assert b"".join(line_quality.windows(features, 4, 2)) == features.tobytes()
    assert len(line_quality.windows(features, 2, 2)) == 2 and line_quality.windows(features[:0], 2, 2) == []
