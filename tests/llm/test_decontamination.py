import random
import re
import time

import numpy as np
import pytest

from hindcast.llm import decontamination
from tests.llm.tables import documents

GAP = re.compile(r"[\x20\t-\r!-/:-@\[-`{-~]+")


def tokens(text):
    return [t for t in GAP.split((text or "").lower()) if t]


def brute_tiles(item, doc, least):
    """Greedy string tiling as first described: look for the longest free matches, mark them, repeat."""
    free_item, free_doc, out = [True] * len(item), [True] * len(doc), []
    while True:
        best, at = least - 1, None
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and free_item[i + k] and free_doc[j + k]:
                    k += 1
                if k > best:
                    best, at = k, (i, j)
        if at is None:
            return out
        out.append((best, *at))
        for k in range(best):
            free_item[at[0] + k] = free_doc[at[1] + k] = False


def shared(item, doc, least):
    return [(i, j) for i in range(len(item) - least + 1) for j in range(len(doc) - least + 1) if item[i : i + least] == doc[j : j + least]]


@pytest.mark.parametrize("seed", range(60))
def test_tiles_equal_the_plain_method(seed):
    rng = random.Random(seed)
    item = [rng.randint(0, rng.choice([2, 4, 9])) for _ in range(rng.randint(0, 25))]
    doc = [rng.randint(0, rng.choice([2, 4, 9])) for _ in range(rng.randint(0, 40))]
    for _ in range(2):
        a = rng.randint(0, 10)
        doc[len(doc) // 2 : len(doc) // 2] = item[a : a + rng.randint(2, 12)]
    least = rng.choice([1, 2, 3, 5])
    assert fast_tiles(item, doc, least) == brute_tiles(item, doc, least)


@pytest.mark.parametrize("seed", range(20))
def test_pairs_in_parts_give_the_same_tiles(seed, monkeypatch):
    rng = random.Random(seed)
    item, doc = ([rng.randint(0, 1) for _ in range(rng.randint(5, n))] for n in (25, 60))
    monkeypatch.setattr(decontamination, "PART", 7)
    assert fast_tiles(item, doc, 3) == brute_tiles(item, doc, 3)


def test_long_repetitions():
    """A text of 500,000 equal tokens and an item of 60: 28 million places fit together."""
    start = time.time()
    assert fast_tiles([1] * 60, [1] * 500_000, 5) == [(60, 0, 0)]
    assert fast_tiles([1] * 60 + list(range(2, 42)), [1] * 500_000, 5) == [(60, 0, 0)]
    assert time.time() - start < 60


def fast_tiles(item, doc, least):
    """The operator's tiles; the seeds that only one side has are left out, as its join does."""
    numbers = {}
    a, b = ([numbers.setdefault(tuple(x[k : k + least]), len(numbers)) for k in range(len(x) - least + 1)] for x in (item, doc))
    own = set(a)
    places = [j for j, seed in enumerate(b) if seed in own]
    return decontamination.tiles(
        np.array(a, np.int64), np.array([b[j] for j in places], np.int64), np.array(places, np.int64), least
    )


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefé", k=rng.randint(2, 6))) for _ in range(300)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [say(rng.randint(5, 40)) for _ in range(30)]
    texts = []
    for n in range(80):
        parts = say(rng.randint(0, 120))
        item = rng.choice(items)
        if n % 4 == 0:  # whole, in other case and punctuation
            parts[3:3] = [w.upper() + "," for w in item]
        elif n % 4 == 1:  # in pieces and in another order
            cut = len(item) // 2
            parts = parts[:9] + item[cut:] + parts[9:30] + item[:cut] + parts[30:]
        elif n % 4 == 2:  # a part too small to count
            parts += item[: len(item) // 3]
        texts.append(" ".join(parts))
    return [*texts, texts[0], None, "", "  ", "same " * 400, " ".join(items[0] * 30)], [" ".join(x) for x in items]


def test_equals_comparing_every_pair(spark):
    texts, items = corpus()
    items = [*items, None, "", "one two", items[3], "same " * 9]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").selectExpr("*", "'x' AS doc_id")
    docs = documents(spark, texts, extra=True)
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            a, b = tokens(item), tokens(text)
            found = brute_tiles(a, b, 5) if shared(a, b, 5) else []
            covered = sum(t[0] for t in found)
            if covered and covered >= 0.6 * len(a):
                want[d, i] = (len(found), covered, len(a))
    for bits, parts in ((27, 1), (3, 5)):  # a filter that is large enough, and one that lets everything through
        bench = bench.repartition(parts)
        rows = decontamination.contaminated(docs, bench, most_bits=bits).collect()
        assert {(r.doc_id, r.item_id): (r.n_tiles, r.tiled_tokens, r.item_tokens) for r in rows} == want
        assert len(rows) == len(want)
        left = decontamination.decontaminate(docs, bench, most_bits=bits)
        assert left.columns == docs.columns
        assert sorted(r.doc_id for r in left.collect()) == sorted(set(range(len(texts))) - {d for d, _ in want})
    assert any(n > 1 for n, _, _ in want.values())


def test_empty_tables(spark):
    texts, items = corpus()
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = documents(spark, texts[:3])
    assert decontamination.contaminated(docs, bench.limit(0)).collect() == []
    assert decontamination.contaminated(docs.limit(0), bench).collect() == []
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == 3


def test_short_items_and_long_passages(spark):
    rng = random.Random(5)
    words = [f"w{n}" for n in range(2000)]
    item = rng.sample(words, 500)
    long = ["x1", *item[100:150], "x2"]
    near = ["x1", *item[200:249], "x2"]
    texts = ["what is two", "What, is TWO?", "so what is two then", " ".join(long), " ".join(near), "", None, "yes", "..."]
    benchmark = spark.createDataFrame([(1, "what is two"), (2, " ".join(item)), (3, ""), (4, "...")], "item_id long, text string")
    docs = documents(spark, texts, extra=True)
    got = decontamination.contaminated(docs, benchmark).collect()
    assert sorted((r.doc_id, r.item_id, r.n_tiles, r.tiled_tokens) for r in got) == [(0, 1, 1, 3), (1, 1, 1, 3), (3, 2, 1, 50)]
    kept = decontamination.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6, 7, 8]


def test_rows_that_share_an_id_are_judged_apart(spark):
    texts, items = corpus()
    bench = spark.createDataFrame([(1, items[0])], "item_id long, text string")
    rows = [(7, items[0], "a"), (7, "a clean text", "b"), (None, items[0], "c"), (None, None, "d"), (7, items[0], "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own_0 string").withColumnRenamed("own_0", "OWN_0")
    found = decontamination.contaminated(docs, bench).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in found) == [("7", 1), ("7", 1), ("None", 1)]
    left = decontamination.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(r.OWN_0 for r in left.collect()) == ["b", "d"]


def test_the_filter_loses_no_seed(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(-(2**63), 2**63, 3000)
    table = spark.createDataFrame([(int(s),) for s in seeds], "seed long").repartition(4)
    seen = decontamination.Filter(table, 27)
    assert len(seen.may_hold(seeds.view(np.uint64))) == len(seeds)
    other = rng.integers(0, 2**64, 100_000, dtype=np.uint64)
    assert len(seen.may_hold(other)) < 1000
