import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hindcast.llm import near_dedup
from hindcast.llm.components import components
from tests.llm.tables import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(text or "")
    if 0 < len(words) < 5:
        return Counter([tuple(words)])
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(texts, share, similar=0.8):
    """Similarity of every pair, and the classes that pairs of at least `similar` form."""
    counts = [shingles(t) for t in texts]
    df = Counter(s for c in counts for s in c)
    n = len(texts)

    def weight(s):
        return 1 + min(1, math.log(n / df[s]) / math.log(1 / share)) if df[s] > share * n else 2

    vectors = [{s: k * weight(s) for s, k in c.items()} for c in counts]
    root, links = list(range(n)), {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in range(n):
        for i in range(j):
            a, b = vectors[i], vectors[j]
            least = sum(min(a[s], b[s]) for s in a.keys() & b.keys())
            most = sum(a.values()) + sum(b.values()) - least
            links[i, j] = least / most if most else 1.0
            if links[i, j] >= similar:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)], links


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghé", k=rng.randint(2, 7))) for _ in range(2000)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    line = say(12)  # in many texts
    texts = []
    for _ in range(40):
        base = say(rng.choice([3, 8, 40, 150, 700]))
        if rng.random() < 0.5:
            base[4:4] = line
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):  # copies with some words changed
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, len(words) // 40, len(words) // 10])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n"]).join(words))
    rng.shuffle(texts)
    return [*texts, None, "", "  ", "one", "one", "again " * 300, "again " * 298, "x" * 3000]


@pytest.mark.parametrize("seed, share", [(1, 0.01), (2, 0.05)])
def test_classes_are_those_of_all_pairs(spark, seed, share, monkeypatch):
    texts = corpus(seed)
    want, links = brute(texts, share)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(documents(spark, texts, extra=True), share=share).collect()}
    assert len(got) == len(texts)
    assert {i: got[i].class_id for i in got} == dict(enumerate(want))
    assert all(got[i].kept == (i == want[i]) for i in got)
    assert len(set(want)) < len(texts) - 10
    assert sum(0.5 < s < 0.8 for s in links.values()) > 5


def test_blocks_and_samples_in_large_groups_change_nothing(spark, monkeypatch):
    """Groups of more members than a block, and of so many that samples choose the pairs to compare."""
    monkeypatch.setattr(near_dedup, "BLOCK", 20)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(220)]
    texts = []
    for n in range(90):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 6])):
            words[rng.randrange(len(words))] = f"x{n}"
        texts.append(" ".join(words))
    texts += [f"clean text number {i} " + " ".join(f"v{i}{k}" for k in range(30)) for i in range(40)]
    want, _ = brute(texts, 0.01)
    got = near_dedup.near_duplicates(documents(spark, texts)).collect()
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(want))


def test_share_of_equal_samples_is_the_weighted_similarity():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    found = []
    for _ in range(40):
        a = np.sort(rng.choice(hashes, 300, replace=False))
        b = np.sort(np.unique(np.concatenate([a[:240], rng.choice(hashes, 60)])))
        w, v = rng.uniform(0.5, 6, len(a)), rng.uniform(0.5, 6, len(b))
        v[np.isin(b, a)] = w[np.isin(a, b)] * rng.choice([1.0, 1.0, 0.7], np.isin(b, a).sum())
        edges = np.array([0, len(a), len(a) + len(b)])
        one, two = near_dedup.consistent_samples(np.concatenate([a, b]), np.concatenate([w, v]), edges)
        found.append((near_dedup.weighted_jaccard((a, w), (b, v)), (one == two).mean()))
    exact, estimated = np.array(found).T
    assert abs(exact.mean() - estimated.mean()) < 0.03
    assert np.abs(exact - estimated).max() < 0.25


def test_pairs_with_few_equal_samples_are_verified(spark):
    """Thinned pairs at a similarity of exactly 0.8 that share a band, but less than 65 % of their samples."""
    rng, texts = random.Random(270), []
    for _ in range(3000):
        base = [rng.randrange(10**9) for _ in range(274)]
        other = list(base)
        other[22::45] = [rng.randrange(10**9, 2 * 10**9) for _ in other[22::45]]
        texts += [" ".join(map(str, base)), " ".join(map(str, other))]
    first, second = (shingles(t) for t in texts[:2])
    assert (first & second).total() / (first | second).total() == 0.8
    hard = []
    for start in range(0, len(texts), 1000):
        sampled = near_dedup.Sampled(near_dedup.Texts(pa.array(texts[start : start + 1000]), 5), near_dedup.Frequent(10**6, 0.01, {}), 0.8)
        assert sampled.rows == [(i, 1) for i in range(1000)]
        bands = sampled.bands()
        for i in range(0, 1000, 2):
            if (bands[i] == bands[i + 1]).any() and (sampled.samples[i] == sampled.samples[i + 1]).mean() < 0.65:
                hard += texts[start + i : start + i + 2]
    assert len(hard) >= 10
    others = [f"a short text on number {i}" for i in range(300)]  # so that two texts are under one in a hundred
    found = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(documents(spark, [*hard, *others])).collect()}
    assert [found[i + 1] for i in range(0, len(hard), 2)] == list(range(0, len(hard), 2))


def test_similar_texts_meet_on_a_common_level():
    for weight in np.linspace(1, 9000, 4001):
        a = near_dedup.levels_of(float(weight), 0.8)
        b = near_dedup.levels_of(float(weight) / 0.8, 0.8)
        assert set(a) & set(b) and len(a) <= 2


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 300 + i) for i in range(50)]
    edges += [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_rows_without_id_and_repeated_rows(spark):
    docs = documents(spark, ["a b c d e f g", "a b c d e f g", "other words entirely here now"])
    unnamed = docs.where("doc_id = 0").selectExpr("CAST(NULL AS long) AS doc_id", "text", "lang", "source", "n_chars")
    rows = near_dedup.near_duplicates(docs.unionAll(unnamed).unionAll(docs.where("doc_id = 2"))).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.class_id, r.kept) for r in rows if r.doc_id is not None) == [
        (False, 0, 0, True), (False, 1, 0, False), (False, 2, 2, True), (False, 2, 2, True)
    ]
    assert [(r.class_id, r.kept) for r in rows if r.doc_id is None] == [(0, False)]
    assert near_dedup.near_duplicates(docs.limit(0)).collect() == []


LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


def stays(spark, rows, schema="doc_id long, text string, lang string"):
    found = near_dedup.keep_first(spark.createDataFrame(rows, schema).repartition(3))
    assert found.columns == [c.split()[0] for c in schema.split(", ")]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_texts_that_share_an_id_are_judged_each_for_itself(spark):
    other = "a text of its own that is like no other text in this table at all and stays"
    assert stays(spark, [(1, LONG, "x"), (2, other, "x"), (2, LONG, "x")]) == [(1, LONG, "x"), (2, other, "x")]
    # Two texts under one id, one of them like a third: the other is not drawn into its class.
    assert stays(spark, [(2, LONG, "x"), (2, other, "x"), (5, LONG + " seventeen", "x")]) == [(2, other, "x"), (2, LONG, "x")]


def test_repeated_rows_and_rows_without_id_leave_one(spark):
    assert stays(spark, [(1, LONG, "x"), (1, LONG, "x"), (1, LONG, "x")]) == [(1, LONG, "x")]
    assert len(stays(spark, [(1, LONG, "x"), (1, LONG, "y")])) == 1
    assert stays(spark, [(None, LONG, "x"), (None, LONG, "x")]) == [(None, LONG, "x")]
    assert stays(spark, [(None, LONG, "x"), (7, LONG, "x")]) == [(7, LONG, "x")]
    assert stays(spark, [(3, None, "x"), (4, " ", "x"), (5, "", "x")]) == [(3, None, "x")]


def test_columns_with_clashing_names_stay(spark):
    schema = "doc_id long, text string, _extra string, own_0 int, key1 string, class_id long, stays_own_1 int, n int, row int, id int"
    rows = [(i, LONG if i < 2 else f"text {i}", "e", i, "k", 9, 1, 2, 3, 4) for i in range(4)]
    assert stays(spark, rows, schema) == sorted([rows[0], *rows[2:]], key=repr)


def test_keep_first_of_nothing(spark):
    assert stays(spark, []) == []


def shuffled_bytes(df):
    """Bytes that the shuffles of the collected frame's own plan took in."""

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.finalPhysicalPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        own = node.metrics().apply("dataSize").value() if name == "ShuffleExchangeExec" else 0
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_documents_that_stay_are_not_shuffled(spark):
    """Only rows that may go meet the table of those that go, also where it is too large to broadcast."""
    rng = random.Random(8)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(400)) for _ in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), (300, texts[0]), (301, texts[1] + " end")], "doc_id long, text string")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = {k: spark.conf.get(k) for k in (key, "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for k in before:
        spark.conf.set(k, "-1")
    try:
        found = near_dedup.keep_first(docs)
        assert shuffled_bytes(found) < sum(map(len, texts)) / 10
        assert sorted(r.doc_id for r in found.collect()) == list(range(300))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_copies_of_a_text_are_verified_once(spark, monkeypatch):
    gathered, in_blocks = [], near_dedup._in_blocks
    monkeypatch.setattr(near_dedup, "_in_blocks", lambda rows, n: (gathered.append(rows), in_blocks(rows, n))[1])
    rows = [(i, LONG, "x") for i in range(20)] + [(1, LONG, "x")] * 20 + [(50, LONG + " seventeen", "x")]
    assert stays(spark, rows) == [(0, LONG, "x")]
    assert gathered[-1].count() == 2
