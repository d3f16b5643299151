import hashlib
import random
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import pytest

from hindcast.llm import alignment, queries
from hindcast.llm.text import read_table
from tests.llm.tables import documents

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def tokens(texts):
    """Ids and bytes of both tokenizers over whole documents."""
    known = alignment.tokenizers_of(queries.byte_bpe(), queries.piece_bpe())
    out = []
    for text in texts:
        want = b" " + (text or "").encode()
        a = known.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = known.b.encode(text) if text else []
        a, b = ([(i, of[i]) for i in ids] for ids, of in ((a, known.bytes_a), (b, known.bytes_b)))
        same = all(b"".join(x for _, x in side) == want for side in (a, b))
        out.append((a, b) if same else ([], []))
    return out


def grouped(a, b):
    """Lists of A and B ids between the bytes where tokens of both end."""
    cuts, ends = [], []
    for side in (a, b):
        at, own = 0, []
        for _, x in side:
            at += len(x)
            own.append(at)
        ends.append(own)
    cuts = sorted(set(ends[0]) & set(ends[1]))
    out = [([], []) for _ in cuts]
    for k, side in enumerate((a, b)):
        for (i, _), end in zip(side, ends[k], strict=True):
            out[bisect_left(cuts, end)][k].append(i)
    return out


def brute(texts):
    groups = [grouped(a, b) for a, b in tokens(texts)]
    linked = [Counter((x, y) for a, b in doc for x in a for y in b) for doc in groups]
    counts = Counter(pair for doc in linked for pair in doc)
    most = Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for doc, pairs in zip(groups, linked, strict=True):
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in doc)
        out.append((
            sum(len(a) for a, _ in doc), sum(len(b) for _, b in doc), len(doc), sum(pairs.values()),
            sum(n for p, n in pairs.items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in pairs.items()),
            hashlib.sha256(spelled.encode()).hexdigest() if doc else "",
        ))
    return out


def odd_texts(seed, n):
    rng = random.Random(seed)
    parts = [*" \t\n\r\x0b\x1c\x1f\x00\x85\xa0  　 ", *"'sté漢🙂a1.,|;▁́", "<|endoftext|>", "</s>", "<unk>", "don't", " the", "  "]
    return ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(n)]


def digests(docs, **how):
    return alignment.alignment_digests(docs, queries.byte_bpe(), queries.piece_bpe(), **how)


@pytest.mark.parametrize("chunk", [4 << 20, 500])
def test_equals_linking_every_token(spark, chunk):
    """Small chunks share pairs among many of them."""
    texts = odd_texts(1, 300) + [None, "", " ", "\n", "a" * 3000, " " * 500, "=-" * 400, "▁", "a b", "a b", "the the the"]
    want = brute(texts)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in digests(documents(spark, texts, extra=True), chunk=chunk).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[2] for w in want) < sum(w[0] for w in want) < sum(w[3] for w in want)


def test_whole_table(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    rows = docs.orderBy("doc_id").collect()
    want = brute([r.text for r in rows])
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op11_alignment(spark, "/root/testdata/sf0.001").collect()}
    assert [got[r.doc_id] for r in rows] == want


def test_groups_of_the_operator(spark):
    texts = [*odd_texts(2, 60), None, "", "plain words, tokenized differently"]
    found = alignment.align(documents(spark, texts, extra=True), queries.byte_bpe(), queries.piece_bpe())
    got = {r.doc_id: r for r in found.collect()}
    for i, (a, b) in enumerate(tokens(texts)):
        row = got[i]
        assert (row.a_ids, row.b_ids) == ([x for x, _ in a], [x for x, _ in b])
        cuts = list(zip([0, *row.a_ends], [0, *row.b_ends], strict=True))
        groups = [(row.a_ids[p:q], row.b_ids[r:s]) for (p, r), (q, s) in zip(cuts, cuts[1:])]  # noqa: B905
        assert groups == grouped(a, b)


def test_crowded_groups_are_linked_by_different_ids():
    known = alignment.tokenizers_of(queries.byte_bpe(), queries.piece_bpe())
    found = alignment.Aligned(pa.array([*odd_texts(4, 200), "", "=-" * 400]), known)
    n_b = len(known.bytes_b)
    for x, y in zip(alignment.links(found, n_b), alignment.links(found, n_b, many=1), strict=True):
        assert x.tolist() == y.tolist()


def test_in_step_equals_common_ends():
    rng = random.Random(3)
    for _ in range(500):
        a, b = (sorted(rng.sample(range(1, 60), rng.randint(0, 50)) + [60]) for _ in range(2))
        if rng.random() < 0.3:
            b = a[:]
        inner_a, inner_b = set(range(len(a))), set(range(len(b)))
        for p, q, end_p, end_q in alignment.in_step(a, b):
            assert end_p - p > 1 or end_q - q > 1
            inner_a -= set(range(p, end_p - 1))
            inner_b -= set(range(q, end_q - 1))
        assert [a[i] for i in sorted(inner_a)] == [b[i] for i in sorted(inner_b)] == sorted(set(a) & set(b))
    assert alignment.in_step([], []) == []


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = documents(spark, ["same words", "other words", None])
    double = docs.union(docs.where("doc_id = 0")).selectExpr("nullif(doc_id, 1) AS doc_id", "text", "lang")
    rows = sorted(digests(double).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    assert [r.doc_id for r in rows] == [None, 0, 0, 2]
    want = brute(["other words", "same words", "same words", None])
    assert [tuple(r[c] for c in COLUMNS) for r in rows] == want
    assert digests(docs.limit(0)).collect() == []
