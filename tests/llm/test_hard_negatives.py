import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.llm import hard_negatives, queries
from hindcast.llm.hard_negatives import Index
from hindcast.llm.text import read_table

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rows int"


def brute(rows, step, positives=5, negatives=3, low=50, high=95):
    """The result of (id, vector, label) rows, by scoring every anchor against all rows."""
    whole = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label in rows]
    out = []
    for anchor, label, v in whole:
        if anchor % step:
            continue
        dot = lambda w, v=v: sum(x * y for x, y in zip(v, w))  # noqa: B905, E731
        ranked = sorted(((-dot(w), i, own) for i, own, w in whole if i != anchor))
        for score, positive, _ in [r for r in ranked if r[2] == label][:positives]:
            found = [r for r in ranked if r[2] != label and low * -score <= 100 * -r[0] <= high * -score]
            out += [(anchor, positive, k + 1, i, -score, -s) for k, (s, i, _) in enumerate(found[:negatives])]
    return sorted(out)


def clustered(seed, n, dims, labels):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims)) * np.linspace(2, 0.1, dims)
    out = []
    for i in range(n):
        own = int(rng.integers(0, labels))
        v = centres[own] + rng.normal(size=dims) * 0.4
        v = np.zeros(dims) if i % 41 == 0 else np.round(v, 1) if i % 3 else v / np.linalg.norm(v)
        out.append((i, [float(np.float32(x)) for x in v], own if i % 5 else (own + 1) % labels))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)


def result(df):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[c] for c in names) for r in df.collect())


@pytest.mark.parametrize("dims, blocks", [(19, (16_384, 2_048)), (8, (40, 7)), (1, (30, 3))])
def test_equals_scoring_all_pairs(spark, dims, blocks):
    rows = clustered(dims, 240, dims, 4)
    got = result(
        hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 6 == 0, block_rows=blocks[0], block_anchors=blocks[1])
    )
    assert got == brute(rows, 6)
    assert len(got) > 100 or dims == 1


def test_whole_table(spark):
    rows = read_table(spark, "/root/testdata/sf0.001", "embeddings").collect()
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in rows]
    assert result(queries.op12_hard_negatives(spark, "/root/testdata/sf0.001")) == brute(rows, 50)


def test_rows_that_take_no_part_short_vectors_repeated_ids_and_empty_tables(spark):
    rows = clustered(3, 80, 4, 3)
    rows = [(i, v[: 2 + i % 3], label) for i, v, label in rows]
    nan, inf = float("nan"), float("inf")
    odd = [(100, None, 1), (104, [1.0, None], 1), (108, [nan, 1.0], 1), (112, [inf, 1.0], 1), (116, [1.0], None), (None, [9.0], 1)]
    double = [rows[4], (rows[4][0], [9.0, 9.0], 7), (120, [], 1)]
    df = frame(spark, [*rows, *odd, *double])
    padded = [(i, (v + [0.0] * 4)[:4], label) for i, v, label in rows] + [(120, [0.0] * 4, 1)]
    got = result(hard_negatives.hard_negatives(df, F.col("vec_id") % 4 == 0))
    assert got == brute(padded, 4)
    assert result(hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 4 == 0)) == []
    assert result(hard_negatives.hard_negatives(df, F.col("vec_id") < 0)) == []


def test_index_finds_exactly_what_reaches_the_threshold_and_leaves_rows_out():
    rng = np.random.default_rng(4)
    rows, anchors = (np.floor(rng.normal(size=(n, 24)) * np.linspace(100, 1, 24)) for n in (300, 20))
    scores = anchors @ rows.T
    for share in (0.999, 0.9, 0.5, 0.0):
        threshold = np.quantile(scores, share, axis=1)
        i, j, found = Index(rows).reaching(anchors, threshold)
        want = scores >= threshold[:, None]
        assert {*zip(i.tolist(), j.tolist(), strict=True)} == {*zip(*(x.tolist() for x in np.nonzero(want)), strict=True)}
        assert (found == scores[i, j]).all()
    i, j, _ = Index(rows).reaching(anchors, np.full(20, 1e9))
    assert not len(i) and not len(j)
