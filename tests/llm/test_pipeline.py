"""The pipeline against brute-force stages, and its contract."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from hindcast.llm import line_quality, personal_data, queries
from hindcast.llm.text import read_table
from hindcast.sources.sinks import through_storage
from tests.llm.test_decontamination import brute_tiles, shared, tokens
from tests.llm.test_near_dedup import shingles

FOLDER = "/root/testdata/sf0.001"


def similar_classes(texts):
    """Class of each text by weighted Jaccard of all pairs that share a shingle."""
    import math
    from collections import Counter

    counts = {i: shingles(t) for i, t in texts.items()}
    df = Counter(s for c in counts.values() for s in c)
    n = len(texts)
    weight = {s: 1 + min(1, math.log(n / k) / math.log(100)) if k > 0.01 * n else 2 for s, k in df.items()}
    vectors = {i: {s: k * weight[s] for s, k in c.items()} for i, c in counts.items()}
    holders = defaultdict(list)
    for i, v in vectors.items():
        for s in v:
            holders[s].append(i)
    pairs = {(a, b) for group in holders.values() for a in group for b in group if a < b}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in sorted(pairs):
        least = sum(min(vectors[a][s], vectors[b][s]) for s in vectors[a].keys() & vectors[b].keys())
        if least >= 0.8 * (sum(vectors[a].values()) + sum(vectors[b].values()) - least):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage."""
    docs, out = read_table(spark, FOLDER, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = through_storage(stage(spark, docs, FOLDER), "stage")
        out.append((name, docs, after))
        docs = after
    return out


def texts_of(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_keep_the_columns_of_documents(spark, stages):
    columns = read_table(spark, FOLDER, "documents").dtypes
    assert [name for name, _, _ in stages] == [
        "quality rules", "near duplicates", "benchmark decontamination", "personal data", "packing"
    ]
    assert all(after.dtypes == columns for _, _, after in stages[:-1])
    assert all(before.count() >= after.count() > 0 for _, before, after in stages[:-1])


def test_quality_rules_keep_what_the_operator_keeps(spark, stages):
    _, before, after = stages[0]
    field = line_quality.train(before, read_table(spark, FOLDER, "labels"))
    texts = texts_of(before)
    kept = line_quality._verdicts(pa.array(list(texts.values()), pa.string()), field, 0.5)[2]
    assert texts_of(after) == {i: t for (i, t), ok in zip(texts.items(), kept) if ok}


def test_one_document_of_each_class_stays(stages):
    _, before, after = stages[1]
    texts = texts_of(before)
    classes = similar_classes(texts)
    assert texts_of(after) == {i: t for i, t in texts.items() if classes[i] == i}


def test_contaminated_documents_go(spark, stages):
    _, before, after = stages[2]
    items = [tokens(r.text) for r in read_table(spark, FOLDER, "benchmark").collect()]
    clean = {}
    for i, text in texts_of(before).items():
        doc = tokens(text)
        bad = False
        for item in items:
            grams = {tuple(item[k : k + 5]) for k in range(len(item) - 4)}
            if any(tuple(doc[k : k + 5]) in grams for k in range(len(doc) - 4)):
                covered = sum(n for n, _, _ in brute_tiles(item, doc, 5)) if shared(item, doc, 5) else 0
                bad |= covered >= 0.6 * len(item)
        if not bad:
            clean[i] = text
    assert texts_of(after) == clean


def test_personal_data_is_replaced(stages):
    _, before, after = stages[3]
    assert texts_of(after) == {i: personal_data.redacted(t) for i, t in texts_of(before).items()}
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_run_packs_what_is_left(spark, stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.word_bpe())
    want = set()
    for i, text in texts_of(stages[4][1]).items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[start : start + 2048], "<u4")
            want.add((i, piece, start, len(part), zlib.crc32(part.tobytes())))
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want
    assert len(rows) == len(want)
