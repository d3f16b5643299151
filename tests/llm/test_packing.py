import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from hindcast.llm import packing, queries
from tests.llm.tables import documents


def check_plan(counts, capacity):
    """Every piece is placed once and no sequence holds gaps or too much; gives the number of sequences."""
    sequences, placed = defaultdict(list), Counter()
    for run in packing.plan(counts, capacity):
        assert run.first == placed[run.length]
        for i in range(run.sequences * run.each):
            sequences[run.sequence + i // run.each].append((run.offset + i % run.each * run.length, run.length))
        placed[run.length] += run.sequences * run.each
    assert placed == Counter({k: v for k, v in counts.items() if v})
    for items in sequences.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def best_fit(counts, capacity):
    gaps = []
    for length in sorted(Counter(counts).elements(), reverse=True):
        fitting = [g for g in gaps if g >= length]
        if fitting:
            gaps.remove(min(fitting))
            gaps.append(min(fitting) - length)
        else:
            gaps.append(capacity - length)
    return len(gaps)


@pytest.mark.parametrize("seed", range(30))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 2, 7, 20, 64])
    counts = dict(Counter(rng.choice([rng.randint(1, capacity), rng.randint(1, max(1, capacity // 5))]) for _ in range(rng.randint(0, 300))))
    n = check_plan(counts, capacity)
    least = -(-sum(k * v for k, v in counts.items()) // capacity)
    assert least <= n <= best_fit(counts, capacity) + 0.03 * least + 1


def test_complements_of_one_two_and_three_lengths_fill_exactly():
    assert check_plan({7: 1, 3: 1, 6: 1, 1: 1}, 10) == 2
    assert check_plan({6: 4, 3: 4, 1: 4}, 10) == 4
    assert check_plan({4: 2, 3: 2, 2: 2, 1: 2}, 10) == 2
    assert check_plan({5: 6}, 10) == 3


def test_ids_equal_the_tokenizers_and_awkward_rows_are_kept(spark):
    from tokenizers import Tokenizer

    texts = [
        None, "", "  \n", "one two", "one two", "a\x1cb c\x85d e f", "<|endoftext|> x<|startoftext|>", "ÉÈ ΑΣ İx ǅ ß ﬁ é",
        "don't we'll THE!! 100% ça,va «quoi» naïve's ___ a_b", "x " * 5000, "long" * 3000, "tail \x00 ​ ź́",
    ]
    tokenizer = Tokenizer.from_file(queries.word_bpe())
    rows = packing.pack(documents(spark, texts, extra=True), queries.word_bpe()).collect()
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want = []
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[start : start + 2048], "<u4")
            want.append((piece, start, len(part), zlib.crc32(part.tobytes())))
        assert sorted(got[i]) == want, text
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048


def test_repeated_rows_and_empty_table(spark):
    docs = documents(spark, ["same words"] * 40)
    rows = packing.pack(docs.union(docs), queries.word_bpe(), capacity=7).collect()
    assert len(rows) == 80
    assert len({(r.sequence_id, r.offset) for r in rows}) == 80
    empty = packing.pack(docs.limit(0), queries.word_bpe())
    assert empty.count() == 0 and "sequence_id" in empty.columns
