from collections import Counter

from hindcast.operators import linkage as L
from hindcast.operators.joins import full_outer
from tests.conftest import tuples

XWALK = "entity_id bigint, source string, source_key string, hash_key string"


def crosswalk(frame):
    return frame(
        XWALK,
        (7, "A", "1", None), (3, "A", "1", None), (4, "A", "2", None), (5, "A", "x9", None), (6, "H", None, "h1"),
        (8, "B", "2", None),
    )


def test_link_entity_takes_the_smallest_and_keeps_unmatched(frame):
    df = frame("k bigint, v string", (1, "a"), (1, "b"), (2, "c"), (9, "d"), (None, "e"))
    linked = L.link_entity(df, crosswalk(frame), "A", "k")
    assert tuples(linked, "v", "entity_id") == [("a", 3), ("b", 3), ("c", 4), ("d", None), ("e", None)]
    many = L.link_entity(df, crosswalk(frame), "A", "k", many=True)
    assert tuples(many, "v", "entity_id") == [("a", 3), ("a", 7), ("b", 3), ("b", 7), ("c", 4), ("d", None), ("e", None)]


def test_link_hash_and_text(frame):
    df = frame("h string", ("h1",), ("h2",))
    assert tuples(L.link_entity(df, crosswalk(frame), "H", "h", "hash"), "h", "entity_id") == [("h1", 6), ("h2", None)]
    text = frame("k string", ("x9",), ("2",))
    assert tuples(L.link_entity(text, crosswalk(frame), "A", "k", "text"), "k", "entity_id") == [("2", 4), ("x9", 5)]


def test_link_via_and_two_hop(frame):
    records = frame("case_no bigint, v string", (10, "a"), (11, "b"), (None, "c"))
    cases = frame("case_no bigint, entity_id bigint", (10, 5), (10, 4), (12, 9))
    assert tuples(L.link_via(records, cases, "case_no"), "v", "entity_id") == [("a", 4), ("b", None), ("c", None)]
    index = frame("urno bigint, number string", (1, "2"), (1, "2"), (2, "nobody"))
    flags = frame("urno bigint, f string", (1, "Y"), (2, "N"), (3, "N"))
    linked = L.link_two_hop(flags, index, "urno", "number", crosswalk(frame), "A")
    assert tuples(linked, "urno", "entity_id") == [(1, 4), (2, None), (3, None)]
    every_tag = L.link_two_hop(flags, index, "urno", "number", crosswalk(frame), None)
    assert tuples(every_tag, "urno", "entity_id") == [(1, 4), (1, 8), (2, None), (3, None)]


def test_coverage_and_histograms(frame):
    df = frame("entity_id bigint", (1,), (None,), (2,))
    assert tuples(L.link_coverage(df)) == [(1, 3)]
    assert tuples(L.multiplicity_histogram(crosswalk(frame))) == [(1, 6)]


def _join_sizes(left, right):
    """Rows per left key of a left join, the long way."""
    sizes = Counter()
    for (a,) in left:
        matches = sum(1 for (b,) in right if a is not None and a == b)
        sizes[a] += max(matches, 1) if a is not None else 0
    return sorted(Counter(sizes.values()).items())


def test_fanout_histogram_equals_the_join(frame):
    left = [(1,), (1,), (2,), (3,), (None,), (None,)]
    right = [(1,), (1,), (1,), (2,), (None,)]
    found = L.join_fanout_histogram(frame("k bigint", *left), frame("k bigint", *right), "k")
    assert tuples(found) == _join_sizes(left, right)


def test_facts_per_entity(frame):
    facts = frame("stay_id bigint", (1,), (1,), (2,), (3,), (9,), (None,))
    stays = frame("stay_id bigint, entity_id bigint", (1, 10), (2, 10), (3, 11), (3, None), (4, 12))
    assert tuples(L.facts_per_entity_histogram(facts, stays, "stay_id", "entity_id")) == [(0, 1), (1, 1), (3, 1)]


def test_full_outer_keeps_every_row(frame):
    left = frame("k bigint, a string", (1, "a1"), (1, "a2"), (2, "a3"), (None, "a4"))
    right = frame("k bigint, b string", (1, "b1"), (1, "b2"), (3, "b3"), (None, "b4"))
    assert tuples(full_outer(left, right, "k"), "k", "a", "b") == tuples(left.join(right, "k", "full"), "k", "a", "b")


def test_linked_extract(frame):
    df = frame("k string, v string", ("1", "a"), ("5", "b"), ("bad", "c"))
    got = L.linked_extract(df, crosswalk(frame), "A", "k", ["v"])
    assert tuples(got, "k", "v", "entity_id") == [
        ("1", "a", 3), ("1", "a", 7), ("5", "b", None), ("bad", "c", None), (None, None, 4), (None, None, 5)
    ]


def test_typed_crosswalk(frame):
    rows = tuples(L.typed_crosswalk(crosswalk(frame)), "entity_id", "source_key")
    assert (5, None) in rows and (7, 1) in rows and len(rows) == 6
