"""The audit of filter interactions against counting every order on its own."""

import re
from itertools import permutations
from math import factorial

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkeval.llm import filter_audit
from sparkeval.llm.filter_audit import Diagram, audit, failure_masks, interactions, plain_changes, text_filters, with_labels

SCHEMA = "doc_id long, text string, source string, key long, mask int, part string, id string, words int, good int, toxic int"
PROSE = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    (1, PROSE, "a"), (2, PROSE, "b"), (2, PROSE, "b"), (3, PROSE.upper(), "a"), (4, None, "a"), (5, "", None), (6, "", ""), (None, PROSE, "a"), (None, "only here $", "c"),
    (7, "same " * 70, "b"), (8, "x" * 300_000, "a"), (9, PROSE + " 50% & more", None), (10, "ÀÉ " * 60, "b"), (11, PROSE + " tail", "a"), (12, "A $", "b"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, 1), (5, 1, None), (7, 1, 0), (12, 1, 1), (99, 1, 1), (None, 1, 1)]


def failed(text, doc_id, rows):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text))]
    return [*fails, doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows)]


def brute(rows, labels):
    good, toxic = {i for i, g, _ in labels if g == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    out = []
    for part in {s or "" for _, _, s in rows}:
        docs = [(i, failed(t or "", i, rows)) for i, t, s in rows if (s or "") == part]
        own = []
        for order in permutations(range(5)):
            left = docs
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if d[1][f]], [d for d in left if not d[1][f]]
                redundant = sum(d[1][f] for d in docs) - len(gone)
                unique = sum(d[1][f] and sum(d[1]) == 1 for d in docs)
                own.append([part, "".join("ABCDE"[x] for x in order), step, len(left), len(gone), redundant, unique, sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone), f])
        for row in own:
            row[-1] = sum(r[4] for r in own if r[1][r[2] - 1] == row[1][row[2] - 1])
        out += [tuple(r) for r in own]
    return sorted(out)


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, s, 1, 2, "x", "y", 3, 4, 5) for i, t, s in texts], SCHEMA)


def test_against_every_order_on_its_own(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = interactions(with_labels(failure_masks(rows_of(spark, TEXTS)), labels), "ABCDE").collect()
    assert sorted(map(tuple, got)) == brute(TEXTS, LABELS)
    assert len(got) == 4 * 120 * 5  # parts a, b, c and the empty one


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions(with_labels(failure_masks(rows_of(spark, [])), none), "ABCDE").count() == 0
    got = interactions(with_labels(failure_masks(rows_of(spark, TEXTS)), none), "ABCDE")
    assert got.where("good_lost + toxic_lost > 0").isEmpty() and not got.where("removed > 0").isEmpty()


def test_other_filters(spark):
    """Any number of filters, with their own parameters."""
    filters = {k: v for k, v in text_filters(least_words=3, symbols="[!]").items() if k in "AD"}
    docs = rows_of(spark, [(1, "a b", "s"), (2, "a b c", "s"), (3, "a b c!", "s"), (4, "a b", "s")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant) for r in interactions(with_labels(failure_masks(docs, filters), none), "ADC").collect()}
    assert len(got) == 18 and got["ADC", 1] == (2, 2, 0) and got["ADC", 2] == (1, 1, 0) and got["ADC", 3] == (1, 0, 1) and got["CAD", 2] == (2, 1, 1)


def test_swaps_visit_all_orders():
    for k in range(1, 7):
        order = list(range(k))
        seen = {tuple(order)}
        for i in plain_changes(k):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.add(tuple(order))
        assert len(seen) == factorial(k) == len(plain_changes(k)) + 1


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.data())
def test_diagram_after_swaps_equals_diagram_of_the_order(k, data):
    """Swapping levels gives the nodes, shared ones too, and weights that building over the new order gives."""
    counts = data.draw(st.dictionaries(st.integers(0, 2**k - 1), st.tuples(st.integers(0, 2), st.integers(0, 1), st.integers(0, 1))))
    diagram = Diagram(counts, k)
    for i in data.draw(st.lists(st.integers(0, max(0, k - 2)), max_size=8 if k > 1 else 0)):
        diagram.swap(i)
    moved = {sum(1 << j for j, f in enumerate(diagram.order) if mask >> f & 1): w for mask, w in counts.items()}
    fresh = Diagram(moved, k)
    assert [w for _, *w in diagram.path()] == [w for _, *w in fresh.path()]
    assert [len(x) for x in diagram.levels] == [len(x) for x in fresh.levels]
    assert [sorted(w) for w in diagram.weights[:-1]] == [sorted(w) for w in fresh.weights[:-1]]


def test_steps_add_up():
    rows = list(audit({0: (7, 1, 0), 1: (3, 0, 1), 3: (2, 1, 1)}, "AB"))
    assert rows == [("AB", 1, 7, 5, 0, 3, 1, 2, 8), ("AB", 2, 7, 0, 2, 0, 0, 0, 2), ("BA", 1, 10, 2, 0, 0, 1, 1, 2), ("BA", 2, 7, 3, 2, 3, 0, 1, 8)]
    assert filter_audit.COPY == "E"
