"""Near duplicates with buckets and blocks of two, against all pairs, and the share of pairs at the threshold that banding finds."""

import random

import numpy as np
import pytest

from sparkeval.llm import near_dedup


def brute(rows):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    part = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if part[a] != part[b] and x and y and 100 * len(x & y) >= 75 * len(x | y):
                part = [part[b] if p == part[a] else p for p in part]
    out = []
    for k, (i, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if part[j] == part[k] and sets[j][0] is not None]
        out.append((i, len(s), min(ids) if ids and s else i))
    return sorted(out, key=repr)


def corpus():
    """Groups of near copies, chains whose ends are not alike, exact copies, null ids with texts of their own."""
    rng = random.Random(4)
    rows, i = [], 0
    for g in range(12):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(90)]
        for _ in range(rng.randint(2, 9)):
            out = list(words)
            for _ in range(rng.randint(0, 2)):
                out[rng.randrange(90)] = f"x{rng.randint(0, 10**6)}"
            rows.append((i, " ".join(out)))
            i += 1
            if g % 3 == 0:
                words = out
    rows += [(None, rows[0][1]), (None, "words of a null id that no one else has at all"), (None, "other words of a null id that no one else has"), (900, rows[5][1].upper()), (901, ""), (902, None), (903, "a b"), (904, "A  b")]
    return rows


@pytest.mark.parametrize("bucket_rows, block_sets", [(2, 2), (3, 1), (2048, 256)])
def test_small_buckets_and_blocks(spark, bucket_rows, block_sets):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, bucket_rows=bucket_rows, block_sets=block_sets).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_recall_at_the_threshold():
    """Of 6,000 pairs of sets that are exactly 75 per cent alike, all but one in a thousand at most share a table and enough minhashes."""
    rng = np.random.default_rng(8)
    n, both, each = 6000, 300, 50  # 300 of 400 values are shared
    values = rng.integers(1, 1 << 63, (n, both + 2 * each), dtype=np.uint64)
    a, b = np.sort(values[:, : both + each], axis=1), np.sort(np.hstack([values[:, :both], values[:, both + each :]]), axis=1)
    starts = np.arange(n) * (both + each)
    x, y = (near_dedup.signatures(m.reshape(-1), starts) for m in (a, b))
    same = (x == y).reshape(n, 2 * near_dedup.GROUPS, near_dedup.ROWS).all(axis=2)
    table = same[:, : near_dedup.GROUPS].any(axis=1) & same[:, near_dedup.GROUPS :].any(axis=1)
    agree = ((x >> np.uint64(24)).astype(np.uint8) == (y >> np.uint64(24)).astype(np.uint8)).sum(axis=1) >= near_dedup.AGREE
    assert (table & agree).mean() >= 0.999


def test_columns_of_any_name(spark):
    """Columns called like those that the operator adds for itself stay as they are."""
    text = " ".join(f"w{i}" for i in range(40))
    names = ["__id", "__hash", "kept_id0", "KEPT_HASH0", "id", "text_hash", "class", "component", "component_id"]
    rows = [(i, t, *[i * 10 + k for k in range(len(names))]) for i, t in ((1, text), (2, text + " tail"), (3, "something else that nobody wrote before"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = near_dedup.near_dedup(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[2]]
