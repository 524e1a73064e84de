"""Repeated strings against brute force, with parts, chunks and common anchors made so small that every path runs."""

import hashlib
import random
import re

import pytest

from sparkeval.llm import substring_dedup


def brute(texts):
    seen, out = {}, []
    for i, t in texts:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            seen[w] = min(seen.get(w, i), i)
    for i, t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    """Texts with blanks, rules of dashes, a line in all of them between words of their own, shared passages, a long one, copies."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    own = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages, line = [own(14) for _ in range(5)], "this line stands in every text, whatever else it may hold"
    out = []
    for i in range(120):
        parts = [own(rng.randint(0, 12)), " " * rng.choice([0, 15, 49, 50, 51, 90]), own(3), "-" * rng.choice([0, 40, 60, 130]), own(4), line, own(3)]
        parts += [rng.choice(passages)[rng.randint(0, 9) :] for _ in range(rng.randint(0, 2))] + ["é" * rng.choice([0, 30])]
        out.append((i * 3 % 121, "".join(rng.sample(parts, len(parts)))))
    out[7] = (out[7][0], "".join(t for _, t in out[20:50]))
    out[8], out[9], out[10] = (500, out[3][1]), (501, out[3][1]), (502, None)
    return out


@pytest.mark.parametrize("part, common, chunk", [(1 << 23, 64, 1 << 20), (256, 2, 1 << 20), (1024, 3, 200), (256, 1, 120)])
def test_against_brute_force(spark, part, common, chunk):
    texts = corpus(part + common)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = substring_dedup.remove_repeats(docs, part=part, common=common, chunk=chunk).collect()
    assert sorted(map(tuple, got)) == brute(texts)


def test_parts_are_bounded():
    """A common anchor puts no more than `common` entries of a block on its part."""
    import pyarrow as pa

    docs = [f"{i:09d}{' ' * 80}{i * 7919:012d}" for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs)), pa.int64()), pa.array(docs)], ["key", "text"])
    rows = [r for b in substring_dedup._map(8, False, 64, 1 << 20)(iter([batch])) for r in b.to_pylist()]
    asked = [substring_dedup.unpacked(r["blob"]) for r in rows if r["kind"] == substring_dedup.QUESTION]
    left = [substring_dedup.unpacked(r["blob"]) for r in rows if r["kind"] == substring_dedup.LEFT]
    counts = {}
    for bucket, *_ in asked:
        for x in bucket.tolist():
            counts[x] = counts.get(x, 0) + 1
    assert max(counts.values()) < 64 and sum(len(c[0]) for c in left) > 1000


def test_windows_are_told_apart_by_the_second_identifier():
    """Windows of which the first identifiers are all equal: one bucket, still the right bytes."""
    import numpy as np

    from sparkeval.llm.substring_dedup import second_ids, windows_of

    rng = np.random.default_rng(4)
    docs = [bytes(rng.integers(97, 123, 300, dtype=np.uint8)) for _ in range(4)]
    docs.append(docs[0][100:200] + docs[1][:120])
    asked = [np.stack([[0], [len(d) - 49]]).astype("<i8").tobytes() for d in docs]
    (ids, more, doc, place, _), = windows_of(docs, asked)
    text = [docs[d][p : p + 50] for d, p in zip(doc, place)]
    for own in (ids, more):
        assert len(set(own.tolist())) == len(set(text)) and all(len({text[i] for i in np.flatnonzero(own == x)}) == 1 for x in np.unique(own))
    data = np.frombuffer(docs[0] + bytes(8), np.uint8)
    for at in range(0, 250, 31):  # any byte of a window changes it
        for i in range(50):
            other = data.copy()
            other[at + i] ^= 1
            assert second_ids(data, np.array([at])) != second_ids(other, np.array([at]))
    keys = [np.zeros(len(ids), np.uint64), more]
    order, marks = substring_dedup.sort_entries(keys, doc)
    found = substring_dedup.repeated(marks[-1], doc[order])
    want = [any(docs[e].find(text[i]) >= 0 for e in range(doc[i])) for i in order]
    assert found.tolist() == want and any(want)
