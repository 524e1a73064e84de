"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkeval.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, root string, shape binary, code long, near string, form string"


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "w", 1, "r", b"s", 2, "n", "f") for i, t in texts], SCHEMA)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1  # noqa: B905
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(texts):
    counts = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in form.items() if words[v] >= 2 * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=str)


@pytest.mark.parametrize("symbols", [1, 2, spelling.SYMBOLS])
def test_against_all_pairs(spark, symbols):
    """Words over few letters, so that most have many near ones, chains of forms and ties; runs that the hash damages."""
    rng = random.Random(4)
    bases = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 8))) for _ in range(60)]
    texts = []
    for i in range(300):
        words = [rng.choice(bases[: rng.randint(1, 60)]) for _ in range(12)]
        words += [w[:2] + rng.choice("abÿ") + w[2 + rng.randint(0, 1) :] for w in rng.sample(words, 3)]
        texts.append((i, rng.choice([" ", "-", "1"]).join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in words)))
    want = brute(texts)
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] != r[1] for r in want if r[1])
    assert got(spelling.spelling_variants(rows_of(spark, texts), symbols=symbols)) == want


def test_nulls_long_words_and_repeated_rows(spark):
    long = "ab" * 20_000 + "é"
    texts = [(None, None), (None, "alpha Alpha ALPHA alphÄ"), (1, ""), (2, "alpha beta1234 × ÷"), (2, "alpha beta1234 × ÷"), (3, "alphas alphas alphas ÀÉÎÕÜ àéîõü ÀÉÎÕÜ ÀÉÎÕÜ")]
    texts += [(10 + i, long) for i in range(8)] + [(20 + i, long[:9_000] + "x" + long[9_000:]) for i in range(3)] + [(30 + i, long[:77] + "x" + long[78:]) for i in range(3)]
    want = brute([(i, t) for i, t in texts if not (t and len(t) > 1000)])
    rest = brute([(i, t) for i, t in texts if t and len(t) > 1000])
    assert len(rest) == 3 and [r[4] for r in rest].count(2) == 1
    assert got(spelling.spelling_variants(rows_of(spark, texts))) == sorted(want + rest, key=str)
    assert spelling.spelling_variants(rows_of(spark, [])).count() == 0
    assert spelling.spelling_variants(rows_of(spark, [(1, None), (2, "short few")])).count() == 0


def test_neighbourhood_is_full():
    """Hashes of the neighbourhood are those of all sequences one edit away, and of the sequence itself."""
    rng = np.random.default_rng(3)
    for length in (1, 2, 5, 7):
        same = rng.integers(0, 3, (4, length)).astype(np.uint8)
        for row, near in zip(same, spelling.neighbourhood(same, 3), strict=True):
            around = {tuple(row)} | {(*row[:i], *row[i + 1 :]) for i in range(length)}
            around |= {(*row[:i], c, *row[i + 1 :]) for i in range(length) for c in range(3)} | {(*row[:i], c, *row[i:]) for i in range(length + 1) for c in range(3)}
            want = {int(spelling.codes(np.array([x], np.uint8).reshape(1, -1), 3)[0]) for x in around}
            assert set(map(int, near)) == want and len(want) == len(around)


def test_times():
    with pytest.raises(ValueError, match="times"):
        spelling.spelling_variants(None, times=1)
