"""Weights are made where rows are weighed: no table carries them, and sums of bytes do not run over."""

import numpy as np
import pytest

from sparkeval import bootstrap, draws
from sparkeval.bridge import predictions


def test_no_table_carries_weights(spark, monkeypatch):
    """Tables that are written for many patients hold rows of numbers, however many draws there are."""
    seen, write = [], bootstrap.stage
    monkeypatch.setattr(bootstrap, "FLAT", 10)
    monkeypatch.setattr(bootstrap, "stage", lambda df, name: seen.append(df.dtypes) or write(df, name))
    pred = predictions(spark, "/root/testdata/sf0.001").where("split = 'test' and run_id = 0 and class_idx = 1")
    assert bootstrap.bootstrap_rank(pred, 3).count() == 3
    assert seen and not [t for types in seen for t in types if t[1] == "binary"]


def test_table_equals_weights():
    for n, scheme in ((3000, "multinomial"), (3000, "poisson"), (draws.FLAT + 1500, "multinomial")):
        t = draws.weight_table(n, 1, 17, scheme)
        assert t.shape == (n, draws.WIDE) and (t[:, draws.BLOCK_DRAWS :] == 0).all()
        assert (t[:, : draws.BLOCK_DRAWS].T == draws.weights_at(np.arange(n), n, 1, 17, scheme)).all()


@pytest.mark.parametrize("most", [1, 9, 200])
def test_sums_of_bytes(most):
    """Long and short steps, rows that count 0, 1 or many times, over several pieces."""
    rng = np.random.default_rng(most)
    w = rng.integers(0, most + 1, (500, draws.WIDE)).astype(np.uint8)
    step = np.sort(np.append(np.repeat(3, 2 * bootstrap.PIECE_ROWS), rng.integers(0, 400, 9000)))
    at = rng.integers(0, 500, len(step)).astype(np.int32)
    times = rng.choice([0, 1, 1, 1, 7, 100_000_000], len(step)).astype(np.int32)
    want = np.zeros((400, draws.WIDE), np.int64)
    np.add.at(want, step, w[at].astype(np.int64) * times[:, None])
    assert (bootstrap._summed(w, most, at, times, step, 400) == want.T).all()


def test_pieces_have_scores_whole():
    score = -np.sort(np.random.default_rng(4).integers(0, 50, 100_000)).astype(float)
    score[20_000:60_000] = score[20_000]
    score = np.sort(score)[::-1]
    ends = list(bootstrap._pieces(score))
    assert ends[0][0] == 0 and ends[-1][1] == len(score) and all(a[1] == b[0] and score[b[0]] != score[b[0] - 1] for a, b in zip(ends, ends[1:]))
