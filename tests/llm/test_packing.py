"""Packing: ids against the tokenizers library on fuzzed strings, and laws of the sequences against a plain check."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sparkeval.llm import packing

ALPHABET = "abcABC 019.,'\n\t\r éßñÍ漢字🙂👩‍👩‍👧<|endoftext|>​﻿_-"


def test_ids_equal_on_fuzzed_strings():
    from tokenizers import Tokenizer

    import public_tokenizers

    whole, ours, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.tokenizer(packing.vocabulary()), random.Random(6)
    pieces = [*ALPHABET, "<|endoftext|>", "the ", " was", "ing", "'ll", "'s", "   ", "\n\n", "0123", "token = "]
    for _ in range(5000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))
        assert list(ours(text)) == whole.encode(text, add_special_tokens=False).ids, text


def test_costs_are_balanced():
    """Each piece goes, longest first, to the sequence of least cost that has room; sequences are full, the last ones powers of two."""
    rng = random.Random(2)
    pieces = [(d, 0, rng.randint(1, 1023)) for d in range(300)]
    total = sum(n for *_, n in pieces)
    size = packing.capacities(total, 1024)
    assert sum(size) == total and size[: total // 1024] == [1024] * (total // 1024) and all(x & (x - 1) == 0 for x in size)
    room, cost, want = list(size), [0.0] * len(size), []
    for d, start, n in sorted(pieces, key=lambda p: (-p[2], p[0])):
        while n:
            fits = [s for s in range(len(size)) if room[s] >= n]
            s = min(fits, key=lambda s: (cost[s], s)) if fits else max(range(len(size)), key=lambda s: (room[s], -s))
            take = min(n, room[s])
            want.append((d, start, take, s, size[s] - room[s]))
            room[s] -= take
            cost[s] += packing.LINEAR * take + packing.QUADRATIC * take * take
            start, n = start + take, n - take
    assert packing.assign(pieces, 1024) == want and set(room) == {0}
    loads = defaultdict(float)
    for _, _, n, s, _ in want:
        loads[s] += n + n * n / 2048
    whole = [loads[s] for s in range(total // 1024)]
    first_fit, held = [], []
    for _, _, n in pieces:  # against sequences filled one after the other
        held.append(n)
        if sum(held) >= 1024:
            first_fit.append(sum(n + n * n / 2048 for n in held))
            held = []
    assert np.std(whole) < np.std(first_fit)


@pytest.mark.parametrize("length", [1024, 16])
def test_laws_on_the_documents(spark, length):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in d.collect()}
    ours = packing.tokenizer(packing.vocabulary())
    ids = {i: np.append(ours(t or ""), packing.END).astype("<u4") for i, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(d, length).collect():
        assert r.doc_tokens == len(ids[r.id]) and r.ids_crc32 == zlib.crc32(ids[r.id][r.start : r.start + r.length].tobytes())
        pieces[r.id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for groups, ends in ((pieces, {i: len(x) for i, x in ids.items()}), (sequences, {})):
        for key, found in groups.items():
            at = 0
            for start, n in sorted(found):
                assert start == at
                at += n
            assert at == ends.get(key, at) and (ends or at == length or at & (at - 1) == 0 and at < length)
    assert pieces.keys() == texts.keys()
