"""How often each patient is in each bootstrap draw: whole patients with replacement, as many as there are.

Up to FLAT patients a draw hashes its n slots onto them, in a form that SQL can repeat. Beyond, the n slots are first split over ranges of patients: down a tree
of halves a binomial draw, seeded by the node, says how many fall to the left, and a leaf of LEAF patients deals out its own by random bytes. A range's
weights so need the nodes above it and no other range, and they equal that range's slice of the whole draw. Binomials are drawn for a block of draws at once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = (1 << 32) - 1
ROUNDS = ((16, 0x7FEB352D), (15, 0x2C1B3C6D), (16, None))  # a shift and a factor under 2^31, so that products fit a long
STEP, SECOND = 0x9E3779B1, 0x45D9F3B5
BLOCK_DRAWS = 125
WIDE = 128  # bytes of a patient's weights in a table of a block, so that eight are added up as one number
FLAT, LEAF = 1 << 16, 1024
# of a Poisson variable of mean 1: the shares of 0, of at most 1, and so on
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 14)]))


def mixed(x):
    """Spreads 32 bits; x is an integer or an array of uint32."""
    for shift, factor in ROUNDS:
        x = x ^ (x >> shift)
        if factor:
            x = x * factor if isinstance(x, np.ndarray) else x * factor & MASK
    return x


def mixed_column(x: Column) -> Column:
    for shift, factor in ROUNDS:
        x = x.bitwiseXOR(F.shiftrightunsigned(x, shift))
        x = (x * factor).bitwiseAND(MASK) if factor else x
    return x


def draw_keys(draw: int, seed: int) -> tuple[int, int]:
    first = mixed(mixed(seed & MASK) ^ (draw & MASK))
    return first, mixed((first + SECOND) & MASK)


def _hashes(slots: np.ndarray, first: np.ndarray | np.uint32, second: np.ndarray | np.uint32) -> np.ndarray:
    """32 random bits for each slot of a draw with these keys."""
    i = slots.astype(np.uint32)
    return mixed(mixed(i * np.uint32(STEP) ^ first) + second + i * np.uint32(SECOND))


def _keys(draws: range, seed: int) -> tuple[np.ndarray, np.ndarray]:
    k = np.array([draw_keys(d, seed) for d in draws], np.uint32).reshape(-1, 2)
    return k[:, 0], k[:, 1]


def block_of(block: int) -> range:
    return range(block * BLOCK_DRAWS, (block + 1) * BLOCK_DRAWS)


def _small(weights: np.ndarray) -> np.ndarray:
    """Weights as bytes; one above 255 is less likely than 1 in 10^500."""
    if weights.max(initial=0) > 255:
        raise OverflowError("a patient is drawn more than 255 times")
    return weights.astype(np.uint8)


def _hashed(drawn: np.ndarray, size: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A row of weights of `size` patients for each draw, of which drawn[d] slots are hashed onto them."""
    start = np.cumsum(drawn) - drawn
    slots = np.arange(drawn.sum()) - np.repeat(start, drawn)
    h = _hashes(slots, np.repeat(first, drawn), np.repeat(second, drawn))
    at = (h.astype(np.uint64) * np.uint64(size) >> np.uint64(32)).astype(np.int64) + np.repeat(np.arange(len(drawn)) * size, drawn)
    return np.bincount(at, minlength=len(drawn) * size).reshape(len(drawn), size)


@lru_cache(maxsize=4096)
def _drawn(n: int, low: int, high: int, block: int, seed: int) -> np.ndarray:
    """How many slots of each draw of a block fall onto the leaves from low to high."""
    leaves = -(-n // LEAF)
    if (low, high) == (0, leaves):
        return np.full(BLOCK_DRAWS, n, np.int64)
    # the node above: the one whose middle is an end of this one
    a, b = 0, leaves
    while True:
        middle = (a + b) // 2
        if (low, high) in ((a, middle), (middle, b)):
            break
        a, b = (a, middle) if high <= middle else (middle, b)
    above = _drawn(n, a, b, block, seed)
    left, whole = (middle - a) * LEAF, min(n, b * LEAF) - a * LEAF
    node = np.random.Generator(np.random.Philox(np.random.SeedSequence((seed & MASK, block, a, b))))
    to_left = node.binomial(above, left / whole)
    return to_left if low == a else above - to_left


def _leaf_count(n: int, leaf: int, block: int, seed: int) -> np.ndarray:
    low, high = 0, -(-n // LEAF)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if leaf < middle else (middle, high)
        count = _drawn(n, low, high, block, seed)
    return count if n > LEAF else _drawn(n, low, high, block, seed)


def leaf_table(n: int, leaf: int, block: int, seed: int) -> np.ndarray:
    """A row for each patient of a leaf with its weights in the draws of a block, and zeros up to WIDE."""
    size = min(n, (leaf + 1) * LEAF) - leaf * LEAF
    drawn = _leaf_count(n, leaf, block, seed)
    bits = np.random.SFC64(np.random.SeedSequence((seed & MASK, block, leaf, 0, 1)))
    slots = int(drawn.sum())
    if size == LEAF:
        patient = bits.random_raw(-(-slots // 4)).view(np.uint16)[:slots] & np.uint16(LEAF - 1)
    else:
        patient = np.random.Generator(bits).integers(0, size, slots)
    at = np.repeat(np.arange(BLOCK_DRAWS) * size, drawn)
    at += patient
    out = np.zeros((size, WIDE), np.uint8)  # counted draw by draw, as one draw's counts stay in the cache
    out[:, :BLOCK_DRAWS] = _small(np.bincount(at, minlength=BLOCK_DRAWS * size)).reshape(BLOCK_DRAWS, size).T
    return out


@lru_cache(maxsize=64)
def leaf_weights(n: int, leaf: int, block: int, seed: int) -> np.ndarray:
    """A row for each draw of a block with the weights of a leaf's patients."""
    return leaf_table(n, leaf, block, seed)[:, :BLOCK_DRAWS].T


@lru_cache(maxsize=16)
def flat_table(n: int, block: int, seed: int) -> np.ndarray:
    """A row for each of n patients, up to FLAT of them, with its weights in the draws of a block, and zeros up to WIDE."""
    out, taken = np.zeros((n, WIDE), np.uint8), np.full(1, n)
    for i, d in enumerate(block_of(block)):
        out[:, i] = _small(_hashed(taken, n, *_keys(range(d, d + 1), seed)))[0]
    return out


def poisson_weights(slots: np.ndarray, draw: int, seed: int) -> np.ndarray:
    """Poisson weights of mean 1 of the given patients, each by itself."""
    first, second = draw_keys(draw, seed)
    high = mixed((slots.astype(np.uint64) >> np.uint64(32)).astype(np.uint32))
    return np.searchsorted(POISSON, _hashes(slots, np.uint32(first) ^ high, np.uint32(second)) / float(1 << 32), "right").astype(np.uint8)


def weights_at(slots: np.ndarray, n: int, block: int, seed: int, scheme: str = "multinomial") -> np.ndarray:
    """A row for each draw of a block with the weights of the given patients."""
    if scheme == "poisson":
        return np.stack([poisson_weights(slots, d, seed) for d in block_of(block)])
    if n <= FLAT:
        return np.ascontiguousarray(flat_table(n, block, seed).take(slots, axis=0)[:, :BLOCK_DRAWS].T)
    out = np.empty((BLOCK_DRAWS, len(slots)), np.uint8)
    leaf = slots // LEAF
    for k in np.unique(leaf):
        own = leaf == k
        out[:, own] = leaf_weights(n, int(k), block, seed)[:, slots[own] - k * LEAF]
    return out


def weight_table(n: int, block: int, seed: int, scheme: str = "multinomial") -> np.ndarray:
    """A row for each of n patients with its weights in the draws of a block, and zeros up to WIDE."""
    if scheme == "multinomial" and n <= FLAT:
        return flat_table(n, block, seed)
    out = np.zeros((n, WIDE), np.uint8)
    if scheme == "multinomial":
        for leaf in range(-(-n // LEAF)):
            out[leaf * LEAF : (leaf + 1) * LEAF] = leaf_table(n, leaf, block, seed)
    else:
        for a in range(0, n, FLAT):
            own = np.arange(a, min(a + FLAT, n))
            out[own, :BLOCK_DRAWS] = weights_at(own, n, block, seed, scheme).T
    return out


def slot_weights(n: int, draw: int, seed: int) -> np.ndarray:
    """How often each of n patients is in a draw."""
    return weights_at(np.arange(n), n, draw // BLOCK_DRAWS, seed)[draw % BLOCK_DRAWS].astype(np.float64)
