"""Patient-clustered bootstrap: weights per draw and patient (`draws`), not copies of rows.

Rates need counts per patient only: a task takes the counts of a range of patients, makes each weight there once for all keys, and adds up.
Rank metrics and thresholds need rows by score. These are dealt once, as short arrays, over ranges of (key, score), and a range is written as groups of equal
score with their patients' numbers. A task reads some ranges; for each block of draws it makes the weights of all patients once, a byte each, and sums them up score by score in
falling order; what lies above a range, where a key has several, comes in front of it from a first pass. Rows are
shuffled once, not once for each draw, and never carry weights. Beyond `TABLE_PATIENTS` a task makes the weights of some thousand rows' patients at a time instead, slower but as bounded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkeval import staging
from sparkeval.draws import BLOCK_DRAWS, FLAT, MASK, SECOND, STEP, WIDE, draw_keys, mixed_column, weight_table, weights_at
from sparkeval.ranking import macro
from sparkeval.staging import same_keys, small, stage
from sparkeval.subgroups import AXES, REFERENCE, abnormal_studies, by_axis, levels, shared_levels
from sparkeval.thresholds import MIN_SUPPORT, TIE, check_objective, safe_ratio

TASK_ROWS = 100_000  # rows of counts that a task weighs
CHUNK_ROWS = 2_000_000  # rows that a range of scores should have
PART_ROWS = 100_000  # rows that a task sorts at least, if there are so many ranges
HELD_ROWS = 1_000_000  # rows that a task holds before it deals them over ranges
MARKED = 16  # one row in so many is looked at where borders of ranges are chosen
MARKS = 64  # scores that stand for a key's held rows where ranges are chosen
TABLE_PATIENTS = 8_000_000  # of which a task holds a block's weights
PIECE_ROWS = 4096  # of which a block's weights lie in a processor's cache
HELD_SUMS = 4_000_000  # sums that a task holds before it sends them on


def numbered(patients: DataFrame) -> DataFrame:
    """patient_id and slot, from 0 in the order of the id, whatever its type."""
    slots = staging.numbered(patients.select("patient_id").distinct(), (), ["patient_id"], "patients", "slot")
    return staging.stage(slots.select("patient_id", F.col("slot").cast("long").alias("slot")), "patient_slots")


def draw_weights(patients: DataFrame, draws: int, seed: int = 17) -> DataFrame:
    """draw, slot and weight (not 0): how often each patient is in a draw; the weights of a draw add up to the number of patients.

    patients: one row per patient with its number `slot`, from 0.
    """
    n = patients.count()
    if n > FLAT:
        return _weight_rows(patients, n, draws, seed)
    keys = [draw_keys(d, seed) for d in range(draws)]
    first, second = (F.get(F.array(*[F.lit(k[i]).cast("long") for k in keys]), F.col("draw")) for i in (0, 1))
    d = patients.select("slot").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    d = d.select("draw", "slot", (F.col("slot") * F.lit(STEP)).bitwiseAND(MASK).bitwiseXOR(first).alias("h"), second.alias("second"))
    d = d.withColumn("h", mixed_column(F.col("h")))
    d = d.withColumn("h", (F.col("h") + F.col("second") + (F.col("slot") * F.lit(SECOND)).bitwiseAND(MASK)).bitwiseAND(MASK)).withColumn("h", mixed_column(F.col("h")))
    return d.groupBy("draw", F.shiftrightunsigned(F.col("h") * F.lit(n).cast("long"), 32).alias("slot")).agg(F.count("*").alias("weight"))


def _weight_rows(patients: DataFrame, n: int, draws: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column("slot").to_numpy()
            for block in _blocks(draws):
                w = weights_at(slots, n, block, seed)[: draws - block * BLOCK_DRAWS]
                d, at = np.nonzero(w)
                columns = [pa.array((d + block * BLOCK_DRAWS).astype(np.int32)), pa.array(slots[at]), pa.array(w[d, at].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["draw", "slot", "weight"])

    tiles = patients.select("slot").repartitionByRange(n // TASK_ROWS + 1, "slot").sortWithinPartitions("slot")
    return tiles.mapInArrow(run, "draw int, slot long, weight long")


def _blocks(draws: int) -> range:
    return range(-(-draws // BLOCK_DRAWS))


def _types(df: DataFrame, names: Iterable[str]) -> dict[str, str]:
    kinds = dict(df.dtypes)
    return {k: kinds[k] for k in names}


def _schema(types: dict[str, str]) -> str:
    return ", ".join(f"`{k}` {t}" for k, t in types.items())


def _table(types: dict[str, str], rows: list[tuple]) -> pa.RecordBatch:
    """Rows of keys and of arrays of sums."""
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "smallint": pa.int16(), "date": pa.date32(), "boolean": pa.bool_()}
    columns = []
    for i, t in enumerate(types.values()):
        values = [r[i] for r in rows]
        if t.startswith("array<"):
            inner = kinds[t[6:-1]]
            flat = pa.array(np.concatenate(values).astype(inner.to_pandas_dtype()))
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(v) for v in values])), pa.int32()), flat))
        else:
            columns.append(pa.array(values, kinds[t]))
    return pa.RecordBatch.from_arrays(columns, list(types))


def _exploded(arrays: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """draw, keys and the values of each draw, where a row of `arrays` holds those of all draws."""
    each = arrays.select(*keys, F.posexplode(F.arrays_zip(*names)).alias("draw", "v"))
    return each.select("draw", *keys, *[F.col(f"v.{c}").alias(c) for c in names])


def sums_over_draws(per_slot: DataFrame, n: int, draws: int, keys: tuple[str, ...], names: tuple[str, ...], seed: int = 17, scheme: str = "multinomial") -> DataFrame:
    """draw, keys and weighted sums of the columns `names` (the last one counts rows; draws without any are left out).

    per_slot: keys, slot and the columns, counts that are added up per patient. A task has a range of patients and makes their weights once.
    """
    types = _types(per_slot, keys) | {c: "array<bigint>" for c in names}
    width = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            return _table(types, [(*k, *v) for k, v in held.items()])

        for batch in batches:
            if not batch.num_rows:
                continue
            slots, at = np.unique(batch.column("slot").to_numpy(), return_inverse=True)
            counts = np.column_stack([batch.column(c).to_numpy() for c in names])
            found: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(*[batch.column(k).to_pylist() for k in keys], strict=True)):
                found.setdefault(k, []).append(i)
            for block in _blocks(draws):
                w = weights_at(slots, n, block, seed, scheme)[: draws - block * BLOCK_DRAWS].astype(np.float64)
                for k, rows in found.items():
                    # counts of one patient and key, times weights up to 255: exact in floats of 64 bits
                    sums = w[:, at[rows]] @ counts[rows].astype(np.float64)
                    own = held.setdefault(k, np.zeros((width, draws), np.int64))
                    own[:, block * BLOCK_DRAWS : block * BLOCK_DRAWS + len(w)] += np.rint(sums).astype(np.int64).T
            if len(held) * width * draws > HELD_SUMS:
                yield out()
                held.clear()
        if held:
            yield out()

    rows = stage(per_slot.select(*keys, "slot", *names), "draw_counts")
    tasks = rows.count() // TASK_ROWS + 1
    tiles = rows.repartitionByRange(tasks, "slot").sortWithinPartitions("slot")
    found = _exploded(tiles.mapInArrow(run, _schema(types)), keys, names)
    return found.groupBy("draw", *keys).agg(*[F.sum(c).alias(c) for c in names]).where(F.col(names[-1]) > 0)


def _summed(w: np.ndarray, most: int, at: np.ndarray, times: np.ndarray | None, step: np.ndarray, steps: int) -> np.ndarray:
    """A row for each draw with the sum of weights times counts at each step. w: a row of weights for each patient, of at most `most`; at: the rows' patients; times: None if all are 1.

    Eight weights are added up as one number, in groups of rows that keep each of them below 256; sums run along memory.
    """
    out, eight, fit = np.zeros((steps, WIDE), np.int64), w.view(np.uint64), max(255 // max(most, 1), 1)
    some = np.arange(len(at)) if times is None else np.flatnonzero(times)
    for a in range(0, len(some), PIECE_ROWS):
        rows = some[a : a + PIECE_ROWS]
        own = step[rows]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        groups = -(-np.diff(np.append(first, len(rows))) // fit)
        start = np.cumsum(groups) - groups
        begin = np.repeat(first, groups) + (np.arange(groups.sum()) - np.repeat(start, groups)) * fit
        sums = eight.take(at[rows], axis=0)
        if len(begin) < len(rows):
            sums = np.ascontiguousarray(np.add.reduceat(np.ascontiguousarray(sums.T), begin, axis=1).T)
        sums = sums.view(np.uint8)
        if times is None and len(sums) == len(first) == steps and len(some) <= PIECE_ROWS:
            return sums.astype(np.int64).T  # nothing to add up
        out[own[first]] += sums if len(sums) == len(first) else np.add.reduceat(sums.astype(np.int64), start, axis=0)
        many = rows[:0] if times is None else rows[times[rows] > 1]
        if len(many):
            first = np.flatnonzero(np.append(True, step[many][1:] != step[many][:-1]))
            out[step[many][first]] += np.add.reduceat(w.take(at[many], axis=0) * (times[many, None].astype(np.int64) - 1), first, axis=0)
    return out.T


class Rows(NamedTuple):
    """Rows of a key in falling order of the score: groups of equal score and bits with their lengths, and the rows' patients. Bits: the label, then what else is counted."""

    score: np.ndarray
    bits: np.ndarray
    length: np.ndarray
    slot: np.ndarray

    def piece(self, a: int, b: int, ends: np.ndarray) -> Rows:
        """The groups from a to b; ends: the sums of the lengths before each group."""
        return Rows(self.score[a:b], self.bits[a:b], self.length[a:b], self.slot[ends[a] : ends[b]])


class Sweep:
    """One key's counts in one range of scores, in falling order of the score and piece by piece, over a block of draws. Subclasses take the steps, one for each distinct score."""

    fields: dict[str, str] = {}
    positives_only = True  # whether steps without a positive row are left out
    stepwise = True

    def __init__(self, draws: int, names: Sequence[str], head: tuple[np.ndarray, ...] | None):
        none = np.zeros(draws, np.int64)
        self.tp, self.called, self.positives, self.rows = [*head, none, none][:4] if head else [none] * 4
        self.draws, self.sums = draws, {x: none.copy() for x in ("pos", *names, "n")}

    def add(self, piece: Rows, w: np.ndarray, most: int) -> None:
        """Rows of one piece, which has its scores whole. w: a row of weights for each patient, of at most `most`."""
        groups = _summed(w, most, piece.slot, None, np.repeat(np.arange(len(piece.score)), piece.length), len(piece.score))[: self.draws].T
        for i, x in enumerate(self.sums):
            self.sums[x] += groups.sum(axis=0) if x == "n" else groups[piece.bits >> i & 1 > 0].sum(axis=0)
        if not self.stepwise:
            return
        new = np.append(True, piece.score[1:] != piece.score[:-1])
        first, positive = np.flatnonzero(new), piece.bits & 1 > 0
        p, m = np.where(positive[:, None], groups, 0), groups
        if len(first) < len(new):
            p, m = np.add.reduceat(p, first, axis=0), np.add.reduceat(m, first, axis=0)
        tp, called = self.tp + np.cumsum(p, axis=0), self.called + np.cumsum(m, axis=0)
        self.tp, self.called = tp[-1].copy(), called[-1].copy()
        some = np.unique((np.cumsum(new) - 1)[positive]) if self.positives_only else slice(None)
        self.take(slice(None), piece.score[new][some], p[some].T, m[some].T, tp[some].T, called[some].T)

    def close(self) -> tuple[np.ndarray, ...]:
        return (*self.result(), *self.sums.values())

    def take(self, block: slice, score: np.ndarray, p: np.ndarray, m: np.ndarray, tp: np.ndarray, called: np.ndarray) -> None:
        """Steps: their scores, and for each draw their positives and rows, and the positives and rows down to them."""

    def result(self) -> tuple[np.ndarray, ...]:
        return ()


class Sums(Sweep):
    """A range's weighted sums alone."""

    stepwise = False


class Ranks(Sweep):
    """`lost`: twice the pairs of a positive and a negative that stands above it, equal ones half; `ap`: the summed precision at positives."""

    fields = {"lost": "double", "ap": "double"}

    def __init__(self, draws: int, *rest):
        super().__init__(draws, *rest)
        self.lost, self.ap = np.zeros(draws), np.zeros(draws)

    def take(self, block, score, p, m, tp, called):
        p, tp, called = p.astype(np.float64), tp.astype(np.float64), called.astype(np.float64)
        self.lost[block] += np.einsum("ij,ij->i", p, 2 * (called - tp) - (m - p))
        self.ap[block] += np.einsum("ij,ij->i", p, tp / np.maximum(called, 1))

    def result(self):
        return self.lost, self.ap


def candidates(objective: str, beta: float = 2.0, target: float = 0.8) -> type[Sweep]:
    """A range's candidate for the threshold that thresholds.tune picks, with its value; none unless the draw allows one."""
    b = 1.0 if objective == "f1" else beta * beta

    def ratio(a: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.divide(a, c, out=np.zeros(np.broadcast_shapes(a.shape, c.shape)), where=c != 0)

    class Candidates(Sweep):
        fields = {"score": "double", "value": "double"}
        positives_only = False

        def __init__(self, draws: int, *rest):
            super().__init__(draws, *rest)
            self.at, self.value, self.best = np.full(draws, np.nan), np.full(draws, np.nan), np.full(draws, -np.inf)
            self.open = (self.positives >= MIN_SUPPORT) & (self.positives < self.rows)

        def take(self, block, score, p, m, tp, called):
            drawn = (m > 0) & self.open[block, None]
            tp, called = tp.astype(np.float64), called.astype(np.float64)
            positives, rows = self.positives[block, None].astype(np.float64), self.rows[block, None].astype(np.float64)
            precision, recall, specificity = ratio(tp, called), ratio(tp, positives), ratio(rows - positives - called + tp, rows - positives)
            at, value = self.at[block], self.value[block]
            if objective == "sensitivity":
                reached = drawn & (recall >= target)
                new = reached.any(axis=1) & np.isnan(at)
                first, found = reached.argmax(axis=1), specificity
            else:
                found = recall + specificity - 1 if objective == "youden" else ratio((1 + b) * precision * recall, b * precision + recall)
                found = np.where(drawn, found, -np.inf)
                self.best[block] = np.maximum(self.best[block], found.max(axis=1))
                near = drawn & (found >= self.best[block, None] - TIE)
                new = near.any(axis=1)
                first = near.shape[1] - 1 - near[:, ::-1].argmax(axis=1)
            rows_at = np.flatnonzero(new)
            at[rows_at], value[rows_at] = score[first[rows_at]], found[rows_at, first[rows_at]]

        def result(self):
            return self.at, self.value

    return Candidates


def _pieces(score: np.ndarray, length: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Ends of pieces of about PIECE_ROWS rows that have their scores whole; with lengths, scores are those of groups of so many rows."""
    ends = np.append(np.flatnonzero(score[1:] != score[:-1]) + 1, len(score))
    rows = ends if length is None else np.cumsum(length)[ends - 1]
    i = 0
    while i < len(ends):
        before, first = (int(rows[i - 1]), int(ends[i - 1])) if i else (0, 0)
        i = max(int(np.searchsorted(rows, before + PIECE_ROWS, "right")), i + 1)
        yield first, int(ends[i - 1])


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of about HELD_ROWS rows at a time; null keys are -1."""
    held, rows = [], 0

    def out() -> dict[str, np.ndarray]:
        t = pa.Table.from_batches(held)
        return {c: t.column(c).fill_null(-1).to_numpy() for c in t.column_names}

    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= HELD_ROWS:
            yield out()
            held, rows = [], 0
    if rows:
        yield out()


def _by_key(columns: dict[str, np.ndarray], names: Sequence[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """key, its rows in falling order of the score, and their scores."""
    for name in names:
        order = np.argsort(columns[name].astype(np.int16) if columns[name].max(initial=0) < 1 << 15 else columns[name], kind="stable")
        keys = columns[name][order]
        ends = np.flatnonzero(np.append(keys[1:] != keys[:-1], True)) + 1 if len(keys) else []
        for a, b in zip([0, *ends[:-1]], ends):
            if keys[a] >= 0:
                own = order[a:b]
                score = columns["score"][own]
                falling = np.argsort(-score)
                yield int(keys[a]), own[falling], score[falling]


def _marks(names: Sequence[str], of: frozenset[int]):
    """key, score and the rows that it stands for: evenly spaced ones of each key among the rows that a task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _held(batches):
            found = []
            for key, _, score in _by_key(columns, names):
                if key in of:
                    n = min(len(score), MARKS)
                    at = score[((np.arange(n) + 0.5) * len(score) / n).astype(np.int64)]
                    found.append((np.full(n, key, np.int32), at, np.full(n, len(score) / n)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["key", "score", "n"])

    return run


def _dealt(names: Sequence[str], bounds: dict[int, np.ndarray], slot: pa.DataType):
    """key, part and arrays of the rows that a task holds of it, in falling order of the score. bounds: of a key with several parts the least score of each but the last, falling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _held(batches):
            key_of, part_of, sizes, rows = [], [], [], []
            for key, own, score in _by_key(columns, names):
                ends = np.append(np.searchsorted(-score, -bounds[key], "right"), len(own)) if key in bounds else np.array([len(own)])
                size = np.diff(np.append(0, ends))
                some = np.flatnonzero(size)
                key_of.append(np.full(len(some), key, np.int32))
                part_of.append(some.astype(np.int32))
                sizes.append(size[some])
                rows.append(own)
            if rows:
                at, offsets = np.concatenate(rows), pa.array(np.append(0, np.cumsum(np.concatenate(sizes))), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(columns[c][at], t)) for c, t in (("score", pa.float64()), ("bits", pa.int8()), ("slot", slot))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key_of)), pa.array(np.concatenate(part_of)), *lists], ["key", "part", "score", "bits", "slot"])

    return run


def _ranges(slot: pa.DataType):
    """A row for each key and part, whose rows follow each other, with all of its rows as groups of equal score and bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out() -> pa.RecordBatch:
            score, bits, slots = map(np.concatenate, zip(*held))
            order = np.lexsort((bits, -score))
            score, bits, slots = score[order], bits[order], slots[order]
            first = np.flatnonzero(np.append(True, (score[1:] != score[:-1]) | (bits[1:] != bits[:-1])))
            length = np.diff(np.append(first, len(score)))
            columns = [(score[first], pa.float64()), (bits[first], pa.int8()), (length, pa.int32()), (slots, slot)]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, t)) for v, t in columns]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in at] + lists, ["key", "part", *Rows._fields])

        for b in batches:
            for i, own in enumerate(zip(b.column("key").to_pylist(), b.column("part").to_pylist())):
                if held and own != at:
                    yield out()
                    held = []
                at = own
                held.append([b.column(c)[i].values.to_numpy() for c in ("score", "bits", "slot")])
        if held:
            yield out()

    return run


def _streamed(ranges: DataFrame, n: int, draws: int, kind: type[Sweep], seed: int, scheme: str, more: tuple[str, ...]) -> DataFrame:
    """key, part, and arrays over the draws of what `kind` gives for each range, of the range's weighted sums of pos, more and n.

    A task makes a block's weights once for all ranges that it reads.
    """
    types = {"key": "int", "part": "int"} | {k: f"array<{t}>" for k, t in kind.fields.items()} | {f"sum_{x}": "array<bigint>" for x in ("pos", *more, "n")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            for i in range(b.num_rows):
                rows = Rows(*[b.column(c)[i].values.to_numpy() for c in Rows._fields])
                if not kind.stepwise:  # rows that a sum takes in any order are looked up in that of their patients
                    bits = np.repeat(rows.bits, rows.length)
                    order = np.lexsort((rows.slot, bits))
                    found, length = np.unique(bits, return_counts=True)
                    rows = Rows(np.zeros(len(found)), found, length, rows.slot[order])
                head = b.column("head")[i].values if "head" in b.schema.names else None
                head = None if head is None else head.to_numpy().reshape(-1, draws)
                ends = np.append(0, np.cumsum(rows.length))
                held.append(((b.column("key")[i].as_py(), b.column("part")[i].as_py()), rows, ends, list(_pieces(rows.score, rows.length)), head, []))
        for block in _blocks(draws) if held else ():
            own = slice(block * BLOCK_DRAWS, min((block + 1) * BLOCK_DRAWS, draws))
            whole = weight_table(n, block, seed, scheme) if n <= TABLE_PATIENTS else None
            most = 0 if whole is None else int(whole.max(initial=0))
            for _, rows, ends, pieces, head, out in held:
                sweep = kind(own.stop - own.start, more, None if head is None else tuple(head[:, own]))
                for a, b in pieces:
                    piece, w = rows.piece(a, b, ends), whole
                    if w is None:
                        slots, at = np.unique(piece.slot, return_inverse=True)
                        w = np.zeros((len(slots), WIDE), np.uint8)
                        w[:, :BLOCK_DRAWS] = weights_at(slots.astype(np.int64), n, block, seed, scheme).T
                        piece, most = piece._replace(slot=at), int(w.max(initial=0))
                    sweep.add(piece, w, most)
                out.append(sweep.close())
        step = HELD_SUMS // (draws * len(types)) + 1
        for a in range(0, len(held), step):
            yield _table(types, [(*h[0], *map(np.concatenate, zip(*h[-1]))) for h in held[a : a + step]])

    return ranges.mapInArrow(run, _schema(types))


def swept_over_draws(rows: DataFrame, items: DataFrame, n: int, draws: int, names: Sequence[str], kind: type[Sweep], seed: int, scheme: str, *more: str, totals: bool = False) -> DataFrame:
    """draw, the columns of `items` but key and rows, part, the fields that `kind` gives for each range, and the range's sums of pos, more and n in the draw.

    items: what _items gives; rows: score, slot, bits, and in the columns `names` the keys that a row counts for, if any. They are read up to twice, so staged by the caller if they are dear.
    totals: whether `kind` has to know a key's sums beforehand; without, only the ranges of keys that have several are looked at twice.
    """
    rows = rows.select(*names, "score", "slot", "bits")
    slot, kinds = (pa.int32(), "int") if n < 1 << 31 else (pa.int64(), "bigint")
    several = {r.key: r.rows for r in items.where(F.col("rows") > CHUNK_ROWS).collect()}  # a row for each so many rows
    bounds: dict[int, np.ndarray] = {}
    if several:
        some = rows.where(F.pmod(F.xxhash64("slot", "score"), F.lit(MARKED)) == 0)  # borders of ranges need no more; every row is dealt by them
        marks = stage(some.mapInArrow(_marks(names, frozenset(several)), "key int, score double, n double"), "draw_marks")
        falling = Window.partitionBy("key").orderBy(F.desc("score"))
        above = (F.sum("n").over(falling) - F.col("n")) / F.sum("n").over(Window.partitionBy("key"))
        at = F.floor(above * F.ceil(F.col("rows") / CHUNK_ROWS)).alias("part")
        found = marks.join(F.broadcast(items.select("key", "rows")), "key").select("key", "score", at).groupBy("key", "part").agg(F.min("score").alias("least")).orderBy("key", "part").collect()  # a row for each range
        for r, following in zip(found, [*found[1:], None]):
            if following is not None and following.key == r.key:
                bounds[r.key] = np.append(bounds.get(r.key, []), r.least)
    total, ranges = items.agg(F.sum("rows"), F.count("*")).first()
    parts = max(min((total or 0) // PART_ROWS + 1, ranges + sum(map(len, bounds.values()))), 1)
    arrays = f"key int, part int, score array<double>, bits array<tinyint>, slot array<{kinds}>"
    dealt = rows.mapInArrow(_dealt(names, bounds, slot), arrays).repartition(parts, "key", "part").sortWithinPartitions("key", "part")
    c = stage(dealt.mapInArrow(_ranges(slot), arrays.replace("slot", "length array<int>, slot")), "draw_ranges")
    if totals or bounds:
        asked = c if totals else c.where(F.col("key").isin(list(bounds)))
        per = _exploded(_streamed(asked, n, draws, Sums, seed, scheme, ()), ("key", "part"), ("sum_pos", "sum_n"))
        whole = Window.partitionBy("draw", "key")
        before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sums = [F.coalesce(F.sum(x).over(before), F.lit(0)).cast("long") for x in ("sum_pos", "sum_n")]
        sums += [F.sum(x).over(whole).cast("long") for x in ("sum_pos", "sum_n")] if totals else []
        per = per.select("draw", "key", "part", *[x.alias(f"h{i}") for i, x in enumerate(sums)])
        lists = [F.array_sort(F.collect_list(F.struct("draw", f"h{i}"))).getField(f"h{i}") for i in range(len(sums))]
        heads = stage(per.groupBy("key", "part").agg(F.concat(*lists).alias("head")), "draw_heads")  # a row for each range, with a number or two for each draw
        c = c.join(small(heads, heads.count(), 8 * len(sums) * draws), ["key", "part"], "left")
    found = _exploded(_streamed(c, n, draws, kind, seed, scheme, more), ("key", "part"), (*kind.fields, *[f"sum_{x}" for x in ("pos", *more, "n")]))
    return found.join(F.broadcast(items.drop("rows")), "key").drop("key")  # a row for each key


def _items(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, rows and a number `key` from 0 of each row of `counts`, which has a row for each key."""
    return stage(counts.select(*keys, "rows", (F.row_number().over(Window.orderBy(*keys)) - 1).alias("key")), "draw_items")


def _bits(*more: str) -> Column:
    """The label and more columns of 0 and 1 as one number."""
    columns = [F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in ("label", *more)]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(c, i) for i, c in enumerate(columns)]).cast("tinyint").alias("bits")


def _packed(rows: DataFrame, slots: DataFrame | None, keys: tuple[str, ...], *more: str) -> DataFrame:
    """Bits by key, score and slot, a row for each one: a patient seldom has a score twice, so that adding them up would shuffle all for nothing. slots: None if rows have theirs."""
    rows = rows if slots is None else rows.drop("slot").join(slots, "patient_id")
    return rows.select(*keys, F.coalesce(F.col("score").cast("double"), F.lit(float("-inf"))).alias("score"), "slot", _bits(*more))


def _swept_by_keys(pred: DataFrame, keys: tuple[str, ...], slots: DataFrame | None, draws: int, kind: type[Sweep], seed: int, scheme: str, totals: bool = False) -> DataFrame:
    own = numbered(pred) if slots is None else slots
    items = _items(pred.groupBy(*keys).agg(F.count("*").alias("rows")), keys)
    rows = same_keys(_packed(pred, own if slots is None else None, keys), small(items.drop("rows"), items.count()), keys)
    rows = stage(rows.drop(*keys), "draw_rows") if slots is None else rows  # joined once
    return swept_over_draws(rows, items, own.count(), draws, ("key",), kind, seed, scheme, totals=totals)


def bootstrap_rates(fired: DataFrame, draws: int, keys: tuple[str, ...] = ("run_id", "class_idx"), seed: int = 17, scheme: str = "multinomial", slots: DataFrame | None = None) -> DataFrame:
    """precision, recall and f1 of each draw and key; counts are added up per patient before they meet the weights.

    scheme: `multinomial` draws as many patients as there are; `poisson` weighs each patient by itself. slots: as in bootstrap_rank.
    """
    sums = {"tp": F.col("fired") * F.col("label"), "called": F.col("fired"), "true": F.col("label"), "n": F.lit(1)}
    own = numbered(fired) if slots is None else slots
    per = fired.groupBy(*keys, "patient_id" if slots is None else "slot").agg(*[F.sum(v).cast("long").alias(k) for k, v in sums.items()])
    per = per.join(own, "patient_id").drop("patient_id") if slots is None else per
    s = sums_over_draws(per, own.count(), draws, keys, tuple(sums), seed, scheme)
    return s.select("draw", *keys, safe_ratio(F.col("tp"), F.col("called")).alias("precision"), safe_ratio(F.col("tp"), F.col("true")).alias("recall"), safe_ratio(2 * F.col("tp"), F.col("called") + F.col("true")).alias("f1"))


def percentile_interval(draws: DataFrame, value: str, keys: tuple[str, ...], n: int, level: float = 0.95) -> DataFrame:
    """Ends of the percentile interval; null if fewer than half of the n draws, or fewer than two, have a value."""
    a = (1 - level) / 2
    enough = (F.count(value) >= n / 2) & (F.count(value) >= 2)
    return draws.groupBy(*keys).agg(F.when(enough, F.percentile(value, F.lit(a))).alias("ci_low"), F.when(enough, F.percentile(value, F.lit(1 - a))).alias("ci_high"))


def weighted_rows(pred: DataFrame, draws: int, seed: int = 17, patients: DataFrame | None = None) -> DataFrame:
    """The rows of each draw's patients with `draw` and `weight`. Draws are of `patients` where given, so that tables share them."""
    slots = numbered(pred if patients is None else patients)
    return pred.join(slots, "patient_id").join(draw_weights(slots, draws, seed), "slot").drop("slot")


def _areas(swept: DataFrame, keys: tuple[str, ...], *more: str) -> DataFrame:
    g = swept.groupBy("draw", *keys).agg(F.sum("lost").alias("lost"), F.sum("ap").alias("ap"), *[F.sum(f"sum_{x}").alias(x) for x in (*more, "pos", "n")]).where("n > 0")
    p, pairs = F.col("pos").cast("double"), 2 * F.col("pos").cast("double") * (F.col("n") - F.col("pos"))
    return g.select("draw", *keys, F.try_divide(pairs - F.col("lost"), pairs).alias("auroc"), F.try_divide("ap", p).alias("auprc"), "pos", *more)


def bootstrap_rank(pred: DataFrame, draws: int, keys: tuple[str, ...] = ("run_id", "class_idx"), seed: int = 17, scheme: str = "multinomial", slots: DataFrame | None = None) -> DataFrame:
    """AUROC and average precision of each draw and key.

    pred is read several times. slots: `numbered` of its patients, if it has their numbers in a column `slot` already; rows with scores are then never joined or sorted by patient.
    """
    return _areas(_swept_by_keys(pred, keys, slots, draws, Ranks, seed, scheme), keys).drop("pos")


def bootstrap_thresholds(pred: DataFrame, objective: str, draws: int, keys: tuple[str, ...] = ("run_id", "class_idx"), seed: int = 17, scheme: str = "multinomial", slots: DataFrame | None = None) -> DataFrame:
    """The threshold refitted on each draw, and its objective; null where the draw has too few positives or nothing separates.

    Candidates of ranges within 1e-12 of the best one tie, as those inside a range do.
    """
    check_objective(objective)
    s = _swept_by_keys(pred, keys, slots, draws, candidates(objective), seed, scheme, totals=True)
    drawn = F.sum("sum_n").over(Window.partitionBy("draw", *keys))
    s = s.withColumn("drawn", drawn).where("drawn > 0").withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("score", "value")})
    best = F.max("value").over(Window.partitionBy("draw", *keys))
    s = s.withColumn("best", best)
    at = F.struct("score", "value")
    pick = F.max(F.when(F.col("value").isNotNull(), at)) if objective == "sensitivity" else F.min(F.when(F.col("value") >= F.col("best") - TIE, at))
    out = s.groupBy("draw", *keys).agg(pick.alias("at"))
    good = F.col("at.value") > 0
    return out.select("draw", *keys, F.when(good, F.col("at.score")).alias("threshold"), F.when(good, F.col("at.value")).alias("objective"))


def metric_intervals(rank: DataFrame, rates: DataFrame, draws: int, runs: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """runs, class_idx (null: macro), metric and its interval, from the draws of bootstrap_rank and bootstrap_rates.

    Macro AUROC and average precision leave out classes without a value, and draws without any class do not count; the other
    macro metrics average all classes.
    """
    names = ("auroc", "auprc", "precision", "recall", "f1")
    d = rank.join(rates, ["draw", *runs, "class_idx"], "full")
    own = d.unpivot(["draw", *runs, "class_idx"], list(names), "metric", "value")
    means = macro(d, ("draw", *runs), names).withColumnsRenamed({f"macro_{c}": c for c in names})
    over = means.unpivot(["draw", *runs], list(names), "metric", "value").where("value is not null")
    each = percentile_interval(own, "value", (*runs, "class_idx", "metric"), draws)
    return each.unionByName(percentile_interval(over, "value", (*runs, "metric"), 0).withColumn("class_idx", F.lit(None).cast("int")))


def paired_delta(first: DataFrame, second: DataFrame, draws: int, seed: int = 17, slots: DataFrame | None = None) -> DataFrame:
    """Macro AUROC and average precision of `first` minus those of `second` on the same draws: mean, interval, share of draws above 0. slots: as in bootstrap_rank, of both."""
    columns = ("patient_id" if slots is None else "slot", "class_idx", "label", "score")
    both = first.select(*columns, F.lit("first").alias("side")).unionByName(second.select(*columns, F.lit("second").alias("side")))
    m = macro(bootstrap_rank(both, draws, ("side", "class_idx"), seed, slots=slots), ("draw", "side"), ["auroc", "auprc"])
    m = m.unpivot(["draw", "side"], ["macro_auroc", "macro_auprc"], "metric", "value")
    d = m.groupBy("draw", "metric").pivot("side", ["first", "second"]).agg(F.first("value")).withColumn("delta", F.col("first") - F.col("second"))
    share = d.groupBy("metric").agg(F.avg("delta").alias("delta"), F.avg((F.col("delta") > 0).cast("double")).alias("share_above"))
    return share.join(percentile_interval(d, "delta", ("metric",), draws), "metric")


def bootstrap_gaps(fired: DataFrame, draws: int, least: int = 10, seed: int = 17, scheme: str = "multinomial", slots: DataFrame | None = None) -> DataFrame:
    """Gaps of each level to its reference on each draw: AUROC and miss rate over the classes shared on all rows, and underdiagnosis.

    A gap is null where one side is undefined on the draw. slots: as in bootstrap_rank.
    """
    keys = ("run_id", "axis", "level", "class_idx")
    own_slots = numbered(fired) if slots is None else slots
    n = own_slots.count()
    items = _items(shared_levels(fired, least), keys)
    rows = _packed(fired.withColumn("hit", F.col("fired") * F.col("label")).withColumns(levels()), own_slots if slots is None else None, ("run_id", "class_idx", *AXES), "hit")
    n_items = items.count()
    for axis in AXES:  # a row counts for a key on each axis, and is dealt as one
        of = small(items.where(F.col("axis") == axis).select("run_id", "class_idx", F.col("level").alias(axis), F.col("key").alias(f"{axis}_key")), n_items)
        rows = rows.join(of, ["run_id", "class_idx", axis], "left")
    names = [f"{axis}_key" for axis in AXES]
    rows = rows.where(F.coalesce(*names).isNotNull()).select(*names, "score", "slot", "bits")
    rows = stage(rows, "draw_rows") if slots is None else rows  # joined once
    c = _areas(swept_over_draws(rows, items, n, draws, names, Ranks, seed, scheme, "hit"), keys, "hit")
    c = stage(c.withColumn("fnr", 1 - F.try_divide(F.col("hit").cast("double"), "pos")).drop("auprc", "hit", "pos"), "gap_draws")
    reference = F.when(F.col("axis") == "sex", REFERENCE["sex"]).otherwise(REFERENCE["age"])
    ref = c.where(F.col("level") == reference).select("draw", "run_id", "axis", "class_idx", F.col("auroc").alias("ra"), F.col("fnr").alias("rf"))
    own = c.join(ref, ["draw", "run_id", "axis", "class_idx"]).groupBy("draw", "run_id", "axis", "level")
    own = own.agg((F.avg("auroc") - F.avg("ra")).alias("auroc_gap"), (F.avg("fnr") - F.avg("rf")).alias("fnr_gap"))
    # studies with a finding, by level; the reference level's rate stands beside each level's
    per = abnormal_studies(fired).withColumns(levels()).groupBy("run_id", "patient_id", *AXES).agg(F.sum(1 - F.col("fired")).cast("long").alias("missed"), F.count("*").alias("abnormal"))
    per = per.join(own_slots, "patient_id").select("run_id", "slot", "missed", "abnormal", by_axis())
    u = sums_over_draws(per, n, draws, keys[:3], ("missed", "abnormal"), seed, scheme)
    u = stage(u.select("draw", *keys[:3], (F.col("missed") / F.col("abnormal")).alias("u")), "gap_draws")
    at_reference = u.where(F.col("level") == reference).select("draw", "run_id", "axis", F.col("u").alias("ru"))
    u = u.join(at_reference, ["draw", "run_id", "axis"]).withColumn("underdiagnosis_gap", F.col("u") - F.col("ru")).drop("u", "ru")
    return own.join(u, ["draw", "run_id", "axis", "level"], "full")


def gap_intervals(gaps: DataFrame, draws: int) -> DataFrame:
    """Interval of each gap over its draws, and whether it leaves out 0."""
    g = gaps.unpivot(["draw", "run_id", "axis", "level"], ["auroc_gap", "fnr_gap", "underdiagnosis_gap"], "metric", "value")
    ci = percentile_interval(g, "value", ("run_id", "axis", "level", "metric"), draws)
    return ci.withColumn("resolved", F.coalesce((F.col("ci_low") > 0) | (F.col("ci_high") < 0), F.lit(False)))
