"""Removal of repeated byte strings by bucket-pointer refinement.

A byte string's bucket identifier is made from those of its parts: pairs of identifiers at later offsets give the identifiers of
twice the length, again and again, up to 20 bytes; those at offsets 0, 20 and 30 give a 50-byte window's. Identifiers are 64-bit
fingerprints, so tasks agree on them without exchanging ranks. Instead of every suffix, only the least 20-byte string
of each window (its anchor, which equal windows share) is sorted. Three refinements settle all windows:

1. anchors are sorted into buckets by their identifier, and each bucket by the identifiers of the first and last window of the anchor;
   windows of an entry with an equal one in a smaller document are repeated, those of a bucket with one entry are not;
2. what is left of buckets with different entries is sorted by window identifier, and by a second one of 64 bits from the window's bytes;
3. per document, the repeated windows' bytes are cut out.

Tasks combine their own entries before the shuffles, which carry columns packed into blobs, not rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeval.llm.common import read, release, runs_of, stage
from sparkeval.llm.near_dedup import BYTES, PLACES, mix

WINDOW, GRAM = 50, 20
TAIL = WINDOW - GRAM
CHUNK = 1 << 20  # bytes whose identifiers are held at a time; longer documents are cut into pieces that share WINDOW - 1 bytes
BLOCK = 1 << 24  # bytes whose entries are combined before they are sent
HELD = 1 << 19  # entries or windows that are sorted at a time before they are sent
PART = 1 << 23  # text bytes a part, which is a task's, at every size of the text
COMMON = 64  # entries of one anchor in a block from which on they are compared window by window, which spreads them over the parts
PLACE_BITS = np.uint64((1 << 21) - 1)  # a place in a chunk
A, B, C, D = (np.uint64(int(x)) for x in PLACES[:4])


def gram_ids(data: np.ndarray) -> np.ndarray:
    """Identifiers of the GRAM-byte strings at every place: each step pairs identifiers with those at a later offset."""
    ids, length = BYTES[data], 1
    while length < GRAM:
        step = min(length, GRAM - length)
        ids = ids[: len(ids) - step] * A + (ids[step:] ^ (ids[step:] >> np.uint64(29))) * B
        length += step
    return mix(ids)


def window_ids(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(mix(grams[at] * C + grams[at + GRAM] * B) * C + grams[at + TAIL] * D)


def second_ids(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A second identifier of windows, from their bytes as seven words of 8 bytes (the last two share some) and not from their grams' identifiers."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # at every byte
    out = np.zeros(len(at), np.uint64)
    for k, offset in enumerate((0, 8, 16, 24, 32, 40, WINDOW - 8)):
        out = mix(out * B + words[at + offset] * PLACES[k % len(PLACES)] + np.uint64(k))
    return out


def least_grams(grams: np.ndarray) -> np.ndarray:
    """Place of the least gram in each window, the leftmost of equal ones."""
    least, length = (grams & ~PLACE_BITS) | np.arange(len(grams), dtype=np.uint64), 1
    while length < TAIL + 1:
        step = min(length, TAIL + 1 - length)
        least = np.minimum(least[: len(least) - step], least[step:])
        length += step
    return (least & PLACE_BITS).astype(np.int64)


def in_chunks(docs: list[bytes], chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents (their places in docs) and the offsets of their pieces in them, bytes (padded) and ends of pieces, chunk by chunk."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        doc, base, pieces = zip(*held, strict=True)
        return np.array(doc), np.array(base), np.frombuffer(b"".join(pieces) + bytes(WINDOW + 1), np.uint8), np.cumsum([len(p) for p in pieces])

    for i, d in enumerate(docs):
        for base in range(0, max(len(d) - WINDOW + 1, 1), chunk - WINDOW + 1):
            piece = d[base : base + chunk]
            if held and size + len(piece) > chunk:
                yield out()
                held, size = [], 0
            held.append((i, base, piece))
            size += len(piece)
    if held:
        yield out()


def gathered(pieces: Iterator[list[np.ndarray]], n_keys: int) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """Identifiers and columns of about HELD rows at a time."""
    held: list[list[np.ndarray]] = []
    size = 0
    for columns in pieces:
        held.append(columns)
        size += len(columns[0])
        if size >= HELD:
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            yield whole[:n_keys], whole[n_keys:]
            held, size = [], 0
    if size:
        whole = [np.concatenate(c) for c in zip(*held, strict=True)]
        yield whole[:n_keys], whole[n_keys:]


def entries(docs: list[bytes], chunk: int = CHUNK) -> Iterator[list[np.ndarray]]:
    """Of the anchors, chunk by chunk: bucket, refined identifier, document (its place in docs), first window, number of windows."""
    for docs_at, base, data, ends in in_chunks(docs, chunk):
        starts = np.append(0, ends[:-1])
        n = np.maximum(ends - starts - WINDOW + 1, 0)
        if not n.any():
            continue
        windows = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
        piece = np.repeat(np.arange(len(ends)), n)
        grams = gram_ids(data)
        anchor = least_grams(grams)[windows]
        at = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])))
        to = np.append(at[1:], len(windows)) - 1
        length = (to - at + 1).astype(np.uint64)
        refined = mix(window_ids(grams, windows[at]) * A + window_ids(grams, windows[to]) + length)
        of = piece[at]
        yield [grams[anchor[at]], refined, docs_at[of], windows[at] - starts[of] + base[of], to - at + 1]


def packed(columns: list[np.ndarray]) -> bytes:
    """Identifiers as they are, then (document, place) in order as differences, then lengths."""
    *ids, doc, place, length = columns
    steps = [np.diff(doc, prepend=0).astype("<i8"), np.diff(place, prepend=0).astype("<i8"), length.astype("u1")]
    head = np.array([len(doc), len(ids)], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(x.tobytes() for x in [*ids, *steps]))


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, k = (int(x) for x in np.frombuffer(raw, "<u4", 2))
    at, out = 8, []
    for kind in ["<u8"] * k + ["<i8", "<i8", "u1"]:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return [*out[:k], np.cumsum(out[k]), np.cumsum(out[k + 1].astype(np.int64)), out[k + 2].astype(np.int64)]


def joined(blobs: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*map(unpacked, blobs), strict=True)]


def dealt(columns: list[np.ndarray], part: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """Columns as one blob for each part."""
    if not len(part):
        return
    order = np.lexsort((columns[-2], columns[-3], part))
    part, columns = part[order], [c[order] for c in columns]
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for a, b in zip(at, [*at[1:], len(part)], strict=True):
        yield int(part[a]), kind, packed([c[a:b] for c in columns])


def part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def sort_entries(keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys, then document; where a new bucket (first key) and a new entry (all keys) begin."""
    order = np.lexsort((doc, *keys[::-1]))
    new = np.zeros(len(order), bool)
    marks = []
    for k in keys:
        k = k[order]
        new = new | np.append(True, k[1:] != k[:-1])[: len(order)]
        marks.append(new.copy())
    return order, np.stack(marks) if len(order) else np.zeros((len(keys), 0), bool)


def repeated(marks: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a sorted entry has an equal one in a smaller document."""
    at = np.flatnonzero(marks)
    return doc > np.repeat(doc[at], np.diff(np.append(at, len(doc))))


QUESTION, ANSWER, LEFT = 0, 1, 2  # for the bucket's task; settled; for the next refinement
_OUT = ["part", "kind", "blob"]


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, blob = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], _OUT)


def _map(parts: int, of_windows: bool, common: int, chunk: int):
    """Entries of a task's documents: those repeated within a block are answers, the others questions for the bucket's task.

    Of an anchor with `common` entries or more in the block, windows are what the next refinement asks for, and one entry that equals none
    other tells the bucket's task that the bucket is mixed.
    """

    def block(ids: np.ndarray, docs: list[bytes], asked: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        found = gathered(windows_of(docs, asked, chunk), 2) if of_windows else gathered(entries(docs, chunk), 2)
        for keys, columns in found:
            yield from sent(keys, [ids[columns[0]], *columns[1:]])

    def sent(keys: list[np.ndarray], columns: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
        order, marks = sort_entries(keys, columns[0])
        keys, columns = [k[order] for k in keys], [c[order] for c in columns]
        known = repeated(marks[-1], columns[0])
        yield from dealt([c[known] for c in columns], part_of(columns[0][known], parts), ANSWER)
        ask = ~known
        if not of_windows:
            at = np.flatnonzero(marks[0])
            often = np.repeat(np.add.reduceat(ask.astype(np.int64), at) >= common, np.diff(np.append(at, len(ask))))
            mixed, first = ask & often, often & marks[0]
            yield from dealt([c[mixed] for c in columns], part_of(columns[0][mixed], parts), LEFT)
            # no document is smaller than the sign's, so that it answers nothing and nobody answers it
            signs = [keys[0][first], mix(keys[0][first] ^ keys[1][first] ^ columns[0][first].astype(np.uint64)), np.full(first.sum(), -1 << 62), np.zeros(first.sum(), np.int64), np.zeros(first.sum(), np.int64)]
            yield from dealt(signs, part_of(signs[0], parts), QUESTION)
            ask &= ~often
        yield from dealt([c[ask] for c in keys + columns], part_of(keys[0][ask], parts), QUESTION)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        docs: list[bytes] = []
        asked: list[bytes] = []
        size = 0
        for batch in batches:
            keys, texts = batch.column("key").to_pylist(), batch.column("text").cast(pa.large_binary())
            places = batch.column("asked").to_pylist() if of_windows else None
            for i, t in enumerate(texts):
                ids.append(keys[i])
                docs.append(t.as_py() or b"")
                if of_windows:
                    asked.append(places[i])
                size += len(docs[-1]) + 64
                if size >= BLOCK:
                    rows = list(block(np.array(ids, np.int64), docs, asked))
                    if rows:
                        yield _batch(rows)
                    ids, docs, asked, size = [], [], [], 0
        rows = list(block(np.array(ids, np.int64), docs, asked)) if ids else []
        if rows:
            yield _batch(rows)

    return run


def windows_of(docs: list[bytes], asked: list[bytes], chunk: int = CHUNK) -> Iterator[list[np.ndarray]]:
    """The windows asked for, chunk by chunk: both identifiers; document, place and length 1."""
    last, wanted = -1, np.empty(0, np.int64)
    for docs_at, base, data, ends in in_chunks(docs, chunk):
        grams = gram_ids(data)
        ids, more, doc, place = [], [], [], []
        for d, first, start, end in zip(docs_at, base, np.append(0, ends[:-1]), ends, strict=True):
            if d != last:
                last, spans = d, np.frombuffer(asked[d], "<i8").reshape(2, -1)
            # windows of a span that start in this piece
            to = first + max(end - start - WINDOW + 1, 0)
            low, high = np.maximum(spans[0], first), np.minimum(spans[0] + spans[1], to)
            n = np.maximum(high - low, 0)
            wanted = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            ids.append(window_ids(grams, wanted - first + start))
            more.append(second_ids(data, wanted - first + start))
            doc.append(np.full(len(wanted), d))
            place.append(wanted)
        doc = np.concatenate(doc)
        yield [np.concatenate(ids), np.concatenate(more), doc, np.concatenate(place), np.ones(len(doc), np.int64)]


def _refine(parts: int, of_windows: bool):
    """Over a part's questions from all tasks: answers, and what the next refinement has to settle, dealt by document."""

    def settle(blobs: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        *keys, doc, place, length = joined(blobs)
        order, marks = sort_entries(keys, doc)
        columns = [c[order] for c in (doc, place, length)]
        known = repeated(marks[-1], columns[0]) & (columns[2] > 0)
        yield from dealt([c[known] for c in columns], part_of(columns[0][known], parts), ANSWER)
        if not of_windows:
            at = np.flatnonzero(marks[0])
            sizes = np.diff(np.append(at, len(known)))
            mixed = np.add.reduceat(marks[1].astype(np.int64), at) > 1
            mixed &= np.maximum.reduceat(columns[0], at) > np.minimum.reduceat(columns[0], at)
            left = np.repeat(mixed, sizes) & ~known
            left &= columns[2] > 0
            yield from dealt([c[left] for c in columns], part_of(columns[0][left], parts), LEFT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches, ["part", "kind"]):
            blobs = table["blob"].to_pylist()
            if table["kind"][0].as_py() == QUESTION:
                rows = list(settle(blobs))
            else:
                columns = joined(blobs)
                rows = list(dealt(columns, part_of(columns[0], parts), table["kind"][0].as_py()))
            if rows:
                yield _batch(rows)

    return run


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document and kind: first windows and numbers of windows, as two rows of integers."""
    for table in runs_of(batches, ["part", "kind"]):
        doc, place, length = joined(table["blob"].to_pylist())
        order = np.lexsort((place, doc))
        doc, place, length = doc[order], place[order], length[order]
        at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        ends = [*at[1:], len(doc)]
        rows = [np.stack([place[a:b], length[a:b]]).astype("<i8").tobytes() for a, b in zip(at, ends, strict=True)]
        kind = pa.array([table["kind"][0].as_py()] * len(at), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(doc[at]), kind, pa.array(rows, pa.binary())], ["key", "kind", "places"])


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, text, found in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("places").to_pylist(), strict=True):
                data = np.frombuffer(text.as_py() or b"", np.uint8)
                edge = np.zeros(len(data) + 1, np.int64)
                for blob in found or ():
                    at, n = np.frombuffer(blob, "<i8").reshape(2, -1)
                    np.add.at(edge, np.minimum(at, len(data)), 1)
                    np.add.at(edge, np.minimum(at + n - 1 + WINDOW, len(data)), -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept = data[~gone].tobytes()
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((key, len(data), int(gone.sum()), spans, kept if with_text else hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 4 + [pa.binary() if with_text else pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _settled(docs: DataFrame, parts: int, of_windows: bool, common: int, chunk: int) -> DataFrame:
    schema = "part long, kind int, blob binary"
    dealt_out = docs.mapInArrow(_map(parts, of_windows, common, chunk), schema).repartition(parts, "part", "kind").sortWithinPartitions("part", "kind")
    answers = dealt_out.mapInArrow(_refine(parts, of_windows), schema).repartition(parts, "part", "kind").sortWithinPartitions("part", "kind")
    out = stage(answers.mapInArrow(_by_document, "key long, kind int, places binary"), "repeated_windows")
    del dealt_out, answers
    release(docs.sparkSession)  # the entries take about as much room as the text
    return out


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, part: int = PART, common: int = COMMON, chunk: int = CHUNK
) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept of every row: without the bytes of 50-byte strings that a smaller document has too.

    `kept` is the SHA-256 of the bytes that stay, or with `with_text` the bytes. A null or empty text has none. Ids identify
    documents: repeated rows of one document don't count as smaller than each other. Null ids come after all others, in the order of a
    hash of their text. No bucket is capped: parts follow the size of the text, so that a task holds the entries of so many bytes at every
    size, and an anchor that stands everywhere is refined window by window at once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    beyond = F.lit(1 << 62) + F.pmod(F.xxhash64(text), F.lit(1 << 62))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), beyond).alias("key"), text.alias("text"))
    parts = max(16, -(-source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // part))
    first = _settled(source.select("key", "text"), parts, False, common, chunk)
    left = first.where(F.col("kind") == LEFT).select("key", F.col("places").alias("asked"))
    near = source.select("key", "text").repartition(parts, "key").join(left.repartition(parts, "key"), "key")  # so many bytes of text a task, as everywhere
    second = _settled(near, parts, True, common, chunk)
    places = first.where(F.col("kind") == ANSWER).unionByName(second.where(F.col("kind") == ANSWER))
    places = stage(places.groupBy("key").agg(F.collect_list("places").alias("places")), "repeated_places")  # two a document at most
    fields = "id long, n_bytes long, n_removed long, n_spans long, kept " + ("binary" if with_text else "string")
    return source.repartition(parts, "key").join(places.repartition(parts, "key"), "key", "left").select("id", "text", "places").mapInArrow(_cut(with_text), fields)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.withColumnsRenamed({"id": "doc_id", "kept": "kept_sha256"})
