"""Cost-balanced packing of tokenised documents into fixed-length sequences.

Every task tokenises its own documents and packs them block by block, so nothing is shuffled. Whole sequences are cut from long
documents first. What is left over is placed by falling length into the sequence of lowest estimated cost (linear plus
quadratic attention cost) that still has room; a piece that fits nowhere is cut. A block's sequences have room for exactly its
tokens: all are full but the last ones, whose lengths are powers of two.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeval.llm.common import read, trimmed

LENGTH = 1024
LINEAR, QUADRATIC = 1.0, 1.0 / 2048  # cost of a token, and of a pair of tokens that attend to each other
BLOCK_TOKENS = 1 << 21
END = 0
SPECIAL = {"<|endoftext|>": 50256}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokenizer(path: str):
    """Text to ids; the ranks are those of the byte_bpe_50k vocabulary that the tokenizers library reads from its json."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all")


def capacities(tokens: int, length: int) -> list[int]:
    """Full sequences, and powers of two for what is left of them."""
    whole, left = divmod(tokens, length)
    return [length] * whole + [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


def assign(pieces: list[tuple[int, int, int]], length: int) -> list[tuple[int, int, int, int, int]]:
    """pieces (document, start, length < a sequence's) to (document, start, length, sequence, offset)."""
    size = np.array(capacities(sum(p[2] for p in pieces), length), np.int64)
    room, cost, out = size.copy(), np.zeros(len(size)), []
    for doc, start, left in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        while left:
            fits = room >= left
            s = int(np.argmin(np.where(fits, cost, np.inf))) if fits.any() else int(np.argmax(room))
            n = min(left, int(room[s]))
            out.append((doc, start, n, s, int(size[s] - room[s])))
            room[s] -= n
            cost[s] += LINEAR * n + QUADRATIC * n * n
            start, left = start + n, left - n
    return out


def _pack(path: str, length: int, with_ids: bool):
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = tokenizer(path)
        sequence = TaskContext.get().partitionId() << 33
        docs: list[tuple[int | None, np.ndarray]] = []
        held = 0

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            placed, rest = [], []
            for d, (_, ids) in enumerate(docs):
                for at in range(0, len(ids) - length + 1, length):
                    placed.append((d, at, length, sequence, 0))
                    sequence += 1
                if tail := len(ids) % length:
                    rest.append((d, len(ids) - tail, tail))
            packed = assign(rest, length)
            placed += [(d, start, n, sequence + s, offset) for d, start, n, s, offset in packed]
            sequence += 1 + max((p[3] for p in packed), default=-1)
            for at in range(0, len(placed), 4096):
                part = placed[at : at + 4096]
                pieces = [docs[d][1][start : start + n] for d, start, n, _, _ in part]
                columns = [
                    pa.array([docs[p[0]][0] for p in part], pa.int64()),
                    pa.array([p[1] for p in part], pa.int64()),
                    pa.array([p[2] for p in part], pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in pieces], pa.int64()),
                    pa.array([len(docs[p[0]][1]) for p in part], pa.int64()),
                    pa.array([p[3] for p in part], pa.int64()),
                    pa.array([p[4] for p in part], pa.int64()),
                ]
                if with_ids:
                    ends = np.cumsum([0] + [len(x) for x in pieces])
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(pieces).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encode(text.as_py() or ""), END).astype("<u4")
                docs.append((i, ids))
                held += len(ids)
                if held >= BLOCK_TOKENS:
                    yield from block()
                    docs, held = [], 0
        if docs:
            yield from block()

    return run


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Pieces of the tokenised documents (each closed by id 0) and their places; with `ids` also each piece's ids.

    Every id lies in exactly one piece, sequences are filled without gaps and hold at most `length` ids. A null text counts as
    empty: only the closing id. Null ids and repeated rows are documents of their own. An empty table gives no pieces.
    """
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * ids
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(trimmed(_pack(path or vocabulary(), length, ids)), schema)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
