"""Spelling variants grouped over a reduced alphabet.

Letters are hashed to a few symbols, which turns words into shapes. Words one edit apart have shapes at most one edit apart, and a shape over few
symbols has a short list of shapes around it: its full one-edit neighbourhood is generated and joined with the shapes of the vocabulary, and
each pair of words that this brings together is verified on the original strings. Shapes meet as 64-bit hashes, whose collisions only bring
more pairs to verify.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeval.llm.common import drop_staged, read, small, stage

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT, EVERY = 5, 3, 97
SYMBOLS = 6
HELD_WORDS = 200_000  # words that a task counts before it sends them on
CELLS = 1 << 19  # neighbours that are computed at a time; one word's are computed at once

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits."""
    x = (x ^ (x >> np.uint64(32))) * BASE
    x = (x ^ (x >> np.uint64(29))) * BASE
    return x ^ (x >> np.uint64(32))


def damaged(run: str, doc_id: int | None) -> str:
    """The run, or in one of 97 (document, run) the run without the letter that the pair's hash names; a null id is written as nothing."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(least_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """word and n, counted as far as HELD_WORDS words go."""
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                own = Counter(RUN.findall((text.as_py() or "").encode().lower().decode()))  # of bytes: only A-Z
                for run, n in own.items():
                    if len(run) >= least_length and len(word := damaged(run, doc_id)) >= least_length:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n: the runs of letters of all texts in A-Z lower case, of at least so many code points and occurrences, after `damaged`."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_count(least_length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def shapes(words: list[str], symbols: int) -> list[np.ndarray]:
    """The symbols of each word's letters."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    reduced = (spread(points + np.uint64(1)) % np.uint64(symbols)).astype(np.uint8)
    return np.split(reduced, np.cumsum([len(w) for w in words])[:-1])


def _values(symbols: int) -> np.ndarray:
    return spread(np.arange(1, symbols + 1, dtype=np.uint64)) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(n, BASE)))


def _coded(sums: np.ndarray, length: int) -> np.ndarray:
    return spread(sums + np.uint64(length * int(BASE_INVERSE) % (1 << 64)))


def codes(same: np.ndarray, symbols: int) -> np.ndarray:
    """The hash of each row of symbols."""
    n, length = same.shape
    return _coded((_values(symbols)[same] * _powers(length)[:length]).sum(axis=1, dtype=np.uint64), length).reshape(n)


def neighbourhood(same: np.ndarray, symbols: int) -> np.ndarray:
    """Hashes of each row of symbols itself, of all it becomes by one deletion, by one insertion and by one replacement: a row for each, some of them equal."""
    n, length = same.shape
    value, powers = _values(symbols), _powers(length + 1)
    own = value[same] * powers[:length]
    before = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(own, axis=1, dtype=np.uint64)], axis=1)
    total = before[:, -1:]
    gone = before[:, :-1] + (total - before[:, 1:]) * BASE_INVERSE
    more = (before + (total - before) * BASE)[:, :, None] + value * powers[: length + 1, None]
    other = (total - own)[:, :, None] + value * powers[:length, None]  # the row itself is among them
    return np.concatenate([_coded(gone, length - 1), _coded(more.reshape(n, -1), length + 1), _coded(other.reshape(n, -1), length)], axis=1)


def _same_length(found: list[np.ndarray], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows of one length and the rows below each other, as many as CELLS neighbours allow."""
    lengths = np.array([len(x) for x in found])
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        step = max(1, CELLS // int((2 * length + 1) * symbols))
        for i in range(0, len(at), step):
            yield at[i : i + step], np.stack([found[j] for j in at[i : i + step]])


def _shape(symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = shapes(batch.column("word").to_pylist(), symbols)
            code = np.zeros(len(found), np.uint64)
            for at, same in _same_length(found, symbols):
                code[at] = codes(same, symbols)
            columns = [batch.column("word"), batch.column("n"), pa.array([x.tobytes() for x in found], pa.binary()), pa.array(code.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n", "shape", "code"])

    return run


def _around(symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x, np.uint8) for x in batch.column("shape").to_pylist()]
            code = batch.column("code").to_numpy()
            for at, same in _same_length(found, symbols) if found else ():
                near = np.sort(neighbourhood(same, symbols), axis=1)
                new = np.append(np.ones((len(at), 1), bool), near[:, 1:] != near[:, :-1], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(code[at], new.sum(axis=1))), pa.array(near[new].view(np.int64))], ["code", "near"])

    return run


def near_words(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """word, n, near and near_n: all ordered pairs of words of the vocabulary that one insertion, deletion or replacement turns into each other.

    vocabulary: word (not empty) and n, each word once.
    """
    words = stage(vocabulary.select("word", "n").mapInArrow(_shape(symbols), "word string, n long, shape binary, code long"), "spelling_shapes")
    around = words.select("shape", "code").distinct().mapInArrow(_around(symbols), "code long, near long")
    there = words.select(F.col("code").alias("near"), F.col("word").alias("near_word"), F.col("n").alias("near_n"))
    met = around.join(there, "near").drop("near")  # the vocabulary's shapes around each shape
    pairs = met.join(words.select("code", "word", "n"), "code").where(F.levenshtein("word", "near_word", 1) == 1)
    # two shapes with one hash would bring a pair twice
    return pairs.select("word", "n", F.col("near_word").alias("near"), "near_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word and root: the last word that forms lead to. forms: word and form, each word once and without cycles. Pointers are doubled until none moves."""
    to = stage(forms.select("word", F.col("form").alias("root")), "spelling_roots")
    n = to.count()
    while True:
        ahead = small(to.select(F.col("word").alias("root"), F.col("root").alias("next")), n)
        jumped = stage(to.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling_roots")
        drop_staged(to)
        to = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return to


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", symbols: int = SYMBOLS, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of `vocabulary`.

    form: the near word of largest n (of equal ones the first in code-point order), where that is at least `times` the word's, else null; root:
    where forms lead, the word itself without one. Null texts have no words, and a null id is written as nothing in the hash that damages a
    run. Repeated rows count each time; a word may be a whole text of any length. An empty table gives an empty result; other columns are not looked at.
    """
    if times < 2:
        raise ValueError("times must be 2 or more, so that forms lead to larger counts")
    words = stage(vocabulary(docs, id_col, text_col, least_length, least_count), "spelling_words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    near = stage(near_words(words, symbols).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")), "spelling_near")
    form_n = -F.col("best.minus")
    out = words.join(near, "word", "left").withColumn("has", form_n >= F.col("n") * times)
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("best.near")).alias("form"), F.when(F.col("has"), form_n).alias("form_n"))
    out = stage(out, "spelling_forms")
    root = roots(out.where("form is not null"))
    return out.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"))


# the hash of a run by the bits of its bytes: letters up to 00FF take one byte or two
_BYTES = "flatten(list_transform(string_split({x}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)]::BIGINT[] END))"
_BIT = "xor(k >> 1, (k & 1) * 3988292384)"
OP12_SQL = rf"""
WITH RECURSIVE bytes AS (SELECT range AS b, list_reduce(list_prepend(range, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda k, i: {_BIT}) AS crc FROM range(256)),
crcs AS (SELECT list(crc ORDER BY b) AS t FROM bytes),
runs AS (SELECT doc_id, run, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY doc_id, run),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {_BYTES.format(x="coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")}),
                lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h FROM runs CROSS JOIN crcs),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN run[:(h % length(run))] || run[(h % length(run)) + 2:] ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
           FROM words w LEFT JOIN best b ON w.word = b.word),
led AS (SELECT word, coalesce(form, word) AS root, form IS NULL AS ended FROM formed
        UNION ALL SELECT l.word, coalesce(f.form, l.root), f.form IS NULL FROM led l JOIN formed f ON l.root = f.word WHERE NOT l.ended)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM formed f JOIN led l ON l.word = f.word AND l.ended
"""
