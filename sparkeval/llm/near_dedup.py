"""MinHash near-deduplication with tensored banding.

Documents are sets of five-word shingles; equal sets are one class. Two small collections of minhash groups are computed for each
class, and a table key is a pair of one group from either collection: 12 x 12 tables from 2 x 12 groups of two hashes, 48
minhashes instead of 576. Only groups that occur twice form keys. Classes in a bucket are linked where enough minhashes agree; the
links' components are verified on full sets: first against the component's first class, then what that leaves against
all classes of the component, in blocks. Verified links give the final components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeval.llm.common import blob, drop_staged, read, runs_of, small, stage, trimmed
from sparkeval.llm.graph import connected_components

WORDS = 5
SIMILARITY = 75  # per cent
GROUPS, ROWS = 12, 2  # groups in a collection, minhashes in a group
HASHES = 2 * GROUPS * ROWS
# A pair at 0.75 shares a group of either collection but for 1 in 10,000 pairs, and has fewer agreeing minhashes than this (of 48, 36
# expected) about as rarely.
AGREE = 23
BUCKET_ROWS = 2048  # larger buckets are compared block against block
BLOCK_SETS = 256  # the same for sets of a component
TASK_ROWS = 40_000  # rows of buckets that a task compares
CHUNK = 1 << 18  # bytes of text that are hashed at a time; the arrays for it take some 80 bytes a byte
VALUES = 1 << 15  # shingles whose membership in a block's sets is held at a time

_random = np.random.default_rng(20240607)
BYTES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
PLACES = _random.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
FACTORS = _random.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
OFFSETS = _random.integers(1, 1 << 63, HASHES, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted within a text, and each text's number of them."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends_at = np.cumsum([len(t) + 1 for t in texts])
    blank = SPACE[data]
    start = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    end = np.flatnonzero(blank & np.append(False, ~blank[:-1]))
    powers = np.cumprod(np.append(np.uint64(1), np.full(len(data) - 1, BASE)))
    sums = np.append(np.uint64(0), np.cumsum(BYTES[data] * powers))
    back = np.cumprod(np.append(np.uint64(1), np.full(len(data) - 1, BASE_INVERSE)))
    words = mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))
    owner = np.searchsorted(ends_at, start, "right")
    n_words = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    n = np.where(n_words >= WORDS, n_words - WORDS + 1, (n_words > 0).astype(np.int64))
    out = np.zeros(int(n.sum()), np.uint64)
    at = np.cumsum(n) - n
    if len(words) >= WORDS:
        whole = sum((words[j : len(words) - WORDS + 1 + j] * PLACES[j] for j in range(1, WORDS)), words[: len(words) - WORDS + 1] * PLACES[0])
        long = n_words >= WORDS
        places = np.repeat(first[long] - at[long], n[long]) + np.flatnonzero(np.repeat(long, n))
        out[np.repeat(long, n)] = mix(whole[places])
    for d in np.flatnonzero((n_words > 0) & (n_words < WORDS)):
        own = words[first[d] : first[d] + n_words[d]]
        out[at[d]] = mix(np.array([(own * PLACES[: len(own)]).sum() + np.uint64(len(own))], np.uint64))[0]
    for a, m in zip(at, n, strict=True):
        out[a : a + m].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[at[n > 0]] = True
    kept = np.add.reduceat(new, at[n > 0]) if len(out) else np.empty(0, np.int64)
    sizes = np.zeros(len(texts), np.int64)
    sizes[n > 0] = kept
    return out[new], sizes


def chunks(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """Rows from and to, and their texts as lower-case bytes, about CHUNK bytes at a time."""
    at = size = 0
    texts: list[bytes] = []
    for i, value in enumerate(column):
        texts.append((value.as_py() or "").encode().lower())
        size += len(texts[-1])
        if size >= CHUNK or i + 1 == len(column):
            yield at, i + 1, texts
            at, size, texts = i + 1, 0, []


def class_of(sets: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return mix(np.add.reduceat(mix(sets ^ BASE), starts) + sizes.astype(np.uint64)).view(np.int64)


def signatures(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.empty((len(starts), HASHES), np.uint64)
    for h in range(HASHES):
        out[:, h] = np.minimum.reduceat((sets ^ OFFSETS[h]) * FACTORS[h], starts)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text hash, size, class, minhash bytes and group keys of each document."""
    names = ["id", "text_hash", "n", "class", "bytes", "keys"]
    for batch in batches:
        for a, b, texts in chunks(batch.column("text")):
            sets, sizes = shingle_sets(texts)
            some = sizes > 0
            klass, low, keys = np.zeros(b - a, np.int64), [b""] * (b - a), [None] * (b - a)
            if some.any():
                starts = (np.cumsum(sizes) - sizes)[some]
                klass[some] = class_of(sets, starts, sizes[some])
                signs = signatures(sets, starts)
                pairs = signs.reshape(len(starts), 2 * GROUPS, ROWS)
                grouped = mix(pairs[:, :, 0] * PLACES[0] + mix(pairs[:, :, 1]) + np.arange(2 * GROUPS, dtype=np.uint64) * BASE).view(np.int64)
                tiny = (signs >> np.uint64(24)).astype(np.uint8)
                for i, d in enumerate(np.flatnonzero(some)):
                    low[d], keys[d] = tiny[i].tobytes(), grouped[i]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(a, b - a),
                    batch.column("text_hash").slice(a, b - a),
                    pa.array(sizes),
                    pa.array(klass),
                    pa.array(low, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names,
            )


class Forest:
    """Links of a small group of rows: only those that join two of its components are kept."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def add(self, i: int, others: np.ndarray) -> None:
        labels, at = np.unique(self.label[others], return_index=True)
        apart = labels != self.label[i]
        for x in others[at[apart]]:
            self.links.append((i, int(x)))
        self.label[np.isin(self.label, labels[apart])] = self.label[i]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside each bucket between classes of which enough minhashes agree: to the bucket's first class, then of the rest."""

    def links(table: pa.Table) -> pa.RecordBatch:
        nodes = table["class"].to_numpy()
        low = np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint8).reshape(len(nodes), HASHES)
        n, keys = table["n"].to_numpy(), [table[c].to_numpy() for c in ("key", "pair")]
        new = np.append(True, (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]))
        starts = np.flatnonzero(new)
        lengths = np.diff(np.append(starts, len(nodes)))
        head = np.repeat(starts, lengths)

        def alike(i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
            near = np.minimum(n[i], n[j]) * 100 >= SIMILARITY * np.maximum(n[i], n[j])
            return near & ((low[i] == low[j]).sum(axis=-1) >= AGREE)

        rows = np.arange(len(nodes))
        ok = alike(head, rows)
        out = [np.stack([nodes[head[ok]], nodes[rows[ok]]])]
        for s, length in zip(starts[lengths > 2], lengths[lengths > 2], strict=True):
            run = np.arange(s, s + length)
            rest = run[~ok[run]]
            if len(rest) == 0:
                continue
            forest = Forest(length)
            forest.label[ok[run]] = 0
            for i in rest:
                forest.add(int(i - s), np.flatnonzero(alike(int(i), run)))
            if forest.links:
                a = np.array(forest.links)
                out.append(np.stack([nodes[s + a[:, 0]], nodes[s + a[:, 1]]]))
        a, b = np.concatenate(out, axis=1)
        apart = a != b
        return pa.RecordBatch.from_arrays([pa.array(a[apart]), pa.array(b[apart])], ["a", "b"])

    held: list[pa.Table] = []
    for run in runs_of(batches, ["key", "pair"]):
        if run.num_rows > 1:
            held.append(run)
            if sum(t.num_rows for t in held) > 20_000:
                yield links(pa.concat_tables(held))
                held = []
    if held:
        yield links(pa.concat_tables(held))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted set of each document as bytes, where the document has the class that is asked for."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        asked = batch.column("class").to_numpy()
        for a, b, texts in chunks(batch.column(at)):
            sets, sizes = shingle_sets(texts)
            starts = np.cumsum(sizes) - sizes
            some = np.flatnonzero(sizes > 0)
            keep = some[class_of(sets, starts[some], sizes[some]) == asked[a:b][some]] if len(some) else some
            columns = [c.take(pa.array(keep + a)) for i, c in enumerate(batch.columns) if i != at]
            names = [x for i, x in enumerate(batch.schema.names) if i != at]
            values = pa.array([blob(sets[starts[d] : starts[d] + sizes[d]]) for d in keep], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, values], [*names, "set"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= SIMILARITY * (len(a) + len(b) - both)


def overlaps(asked: list[np.ndarray], sets: list[np.ndarray]) -> np.ndarray:
    """Whether each asked set is similar to each set: intersections by products of membership matrices over ranges of the values."""
    values = np.unique(np.concatenate(sets))

    def members(group: list[np.ndarray], at: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Which of the values `own` are in each set, whose next value is number `at`; moves `at` past them."""
        m = np.zeros((len(group), len(own)), np.float32)
        for i, s in enumerate(group):
            end = np.searchsorted(s, own[-1], "right")
            part = s[at[i] : end]
            place = np.searchsorted(own, part)
            m[i, place[own[place] == part]] = 1
            at[i] = end
        return m

    both = np.zeros((len(asked), len(sets)), np.int64)
    at_asked, at_sets = np.zeros(len(asked), np.int64), np.zeros(len(sets), np.int64)
    for k in range(0, len(values), VALUES):
        own = values[k : k + VALUES]
        both += np.rint(members(asked, at_asked, own) @ members(sets, at_sets, own).T).astype(np.int64)
    asked_sizes, sizes = (np.array([len(s) for s in g]) for g in (asked, sets))
    return 100 * both >= SIMILARITY * (asked_sizes[:, None] + sizes[None, :] - both)


def rest_links(rest: list[int], nodes: np.ndarray, sets: list[np.ndarray], settled: np.ndarray) -> list[tuple[int, int]]:
    """Links of the rows `rest` with all rows; settled rows are linked already."""
    forest = Forest(len(nodes))
    if settled.any():
        forest.label[settled] = np.flatnonzero(settled)[0]
    for at in range(0, len(rest), 64):
        part = rest[at : at + 64]
        if len(nodes) < 8:
            alike = np.array([[i == j or similar(sets[i], sets[j]) for j in range(len(nodes))] for i in part])
        else:
            alike = overlaps([sets[i] for i in part], sets)
        for i, row in zip(part, alike, strict=True):
            forest.add(i, np.flatnonzero(row))
    return [(int(nodes[i]), int(nodes[j])) for i, j in forest.links]


def _verify(rest_only: bool):
    """Over blocks of a component's sets, its first class (or the rows asked for) in front: verified links, and classes left over."""

    def out(links: list[tuple[int, int]], left: list[int]) -> pa.RecordBatch:
        a, b = [x for x, _ in links] + left, [x for _, x in links] + [None] * len(left)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches, ["component", "block", "asking"]):
            nodes = table["class"].to_numpy()
            _, once = np.unique(nodes, return_index=True)  # repeated rows, and asked rows among the others
            first = table["first"].to_numpy()
            once = once[np.argsort(~first[once], kind="stable")] if not rest_only else once
            asked = {int(x) for x in nodes[first]}
            nodes = nodes[once]
            values = table["set"].take(pa.array(once)).to_pylist()
            sets = [np.frombuffer(v, np.uint64) for v in values]
            if rest_only:
                yield out(rest_links([i for i, x in enumerate(nodes) if int(x) in asked], nodes, sets, np.zeros(len(nodes), bool)), [])
                continue
            if int(nodes[0]) not in asked or len(nodes) < 2:
                continue
            settled = np.array([True, *[similar(sets[0], s) for s in sets[1:]]])
            links = [(int(nodes[0]), int(x)) for x in nodes[1:][settled[1:]]]
            rest = [int(i) for i in np.flatnonzero(~settled)]
            if table["blocks"][0].as_py() == 1:
                yield out(links + (rest_links(rest, nodes, sets, settled) if rest else []), [])
            else:
                yield out(links, [int(nodes[i]) for i in rest])

    return run


def _with_sets(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """members with the set of their document, which is named by its id and the hash of its text, so that null ids meet their own text only."""
    wanted = small(members.withColumnsRenamed({"id": "rep", "text_hash": "rep_hash"}), n)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema if f.name not in ("id", "text_hash"))
    near = docs.join(wanted, (F.xxhash64("text") == F.col("rep_hash")) & F.col("id").eqNullSafe(F.col("rep")))
    return near.select(*[c for c in members.columns if c not in ("id", "text_hash")], "text").mapInArrow(trimmed(_sets), fields + ", set binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS, block_sets: int = BLOCK_SETS) -> DataFrame:
    """id, text_hash, n_shingles and component_id (the smallest id reachable over links of similarity 0.75) of every row.

    Words are split at ASCII white space with A-Z in lower case. A text with fewer than five words is one shingle; one
    without words, a null one too, is alone with its own id. Ids of repeated rows and ids that are null are treated like any
    others: a component's id is the smallest that is not null. No bucket, component or group is capped.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = source.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        trimmed(_sign), "id long, text_hash long, n long, class long, bytes binary, keys array<long>"
    )
    rows = stage(rows, "minhashes")
    own = F.min_by("text_hash", F.struct(F.col("id").isNull(), F.col("id"), F.col("text_hash")))
    classes = rows.where("n > 0").groupBy("class").agg(F.min("id").alias("id"), own.alias("text_hash"), F.first("n").alias("n"), F.first("bytes").alias("bytes"), F.first("keys").alias("keys"))
    classes = stage(classes, "shingle_classes")

    groups = classes.select("class", F.posexplode("keys").alias("place", "key"))
    twice = groups.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key")
    live = groups.join(twice, "key").groupBy("class").agg(
        F.collect_list(F.when(F.col("place") < GROUPS, F.col("key"))).alias("left"),
        F.collect_list(F.when(F.col("place") >= GROUPS, F.col("key"))).alias("right"),
    )  # at most 24 keys for each class
    tables = live.select("class", F.explode("left").alias("l"), "right").select("class", "l", F.explode("right").alias("r"))
    tables = stage(tables.select("class", F.xxhash64("l", "r").alias("key")), "minhash_tables")
    buckets = tables.groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
    rows_in = tables.join(buckets, "key").withColumn("parts", F.ceil(F.col("times") / bucket_rows).cast("int"))
    own = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    rows_in = rows_in.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pair = F.least("own", "other") * F.lit(1 << 20).cast("long") + F.greatest("own", "other")
    rows_in = stage(rows_in.select("key", pair.alias("pair"), "class"), "minhash_buckets")
    # rows are few bytes and much work: tasks by their number, not by their size
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows_in.count() // TASK_ROWS))
    edges = rows_in.join(classes.select("class", "n", "bytes"), "class").repartition(tasks, "key", "pair").sortWithinPartitions("key", "pair", "class").mapInArrow(trimmed(_candidates), "a long, b long")
    near = stage(connected_components(edges).withColumnRenamed("node", "class"), "near_components")
    drop_staged(tables)
    drop_staged(rows_in)

    sizes = near.groupBy("component").agg(F.count("*").alias("members"))
    members = near.join(sizes, "component").join(classes.select("class", "id", "text_hash"), "class")
    members = members.withColumn("blocks", F.ceil(F.col("members") / block_sets).cast("int"))
    members = stage(members.select("id", "text_hash", "class", "component", "blocks"), "near_members")
    n = members.count()
    first = F.col("class") == F.col("component")
    sets = _with_sets(source, members, n).withColumn("first", first).withColumn("asking", F.lit(0))
    block = F.when(F.col("first"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")))
    sets = sets.withColumn("block", F.explode(block)).repartition("component", "block").sortWithinPartitions("component", "block", "asking")
    found = stage(sets.mapInArrow(trimmed(_verify(False)), "a long, b long"), "near_links")
    links, left = found.where("b is not null"), found.where("b is null").select(F.col("a").alias("class")).distinct()
    n_left = left.count()
    if n_left:  # of components over several blocks: what the first class did not settle, against every block
        open_ = members.join(small(left, n_left).withColumn("first", F.lit(True)), "class", "left").withColumn("first", F.coalesce("first", F.lit(False)))
        asking = open_.where("first").groupBy("component").agg(F.ceil(F.count("*") / block_sets).cast("int").alias("askers"))
        open_ = stage(open_.join(asking, "component"), "near_open")
        again = _with_sets(source, open_, open_.count())
        own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
        mine = F.pmod(F.xxhash64("class"), F.col("askers")).cast("int")
        others = again.withColumn("first", F.lit(False)).withColumn("block", own).withColumn("asking", F.explode(F.sequence(F.lit(0), F.col("askers") - 1)))
        askers = again.where("first").withColumn("asking", mine).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        every = others.unionByName(askers).repartition("component", "block", "asking").sortWithinPartitions("component", "block", "asking")
        links = links.unionByName(every.mapInArrow(trimmed(_verify(True)), "a long, b long"))
    final = connected_components(links).withColumnRenamed("node", "class")
    named = classes.select("class", "id").join(final, "class")
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    reach = named.join(smallest, "component").select("class", "component_id")
    whole = classes.select("class", "id").join(reach, "class", "left").select("class", F.coalesce("component_id", "id").alias("component_id"))
    whole = stage(whole, "near_classes")
    out = rows.select("id", "text_hash", "n", F.when(F.col("n") > 0, F.col("class")).alias("class")).join(whole, "class", "left")
    reached = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", "text_hash", F.col("n").alias("n_shingles"), reached.alias("component_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the near copies: of each component the document with the smallest id stays, with docs' columns."""
    found = near_duplicates(docs, id_col, text_col)
    names = {c.lower() for c in docs.columns}
    own, digest = (next(n for i in range(len(names) + 1) if (n := f"{c}{i}") not in names) for c in ("kept_id", "kept_hash"))  # whatever docs' columns are called
    kept = stage(found.where("id <=> component_id").select(F.col("id").alias(own), F.col("text_hash").alias(digest)).distinct(), "near_kept")
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(digest))
    return docs.join(kept, same, "left_semi")


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
