"""Sharding by balanced label propagation.

Documents that share a hub (here: an equal text) start on hashed shards. Each round joins documents with their hub's votes
(documents per shard). In one turn every document asks for the open shard most of its neighbours are on, and a shard's free room is dealt out
by a histogram of the requests, largest gain first; in the next it asks for any shard, and two shards swap as many documents as
ask in both directions, so that full shards change too. Documents without links fill the shards up at the end, so that row counts are at most
one apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkeval.llm.common import drop_staged, ranked, read, small, stage

LOTS = 1024
PIECES = 256  # a hub with more than this part of all links is joined in pieces


def sized(links: DataFrame) -> DataFrame:
    """links with `pieces`, in how many their hub is joined, and `piece`, their own. Hubs of one link are left out.

    The hubs that are large are few (at most PIECES) and broadcast; the links of all others meet their counts by a shuffle.
    """
    hubs = stage(links.groupBy("hub").agg(F.count("*").alias("n")).where("n > 1"), "shard_hubs")
    total = hubs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = F.col("n") * PIECES > F.lit(total)
    pieces = F.floor(F.col("n") * PIECES / F.greatest(F.lit(total), F.lit(1))).cast("int") + 1
    hot = F.broadcast(hubs.where(large).select("hub", pieces.alias("pieces")))
    found = links.join(hot, "hub")
    rest = links.join(hot, "hub", "left_anti").join(hubs.where(~large).select("hub", F.lit(1).alias("pieces")), "hub")
    return found.unionByName(rest).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))


def propagate(links: DataFrame, shards: int, capacity: int, rounds: int = 10, one_hub: bool = True) -> DataFrame:
    """links (id, hub): the linked documents' shards as (id, hub, shard).

    A hub's votes are copied to each of its pieces, so that no task joins a large hub alone. No shard takes a document in beyond `capacity`
    documents, but for a part of a lot in a swap. With `one_hub` every id occurs once; otherwise an id may have several hubs, whose votes
    are added up.
    """
    state = stage(sized(links).select("id", "hub", "pieces", "piece", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")), "shards")
    idle = 0
    for turn in range(rounds):
        swaps = turn % 2 == 1
        people = state if one_hub else state.select("id", "shard").distinct()
        loads = dict(people.groupBy("shard").count().collect())  # a row for each shard
        room = [max(0, capacity - loads.get(s, 0)) for s in range(shards)]
        ask = F.array(*[F.lit(swaps or r > 0) for r in room])
        votes = state.groupBy("hub").agg(
            F.array(*[F.count(F.when(F.col("shard") == s, 1)) for s in range(shards)]).alias("votes"), F.count("*").alias("members"), F.first("pieces").alias("pieces")
        )
        # a hub whose members are on one shard already asks for nothing
        votes = votes.where(F.array_max("votes") < F.col("members"))
        votes = votes.select("hub", "votes", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
        near = state.join(votes, ["hub", "piece"])
        if not one_hub:
            total = F.array(*[F.sum(F.col("votes")[s]) for s in range(shards)])
            near = near.groupBy("id").agg(F.first("shard").alias("shard"), F.min("hub").alias("hub"), total.alias("votes"))
        spread = F.xxhash64("hub")  # hubs with even votes meet on different shards
        choice = F.transform(
            F.col("votes"),
            lambda v, s: F.when(
                F.get(ask, s) | (s == F.col("shard")), F.struct(v.alias("v"), (-F.pmod(spread + s, F.lit(shards))).alias("o"), s.cast("int").alias("s"))
            ),
        )
        near = near.withColumn("best", F.array_max(choice))
        gain = F.col("best.v") - F.get("votes", F.col("shard"))
        lot = (40 - F.floor(F.log2(gain + 1))) * LOTS + F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(LOTS))
        asks = near.where(F.col("best.s") != F.col("shard")).select("id", F.col("shard").alias("from"), F.col("best.s").alias("to"), lot.cast("int").alias("lot"))
        asks = stage(asks, "shard_requests")
        if swaps:
            pairs = {(r["from"], r["to"]): r["count"] for r in asks.groupBy("from", "to").count().collect()}  # at most shards x shards
            by, quotas = ["from", "to"], [(a, b, min(n, pairs.get((b, a), 0))) for (a, b), n in pairs.items()]
        else:
            by, quotas = ["to"], [(None, s, r) for s, r in enumerate(room)]
        quota = asks.sparkSession.createDataFrame(quotas, "from int, to int, quota long").select(*by, "quota")
        upto = F.sum("count").over(Window.partitionBy(*by).orderBy("lot"))
        placed = asks.groupBy(*by, "lot").count().withColumn("upto", upto).join(F.broadcast(quota), by)  # bound: a row for each pair of shards
        granted = placed.where(F.col("upto") <= F.col("quota")).groupBy(*by).agg(F.max("lot").alias("most"))
        moves = asks.join(F.broadcast(granted), by).where("lot <= most").select("id", F.col("to").alias("to"))  # the same bound
        n = moves.count()
        idle = 0 if n else idle + 1
        if n:
            fresh = stage(state.join(small(moves, n), "id", "left").select("id", "hub", "pieces", "piece", F.coalesce("to", "shard").alias("shard")), "shards")
            drop_staged(state)
            state = fresh
        drop_staged(asks)
        if idle == 2:
            break
    return state.select("id", "hub", "shard")


def cut_edges(links: DataFrame, state: DataFrame) -> int:
    """Pairs of documents of one hub that are on different shards, from counts."""
    own = links.join(state.select("id", "shard").distinct(), "id").groupBy("hub", "shard").agg(F.count("*").alias("n"))
    per = own.groupBy("hub").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
    return per.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2), F.lit(0.0)).cast("long")).first()[0]


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", rounds: int = 10) -> DataFrame:
    """id, size (UTF-8 bytes plus 8), crc, hub, linked, shard and slot of every row, repeated rows included.

    A null text counts as empty and links with other empty ones; a null id is an id like another. Slots number a shard's
    rows from 0 without gaps. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("crc"),
        F.md5(text).alias("hub"),
    )
    base = stage(base, "shard_rows")
    total = base.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    state = propagate(base.select(F.col("row").alias("id"), "hub"), shards, total // shards, rounds)
    loads = dict(state.groupBy("shard").count().collect())
    linked = sum(loads.values())
    placed = base.join(state.select(F.col("id").alias("row"), F.col("shard").alias("own")), "row", "left")
    placed = ranked(placed.withColumn("own", F.coalesce("own", F.lit(-1))), "own", "row", total)

    # what the first hashing put above a quota joins the documents without links, which fill the gaps by rank
    used = [min(loads.get(s, 0), quota[s]) for s in range(shards)]
    over, gaps = [total - linked], [0]
    for s in range(shards):
        over.append(over[-1] + loads.get(s, 0) - used[s])
        gaps.append(gaps[-1] + quota[s] - used[s])
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    free = F.col("own") == -1
    above = F.col("rank") - F.get(longs(used), F.col("own"))
    pool = F.when(free, F.col("rank")).when(above >= 0, F.get(longs(over), F.col("own")) + above)
    placed = placed.withColumn("pool", pool)
    gap = sum((F.col("pool") >= F.lit(g)).cast("int") for g in gaps[1:-1]) if shards > 1 else F.lit(0)
    placed = placed.withColumn("gap", gap)
    shard = F.when(F.col("pool").isNull(), F.col("own")).otherwise(F.col("gap"))
    inside = F.get(longs(used), F.col("gap")) + F.col("pool") - F.get(longs(gaps), F.col("gap"))
    slot = F.when(F.col("pool").isNull(), F.col("rank")).otherwise(inside)
    return placed.select(
        "id", "size", "crc", "hub", (F.col("own") >= 0).alias("linked"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot")
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(read(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "linked",
    )
