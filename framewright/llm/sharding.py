"""Sharding by balanced label propagation.

Documents and what they share (here: their text) form an edge table (document, link); two documents
with a link in common are neighbours. All start with a hashed shard as their label. In each round
the labels are read again: a link counts those of its documents, offers the one that most of them
have and whose shard has room for the others, and every document wishes for the offer behind which
most of its neighbours stand. Moves are taken up largest group first while quotas hold; a document
that has been seated holds room and may move again when its neighbours have. A round that cuts more
links than the best one before is taken back, and propagation ends. Rows without a neighbour, and
what found no room whole, then fill every quota to the row, so sizes stay even whatever has moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import checkpointed

SHARDS, ROUNDS = 40, 12
#: Hash buckets within which ranks are taken, per group, and the hash classes in which moves are taken up.
BUCKETS, CLASSES = 1024, 64


def positions(df: DataFrame, group: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Gapless numbers from 0 in each group, in bucket order, without sorting a group in one task.

    Rows are only sorted within a bucket; the buckets' sizes (few rows) are summed up before."""
    df = df.withColumn("__bucket", bucket)
    by = [*group, "__bucket"]
    sizes = df.groupBy(by).agg(F.count("*").alias("__n"))
    up_to = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, F.coalesce(F.sum("__n").over(up_to), F.lit(0)).alias("__offset"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.join(offsets, by).withColumn(name, (rank - 1 + F.col("__offset")).cast("long")).drop("__bucket", "__offset")


def edge_table(docs: DataFrame, links: list[str], most: int, shards: int = SHARDS) -> DataFrame:
    """(id, link, size, hot) of the links that several rows of `docs` (id, links) share.

    A link of more rows than `most`, which no shard can hold, is cut into equal parts, each a link of its own.
    Links that hold a tenth of a shard, or one row in 400, are hot: that bounds their number, so they are broadcast."""
    every = None
    for k, name in enumerate(links):
        mine = docs.where(F.col(name).isNotNull()).select("id", F.xxhash64(F.lit(k), name).alias("link"))
        every = mine if every is None else every.unionByName(mine)
    sizes = checkpointed(every.groupBy("link").agg(F.count("*").alias("size")).where("size > 1"))
    hot = sizes.where(F.col("size") > F.greatest(F.lit(1), F.lit(docs.count() // max(400, 10 * shards))))
    cold = every.join(F.broadcast(hot), "link", "left_anti").join(sizes, "link").withColumn("hot", F.lit(False))
    large = every.join(F.broadcast(hot), "link").withColumn("hot", F.lit(True))
    over = positions(large.where(F.col("size") > most), ["link"], F.pmod(F.xxhash64("id"), F.lit(BUCKETS)), [F.col("id")], "at")
    parts = F.ceil(F.col("size") / most)
    over = over.withColumn("part", F.pmod(F.col("at"), parts)).withColumn("size", F.floor((F.col("size") - F.col("part") + parts - 1) / parts).cast("long"))
    over = over.select("id", F.xxhash64("link", "part").alias("link"), "size", "hot")
    return cold.unionByName(large.where(F.col("size") <= most)).unionByName(over)


def cut_links(state: DataFrame) -> int:
    """How many edges (id, link, label, seated) lead out of the shard that most documents of their link have, unseated ones all."""
    votes = state.groupBy("link").agg(F.count("*").alias("n"))
    best = state.where("seated").groupBy("link", "label").agg(F.count("*").alias("c")).groupBy("link").agg(F.max("c").alias("c"))
    return votes.join(best, "link", "left").agg(F.coalesce(F.sum(F.col("n") - F.coalesce("c", F.lit(0))), F.lit(0))).first()[0]


def propagate(edges: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> tuple[DataFrame, list[int]]:
    """(id, label) of the documents that found a seat, and the cut edges after each round, which never rise.

    edges: as edge_table() gives them. The driver sees only each shard's load (one row a shard)."""
    spark, shards = edges.sparkSession, len(quotas)
    start = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(shards)).cast("int")
    state = checkpointed(edges.withColumn("label", start).withColumn("seated", F.lit(False)))
    cuts = [cut_links(state)]
    for r in range(rounds):
        held = {x[0]: x[1] for x in state.where("seated").groupBy("label").agg(F.count_distinct("id")).collect()}
        room = [q - held.get(k, 0) for k, q in enumerate(quotas)]
        rooms = F.broadcast(spark.createDataFrame(list(enumerate(room)), "label int, room long"))  # a row a shard
        votes = state.groupBy("link", "label").agg(F.count("*").alias("n"), F.count_if("seated").alias("here"), F.first("size").alias("size"), F.first("hot").alias("hot"))
        fits = votes.join(rooms, "label").withColumn("vote", F.when(F.col("size") - F.col("here") <= F.col("room"), F.struct("n", (-F.col("label")).alias("s"))))
        offers = fits.groupBy("link").agg(F.max("vote").alias("vote"), F.first("size").alias("size"), F.first("hot").alias("hot"))
        # where no shard of its documents has room, a link offers one of the roomiest, as its hash says
        wide = sorted(range(shards), key=lambda k: -room[k])[: max(1, shards // 4)]
        anywhere = F.array(*map(F.lit, wide))[F.pmod(F.xxhash64("link", F.lit(r)), F.lit(len(wide))).cast("int")]
        roomy = F.array(*map(F.lit, room))[anywhere] >= F.col("size")
        to = F.coalesce(-F.col("vote.s"), F.when(roomy, anywhere))
        offers = checkpointed(offers.select("link", "hot", to.alias("to"), F.coalesce("vote.n", F.lit(0)).alias("votes"), F.col("size").alias("whole")).where("to IS NOT NULL"))
        seen = state.where("hot").join(F.broadcast(offers.where("hot").drop("hot")), "link").unionByName(state.where("NOT hot").join(offers.where("NOT hot").drop("hot"), "link"))
        best = F.max(F.struct("votes", "whole", (-F.col("to")).alias("s"), "link")).alias("best")
        wish = seen.groupBy("id").agg(best, F.first("label").alias("label"), F.first("seated").alias("seated"))
        wish = wish.select("id", F.col("best.link").alias("by"), (-F.col("best.s")).alias("to"), "label", "seated").where("NOT seated OR to <> label")
        wish = checkpointed(wish)
        units = wish.groupBy("by", "to").agg(F.count("*").alias("movers"))
        units = units.withColumn("rank", -F.floor(F.log2("movers")).cast("int")).withColumn("hash", F.pmod(F.xxhash64("by", F.lit(r)), F.lit(CLASSES)).cast("int"))
        before = Window.partitionBy("to").orderBy("rank", "hash").rowsBetween(Window.unboundedPreceding, 0)
        loads = units.groupBy("to", "rank", "hash").agg(F.sum("movers").alias("load")).withColumn("load", F.sum("load").over(before))
        loads = loads.join(rooms.withColumnRenamed("label", "to"), "to").where("load <= room").select("to", "rank", "hash")
        taken = checkpointed(units.join(F.broadcast(loads), ["to", "rank", "hash"]).select("by", "to"))  # ranks x CLASSES a shard at most
        moves = checkpointed(wish.join(taken, ["by", "to"]).select("id", "to"))
        if moves.isEmpty():
            break
        next_ = state.join(moves, "id", "left").withColumn("label", F.coalesce("to", "label")).withColumn("seated", F.col("seated") | F.col("to").isNotNull()).drop("to")
        next_ = checkpointed(next_)
        cut = cut_links(next_)
        if cut > cuts[-1]:
            break
        state = next_
        cuts.append(cut)
    return state.where("seated").groupBy("id").agg(F.first("label").alias("label")), cuts


def assign(df: DataFrame, key: str, links: list[str], shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Add shard (0 to shards - 1) and slot (gapless from 0 in each shard); row counts differ by one at most.

    `links` are longs that neighbours share, null where there is none. Rows that share a link lie in
    one shard unless no shard has room for all of them. Rows are told apart by a number of their own:
    null keys and repeated rows are placed like others; an empty table gives an empty result."""
    docs = checkpointed(df.withColumn("__id", F.monotonically_increasing_id()))
    total = docs.count()
    quotas = [total // shards + (k < total % shards) for k in range(shards)]
    edges = checkpointed(edge_table(docs.select(F.col("__id").alias("id"), *links), links, max(1, quotas[0]), shards))
    seats, _ = propagate(edges, quotas, rounds)
    joined = checkpointed(docs.join(seats.select(F.col("id").alias("__id"), F.col("label").alias("shard")), "__id", "left"))
    held = {r[0]: r[1] for r in joined.where("shard IS NOT NULL").groupBy("shard").count().collect()}
    bounds, at = [], 0
    for k, q in enumerate(quotas):
        at += q - held.get(k, 0)
        bounds.append(at)
    free = joined.where("shard IS NULL").drop("shard")
    hashed = F.xxhash64(F.col(key), F.col("__id"))
    # rows that share a link lie in one bucket of the order, in 16 parts, so a hot one isn't a single task's
    first = F.coalesce(*map(F.col, links), hashed)
    grouped = F.pmod(F.xxhash64(first), F.lit(BUCKETS)) * 16 + F.pmod(hashed, F.lit(16))
    ranked = positions(free, [], grouped, [first, hashed], "__rank")
    shard = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b <= F.col("__rank"))).cast("int")
    filled = ranked.withColumn("shard", shard).drop("__rank")
    everything = joined.where("shard IS NOT NULL").unionByName(filled)
    return positions(everything, ["shard"], F.pmod(hashed, F.lit(BUCKETS)), [hashed, F.col("__id")], "slot").drop("__id")


def shard_by_text(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) with equal texts as neighbours.

    The law is `rows`. Size is the text's UTF-8 bytes plus 16, of a null text 16; its CRC-32 is that
    of an empty one. Texts are read once and not shuffled; only (key, size, checksum, hash) move."""
    filled = F.coalesce(F.col(text), F.lit(""))
    narrow = df.select(F.col(key), (F.octet_length(filled) + 16).cast("long").alias("size"), F.crc32(filled.cast("binary")).alias("text_crc32"), F.xxhash64(filled, F.octet_length(filled)).alias("__link"))
    placed = assign(narrow, key, ["__link"], shards)
    return placed.select(key, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
