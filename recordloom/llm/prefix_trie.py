"""Prefix trie of conversations by cutting depths in half, as in van Emde Boas layouts.

Turns are cut into blocks of a fixed depth. Blocks are named bottom-up: two neighbouring names
make the name of their union, so a cut sequence of 2^k blocks is named in k rounds. Going down
again, a piece of depth 2^k is cut at half depth: its upper half keeps the prefix it hangs from,
its lower half hangs from that prefix extended by the upper half's name, and all pieces of a
level recurse at once. Inside a block names follow turn by turn. Equal prefixes have equal names,
so nodes are groups of names.

Totals go the same way. A node is counted in the pieces of its smallest member: first inside
blocks, then level by level what hangs below a cut is grafted onto the cut's prefix and its
ancestors in the upper half. A node thus meets log2(depth) half pieces, not all its ancestors.

Defined cases: a null conv_id takes no part; null roles and texts are empty; turns are ordered
nulls first, equal turns by the digest of role and text; repeated rows are turns of their own;
a conversation without turns is a member of the root; an empty table gives no node; extra columns
are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import stored
from recordloom.llm.turns import joined_digests, numbered, short_digest, turn_key
from recordloom.session import cut_lineage

BLOCK_TURNS = 32
# Ids of one number range are joined before they are hashed; a range has at most as many ids as numbers.
ID_RANGE = 4096
NODE_SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _root() -> Column:
    """The name of the empty prefix."""
    return F.lit(b"")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, key, bytes): turns in order, each (role, text) by its name."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", turn_key(role, text).alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    return numbered(rows, "conv_id", ["turn", "key"]).drop("turn")


def rebuilt_turns(turns: DataFrame, family: int = 5, spread_of: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) in which every conversation begins like the first of its family.

    A conversation takes the first h turns of its family's first (all if fewer), then its own
    after its first h; h is the CRC of its id modulo ``spread_of``.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % spread_of).cast("long")
    convs = sizes.select("conv_id", head.alias("head"), (F.col("conv_id") - F.col("conv_id") % family).alias("first"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("first"), F.col("n").alias("first_n")), "first", "left")
    convs = cut_lineage(convs.withColumn("taken", F.least("head", F.coalesce("first_n", F.lit(0)))))
    own = turns.join(convs.select("conv_id", "head", "taken"), "conv_id").filter("pos >= head").withColumn("pos", F.col("taken") + F.col("pos") - F.col("head"))
    begin = turns.filter(F.col("pos") < spread_of).withColumnRenamed("conv_id", "first")
    lent = begin.join(convs.select("conv_id", "first", "taken"), "first").filter("pos < taken")
    columns = ["conv_id", "pos", "key", "bytes"]
    return own.select(columns).unionByName(lent.select(columns)), convs.select("conv_id")


def _extended(prefix: Column, name: Column) -> Column:
    return short_digest(prefix, F.lit("+"), name)


def _block_names(blocks: DataFrame, block: int) -> tuple[list[DataFrame], int]:
    """Names of runs of 1, 2, 4... full blocks, (conv_id, i, name) per level, and the levels of the recursion."""
    full = blocks.filter(F.size("turns") == block)
    digest = F.aggregate("turns", F.lit(b""), lambda name, t: _extended(name, t["key"]))
    names = [cut_lineage(full.select("conv_id", F.col("block").alias("i"), digest.alias("name")))]
    most = names[0].agg(F.max("i")).first()[0]
    levels = 0 if most is None else (most + 1).bit_length()
    for _ in range(levels - 1):
        half = names[-1].groupBy("conv_id", F.floor(F.col("i") / 2).alias("i")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("left"), F.max(F.when(F.col("i") % 2 == 1, F.col("name"))).alias("right")
        )
        names.append(cut_lineage(half.dropna().select("conv_id", "i", _extended(F.col("left"), F.col("right")).alias("name"))))
    return names, levels


def _borders(blocks: DataFrame, names: list[DataFrame], levels: int) -> DataFrame:
    """(conv_id, block, start, end): names of the prefixes before each block and, where it is full, behind it.

    Only for conversations with a full block; the others have one block, which starts at the root.
    """
    long = names[0].filter("i = 0").select("conv_id")
    sizes = blocks.groupBy("conv_id").agg((F.max("block") + 1).alias("blocks")).join(long, "conv_id")
    pieces = sizes.select("conv_id", F.lit(0).cast("long").alias("i"), _root().alias("start"), F.lit(None).cast("binary").alias("end"), "blocks")
    for level in range(levels, 0, -1):
        upper = names[level - 1].filter("i % 2 = 0").select("conv_id", F.floor(F.col("i") / 2).alias("i"), "name")
        cut = pieces.join(upper, ["conv_id", "i"], "left").withColumn("middle", F.when(F.col("name").isNotNull(), _extended(F.col("start"), F.col("name"))))
        first = F.struct((2 * F.col("i")).alias("i"), F.col("start").alias("start"), F.col("middle").alias("end"))
        second = F.struct((2 * F.col("i") + 1).alias("i"), F.col("middle").alias("start"), F.col("end").alias("end"))
        halves = cut.select("conv_id", "blocks", F.explode(F.array(first, second)).alias("h")).select("conv_id", "h.*", "blocks")
        pieces = halves.filter(F.col("i") * (1 << (level - 1)) < F.col("blocks"))
    return pieces.select("conv_id", F.col("i").alias("block"), "start", "end")


def _paths(turns: DataFrame, block: int) -> tuple[DataFrame, int]:
    """(conv_id, block, chain, bytes): names of the prefixes of every block, that before it first; and the levels."""
    cut = turns.groupBy("conv_id", F.floor(F.col("pos") / block).alias("block"))
    blocks = stored(cut.agg(F.array_sort(F.collect_list(F.struct("pos", "key", "bytes"))).alias("turns")))
    names, levels = _block_names(blocks, block)
    if levels:
        rows = blocks.join(_borders(blocks, names, levels), ["conv_id", "block"], "left")
    else:
        rows = blocks.select("*", F.lit(None).cast("binary").alias("start"), F.lit(None).cast("binary").alias("end"))
    start = F.array(F.coalesce("start", _root()))
    chain = F.aggregate("turns", start, lambda done, t: F.concat(done, F.array(_extended(F.element_at(done, -1), t["key"]))))
    # A full block ends in the prefix that the next one hangs from.
    closed = F.when((F.size("turns") == block) & F.col("end").isNotNull(), F.concat(F.slice("chain", 1, block), F.array("end"))).otherwise(F.col("chain"))
    return stored(rows.withColumn("chain", chain).select("conv_id", "block", closed.alias("chain"), F.col("turns.bytes").alias("bytes"))), levels


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK_TURNS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns(conv_id, pos, key, bytes)`` numbers the turns of a conversation from 0; ``convs(conv_id)``
    has every conversation. conv_id is a node's smallest member.
    """
    paths, levels = _paths(turns, block)
    steps = F.arrays_zip(F.slice("chain", 2, block).alias("name"), F.slice("chain", 1, F.size("bytes")).alias("parent"), F.col("bytes").alias("bytes"))
    members = paths.select("conv_id", "block", F.posexplode(steps)).select("conv_id", (F.col("block") * block + F.col("pos") + 1).alias("depth"), "col.*")
    nodes = members.groupBy("name").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("bytes").alias("bytes")
    )
    children = nodes.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))

    totals = _totals(nodes, paths, levels, block)
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).first()
    if not root["n_convs"]:
        return turns.sparkSession.createDataFrame([], NODE_SCHEMA)
    top = nodes.filter("depth = 1").select("name").join(totals, "name").agg(F.count("*").alias("n"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    trunk = top.select(
        _root().alias("name"), F.lit(root["conv_id"]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(root["n_convs"]).cast("long").alias("n_convs"), F.col("n").alias("n_children"),
        F.when(F.col("n") == 0, 1).otherwise(F.col("leaves")).cast("long").alias("leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved"),
    )
    parents = nodes.filter("n_children > 0").select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.join(totals, "name")
    columns = trunk.columns
    first = below.filter("depth = 1").withColumn("parent_conv_id", F.lit(root["conv_id"]).cast("long"))
    deeper = below.filter("depth > 1").join(parents, "parent")
    every = trunk.unionByName(first.select(columns)).unionByName(deeper.select(columns))

    last = paths.groupBy("conv_id").agg(F.max(F.struct("block", F.element_at("chain", -1).alias("name")))["name"].alias("name"))
    ends = convs.join(last, "conv_id", "left").withColumn("name", F.coalesce("name", _root()))
    chunks = ends.groupBy("name", F.floor(F.col("conv_id") / ID_RANGE).alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    digests = joined_digests(chunks, "name", ["chunk"], "ids", ",")
    return every.join(digests, "name", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )


def _totals(nodes: DataFrame, paths: DataFrame, levels: int, block: int) -> DataFrame:
    """(name, leaves, saved): sums over the subtree of every node."""
    own = F.struct(
        (F.pmod(F.col("depth") - 1, F.lit(block)) + 1).cast("int").alias("slot"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )
    # A conversation is the smallest member of one node a depth at most.
    held = nodes.groupBy("conv_id", F.floor((F.col("depth") - 1) / block).alias("block")).agg(F.collect_list(own).alias("own"))
    rows = paths.join(held, ["conv_id", "block"])

    def summed(field: str, slot: Column) -> Column:
        return F.aggregate(F.filter("own", lambda x: x["slot"] >= slot), F.lit(0).cast("long"), lambda total, x: total + x[field])

    slots = F.sequence(F.lit(1), F.array_max(F.transform("own", lambda x: x["slot"])))
    entries = F.transform(slots, lambda s: F.struct(
        F.element_at("chain", s + 1).alias("name"), F.element_at("chain", s).alias("parent"), (F.col("block") * block + s).alias("depth"),
        summed("leaves", s).alias("leaves"), summed("saved", s).alias("saved"),
    ))
    amounts = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    inside = rows.select(F.explode(entries).alias("e")).select("e.*")
    parts = [cut_lineage(inside.groupBy("name", "parent", "depth").agg(*amounts))]
    for level in range(1, levels + 1):
        # Trees that hang below the cuts of this level, summed by the prefix they hang from.
        half = 1 << (level - 1)
        at = F.floor((F.col("depth") - 1) / block)
        hanging = reduce(DataFrame.unionByName, parts).filter(((F.col("depth") - 1) % block == 0) & (at % (2 * half) == half))
        cut = hanging.groupBy(F.col("parent").alias("name")).agg(*amounts, F.min(at).alias("middle"))
        owners = nodes.filter((F.col("depth") % block == 0) & (F.floor(F.col("depth") / block) % (2 * half) == half)).select("name", "conv_id")
        upper = cut.join(owners, "name").select("conv_id", "leaves", "saved", F.explode(F.sequence(F.col("middle") - half, F.col("middle") - 1)).alias("block"))
        slots = F.sequence(F.lit(1), F.size("chain") - 1)
        chained = F.transform(slots, lambda s: F.struct(F.element_at("chain", s + 1).alias("name"), F.element_at("chain", s).alias("parent"), (F.col("block") * block + s).alias("depth")))
        grafted = paths.join(upper, ["conv_id", "block"]).select(F.explode(chained).alias("e"), "leaves", "saved").select("e.*", "leaves", "saved")
        parts.append(cut_lineage(grafted.groupBy("name", "parent", "depth").agg(*amounts)))
    return reduce(DataFrame.unionByName, parts).groupBy("name").agg(*amounts)
