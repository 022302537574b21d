"""Repair of conversation structure by least-cost edits and prefix-doubling path ranking.

A repaired conversation is ``(s?(ua)+)?`` in the initials of its roles. The cost DP runs over
(row, state) nodes, states being "nothing yet", "system", "user" and "assistant"; an arc deletes,
inserts, keeps or reroles. Among the optimal arcs, nodes are ranked by the first 1, 2, 4, ... edits
of the least audit that begins there, each round from the ranks of half the length, and each
node's pointer is doubled alongside. The ranks choose every node's arc, and the doubled pointers
list the path. Edits of one node have different initials, so the choice at a node
never depends on what lies behind a block's end.

Conversations of any length are cut into blocks of rows. A block is a min-plus matrix over the
states; products over the blocks behind it are found by doubling, and so are the states in which
blocks are entered. Texts move once, for the digest, which streams through them in order.

Defined cases: null roles and texts are one space; rows are ordered by turn, nulls first, equal
turns by the digest of role and text; rows without conv_id are one conversation, returned as null
(it shares the number -2^63); repeated rows are duplicates; a conversation of which no row is left
has zeros, an empty audit and the digest of nothing; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import SPACE_CLASS, map_batches, stored
from recordloom.llm.turns import numbered, turn_key
from recordloom.session import cut_lineage, spread

BLOCK_ROWS = 512
_FAR = 1 << 40
# Where a user or assistant turn leads from each state (nothing, system, user, assistant).
_AHEAD = np.array([2, 2, 3, 2])
_ACCEPT = [0, 10, 5, 0]
# Edits in the order of their initials; 0 is the end.
_EDITS = " DIKR"
_ROLES = {2: "user", 3: "assistant"}
BLANK, DUPLICATE, TRUNCATED = 4, 8, 16
_NO_ID = -(2**63)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by a hash of id and turn: dropped, emptied, unpunctuated, repeated or made user turns."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    chance = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), chance.alias("chance")).filter("chance <> 0")
    text = F.when(F.col("chance") == 1, "").when(F.col("chance") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("chance") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("chance") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _row_code(role: Column, text: Column) -> Column:
    """Role class (s 1, u 2, a 3, else 0) and the faults that a row shows by itself."""
    initial = F.substring(role, 1, 1)
    kind = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    blank = ~text.rlike(r"[^\x09-\x0D ]")
    ended = text.rlike(rf"[.!?]{SPACE_CLASS}*\z")
    return (kind + F.when(blank, BLANK).when(~ended, TRUNCATED).otherwise(0)).cast("int")


def _step(code: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Costs of (delete, keep, rerole) per state, before a row of that code, given the costs behind it."""
    kind, late = code & 3, np.where(code & TRUNCATED, 5, 0)[:, None]
    ahead = behind[:, _AHEAD]
    keep = np.full_like(behind, _FAR)
    user, assistant, system = kind == 2, kind == 3, kind == 1
    keep[user] = np.where(_AHEAD == 2, ahead[user], _FAR)
    keep[assistant] = np.where(_AHEAD == 3, ahead[assistant], _FAR)
    keep[system, 0] = behind[system, 1]
    fixed = (code & (BLANK | DUPLICATE) > 0)[:, None]
    return np.stack([behind + 2, np.where(fixed, _FAR, keep + late), np.where(fixed, _FAR, ahead + 1 + late)])


def _closed(cost: np.ndarray) -> np.ndarray:
    """Costs once turns may be inserted first."""
    out = cost.copy()
    out[:, 2], out[:, 3] = np.minimum(cost[:, 2], cost[:, 3] + 5), np.minimum(cost[:, 3], cost[:, 2] + 5)
    out[:, :2] = np.minimum(cost[:, :2], out[:, 2:3] + 5)
    return out


def block_costs(codes: np.ndarray, sizes: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Least cost [block, row, state] to each block's end, whose costs are ``tails``; longest blocks first."""
    costs = np.full((len(sizes), codes.shape[1] + 1, 4), _FAR, dtype=np.int64)
    costs[np.arange(len(sizes)), sizes] = tails
    for at in range(codes.shape[1] - 1, -1, -1):
        n = int(np.searchsorted(-sizes, -at, side="left"))  # blocks with more rows than that
        costs[:n, at] = _closed(_step(codes[:n, at], costs[:n, at + 1]).min(axis=0))
    return costs


def least_paths(codes: np.ndarray, sizes: np.ndarray, costs: np.ndarray, last: np.ndarray, entries: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Edits [block, entry, step] of the ASCII-least cheapest paths (0 behind the end), and states [block, entry] at their ends."""
    count, rows, _ = costs.shape
    node = np.arange(count * rows * 4, dtype=np.int64).reshape(count, rows, 4)
    behind = np.full_like(costs, _FAR)
    behind[:, :-1] = costs[:, 1:]
    flat = np.zeros((count, rows), dtype=codes.dtype)
    flat[:, :-1] = codes
    delete, keep, rerole = (x.reshape(costs.shape) for x in _step(flat.ravel(), behind.reshape(-1, 4)))
    here = np.arange(rows)[None, :, None]
    inside, final = here < sizes[:, None, None], (here == sizes[:, None, None]) & last[:, None, None]
    insert = np.where(inside | final, costs[:, :, _AHEAD] + 5, _FAR)
    below = np.concatenate([node[:, 1:], node[:, -1:]], axis=1)
    kept = np.where((flat & 3 == 1)[:, :, None] & (np.arange(4) == 0), below[:, :, 1:2], below[:, :, _AHEAD])
    spent = np.stack([np.where(inside, delete, _FAR), insert, np.where(inside, keep, _FAR), np.where(inside, rerole, _FAR)])
    target = np.stack([below, node[:, :, _AHEAD], kept, below[:, :, _AHEAD]]).reshape(4, -1)
    optimal = (spent == costs) & (costs < _FAR)
    # Neither end of a finished conversation asks for more.
    optimal = optimal.reshape(4, -1)
    first = np.where(optimal.any(axis=0), optimal.argmax(axis=0) + 1, 0)
    everyone = np.arange(first.size)
    pointer = np.where(first > 0, target[np.maximum(first - 1, 0), everyone], everyone)
    rank, jumps = first, [pointer]
    while (first[jumps[-1]] > 0).any():
        _, rank = np.unique(rank * (rank.max() + 1) + rank[jumps[-1]], return_inverse=True)
        jumps.append(jumps[-1][jumps[-1]])
    # The arc of least initial, then of least rank behind it.
    order = np.where(optimal, np.arange(1, 5)[:, None] * (int(rank.max(initial=0)) + 1) + rank[target], np.iinfo(np.int64).max)
    chosen = np.where(first > 0, order.argmin(axis=0) + 1, 0)
    jumps[0] = np.where(first > 0, target[order.argmin(axis=0), everyone], everyone)
    path = node[:, 0, entries][:, :, None]
    for jump in reversed(jumps):
        path = np.stack([path, jump[path]], axis=-1).reshape(count, len(entries), -1)
    return chosen[path], path[:, :, -1] % 4


def _in_classes(codes: list, tails: np.ndarray, last: np.ndarray):
    """Blocks of a batch by powers of two of their length, so that padding stays small: (rows, codes, sizes, tails, last)."""
    sizes = np.array([len(c) for c in codes], dtype=np.int64)
    power = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
    for p in np.unique(power):
        some = np.nonzero(power == p)[0]
        some = some[np.argsort(-sizes[some], kind="stable")]
        step = max(1, 65_536 >> int(p))
        for at in range(0, len(some), step):
            part = some[at : at + step]
            table = np.zeros((len(part), int(sizes[part].max())), dtype=np.int32)
            for row, i in zip(table, part):
                row[: sizes[i]] = codes[i]
            yield part, table, sizes[part], tails[part], last[part]


def _matrices(blocks: DataFrame) -> DataFrame:
    """(conv_id, block, m): least cost from each state before a block to each state behind it, row by row."""

    def task():
        def handle(columns):
            codes = [np.asarray(c.values) for c in columns["codes"]]
            out = np.zeros((len(codes), 4, 4), dtype=np.int64)
            for state in range(4):
                unit = np.where(np.arange(4) == state, 0, _FAR)
                for part, table, sizes, tails, _ in _in_classes(codes, np.tile(unit, (len(codes), 1)), np.zeros(len(codes), dtype=bool)):
                    out[part, :, state] = block_costs(table, sizes, tails)[:, 0]
            yield {"conv_id": columns["conv_id"], "block": columns["block"], "m": out.reshape(len(codes), 16).tolist()}

        return handle

    return map_batches(blocks.select("conv_id", "block", "codes"), "conv_id long, block long, m array<long>", task)


def _scan(rows: DataFrame, value: str, most: int, ahead: bool, combine) -> DataFrame:
    """Each block's ``value`` combined with those of all blocks behind it (``ahead``) or before it, by doubled steps."""
    step = 1
    while step < most:
        shift = F.col("block") - step if ahead else F.col("block") + step
        other = rows.select("conv_id", shift.alias("block"), F.col(value).alias("_other"))
        rows = rows.join(other, ["conv_id", "block"], "left").withColumn(value, F.when(F.col("_other").isNull(), F.col(value)).otherwise(combine(F.col(value), F.col("_other"))))
        rows = cut_lineage(rows.drop("_other"))
        step *= 2
    return rows


def _product(a: Column, b: Column) -> Column:
    """Min-plus product of two 4 x 4 matrices given row by row."""
    cells = F.sequence(F.lit(0), F.lit(15))
    through = lambda c: F.array_min(F.array(*[F.get(a, F.floor(c / 4).cast("int") * 4 + k) + F.get(b, c % 4 + 4 * k) for k in range(4)]))
    return F.transform(cells, lambda c: F.least(through(c), F.lit(_FAR)))


def _solved(blocks: DataFrame) -> DataFrame:
    """Per block of ``blocks(conv_id, block, codes, over, tail, long)``: counts, and costs, end states and audits by entry state."""
    schema = "conv_id long, block long, blank long, duplicate long, truncated long, illegal long, costs array<long>, exits array<int>, audits array<string>"

    def task():
        letters = np.frombuffer(_EDITS.encode(), dtype=np.uint8)

        def handle(columns):
            codes = [np.asarray(c.values) for c in columns["codes"]]
            tails = np.array(columns["tail"].to_pylist(), dtype=np.int64).reshape(len(codes), 4)
            over = columns["over"].to_pylist()
            last = np.array([o is None for o in over], dtype=bool)
            long = columns["long"].to_numpy(zero_copy_only=False)
            costs, exits, audits = ([None] * len(codes) for _ in range(3))
            for part, table, sizes, ends, closing in _in_classes(codes, tails, last):
                for several in (False, True):
                    mine = long[part] == several
                    if mine.any():
                        cost = block_costs(table[mine], sizes[mine], ends[mine])
                        edits, states = least_paths(table[mine], sizes[mine], cost, closing[mine], [0, 1, 2, 3] if several else [0])
                        for i, c, e, s in zip(part[mine], cost[:, 0], edits, states):
                            costs[i], exits[i] = c.tolist(), s.tolist()
                            audits[i] = [letters[x[x > 0]].tobytes().decode() for x in e]
            bit = lambda b: [int((c & b > 0).sum()) for c in codes]
            illegal = []
            for c, o in zip(codes, over):
                kinds = np.append(c, [] if o is None else [o]).astype(int) & 3
                pairs = kinds[:-1] * 4 + kinds[1:]
                illegal.append(len(pairs) - int(np.isin(pairs, (6, 11, 14)).sum()))
            yield {
                "conv_id": columns["conv_id"], "block": columns["block"], "blank": bit(BLANK), "duplicate": bit(DUPLICATE), "truncated": bit(TRUNCATED),
                "illegal": illegal, "costs": costs, "exits": exits, "audits": audits,
            }

        return handle

    return map_batches(blocks.select("conv_id", "block", "codes", "over", "tail", "long"), schema, task)


def _pieces(audits: DataFrame, block: int) -> DataFrame:
    """(conv_id, pos, lead, role) of kept and inserted turns from ``audits(conv_id, block, audit, entry)``.

    ``lead`` joins the turns inserted before a row; role is null if the row goes, empty if it
    stays as it is, or its new role. Turns inserted at the very end lead a row that is none.
    """

    def task():
        def handle(columns):
            out = {"conv_id": [], "pos": [], "lead": [], "role": []}
            kinds = columns["kinds"]
            for conv, at, audit, state, kind in zip(*(columns[c].to_pylist() for c in ("conv_id", "block", "audit", "entry")), kinds):
                pos, lead, kind = at * block, [], np.asarray(kind.values) & 3
                for edit in audit:
                    if edit == "D":
                        role = None
                    elif edit == "K":
                        k = kind[pos - at * block]
                        state, role = (1 if k == 1 else int(_AHEAD[state])), ""
                    else:
                        state = int(_AHEAD[state])
                        role = _ROLES[state]
                    if edit == "I":
                        lead.append(role + ":")
                        continue
                    if lead or role is not None:
                        for name, value in zip(out, (conv, pos, "\n".join(lead) if lead else None, role)):
                            out[name].append(value)
                    pos, lead = pos + 1, []
                if lead:
                    for name, value in zip(out, (conv, pos, "\n".join(lead), None)):
                        out[name].append(value)
            yield out

        return handle

    return map_batches(audits.select("conv_id", "block", "audit", "entry", F.col("codes").alias("kinds")), "conv_id long, pos long, lead string, role string", task)


def _digests(places: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the repaired turns: edits ``places(conv_id, tail, turn, key, lead, role)`` meet the texts of ``rows`` in sorted order."""
    edits = places.select("conv_id", "tail", "turn", "key", F.lit(0).alias("kind"), "lead", F.col("role").alias("new_role"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    nothing = F.lit(None).cast("string")
    texts = rows.select("conv_id", F.lit(False).alias("tail"), "turn", "key", F.lit(1).alias("kind"), nothing.alias("lead"), nothing.alias("new_role"), "role", "text")
    order = ["conv_id", "tail", "turn", "key", "kind"]
    ordered = spread(edits.unionByName(texts), "conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "key", "kind", "lead", "new_role", "role", "text")
    target = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches):
        current, digest, begun, waiting = None, None, False, None

        def add(piece):
            nonlocal begun
            digest.update(("\n" + piece if begun else piece).encode("utf-8", "replace"))
            begun = True

        for batch in batches:
            ids, digests = [], []
            for conv, turn, key, kind, lead, new_role, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != current or digest is None:
                    if digest is not None:
                        ids.append(current)
                        digests.append(digest.hexdigest())
                    current, digest, begun, waiting = conv, hashlib.sha256(), False, None
                if kind == 0:
                    if lead is not None:
                        add(lead)
                    if new_role is not None:
                        waiting = (turn, key, new_role)
                elif waiting is not None and waiting[:2] == (turn, key):
                    add(f"{waiting[2] or role}:{text}")
                    waiting = None
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], schema=target)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([digest.hexdigest()], pa.string())], schema=target)

    return ordered.mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame, convs: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Per id of ``convs``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows(conv_id, turn, role, text)`` without null roles or texts.
    """
    filled = F.coalesce("conv_id", F.lit(_NO_ID).cast("long")).alias("conv_id")
    rows = rows.select(filled, F.col("turn").cast("long").alias("turn"), "role", "text", turn_key(F.col("role"), F.col("text")).alias("key"))
    placed = numbered(rows.select("conv_id", "turn", "key", _row_code(F.col("role"), F.col("text")).alias("code")), "conv_id", ["turn", "key"])
    firsts = placed.groupBy("conv_id", "key").agg(F.min("pos").alias("pos")).select("conv_id", "pos", F.lit(True).alias("is_first"))
    again = (F.col("code").bitwiseAND(F.lit(BLANK)) == 0) & F.col("is_first").isNull()
    code = F.when(again, F.col("code").bitwiseAND(F.lit(3)) + DUPLICATE).otherwise(F.col("code"))
    placed = stored(placed.join(firsts, ["conv_id", "pos"], "left").withColumn("code", code).drop("is_first"))

    # A block also sees the row behind it, as that ends its last pair of roles.
    at = F.floor(F.col("pos") / block)
    seen_by = F.when((F.col("pos") % block == 0) & (F.col("pos") > 0), F.array(at, at - 1)).otherwise(F.array(at))
    dealt = placed.select("conv_id", "pos", "code", F.explode(seen_by).alias("block"))
    listed = dealt.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("rows"))
    codes = F.transform("rows", lambda r: r["code"])
    blocks = listed.select("conv_id", "block", F.slice(codes, 1, block).alias("codes"), F.get(codes, F.lit(block)).alias("over"))
    blocks = stored(blocks.withColumn("long", (F.col("block") > 0) | F.col("over").isNotNull()))
    most = (blocks.agg(F.max("block")).first()[0] or 0) + 1

    accept = F.array(*[F.lit(x).cast("long") for x in _ACCEPT])
    if most > 1:
        behind = _scan(_matrices(blocks.filter("long")), "m", most, True, _product)
        cost = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.array_min(F.array(*[F.get("m", s * 4 + k) + _ACCEPT[k] for k in range(4)])))
        tails = behind.select("conv_id", (F.col("block") - 1).alias("block"), cost.alias("tail"))
        blocks = blocks.join(tails, ["conv_id", "block"], "left").withColumn("tail", F.coalesce("tail", accept))
    else:
        blocks = blocks.withColumn("tail", accept)
    solved = stored(_solved(blocks))
    if most > 1:
        # A block's own map is applied to what the blocks before it lead to.
        led = _scan(solved.filter(F.size("exits") == 4).select("conv_id", "block", "exits"), "exits", most, False, lambda own, earlier: F.transform(earlier, lambda s: F.get(own, s)))
        entry = led.select("conv_id", (F.col("block") + 1).alias("block"), F.get("exits", F.lit(0)).alias("entry"))
        solved = solved.join(entry, ["conv_id", "block"], "left").withColumn("entry", F.coalesce("entry", F.lit(0)))
    else:
        solved = solved.withColumn("entry", F.lit(0))
    solved = stored(solved.withColumn("audit", F.get("audits", F.col("entry"))))

    places = _pieces(solved.select("conv_id", "block", "audit", "entry").join(blocks.select("conv_id", "block", "codes"), ["conv_id", "block"]), block)
    edits = places.join(placed.select("conv_id", "pos", "turn", "key"), ["conv_id", "pos"], "left").withColumn("tail", F.col("key").isNull())
    digests = _digests(edits, rows.select("conv_id", "turn", "key", "role", "text"))

    counts = ["blank", "duplicate", "truncated", "illegal"]
    whole = solved.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in counts], F.sum(F.when(F.col("block") == 0, F.get("costs", F.lit(0)))).alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda b: b["audit"]), "").alias("audit"),
    )
    gaps = placed.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))
    found = convs.select(filled).distinct().join(gaps, "conv_id", "left").join(whole, "conv_id", "left").join(digests, "conv_id", "left")
    return found.select(
        F.when(F.col("conv_id") != _NO_ID, F.col("conv_id")).alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *counts, "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"),
    )
