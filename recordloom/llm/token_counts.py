"""Token counts that follow edits: a segment tree of pre-tokens per document.

The leaves of a tree are the pre-tokens of the text, with their characters and tokens; inner
nodes hold subtree sums. An edit finds its leaves by descending the sums, and only they, plus
the context that a boundary can depend on, are split and encoded again. A splitter that
looks ahead but never back gives the same boundaries again from any old boundary on, so work
stops where a new boundary meets an old one behind the edit.

Defined cases: a null or empty text has no leaves and no tokens and can be edited (null as
empty); edits apply one after the other, each to the text left by those before; positions are
clipped to that text and a null replacement deletes; null edits are none; repeated rows are
counted alike; extra columns are ignored.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import map_batches, read_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published splitter of byte-level BPE vocabularies of 50k entries.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters behind a boundary that may have decided it.
LOOKAHEAD = 2
BLOCK = 64
EDITS = "array<struct<start:long,stop:long,replacement:string>>"


class LeafCounter:
    """Splits text and counts tokens of pre-tokens, remembering those seen (bounded)."""

    def __init__(self, ranks: dict[bytes, int], splitter: str = SPLITTER, remember: int = 200_000):
        import regex
        import tiktoken

        self.pattern = regex.compile(splitter)
        self.encode = tiktoken.Encoding("counted", pat_str=splitter, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, int] = {}
        self.remember = remember

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encode(piece))
            if len(self.known) >= self.remember:
                self.known.clear()
            if len(piece) <= 64:
                self.known[piece] = n
        return n

    def leaves(self, text: str) -> tuple[list[int], list[int]]:
        pieces = self.pattern.findall(text)
        return list(map(len, pieces)), list(map(self.count, pieces))


class TokenTree:
    """Segment tree over blocks of leaves; ``chars`` and ``tokens`` are the subtree sums (root 1)."""

    def __init__(self, text: str, lengths: list[int], counts: list[int], counter: LeafCounter):
        self.text, self.counter, self.encoded = text, counter, 0
        self._build(lengths, counts)

    def _build(self, lengths: list[int], counts: list[int]) -> None:
        self.blocks = [[lengths[i : i + BLOCK], counts[i : i + BLOCK]] for i in range(0, len(lengths), BLOCK)] or [[[], []]]
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (a, b) in enumerate(self.blocks):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(a), sum(b)
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def leaf_arrays(self) -> tuple[list[int], list[int]]:
        return [x for b in self.blocks for x in b[0]], [x for b in self.blocks for x in b[1]]

    def _set(self, i: int, lengths: list[int], counts: list[int]) -> None:
        self.blocks[i] = [lengths, counts]
        at = self.width + i
        self.chars[at], self.tokens[at] = sum(lengths), sum(counts)
        while at > 1:
            at //= 2
            self.chars[at] = self.chars[2 * at] + self.chars[2 * at + 1]
            self.tokens[at] = self.tokens[2 * at] + self.tokens[2 * at + 1]

    def _find(self, position: int) -> tuple[int, int, int]:
        """(block, leaf, start of the leaf) that holds a character; the end of the text is in the last leaf's place."""
        if position >= self.chars[1]:
            i = len(self.blocks) - 1
            return i, len(self.blocks[i][0]), self.chars[1]
        at, start = 1, 0
        while at < self.width:
            at *= 2
            if position >= start + self.chars[at]:
                start += self.chars[at]
                at += 1
        i = at - self.width
        for j, n in enumerate(self.blocks[i][0]):
            if position < start + n:
                return i, j, start
            start += n
        raise AssertionError("sums and leaves differ")

    def edit(self, start: int, stop: int, replacement: str) -> None:
        size = len(self.text)
        start = min(max(0, start), size)
        stop = min(max(start, stop), size)
        # A leaf that ends LOOKAHEAD characters before the edit cannot change.
        first, leaf, begin = self._find(max(0, start - LOOKAHEAD))
        if leaf == 0 and begin and first:  # the leaf before may end right here
            first, leaf, begin = self._find(begin - 1)
        elif leaf:
            leaf -= 1
            begin -= self.blocks[first][0][leaf]
        self.text = self.text[:start] + replacement + self.text[stop:]
        shift = len(replacement) - (stop - start)
        lengths, counts = self.blocks[first][0][:leaf], self.blocks[first][1][:leaf]
        # Old boundaries behind the edit, in new positions.
        last, old_leaf, old = self._find(stop) if stop < size else (len(self.blocks) - 1, len(self.blocks[-1][0]), size)
        at, met = begin, begin == len(self.text)
        while not met:
            end = self.counter.pattern.match(self.text, at).end()
            lengths.append(end - at)
            counts.append(self.counter.count(self.text[at:end]))
            self.encoded += end - at
            at = end
            while old + shift < at and old < size:
                while old_leaf >= len(self.blocks[last][0]):
                    last, old_leaf = last + 1, 0
                old += self.blocks[last][0][old_leaf]
                old_leaf += 1
            met = at == len(self.text) or (at == old + shift and old >= stop)
        if at == len(self.text):
            last, old_leaf = len(self.blocks) - 1, len(self.blocks[-1][0])
        lengths += self.blocks[last][0][old_leaf:]
        counts += self.blocks[last][1][old_leaf:]
        for i in range(first + 1, last + 1):
            self._set(i, [], [])
        self._set(first, lengths, counts)
        if len(lengths) > 4 * BLOCK:
            self._build(*self.leaf_arrays())


def load_ranks(vocabulary: str = VOCABULARY) -> dict[bytes, int]:
    lines = read_bytes(vocabulary).splitlines()
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}


def build_trees(docs: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, splitter: str = SPLITTER) -> DataFrame:
    """(id, text, leaf_chars, leaf_tokens): the leaves of every document's tree, to be stored and edited later."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def task():
        counter = LeafCounter(ranks.value, splitter)

        def handle(columns):
            leaves = [counter.leaves(t.as_py()) for t in columns["text"]]
            yield {"id": columns["id"], "text": columns["text"], "leaf_chars": [x[0] for x in leaves], "leaf_tokens": [x[1] for x in leaves]}

        return handle

    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, f"id {kind}, text string, leaf_chars array<int>, leaf_tokens array<int>", task).withColumnRenamed("id", id_column)


def apply_edits(
    trees: DataFrame, id_column: str = "doc_id", edits: str = "edits", vocabulary: str = VOCABULARY, splitter: str = SPLITTER
) -> DataFrame:
    """(id, text, leaf_chars, leaf_tokens, n_tokens_before, n_tokens, n_edits, encoded_chars) after the edits of each row.

    ``trees`` is what ``build_trees`` or this function made, with a column of ``edits``
    (array of start, stop, replacement). ``encoded_chars`` counts the characters encoded again.
    Narrow: no row moves.
    """
    ranks = trees.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    rows = trees.select(F.col(id_column).alias("id"), "text", "leaf_chars", "leaf_tokens", F.col(edits).cast(EDITS).alias("edits"))

    def task():
        counter = LeafCounter(ranks.value, splitter)

        def handle(columns):
            found = [edited(*(x.as_py() for x in row), counter) for row in zip(*(columns[c] for c in ("text", "leaf_chars", "leaf_tokens", "edits")))]
            yield {"id": columns["id"]} | {n: [f[i] for f in found] for i, n in enumerate(_EDITED)}

        return handle

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens_before long, n_tokens long, n_edits long, encoded_chars long"
    return map_batches(rows, schema, task).withColumnRenamed("id", id_column)


_EDITED = ("text", "leaf_chars", "leaf_tokens", "n_tokens_before", "n_tokens", "n_edits", "encoded_chars")


def edited(text: str, lengths: list[int], counts: list[int], edits: list[dict] | None, counter: LeafCounter) -> tuple:
    """The columns of ``_EDITED`` for one tree and its edits."""
    if not edits:
        n = sum(counts)
        return text, lengths, counts, n, n, 0, 0
    tree = TokenTree(text, lengths, counts, counter)
    before = tree.tokens[1]
    for e in edits:
        if e is not None and e["start"] is not None:
            tree.edit(e["start"], e["start"] if e["stop"] is None else e["stop"], e["replacement"] or "")
    return (tree.text, *tree.leaf_arrays(), before, tree.tokens[1], len(edits), tree.encoded)


def masked_counts(
    docs: DataFrame, patterns: tuple[tuple[str, str], ...], id_column: str = "doc_id", text: str = "text",
    vocabulary: str = VOCABULARY, splitter: str = SPLITTER,
) -> DataFrame:
    """(id, n_chars, n_tokens_before, n_tokens, n_edits, encoded_chars): trees built, masked and dropped in one pass.

    The same as ``build_trees``, ``masking_edits`` and ``apply_edits`` in a row, where the trees
    need not be kept: one Python worker per task in place of three.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def task():
        counter = LeafCounter(ranks.value, splitter)
        spans = _mask_spans(patterns)

        def one(text):
            new, _, _, *numbers = edited(text, *counter.leaves(text), spans(text), counter)
            return len(new), *numbers

        def handle(columns):
            found = [one(t.as_py()) for t in columns["text"]]
            names = ("n_chars", *_EDITED[3:])
            yield {"id": columns["id"]} | {n: [f[i] for f in found] for i, n in enumerate(names)}

        return handle

    schema = f"id {kind}, n_chars long, n_tokens_before long, n_tokens long, n_edits long, encoded_chars long"
    return map_batches(rows, schema, task).withColumnRenamed("id", id_column)


def attach_edits(trees: DataFrame, edits: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Add the ``edits(id, seq, start, stop, replacement)`` of a table to their trees, in order of ``seq``."""
    lists = (
        edits.groupBy(id_column)
        .agg(F.sort_array(F.collect_list(F.struct("seq", "start", "stop", "replacement"))).alias("listed"))
        .select(F.col(id_column).alias("_edited"), F.transform("listed", lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["replacement"].alias("replacement"))).alias("edits"))
    )
    return trees.join(lists, trees[id_column].eqNullSafe(lists["_edited"]), "left").drop("_edited")


def masking_edits(rows: DataFrame, patterns: tuple[tuple[str, str], ...], column: str = "text") -> DataFrame:
    """Add ``edits`` that replace every match of the patterns, last match first so that positions hold.

    Where matches overlap, the one that starts first is kept, then the one of the earlier pattern.
    """
    inner = rows.select(*[F.col(c) for c in rows.columns])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", edits {EDITS}"

    def task():
        spans = _mask_spans(patterns)

        def handle(columns):
            yield columns | {"edits": [spans(t.as_py()) for t in columns[column]]}

        return handle

    return map_batches(inner, schema, task)


def _mask_spans(patterns: tuple[tuple[str, str], ...]):
    """A function from a text to its masking edits, last first."""
    import re

    compiled = [(re.compile(p), r) for p, r in patterns]

    def spans(text):
        found = sorted((m.start(), i, m.end()) for i, (p, _) in enumerate(compiled) for m in p.finditer(text or "") if m.end() > m.start())
        kept, end = [], 0
        for start, i, stop in found:
            if start >= end:
                kept.append({"start": start, "stop": stop, "replacement": compiled[i][1]})
                end = stop
        return kept[::-1]

    return spans
