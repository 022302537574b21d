"""Language-model scores from a probabilistic suffix tree.

States are contexts of up to ``depth`` preceding words, or the beginning of a text. Words seen
``min_count`` times in training are symbols of their own, all others share the symbol "rare"; a
context is a candidate if it consists of symbols other than "rare" and is seen ``min_count``
times, so what is gathered grows with the corpus. A candidate is retained if its next-symbol
distribution diverges from that of its suffix by more than chance: what follows it, each time
predicted from its other occurrences, must be likelier than by the suffix, by more than the
logarithm of its count in log likelihood. (Divergence of the plain counts would retain a context
followed by different words at random.) Suffixes of retained contexts are retained as well.
Next-symbol distributions are smoothed into those of the suffix in proportion to the number of
different next symbols (Witten and Bell); the root adds one. The probability of a token is that
of its symbol after the longest retained suffix of what precedes it, times, for a rare word, its
share (plus one) of the rare words of the corpus, of which one is unseen.

Counts of (context, symbol) and of rare words stay distributed. What tasks get is the keys of
words and contexts, eight bytes each. Where over MAX_PLACES reach ``min_count``, nothing is sent:
the same model is counted and applied by joins of token rows alone (``joined_scores``).
A text is scored by joining its tokens with the tables. Where a pair may be
unseen (texts not trained on), the log probability is a sum over the lengths of context: root,
then what each longer context adds if it has seen the symbol, and its back-off weight.

Defined cases: a null text is empty and scores its end token; a null id is trained on; rows of
one id and text are scored once and repeated; empty training data leave the root with the end
token unseen; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import lower_words, map_batches, stored

CHUNK_CHARS = 4_000_000
# Neither can be a word, as both contain blanks.
END, BEGIN = b" ", b"  "


def is_held_out(id_column: Column, modulus: int = 7, rest: int = 2) -> Column:
    text = F.coalesce(id_column.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus == rest


def word_number(word: bytes) -> int:
    import xxhash

    value = xxhash.xxh64_intdigest(word)
    return value - (1 << 64) if value >> 63 else value


class Chunk:
    """Tokens of some texts as numbers: ``ids`` into ``words`` (64-bit hashes), with their preceding tokens."""

    def __init__(self, texts: list[str | None]):
        import xxhash

        tokens: list[bytes] = []
        sizes = []
        for text in texts:
            words = lower_words(text)
            words.append(END)
            sizes.append(len(words))
            tokens += words
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(tokens))}
        self.ids = np.fromiter(map(vocabulary.__getitem__, tokens), np.int64, len(tokens))
        digest = xxhash.xxh64_intdigest
        # The last entry is the begin mark, which precedes each first token.
        self.words = np.array([digest(w) for w in vocabulary] + [digest(BEGIN)], dtype=np.uint64).view(np.int64)
        self.sizes = np.array(sizes, dtype=np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.row = np.repeat(np.arange(len(sizes)), self.sizes)


def _chunks(columns: dict, text: str = "text"):
    texts = columns[text].to_pylist()
    start, chars = 0, 0
    for at, t in enumerate(texts):
        n = len(t or "")
        if at > start and chars + n > CHUNK_CHARS:
            yield start, at, texts[start:at]
            start, chars = at, 0
        chars += n
    if texts:
        yield start, len(texts), texts[start:]


def places_in(sorted_numbers: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted number in a sorted array, -1 if it isn't there."""
    if not len(sorted_numbers):
        return np.full(len(wanted), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(sorted_numbers, wanted), len(sorted_numbers) - 1)
    return np.where(sorted_numbers[at] == wanted, at, -1)


def word_counts(train: DataFrame) -> DataFrame:
    """(w, c): occurrences of every word, summed per chunk in the task, then over all."""

    def task():
        def handle(columns):
            for _, _, texts in _chunks(columns):
                chunk = Chunk(texts)
                yield {"w": chunk.words[:-1], "c": np.bincount(chunk.ids, minlength=len(chunk.words) - 1)}

        return handle

    return map_batches(train.select("text"), "w long, c long", task).groupBy("w").agg(F.sum("c").alias("c"))


class Contexts:
    """Candidate contexts: ``words`` (sorted hashes of frequent words), then sorted keys of each longer length.

    A symbol is the place of a frequent word, ``rare`` for any other word, or, before a text,
    ``rare + 1``. A context of one word is its symbol. One of d words is a place in
    ``longer[d - 2]``, whose keys are (context of all words but the last) * ``width`` + last symbol.
    """

    def __init__(self, words: np.ndarray, begins: bool, longer: Sequence[np.ndarray] = ()):
        self.words, self.begins = words, begins
        self.rare = len(words)
        self.width = self.rare + 2
        self.longer = list(longer)

    def plain(self) -> tuple:
        """What makes it anew in a task: broadcast objects of this class would need the package there."""
        return self.words, self.begins, self.longer

    def symbols(self, chunk: Chunk) -> np.ndarray:
        places = places_in(self.words, chunk.words[:-1])
        return np.where(places >= 0, places, self.rare)[chunk.ids]

    def before(self, chunk: Chunk, symbols: np.ndarray) -> list[np.ndarray]:
        """For each length, the context before each token (-1: no candidate)."""
        ended = np.where(symbols == self.rare, -1, symbols)
        first = np.full(len(symbols), self.rare + 1 if self.begins else -1, dtype=np.int64)
        found = []
        for keys in (None, *self.longer):
            # ``ended`` holds the context that ends with each token; the next token has it before it.
            here = np.empty_like(ended)
            here[1:] = ended[:-1]
            here[chunk.first] = first[chunk.first] if keys is None else -1
            found.append(here)
            if len(found) <= len(self.longer):
                keys = self.longer[len(found) - 1]
                ok = (here >= 0) & (symbols != self.rare)
                ended = np.full(len(symbols), -1, dtype=np.int64)
                ended[ok] = places_in(keys, here[ok] * self.width + symbols[ok])
        return found

    def suffixes(self, length: int) -> np.ndarray:
        """For each context of ``length`` words, the context without its first word."""
        keys = self.longer[length - 2]
        shorter, last = np.divmod(keys, self.width)
        if length == 2:
            return last
        return places_in(self.longer[length - 3], self.suffixes(length - 1)[shorter] * self.width + last)


def context_counts(train: DataFrame, contexts: Contexts, length: int) -> DataFrame:
    """(key, c): next symbols after the candidate contexts of ``length`` words; key = context * width + symbol."""
    send = train.sparkSession.sparkContext.broadcast(contexts.plain())

    def task():
        known = Contexts(*send.value)

        def handle(columns):
            for _, _, texts in _chunks(columns):
                chunk = Chunk(texts)
                symbols = known.symbols(chunk)
                here = known.before(chunk, symbols)[length - 1]
                at = here >= 0
                key, c = np.unique(here[at] * known.width + symbols[at], return_counts=True)
                yield {"key": key, "c": c}

        return handle

    return map_batches(train.select("text"), "key long, c long", task).groupBy("key").agg(F.sum("c").alias("c"))


def _column(rows: DataFrame, *names: str) -> list[np.ndarray]:
    table = rows.select(*names).toArrow()
    return [table.column(n).to_numpy() for n in names]


class Level:
    """Contexts of one length: count, different next symbols and divergence of each, and the table of next symbols.

    ``table(key, c, suffix_p)``: ``suffix_p`` is the symbol's probability after the suffix.
    """

    def __init__(self, table: DataFrame, width: int, size: int):
        self.table = table
        sums = table.groupBy(F.expr(f"key div {width}").alias("context")).agg(F.sum("c").alias("n"), F.count("*").alias("d"))
        context, n, d = _column(sums, "context", "n", "d")
        self.n, self.d, self.kept = np.zeros(size), np.zeros(size), np.zeros(size, dtype=bool)
        self.n[context], self.d[context] = n, d
        self.total = np.where(self.n > 0, self.n + self.d, 1.0)
        self.back = np.where(self.n > 0, self.d / self.total, 1.0)
        context, gain = _column(_gains(table, self.n, self.d, width), "context", "gain")
        self.kept[context] = gain > np.log(self.n[context])


def _gains(table: DataFrame, n: np.ndarray, d: np.ndarray, width: int) -> DataFrame:
    """(context, gain): the log likelihood of the next symbols, each predicted without itself, beyond the suffix's."""
    send = table.sparkSession.sparkContext.broadcast((n, d))

    def task():
        n, d = send.value

        def handle(columns):
            key, c, suffix_p = (columns[x].to_numpy() for x in ("key", "c", "suffix_p"))
            context = key // width
            # Without its only occurrence a symbol is no kind of its own; a context seen once says nothing.
            kinds = d[context] - (c == 1)
            size = n[context] - 1 + kinds
            ratio = np.where(size > 0, ((c - 1) / suffix_p + kinds) / np.maximum(size, 1), 1.0)
            found, place = np.unique(context, return_inverse=True)
            yield {"context": found, "gain": np.bincount(place, c * np.log(ratio), len(found))}

        return handle

    return map_batches(table, "context long, gain double", task).groupBy("context").agg(F.sum("gain").alias("gain"))


class SuffixTree:
    """A trained model. ``table(key, full, adds)`` has the next symbols of all retained contexts.

    ``key`` = (``offset`` of the context's length + context) * width + symbol; ``full`` is the log10
    probability of the symbol and ``adds`` what the context adds to its suffix beyond its back-off weight.
    ``whole`` is false if more than MAX_PLACES words or contexts of a length reach ``min_count``, so that
    only the more frequent are held; with ``whole_only`` nothing further is counted then.
    """

    def __init__(self, train: DataFrame, min_count: int, depth: int, whole_only: bool = False):
        self.word_counts = stored(word_counts(train))
        row = self.word_counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        self.n, self.v = row["n"], row["v"]
        self.unknown = -math.log10(self.n + self.v + 1)
        end = word_number(END)
        self.levels: list[Level] = []
        self.floor = _floor(self.word_counts.select("c"), min_count)
        self.whole = self.floor == min_count
        if whole_only and not self.whole:
            return
        frequent = (F.col("c") >= self.floor) | (F.col("w") == end)
        words, counts = _column(self.word_counts.filter(frequent), "w", "c")
        order = np.argsort(words)
        words, counts = words[order], counts[order].astype(np.float64)
        texts = counts[words == end].sum()
        self.contexts = Contexts(words, bool(texts >= self.floor))
        self.counts = counts
        width, rare = self.contexts.width, self.contexts.rare
        # Rare words, and one unseen word, share the rest of the root's distribution.
        self.rare_total = self.n + self.v + 1 - counts.sum() - len(counts)
        self.root = np.append(counts + 1, [self.rare_total, 1.0]) / (self.n + self.v + 1)
        ends = int(places_in(words, np.array([end]))[0])

        floor = self.floor
        for length in range(1, depth + 1):
            size = width if length == 1 else len(self.contexts.longer[-1])
            if not size:
                break
            own = context_counts(train, self.contexts, length)
            if length == 1:
                joined = stored(_after_root(own, self.root, width))
            else:
                joined = stored(self._after_suffix(own, length))
            self.levels.append(Level(joined, width, size))
            if length < depth:
                symbol = F.col("key") % width
                again = joined.filter((symbol != rare) & (symbol != ends))
                # Never lower than that of the shorter contexts, so that every suffix is a candidate.
                floor = _floor(again.select("c"), floor)
                self.whole = floor == min_count
                if whole_only and not self.whole:
                    return
                self.contexts.longer.append(np.sort(_column(again.filter(F.col("c") >= floor), "key")[0]))
        # Suffixes of retained contexts are retained.
        for length in range(len(self.levels), 1, -1):
            up = self.contexts.suffixes(length)[self.levels[length - 1].kept]
            self.levels[length - 2].kept[up] = True
        self.offsets = np.cumsum([0] + [len(x.kept) for x in self.levels])
        self.table = self._table()
        self._rare_weights()

    def _after_suffix(self, own: DataFrame, length: int) -> DataFrame:
        """Counts of a length with the probability of each symbol after the suffix."""
        width, suffix = self.contexts.width, self.contexts.suffixes(length)
        shorter = self.levels[length - 2]
        rows = _with_place(own, suffix, width)
        met = np.zeros(len(shorter.kept), dtype=bool)
        met[suffix] = True
        probability = _probabilities(shorter.table, shorter, width, met).select(F.col("key").alias("up"), F.col("p").alias("suffix_p"))
        return rows.join(probability, "up").select("key", "c", "suffix_p")

    def _table(self) -> DataFrame:
        table = None
        for offset, level in zip(self.offsets, self.levels, strict=False):
            part = _probabilities(level.table, level, self.contexts.width, level.kept, int(offset))
            part = part.select("key", "c", F.log10("p").alias("full"), "adds")
            table = part if table is None else table.unionByName(part)
        return table

    def _rare_weights(self) -> None:
        """log10 probability of a rare word (as a class) after each context, and back-off weights, by offset + context."""
        width, rare = self.contexts.width, self.contexts.rare
        weights, suffix_p = [], None
        for length, level in enumerate(self.levels, 1):
            key, c = _column(level.table.filter(F.col("key") % width == rare), "key", "c")
            seen = np.zeros(len(level.kept))
            seen[key // width] = c
            up = np.full(len(seen), self.root[rare]) if length == 1 else suffix_p[self.contexts.suffixes(length)]
            suffix_p = np.where(level.n > 0, (seen + level.d * up) / level.total, up)
            weights.append(np.log10(suffix_p))
        self.rare_weights = np.concatenate(weights) if weights else np.zeros(0)
        self.back = np.concatenate([np.log10(x.back) for x in self.levels]) if weights else np.zeros(0)

    def frequent(self, share: float) -> float:
        return max(1.0, share * self.n)

    def frequent_rows(self, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the table with at least ``share`` of all tokens: at most 1 / share for each length of context."""
        if self.table is None:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        key, full, adds = _column(self.table.filter(F.col("c") >= self.frequent(share)), "key", "full", "adds")
        order = np.argsort(key)
        return key[order], full[order], adds[order]


MAX_PLACES = 4_000_000


def _floor(counts: DataFrame, min_count: int) -> int:
    """``min_count``, doubled while more than MAX_PLACES rows reach it, so that their keys (32 MB) can be sent to tasks."""
    floors = [min_count << i for i in range(40)]
    reach = counts.agg(*[F.count_if(F.col("c") >= f).alias(f"f{i}") for i, f in enumerate(floors)]).first()
    return next(f for i, f in enumerate(floors) if reach[f"f{i}"] <= MAX_PLACES)


def _after_root(own: DataFrame, root: np.ndarray, width: int) -> DataFrame:
    send = own.sparkSession.sparkContext.broadcast(root)

    def task():
        p = send.value

        def handle(columns):
            yield {"key": columns["key"], "c": columns["c"], "suffix_p": p[columns["key"].to_numpy() % width]}

        return handle

    return map_batches(own, "key long, c long, suffix_p double", task)


def _with_place(own: DataFrame, suffix: np.ndarray, width: int) -> DataFrame:
    """Add ``up``, the key of the same symbol after the context's suffix."""
    send = own.sparkSession.sparkContext.broadcast(suffix)

    def task():
        up = send.value

        def handle(columns):
            context, symbol = np.divmod(columns["key"].to_numpy(), width)
            yield {"key": columns["key"], "c": columns["c"], "up": up[context] * width + symbol}

        return handle

    return map_batches(own, "key long, c long, up long", task)


def _probabilities(table: DataFrame, level: Level, width: int, only: np.ndarray, offset: int = 0) -> DataFrame:
    """(key, c, p, adds) of the contexts in ``only``, with ``offset`` added to the context; ``adds`` is a logarithm."""
    send = table.sparkSession.sparkContext.broadcast((level.d, level.total, level.back, only))

    def task():
        d, total, back, only = send.value

        def handle(columns):
            key, c, suffix_p = (columns[x].to_numpy() for x in ("key", "c", "suffix_p"))
            own = only[key // width]
            key, c, suffix_p = key[own], c[own], suffix_p[own]
            context = key // width
            p = (c + d[context] * suffix_p) / total[context]
            yield {"key": key + offset * width, "c": c, "p": p, "adds": np.log10(p / suffix_p / back[context])}

        return handle

    return map_batches(table, "key long, c long, p double, adds double", task)


# What differs from row to row comes last, so that shuffled rows compress well.
SCORED = "id {}, body long, score double, base double, known long, n long, kind int, key long"
WORD, EXACT, ADDED, TRAINED, HELD = range(5)


def token_rows(docs: DataFrame, tree: SuffixTree, kind: str, share: float) -> DataFrame:
    """What each text asks of the tables: one row per different key and text, and a row with what is known already.

    Frequent words, frequent pairs of context and symbol, and back-off weights are settled in the
    task. Rare words are asked for by their hash (WORD). What follows a context is seen if the text
    was trained on, so its longest context is asked (EXACT); else each length is (ADDED).
    """
    offsets = tree.offsets
    kept = np.concatenate([x.kept for x in tree.levels]) if tree.levels else np.zeros(0, dtype=bool)
    log_root, log_count = np.log10(tree.root), np.log10(np.append(tree.counts + 1, [1.0, 1.0]))
    model = (tree.contexts.plain(), kept, log_root, log_count, tree.rare_weights, tree.back, tree.frequent_rows(share), math.log10(tree.rare_total))
    send = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("id", "body", "held_out", "text")

    def task():
        contexts, kept, log_root, log_count, rare_weights, back, (hot, hot_full, hot_adds), rare_size = send.value
        contexts = Contexts(*contexts)
        width, rare = contexts.width, contexts.rare

        def handle(columns):
            held = np.array(columns["held_out"].to_pylist(), dtype=bool)
            for lo, hi, texts in _chunks(columns):
                chunk = Chunk(texts)
                size = len(texts)
                symbols = contexts.symbols(chunk)
                out = held[lo:hi][chunk.row]
                is_rare = symbols == rare
                longest = np.full(len(symbols), -1, dtype=np.int64)
                settled = np.zeros(len(symbols))
                asked = []

                def ask(kind, at, state, values):
                    """Settle frequent pairs; the rest become rows."""
                    key = state * width + symbols[at]
                    found = places_in(hot, key)
                    hit = found >= 0
                    settled[at[hit]] += values[found[hit]]
                    asked.append((kind, at[~hit], key[~hit]))

                for offset, here in zip(offsets, contexts.before(chunk, symbols), strict=False):
                    at = np.flatnonzero(here >= 0)
                    state = here[at] + offset
                    at, state = at[kept[state]], state[kept[state]]
                    longest[at] = state
                    new = out[at] & ~is_rare[at]
                    settled[at[new]] += back[state[new]]
                    ask(ADDED, at[new], state[new], hot_adds)
                at = np.flatnonzero(~out & ~is_rare & (longest >= 0))
                ask(EXACT, at, longest[at], hot_full)
                at = np.flatnonzero(~is_rare & (out | (longest < 0)))
                settled[at] += log_root[symbols[at]]
                at = np.flatnonzero(is_rare)
                settled[at] += np.where(longest[at] >= 0, rare_weights[longest[at]] if len(rare_weights) else 0.0, log_root[rare]) - rare_size
                asked.append((WORD, at, chunk.words[chunk.ids[at]]))

                ids, bodies = columns["id"].slice(lo, hi - lo), columns["body"].slice(lo, hi - lo)
                yield {
                    "id": ids, "body": bodies, "key": bodies, "kind": np.where(held[lo:hi], HELD, TRAINED).astype(np.int32), "n": chunk.sizes,
                    "score": np.bincount(chunk.row, settled, size), "base": np.bincount(chunk.row, log_count[symbols], size),
                    "known": np.bincount(chunk.row, ~is_rare, size).astype(np.int64),
                }
                for kind, at, key in asked:
                    if not len(at):
                        continue
                    distinct, place = np.unique(key, return_inverse=True)
                    pair, n = np.unique(chunk.row[at] * len(distinct) + place, return_counts=True)
                    row, place = np.divmod(pair, len(distinct))
                    zero = np.zeros(len(pair))
                    yield {
                        "id": ids.take(_indices(row)), "body": bodies.take(_indices(row)), "key": distinct[place], "kind": np.full(len(pair), kind, np.int32),
                        "n": n, "score": zero, "base": zero, "known": np.zeros(len(pair), np.int64),
                    }

        return handle

    return map_batches(rows, SCORED.format(kind), task)


def _indices(rows: np.ndarray):
    import pyarrow as pa

    return pa.array(rows)


def score_texts(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", held_out: Column | None = None, min_count: int = 50, depth: int = 3,
    share: float = 2.5e-7,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every text; scores are log10.

    Trained on the texts for which ``held_out`` is false, on all contexts that reach ``min_count``: by
    ``joined_scores`` where they are too many to be sent to the tasks, else as follows. Pairs of context and symbol with at least
    ``share`` of all tokens are sent to the tasks (at most 1 / share for each length of context). One shuffle brings rare words and
    rarer pairs to the tables, one brings their sums back to the texts.
    """
    held = is_held_out(F.col(id_column)) if held_out is None else held_out
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(F.col(text)).alias("body"), held.alias("held_out"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    tree = SuffixTree(rows.filter(~F.col("held_out")), min_count, depth, whole_only=True)
    if not tree.whole:
        return _per_copy(joined_scores(rows, tree.word_counts, tree.n, tree.v, min_count, depth), id_column, tree)
    words = tree.word_counts.filter(F.col("c") < tree.floor)
    nothing = F.lit(None).cast("float")
    table = words.select(F.lit(0).alias("side"), F.col("w").alias("k"), "c", nothing.alias("full"), nothing.alias("adds"))
    if tree.table is not None:
        # What is frequent has been settled; single precision is enough for what one token adds.
        rest = tree.table.filter(F.col("c") < tree.frequent(share))
        values = [F.col(x).cast("float").alias(x) for x in ("full", "adds")]
        table = table.unionByName(rest.select(F.lit(1).alias("side"), F.col("key").alias("k"), F.lit(0).cast("long").alias("c"), *values))
    asked = token_rows(rows, tree, kind, share)
    # Built from the table, which is the smaller side, so that the rows of the texts need no sort.
    met = asked.join(table.hint("shuffle_hash"), (F.least("kind", F.lit(1)) == F.col("side")) & (F.col("key") == F.col("k")) & (F.col("kind") < TRAINED), "left")
    is_text, word = F.col("kind") >= TRAINED, F.col("kind") == WORD
    value = F.when(word, F.log10(F.col("c") + 1)).when(F.col("kind") == ADDED, F.col("adds")).otherwise(F.col("full"))
    found = F.coalesce(value, F.lit(0.0))
    score = F.when(is_text, F.col("score")).otherwise(F.col("n") * found)
    base = F.when(is_text, F.col("base")).when(word, F.col("n") * found).otherwise(F.lit(0.0))
    known = F.when(is_text, F.col("known")).when(word & F.col("c").isNotNull(), F.col("n")).otherwise(F.lit(0))
    sums = met.groupBy("id", "body").agg(
        F.sum(is_text.cast("long")).alias("copies"), F.max(F.col("kind") == HELD).alias("held_out"), F.sum(F.when(is_text, F.col("n"))).alias("n"),
        F.sum(known).alias("known"), F.sum(base).alias("base"), F.sum(score).alias("score"),
    )
    return _per_copy(sums, id_column, tree)


def _per_copy(sums: DataFrame, id_column: str, tree: SuffixTree) -> DataFrame:
    """A row for each copy of a text, from the sums over all copies."""
    each = lambda c: F.col(c) / F.col("copies")
    return sums.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        F.col("id").alias(id_column), "held_out",
        each("n").cast("long").alias("n_tokens"), each("known").cast("long").alias("n_known"), F.lit(tree.n).cast("long").alias("train_tokens"),
        (each("base") + each("n") * F.lit(tree.unknown)).alias("base_score"), each("score").alias("score"),
    )


def token_windows(docs: DataFrame, kind: str, depth: int) -> DataFrame:
    """(id, body, held_out, w, s1, s2, ...) for every token: its hash and those of the tokens before it, nearest first.

    The begin mark precedes the first token, nulls precede the mark.
    """

    def task():
        def handle(columns):
            held = np.array(columns["held_out"].to_pylist(), dtype=bool)
            for lo, hi, texts in _chunks(columns):
                chunk = Chunk(texts)
                word, row = chunk.words[chunk.ids], _indices(chunk.row + lo)
                place = np.arange(len(word)) - chunk.first[chunk.row]
                out = {"id": columns["id"].take(row), "body": columns["body"].take(row), "held_out": held[lo:hi][chunk.row], "w": word}
                for back in range(1, depth + 1):
                    before = np.where(place >= back, np.roll(word, back), chunk.words[-1])
                    out[f"s{back}"] = _masked(before, place < back - 1)
                yield out

        return handle

    longs = "".join(f", s{back} long" for back in range(1, depth + 1))
    return map_batches(docs.select("id", "body", "held_out", "text"), f"id {kind}, body long, held_out boolean, w long{longs}", task)


def _masked(values: np.ndarray, mask: np.ndarray):
    import pyarrow as pa

    return pa.array(values, mask=mask)


def joined_scores(docs: DataFrame, words: DataFrame, n: int, v: int, min_count: int, depth: int) -> DataFrame:
    """Sums over all copies of each (id, body), by joins and groupings of token rows alone; any number of contexts.

    Contexts are the hashes of their words. Those with a rare word need no test: they are seen less
    than ``min_count`` times themselves.
    """
    end, rare = word_number(END), word_number(b"   ")
    size = float(n + v + 1)
    own = (F.col("c") >= min_count) | ((F.col("w") == end) & (F.col("c") > 0))
    shared = words.filter(own).agg(F.coalesce(F.sum(F.col("c") + 1), F.lit(0)).alias("x")).first()["x"]
    rare_total = size - shared
    kind = docs.schema["id"].dataType.simpleString()
    symbol = F.when(own, F.col("w")).otherwise(F.lit(rare))
    # ``p`` starts as the root's probability of the symbol.
    tokens = stored(
        token_windows(docs, kind, depth).join(words, "w", "left").withColumn("c", F.coalesce("c", F.lit(0)))
        .select("*", symbol.alias("s"), F.when(own, (F.col("c") + 1) / size).otherwise(F.lit(rare_total / size)).alias("p"))
    )
    train = tokens.filter(~F.col("held_out"))
    tables, stats, kept = [], [], []
    for length in range(1, depth + 1):
        context = _context(length)
        seen = train.filter(F.col(context[-1]).isNotNull()).groupBy(*context, "s").agg(F.count("*").alias("c"), F.max("p").alias("suffix_p"))
        sums = seen.groupBy(*context).agg(F.sum("c").alias("n"), F.count("*").alias("d")).filter(F.col("n") >= min_count)
        seen = seen.join(sums, context)
        if length > 1:
            shorter = tables[-1].select(*_context(length - 1), "s", F.col("p").alias("suffix_p"))
            seen = seen.drop("suffix_p").join(shorter, [*_context(length - 1), "s"])
        table = stored(seen.withColumn("p", (F.col("c") + F.col("d") * F.col("suffix_p")) / (F.col("n") + F.col("d"))))
        # As in ``_gains``: without its only occurrence a symbol is no kind of its own.
        kinds = F.col("d") - F.when(F.col("c") == 1, 1).otherwise(0)
        rest = F.col("n") - 1 + kinds
        gain = F.when(rest > 0, F.col("c") * F.log(((F.col("c") - 1) / F.col("suffix_p") + kinds) / rest)).otherwise(0.0)
        all_gains = table.groupBy(*context).agg(F.sum(gain).alias("gain"), F.first("n").alias("n"), F.first("d").alias("d"))
        tables.append(table)
        stats.append(stored(all_gains.select(*context, "n", "d", (F.col("gain") > F.log("n")).alias("diverges"))))
    for length in range(depth, 0, -1):
        context, own_kept = _context(length), stats[length - 1].filter("diverges").select(*_context(length))
        if kept:
            # Suffixes of retained contexts are retained.
            own_kept = own_kept.unionByName(kept[0].select(*context)).distinct()
        kept.insert(0, stored(stats[length - 1].drop("diverges").join(own_kept, context, "left_semi")))
    for length, (table, states) in enumerate(zip(tables, kept), 1):
        context = _context(length)
        pairs = table.join(states, context, "left_semi").select(*context, "s", F.col("c").alias("seen"))
        tokens = tokens.join(states, context, "left").join(pairs, [*context, "s"], "left")
        after = (F.coalesce("seen", F.lit(0)) + F.col("d") * F.col("p")) / (F.col("n") + F.col("d"))
        tokens = tokens.withColumn("p", F.when(F.col("n").isNotNull(), after).otherwise(F.col("p"))).drop("n", "d", "seen")
    share = F.when(F.col("s") == rare, F.log10((F.col("c") + 1) / rare_total)).otherwise(0.0)
    return tokens.groupBy("id", "body").agg(
        F.count_if(F.col("w") == end).alias("copies"), F.max("held_out").alias("held_out"), F.count("*").alias("n"),
        F.count_if(F.col("c") > 0).alias("known"), F.sum(F.log10(F.col("c") + 1)).alias("base"), F.sum(F.log10("p") + share).alias("score"),
    )


def _context(length: int) -> list[str]:
    return [f"s{back}" for back in range(1, length + 1)]
