"""Quality classifier by co-training of two views.

One classifier reads the content of a text (which of its words occur, shares of symbols and
capitals), the other its metadata (source, language, length, layout of lines). Both learn from
labelled documents; then, for some rounds, each labels the unlabelled documents that it is
certain of, for the other to learn from. Each view is calibrated on labelled
documents that neither has learned from, and the calibrated log odds are added (the prior is
counted once).

A document is good if it is labelled of quality and not toxic. The classifiers learn from at most
``max_labelled`` labelled documents (those of smallest hash) and from every unlabelled one: in each
round Spark scores all of them, each view labels those whose calibrated odds are certain enough,
and their features are summed by class and fold. The sums, of fixed size, stand for the
pseudo-labelled documents in the other view's next fit, where all together weigh at most half as
much as the labelled ones of their class. Every document is scored.

Defined cases: a null text is empty; null sources and languages are values of their own; null
ids are scored but not learned from; an id labelled twice is good only if all its labels are;
without labels of both kinds every document gets the share of good labels (1 without any) and
is kept; repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import map_batches, stored
from recordloom.session import cut_lineage

# Fixed rule: ASCII letters and digits make words, with everything beyond ASCII.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SYMBOLS = [bytes([c]) for c in b"!\"#$%&'()*+,-./:;<=>?@[]_{|}"]
_CAPITALS = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_BUCKETS = 32
# Parts in which pseudo-labelled documents of a class are averaged.
FOLDS = 4


def content_words(data: bytes) -> set[bytes]:
    return set(data.translate(_FOLD).split())


def content_shares(data: bytes) -> list[float]:
    """Symbols, capitals and digits per byte, as square roots, so that few count too."""
    n = max(1, len(data))
    counts = [data.count(s) for s in _SYMBOLS]
    counts += [len(data) - len(data.translate(None, _CAPITALS)), len(data) - len(data.translate(None, _DIGITS))]
    return [math.sqrt(c / n) for c in counts]


def metadata(data: bytes, source: str | None, lang: str | None) -> list[float]:
    """Length and layout, then one-of-n buckets of source and language."""
    lines = data.split(b"\n")
    filled = [x for x in lines if x.strip()]
    values = [
        math.log1p(len(data)),
        math.log1p(len(filled)),
        math.log1p(len(data) / max(1, len(lines))),
        1.0 - len(filled) / len(lines),
        1.0 - len(set(filled)) / max(1, len(filled)),
        math.log1p(max(map(len, lines))),
    ]
    for kind, value in (("s", source), ("l", lang)):
        place = zlib.crc32(f"{kind}={value}".encode()) % _BUCKETS
        values += [1.0 if i == place else 0.0 for i in range(_BUCKETS)]
    return values


@dataclass
class Lent:
    """Documents that one view has labelled for the other: averages by class and fold, and how many they are."""

    y: np.ndarray
    count: np.ndarray
    words: np.ndarray
    dense: np.ndarray

    @classmethod
    def nothing(cls, words: int, width: int) -> Lent:
        return cls(np.zeros(0), np.zeros(0), np.zeros((0, words)), np.zeros((0, width)))


class View:
    """Logistic regression on dense columns (standardised) and present words."""

    def __init__(self, words: dict[bytes, int], width: int):
        self.words, self.weights = words, np.zeros(len(words) + width + 1)
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.slope, self.shift = 1.0, 0.0

    def fit(self, dense: np.ndarray, present: list[np.ndarray], y: np.ndarray, lent: Lent | None = None, steps: int = 150, decay: float = 1e-4) -> None:
        """Fit on labelled rows and on the averages of what the other view has labelled."""
        self.mean = dense.mean(axis=0)
        spread = dense.std(axis=0)
        self.scale = np.where(spread > 1e-9, spread, 1.0)
        x = (dense - self.mean) / self.scale
        rows = np.repeat(np.arange(len(y)), [len(p) for p in present])
        columns = np.concatenate(present).astype(np.int64) if len(rows) else np.empty(0, np.int64)
        n = len(self.words)
        lent = lent or Lent.nothing(n, dense.shape[1])
        others = (lent.dense - self.mean) / self.scale
        # Both classes weigh the same. A document that is lent weighs at most half of a labelled one, all
        # together at most half of those of their class, and in both classes alike.
        trust, given = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())), np.zeros(len(lent.y))
        ratio = 0.5 * min(1.0, *[lent.count[lent.y == kind].sum() / max(1, (y == kind).sum()) for kind in (0, 1)])
        if ratio > 0:
            trust /= 1 + ratio
            for kind in (0, 1):
                mine = lent.y == kind
                given[mine] = 0.5 * ratio / (1 + ratio) * lent.count[mine] / lent.count[mine].sum()
        w, m, v = np.zeros_like(self.weights), np.zeros_like(self.weights), np.zeros_like(self.weights)
        chance = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        for step in range(1, steps + 1):
            z = x @ w[n:-1] + w[-1] + np.bincount(rows, w[columns], len(y))
            error = (chance(z) - y) * trust
            wrong = (chance(others @ w[n:-1] + w[-1] + lent.words @ w[:n]) - lent.y) * given
            gradient = np.concatenate([np.bincount(columns, error[rows], n) + lent.words.T @ wrong, x.T @ error + others.T @ wrong, [error.sum() + wrong.sum()]])
            gradient[:-1] += decay * w[:-1]
            m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
            w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights = w

    def raw(self, dense: np.ndarray, present: list[np.ndarray]) -> np.ndarray:
        n = len(self.words)
        z = ((dense - self.mean) / self.scale) @ self.weights[n:-1] + self.weights[-1]
        if n:
            z = z + np.array([self.weights[p].sum() for p in present])
        return z

    def calibrate(self, z: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling: slope and shift of the log odds by Newton's method, with smoothed targets."""
        good, bad = (y == 1).sum(), (y == 0).sum()
        target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
        # The spread of the scores sets the unit, so that far values don't dominate.
        unit = max(1e-6, float(np.median(np.abs(z - np.median(z)))))
        x = np.stack([np.clip(z / unit, -50, 50), np.ones_like(z)], axis=1)
        w = np.array([0.0, math.log((good + 1) / (bad + 1))])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target) + 1e-6 * w)
            w = w - np.clip(step, -2, 2)
        self.slope, self.shift = max(0.0, w[0]) / unit, w[1]

    def odds(self, z: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * z + self.shift, -20, 20)


class Model:
    """Both views, the prior log odds, the cutoff, and how many documents each round has lent (good and bad, to content and to metadata)."""

    def __init__(self, content: View | None, meta: View | None, prior: float, cutoff: float, lent: list | None = None):
        self.content, self.meta, self.prior, self.cutoff, self.lent = content, meta, prior, cutoff, lent or []

    def score(self, content: tuple, meta: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.content.odds(self.content.raw(*content)), self.meta.odds(self.meta.raw(*meta))
        chance = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return chance(a), chance(b), chance(a + b - self.prior)


def _roles(docs: DataFrame, labels: DataFrame, id_column: str, max_labelled: int, seed: int) -> DataFrame:
    """(id, good, role): labelled ids; at most ``max_labelled``, half of each kind, to "learn" from or to be "held" back, the rest "spare"."""
    known = (
        labels.select(F.col(id_column).alias("id"), (F.coalesce("quality", F.lit(0)) >= 1).alias("q"), (F.coalesce("toxic", F.lit(0)) >= 1).alias("t"))
        .filter("id is not null").groupBy("id").agg(F.min(F.col("q") & ~F.col("t")).alias("good"))
    )
    known = known.join(docs.select(F.col(id_column).alias("id")).distinct(), "id", "left_semi")
    order = F.xxhash64("id", F.lit(seed))
    half = lambda kind: known.filter(kind).orderBy(order, "id").limit(max_labelled // 2).select("id")
    # Every third of each kind is kept for calibration, by the rank of its hash.
    rank = F.row_number().over(Window.partitionBy("good").orderBy(order, "id"))  # at most max_labelled rows
    chosen = half("good").unionByName(half("not good")).join(known, "id").withColumn("role", F.when(rank % 3 == 0, "held").otherwise("learn"))
    return known.join(chosen.select("id", "role"), "id", "left").withColumn("role", F.coalesce("role", F.lit("spare")))


def _features(rows: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``rows(id, text, source, lang)`` as (id, shares, meta, present); ids as text."""
    send = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def task():
        known = send.value

        def handle(columns):
            data = [(t or "").encode("utf-8", "replace") for t in columns["text"].to_pylist()]
            yield {
                "id": columns["id"].cast("string"), "shares": [content_shares(d) for d in data],
                "meta": [metadata(d, s, g) for d, s, g in zip(data, columns["source"].to_pylist(), columns["lang"].to_pylist())],
                "present": [sorted(known[w] for w in content_words(d) if w in known) for d in data],
            }

        return handle

    return map_batches(rows, "id string, shares array<float>, meta array<float>, present array<smallint>", task)


def fold_of(name: str) -> int:
    return zlib.crc32(name.encode()) % FOLDS


def lend(views: tuple[View, View], ids: list[str], features: tuple, certain: float) -> dict:
    """Sums over documents by (taker, class, fold): [count, word counts, dense sums] of those the other view is certain of."""
    shares, metas, present = features
    bound, folds = math.log(certain / (1 - certain)), np.array([fold_of(i) for i in ids])
    nothing = [np.empty(0, np.int64)] * len(ids)
    sides = ((0, views[1], metas, nothing, shares, present), (1, views[0], shares, present, metas, nothing))
    sums = {}
    for taker, giver, dense, words, taken, taken_words in sides:
        odds = giver.odds(giver.raw(dense, words))
        for kind, sure in ((1, odds >= bound), (0, odds <= -bound)):
            for fold in np.unique(folds[sure]):
                at = np.flatnonzero(sure & (folds == fold))
                width = len(views[taker].words)
                counts = np.bincount(np.concatenate([taken_words[i] for i in at]).astype(np.int64), minlength=width) if width else np.zeros(0)
                sums[taker, kind, int(fold)] = [len(at), counts.astype(float), taken[at].sum(axis=0)]
    return sums


def _lent(pool: DataFrame, views: tuple[View, View], certain: float) -> tuple[Lent, Lent]:
    """What the views lend each other of all documents of ``pool``: summed in the tasks, then per key."""
    send = pool.sparkSession.sparkContext.broadcast(views)
    target = pa.schema([("taker", pa.int32()), ("kind", pa.int32()), ("fold", pa.int32()), ("place", pa.int32()), ("amount", pa.float64())])

    def run(batches):
        views, total = send.value, {}
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                rows = lambda i: np.stack([np.asarray(x.values, dtype=float) for x in part.column(i)])  # noqa: B023, E731
                features = (rows(1), rows(2), [np.asarray(x.values, dtype=np.int64) for x in part.column(3)])
                for key, amounts in lend(views, part.column(0).to_pylist(), features, certain).items():
                    total[key] = [a + b for a, b in zip(total[key], amounts)] if key in total else amounts
        for key, (count, words, dense) in total.items():
            flat = np.concatenate([[count], words, dense])
            place = np.flatnonzero(flat)
            keys = [pa.array(np.full(len(place), k, dtype=np.int32)) for k in key]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(place.astype(np.int32)), pa.array(flat[place])], schema=target)

    rows = pool.select("id", "shares", "meta", "present").mapInArrow(run, "taker int, kind int, fold int, place int, amount double")
    # As many rows as two vocabularies have words, times classes and folds.
    sums = rows.groupBy("taker", "kind", "fold", "place").agg(F.sum("amount").alias("amount")).collect()
    out = []
    for taker, view in enumerate(views):
        n, width = len(view.words), len(view.mean)
        table = {}
        for r in sums:
            if r["taker"] == taker:
                table.setdefault((r["kind"], r["fold"]), np.zeros(1 + n + width))[r["place"]] = r["amount"]
        out.append(averages(table, n, width))
    return out[0], out[1]


def averages(table: dict, words: int, width: int) -> Lent:
    """From sums by (class, fold) to averages."""
    if not table:
        return Lent.nothing(words, width)
    keys = sorted(table)
    flat = np.stack([table[k] for k in keys])
    count = flat[:, 0]
    return Lent(np.array([k[0] for k in keys], dtype=float), count, flat[:, 1 : 1 + words] / count[:, None], flat[:, 1 + words :] / count[:, None])


def co_train(rows: list, vocabulary: dict[bytes, int], rounds: int, lost: float, exchange: Callable[[tuple[View, View]], tuple[Lent, Lent]]) -> Model:
    """Both views after some rounds of ``exchange``, from labelled ``rows`` of (good, role, shares, meta, present)."""
    good, held = np.array([int(r[0]) for r in rows]), np.array([r[1] == "held" for r in rows])
    shares, metas = np.array([r[2] for r in rows], dtype=float), np.array([r[3] for r in rows], dtype=float)
    present, nothing = [np.asarray(r[4], dtype=np.int64) for r in rows], [np.empty(0, np.int64)] * len(rows)
    content, meta = View(vocabulary, shares.shape[1]), View({}, metas.shape[1])
    lent, record = (None, None), []
    pick = lambda some, mask: [some[i] for i in np.flatnonzero(mask)]
    for turn in range(rounds + 1):
        for view, dense, words, taken in ((content, shares, present, lent[0]), (meta, metas, nothing, lent[1])):
            view.fit(dense[~held], pick(words, ~held), good[~held], taken)
            view.calibrate(view.raw(dense[held], pick(words, held)), good[held])
        if turn < rounds:
            lent = exchange((content, meta))
            record.append([[int(x.count[x.y == kind].sum()) for kind in (1, 0)] for x in lent])
    # Both calibrations hold the odds of the calibration set: their sum counts them twice.
    prior = math.log((held & (good == 1)).sum() / (held & (good == 0)).sum())
    model = Model(content, meta, prior, 0.5, record)
    at = held & (good == 1)
    score = model.score((shares[at], pick(present, at)), (metas[at], pick(nothing, at)))[2]
    model.cutoff = float(min(0.5, np.quantile(score, lost)))
    return model


def fit_views(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
    max_labelled: int = 6000, rounds: int = 3, certain: float = 0.95, min_docs: int = 8, max_words: int = 4000, lost: float = 0.01, seed: int = 0,
) -> Model:
    """Fit both views; ``lost`` is the share of good calibration documents that the cutoff may reject."""
    roles = cut_lineage(_roles(docs, labels, id_column, max_labelled, seed))
    sizes = {(r["good"], r["role"]): r["n"] for r in roles.filter("role <> 'spare'").groupBy("good", "role").agg(F.count("*").alias("n")).collect()}
    if min(sizes.get((g, "learn"), 0) + sizes.get((g, "held"), 0) for g in (True, False)) < 8:
        counts = labels.select((F.coalesce("quality", F.lit(0)) >= 1).alias("q"), (F.coalesce("toxic", F.lit(0)) >= 1).alias("t"))
        share = counts.agg(F.avg((F.col("q") & ~F.col("t")).cast("double"))).first()[0]
        return Model(None, None, 1.0 if share is None else share, 0.0)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"))
    rows = rows.filter("id IS NOT NULL")
    learned = F.broadcast(roles.filter("role = 'learn'").select("id", "good"))  # at most max_labelled ids
    vocabulary = _vocabulary(rows.select("id", "text").join(learned, "id"), {g: sizes[g, "learn"] for g in (True, False)}, min_docs, max_words)
    # Features meet the roles, never texts.
    marked = _features(rows, vocabulary).join(roles.withColumn("id", F.col("id").cast("string")), "id", "left").withColumn("role", F.coalesce("role", F.lit("pool")))
    table = stored(marked.filter("role <> 'spare'"))
    # At most max_labelled ids, each with at most max_words places; rows of one id count once.
    labelled = {r["id"]: (r["good"], r["role"], r["shares"], r["meta"], r["present"]) for r in table.filter("role <> 'pool'").orderBy("id", "present").collect()}
    pool = table.filter("role = 'pool'")
    return co_train([labelled[i] for i in sorted(labelled)], vocabulary, rounds, lost, lambda views: _lent(pool, views, certain))


def _vocabulary(rows: DataFrame, sizes: dict[bool, int], min_docs: int, max_words: int) -> dict[bytes, int]:
    """The words that tell the classes apart best, among those of enough documents; counted in Spark."""

    def task():
        def handle(columns):
            for t, g in zip(columns["text"], columns["good"].to_pylist()):
                words = sorted(content_words((t.as_py() or "").encode("utf-8", "replace")))
                yield {"word": words, "good": [g] * len(words)}

        return handle

    words = map_batches(rows.select("text", "good"), "word binary, good boolean", task)
    counts = words.groupBy("word").agg(F.count_if("good").alias("a"), F.count_if(~F.col("good")).alias("b"))
    share = (F.col("a") + F.col("b")) / (sizes[True] + sizes[False])
    deviation = F.sqrt(F.greatest(F.lit(1e-9), share * (1 - share)) * (1 / sizes[True] + 1 / sizes[False]))
    score = F.abs(F.col("a") / sizes[True] - F.col("b") / sizes[False]) / deviation
    best = counts.filter(F.col("a") + F.col("b") >= min_docs).orderBy(F.desc(score), "word").select("word").limit(max_words)
    return {bytes(r["word"]): i for i, r in enumerate(best.collect())}


def classify(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """(id, content_score, meta_score, score, kept) of every document; chances of being good. Narrow: no row moves."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"))
    kind = rows.schema["id"].dataType.simpleString()
    send = docs.sparkSession.sparkContext.broadcast(model)

    def task():
        model = send.value

        def handle(columns):
            ids, n = columns["id"], len(columns["id"])
            if model.content is None:
                flat = [model.prior] * n
                yield {"id": ids, "content_score": flat, "meta_score": flat, "score": flat, "kept": [True] * n}
                return
            shares, metas, present = [], [], []
            known = model.content.words
            for t, s, g in zip(columns["text"], columns["source"].to_pylist(), columns["lang"].to_pylist()):
                data = (t.as_py() or "").encode("utf-8", "replace")
                shares.append(content_shares(data))
                metas.append(metadata(data, s, g))
                present.append(np.array(sorted(known[w] for w in content_words(data) if w in known), dtype=np.int64))
            if not n:
                return
            a, b, both = model.score((np.array(shares), present), (np.array(metas), [np.empty(0, np.int64)] * n))
            yield {"id": ids, "content_score": a, "meta_score": b, "score": both, "kept": both >= model.cutoff}

        return handle

    return map_batches(rows, f"id {kind}, content_score double, meta_score double, score double, kept boolean", task).withColumnRenamed("id", id_column)
