"""The training-data operators against plain Python, and on nulls, empties, repeats and clashing names."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from recordloom.llm import (
    cotraining,
    decontaminate,
    line_templates,
    near_dup,
    quality_rules,
    queries,
    sampled_pieces,
    sharding,
    suffix_tree_lm,
    token_counts,
    url_filter,
)
from tests.conftest import DATA

CLASHING = "id text_hash body bits size shard slot part state w n kind spans items lines pos leaf form key good stratum count root g".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    """Documents with columns named like what the operators use inside."""
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "the", "of", "É", "x1", "##", "Ωmega"]
    prose = " ".join(rng.choice(words) for _ in range(20000))
    copied = "a line that occurs in two of the documents here"
    rows = [
        (1, None, None, None, None),
        (None, "no id but text\n" + copied, "en", None, 3),
        (None, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, " \n\t ", "en", "s", 4),
        (4, prose, "en", "s", len(prose)),
        (5, copied + "\nother words", "fr", "s", 9),
        (5, copied + "\nother words", "fr", "s", 9),
        (6, "the " * 200, "en", "t", 800),
        (7, "line\n" * 30, None, "t", 150),
        (-8, "a\u2581b \U0001f600 \x00 end\r\n", "en", "s", 9),
    ]
    return table(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality long, toxic long")


# 1 token counts


@pytest.fixture(scope="module")
def counter():
    return token_counts.LeafCounter(token_counts.load_ranks())


def test_edited_counts_equal_full_counts(counter):
    rng = random.Random(1)
    parts = ["the", " cat", "  ", "\n", "'s", "'re", "12", "é", "Ω", "!!", "'", " r", "e", "\t x"]
    for _ in range(60):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 500)))
        tree = token_counts.TokenTree(text, *counter.leaves(text), counter)
        for _ in range(12):
            a = rng.randint(0, len(text) + 3)
            b = a + rng.choice([0, 0, 1, 2, 30, 200])
            new = "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 90])))
            lo, hi = min(a, len(text)), min(b, len(text))
            text = text[:lo] + new + text[hi:]
            tree.edit(a, b, new)
            assert tree.text == text
            assert tree.leaf_arrays() == tuple(counter.leaves(text))
            assert (tree.chars[1], tree.tokens[1]) == (len(text), len(counter.encode(text)))


def test_edits_touch_little(counter):
    text = "some words and more " * 5000
    tree = token_counts.TokenTree(text, *counter.leaves(text), counter)
    tree.edit(50_000, 50_004, "other")
    assert tree.encoded < 60


def test_edits_of_odd_rows(spark, odd, none, counter):
    trees = token_counts.build_trees(odd)
    edited = token_counts.apply_edits(token_counts.masking_edits(trees, ((r"[0-9]+", "<N>"), (r"\s+", " "))))
    rows = edited.collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r["n_tokens"] == len(counter.encode(r["text"])) and sum(r["leaf_chars"]) == len(r["text"])
    listed = spark.createDataFrame([(5, 1, 0, 1, "An"), (5, 2, None, 2, "x"), (6, 1, 700, None, None)], "doc_id long, seq int, start long, stop long, replacement string")
    joined = token_counts.apply_edits(token_counts.attach_edits(trees, listed)).collect()
    assert len(joined) == odd.count() and sum(r["text"].startswith("An line") for r in joined) == 2
    assert token_counts.apply_edits(token_counts.masking_edits(token_counts.build_trees(none), ())).count() == 0
    patterns = ((r"[0-9]+", "<N>"), (r"\s+", " "))
    whole = [(r["doc_id"], len(r["text"]), r["n_tokens_before"], r["n_tokens"], r["n_edits"], r["encoded_chars"]) for r in rows]
    at_once = token_counts.masked_counts(odd, patterns).select("doc_id", "n_chars", "n_tokens_before", "n_tokens", "n_edits", "encoded_chars")
    assert sorted(map(str, map(tuple, at_once.collect()))) == sorted(map(str, whole))
    assert token_counts.masked_counts(none, patterns).count() == 0


def test_query_counts_all_documents(spark, docs, counter):
    got = queries.op1_token_counts(spark, DATA).collect()
    want = {i: len(counter.encode(t or "")) for i, t in texts(docs).items()}
    assert {r["doc_id"]: r["n_tokens_before"] for r in got} == want


# 2 quality rules


def plain_counts(text):
    words = [w for w in (text or "").encode().split()]
    words = [w.decode() for w in words]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = collections.Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts(spark, odd, none):
    given = labels(spark, [(5, 1, 0), (5, 0, 0), (None, 1, 0), (4, None, None)])
    rows = quality_rules.quality_verdicts(odd, given).collect()
    want = sorted((r["doc_id"] or 0, *plain_counts(r["text"])) for r in odd.collect())
    assert sorted((r["doc_id"] or 0, *[r[c] for c in quality_rules.BASE_COUNTS]) for r in rows) == want
    assert all(r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"]) for r in rows)
    assert quality_rules.filter_quality(odd, given).columns == odd.columns
    assert quality_rules.quality_verdicts(none, given.limit(0)).count() == quality_rules.filter_quality(none, given).count() == 0


def test_binomial_tail(spark):
    cases = [(1, 0), (10, 0), (900, 3), (2000, 9), (50, 2)]
    row = spark.range(1).select(*[quality_rules.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), 0.05).alias(f"c{i}") for i, (n, k) in enumerate(cases)]).first()
    for (n, k), got in zip(cases, row):
        want = sum(math.comb(n, j) * 0.05**j * 0.95 ** (n - j) for j in range(k + 1))
        assert got == pytest.approx(want, rel=1e-9)


def test_cutoffs_keep_their_promise(spark):
    """With enough labels a separating signal is admitted, and only in the stratum that has them."""
    rng = random.Random(2)
    rows = [("=a", True, *[0.0] * 6) for _ in range(3000)] + [("=a", False, 0.9, *[0.0] * 5) for _ in range(300)]
    rows += [("=b", True, *[0.0] * 6) for _ in range(100)] + [("=b", False, 0.9, *[0.0] * 5) for _ in range(100)]
    # A signal that good documents have as often as bad ones is never admitted.
    rows = [(*r[:3], 0.45 if rng.random() < 0.2 else 0.0, *r[4:]) for r in rows]
    calibration = spark.createDataFrame(rows, "stratum string, good boolean, " + ", ".join(f"{k} double" for k in quality_rules.GRIDS))
    found = [tuple(r) for r in quality_rules.choose_cutoffs(calibration).collect()]
    assert found == [("=a", "symbols", 0.75)]
    rejected = quality_rules.reject_above(found, F.col("stratum"), {k: F.col(k) for k in quality_rules.GRIDS})
    assert calibration.filter(rejected).groupBy("stratum", "good").count().collect() == [("=a", False, 300)]
    assert quality_rules.choose_cutoffs(calibration.limit(0)).count() == 0


# 3 near-duplicates


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """{index: smallest index reachable over prints within 2 bits}."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(prints))]


def test_simhash_query(spark, docs):
    got = {r["doc_id"]: r for r in queries.op3_simhash_near_dup(spark, DATA).collect()}
    rows = sorted(texts(docs).items())
    prints = [plain_print(t) for _, t in rows]
    for (i, _), p, root in zip(rows, prints, plain_components(prints)):
        assert got[i]["fingerprint"] == f"{p:016x}" and got[i]["component_id"] == rows[root][0]


@pytest.mark.parametrize("hot_cell", [2, 32])
def test_close_pairs_connect_all_within_two_bits(spark, hot_cell):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):  # chains and crowds around some of them
        p = rng.choice(prints)
        for _ in range(rng.randint(0, 3)):
            p ^= 1 << rng.randint(0, 63)
        prints.append(p)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(s,) for s in signed], "bits long")
    at = {s: i for i, s in enumerate(signed)}
    edges = [(at[r["a"]], at[r["b"]]) for r in near_dup.close_pairs(frame, hot_cell).collect()]
    assert all(bin(prints[a] ^ prints[b]).count("1") <= 2 for a, b in edges)
    parent = list(range(len(prints)))
    for _ in range(len(prints)):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert parent == plain_components(prints)


def test_near_duplicates_of_odd_rows(odd, none):
    got = near_dup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    zero = [r for r in got if r["bits"] == 0]
    assert len(zero) == 4 and {r["component_id"] for r in zero} == {1}
    kept = near_dup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(similar_groups([r["text"] for r in odd.collect()]))
    assert near_dup.near_duplicates(none).count() == near_dup.keep_one(none).count() == 0


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar_groups(some):
    """Groups of positions whose five-word shingle sets are linked by a Jaccard similarity of 0.8 or more."""
    sets = [shingles(t) for t in some]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9 and a and b:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    groups = collections.defaultdict(list)
    for i in range(len(sets)):
        groups[find(i)].append(i)
    return groups


@pytest.mark.parametrize("edits", [1, 2])
def test_crowds_of_copies_edited_apart(spark, edits):
    """Copies of one text, each with own edits: all alike with one edit, hardly any with two; nothing grows with the square."""
    rng = random.Random(17)
    base = [f"w{rng.randrange(5000)}" for _ in range(80)]
    some = []
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(80), edits):
            words[at] = f"edit{i}x{at}"
        some.append(" ".join(words))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(some)]
    want = {g[0] for g in similar_groups(some).values()}
    assert {r["doc_id"] for r in near_dup.keep_one(table(spark, rows)).collect()} == want
    sets = spark.createDataFrame([(i, i, near_dup.shingle_set(t, 5).view("int64").tolist()) for i, t in enumerate(some)], "node long, root long, shingles array<long>")
    found = {(r["a"], r["b"]) for r in near_dup._prefix_pairs(sets, 0.8).collect()}
    alike = {(j, i) for i in range(300) for j in range(i) if len(shingles(some[i]) & shingles(some[j])) >= 0.8 * len(shingles(some[i]) | shingles(some[j])) - 1e-9}
    assert alike <= found
    if edits == 2:
        assert 20 * len(found) <= 300 * 299 / 2


def test_keep_one_finds_edited_copies(spark):
    """Copies with edited words, most of them more than 2 bits apart, and one crowd in chains of edits."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randint(0, 400)}"
    found = [[word() for _ in range(rng.randint(60, 300))] for _ in range(20)]
    for base in list(found):
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(1, 1 + len(base) // 30)):
                copy[rng.randrange(len(copy))] = word()
            found.append(copy)
    crowd = [[word() for _ in range(200)]]
    for _ in range(60):
        copy = list(crowd[rng.randrange(len(crowd))])
        for _ in range(3):
            copy[rng.randrange(200)] = word()
        crowd.append(copy)
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate(found + crowd)]
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    want = {i for i, r in enumerate(root) if r == i}
    assert len(want) < len({r for r in plain_components([plain_print(r[1]) for r in rows])})
    assert {r["doc_id"] for r in near_dup.keep_one(table(spark, rows)).collect()} == want


def test_keep_one_links_what_op3_links(spark):
    """Texts whose repeated words leave equal fingerprints, though few of their shingles are common."""
    body = "same three words " * 80
    texts = [body + "then one tail of its own", body + "but quite another end follows here", "something else altogether stands in this one"]
    frame = table(spark, [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)])
    assert [r["component_id"] for r in near_dup.near_duplicates(frame).orderBy("doc_id").collect()] == [0, 0, 2]
    assert len(similar_groups(texts)) == 3
    assert {r["doc_id"] for r in near_dup.keep_one(frame).collect()} == {0, 2}


# 4 line templates


def test_lines_of_odd_rows(odd, none):
    got = line_templates.drop_recurring_lines(odd, detail=True)
    assert got.columns == [*odd.columns, "n_lines", "n_dropped"]
    rows = got.collect()
    assert len(rows) == odd.count()
    by_id = collections.defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append(r["text"])
    copied = "a line that occurs in two of the documents here"
    assert [t for t in by_id[None] if t] == ["no id but text\n" + copied]  # null sorts first: this is the first occurrence
    assert by_id[5] == ["other words"] * 2 and by_id[1] == [None] and by_id[2] == [""]
    assert by_id[7] == ["line\n" * 30]  # repeats within one document are not across documents
    assert line_templates.drop_recurring_lines(none).count() == 0


def test_variable_fields_and_passages(spark):
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(i, f"Entry {i} was saved at {i}:30 by the same old system\nown sentence of number {'abcdefghij'[i]} here it is", "en", "s", 1) for i in range(6)]
    rows += [(10 + i, f"{passage}\nlead {'qwerty'[i]} tail of text", "en", "s", 1) for i in range(3)]
    near = "this is the very same notice with only the name {} changed in it"
    rows += [(20 + i, near.format("ABC"[i] * 3), "en", "s", 1) for i in range(3)]
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring_lines(table(spark, rows)).collect()}
    assert got[0].startswith("Entry 0") and all("Entry" not in got[i] for i in range(1, 6))
    assert passage in got[10] and all(passage not in got[i] for i in (11, 12))
    assert got[20] and got[21] == got[22] == ""
    short = table(spark, [(i, "yes\n" + " ".join("abc"[i] * 9), "en", "s", 1) for i in range(3)])
    assert all(r["text"].startswith("yes") for r in line_templates.drop_recurring_lines(short).collect())


def test_several_templates_share_a_leaf(spark):
    """Two kinds of log lines of one length, whose first fields hold digits: more rows hide nothing."""
    names = ["ann", "bob", "cat", "dan", "eve"]
    kinds = ["2024-05-0{i} 10:1{i} 77 {i} user {x} logged in from the office today", "2024-05-0{i} 10:1{i} 77 {i} disk {x} ran out of free space here"]
    lines = [kind.format(i=i, x=x) for kind in kinds for i, x in enumerate(names)]
    for some, kept in ((lines[:5], 1), (lines, 2)):
        rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(some)]
        got = line_templates.drop_recurring_lines(table(spark, rows), detail=True).collect()
        assert sum(r["n_dropped"] for r in got) == len(some) - kept and {r["doc_id"] for r in got if r["text"]} <= {0, 5}


# 5 shards


def test_shards(spark, docs, odd, none):
    rows = queries.op5_byte_shards(spark, DATA).collect()
    own = texts(docs)
    assert sorted(r["doc_id"] for r in rows) == sorted(own)
    total = sum(len((t or "").encode()) + 8 for t in own.values())
    before, slots = 0, collections.Counter()
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        data = (own[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))
        assert r["shard"] == min(23, (2 * before + r["size"]) * 24 // (2 * total)) and r["slot"] == slots[r["shard"]]
        before += r["size"]
        slots[r["shard"]] += 1
    rows = sharding.shard_by_bytes(odd, 3).collect()
    assert len(rows) == odd.count()
    for s in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert sharding.shard_by_bytes(none).count() == 0


# 6 co-training


def test_cotraining_tells_held_out_documents(spark):
    sf = DATA.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given = spark.read.parquet(f"{sf}/labels.parquet")
    learned = given.filter("doc_id % 4 <> 1")
    scored = cotraining.classify(docs, cotraining.fit_views(docs, learned)).join(given.filter("doc_id % 4 = 1"), "doc_id").collect()
    good = [r for r in scored if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r for r in scored if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.9 * len(good)
    pairs = [(a["score"], b["score"]) for a in good for b in bad]
    assert sum(a > b for a, b in pairs) >= 0.85 * len(pairs)


def test_cotraining_equals_plain_rounds(spark, docs):
    """The same rounds with every unlabelled document in a Python list; pseudo-labels follow the corpus."""
    given = spark.read.parquet(f"{DATA}/labels.parquet")
    model = cotraining.fit_views(docs, given)
    roles = {str(r["id"]): (r["good"], r["role"]) for r in cotraining._roles(docs, given, "doc_id", 6000, 0).collect()}
    rows = {}
    for r in docs.collect():
        data = (r["text"] or "").encode()
        words = np.array(sorted(model.content.words[w] for w in cotraining.content_words(data) if w in model.content.words), dtype=np.int64)
        single = lambda x: np.array(x, dtype=np.float32).astype(float)
        good, role = roles.get(str(r["doc_id"]), (None, "pool"))
        rows[str(r["doc_id"])] = (good, role, single(cotraining.content_shares(data)), single(cotraining.metadata(data, r["source"], r["lang"])), words)
    pool = [i for i in rows if rows[i][1] == "pool"]

    def exchange(views):
        sums = [{}, {}]
        for i in pool:  # one document at a time
            found = cotraining.lend(views, [i], (rows[i][2][None], rows[i][3][None], [rows[i][4]]), 0.95)
            for (taker, kind, fold), amounts in found.items():
                flat = np.concatenate([[amounts[0]], amounts[1], amounts[2]])
                sums[taker][kind, fold] = sums[taker].get((kind, fold), 0) + flat
        return tuple(cotraining.averages(t, len(v.words), len(v.mean)) for t, v in zip(sums, views))

    labelled = [rows[i] for i in sorted(rows) if rows[i][1] in ("learn", "held")]
    plain = cotraining.co_train(labelled, model.content.words, 3, 0.01, exchange)
    assert plain.lent == model.lent and len(model.lent) == 3
    for a, b in ((plain.content, model.content), (plain.meta, model.meta)):
        assert np.allclose(a.weights, b.weights, atol=1e-6)
    assert plain.cutoff == pytest.approx(model.cutoff, abs=1e-6)
    twice = cotraining.fit_views(docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10**9)), given)
    assert sum(map(sum, twice.lent[0])) > sum(map(sum, model.lent[0]))


def test_cotraining_of_odd_rows(spark, odd, none):
    few = labels(spark, [(5, 1, 0), (None, 0, 1), (4, None, None), (5, 1, 0)])
    rows = cotraining.classify(odd, cotraining.fit_views(odd, few)).collect()
    assert len(rows) == odd.count() and all(r["kept"] and 0 <= r["score"] <= 1 for r in rows)
    assert cotraining.classify(none, cotraining.fit_views(none, few.limit(0))).count() == 0
    many = spark.createDataFrame([(i, ("good words here " if i % 2 else "bad ## stuff ") * (1 + i % 5), None, None, i) for i in range(120)], SCHEMA)
    given = labels(spark, [(i, i % 2, 0) for i in range(100)])
    model = cotraining.fit_views(many, given)
    found = {r["doc_id"]: r["kept"] for r in cotraining.classify(many, model).collect()}
    assert all(found[i] == bool(i % 2) for i in range(100, 120))
    assert cotraining.classify(odd, model).count() == odd.count()


# 7 pieces


@pytest.fixture(scope="module")
def pieces():
    return sampled_pieces.load_pieces()


def all_segmentations(text, pieces, vocabulary):
    """{ids: log probability} by enumeration."""
    whole = " " + text
    ids = {p.replace("\u2581", " "): i for i, (p, _, kind) in enumerate(pieces) if kind == "piece"}
    found = {}

    def walk(at, path, weight):
        if at == len(whole):
            found[tuple(path)] = weight
            return
        if whole[at] not in ids:
            walk(at + 1, path + [vocabulary.byte_ids[b] for b in whole[at].encode()], weight + vocabulary.byte_weight)
        for end in range(at + 1, min(len(whole), at + vocabulary.longest) + 1):
            if whole[at:end] in ids:
                i = ids[whole[at:end]]
                walk(end, path + [i], weight + vocabulary.weight[i])

    walk(0, [], 0.0)
    top = max(found.values())
    total = top + math.log(sum(math.exp(v - top) for v in found.values()))
    return {k: v - total for k, v in found.items()}


def test_segmentations_are_decoded_together(pieces, monkeypatch):
    vocabulary = sampled_pieces.Vocabulary(pieces, 3e-5)
    texts = ["it the", "", " two  blanks ", "\u2460\u2581 an", "\ud55c\uae00"]
    rows = [s["ids"] for samples in sampled_pieces.sample_chunk(vocabulary, texts, list(range(5)), 3) for s in samples]
    want = [t for t, samples in zip(texts, sampled_pieces.sample_chunk(vocabulary, texts, list(range(5)), 3)) for _ in samples]
    for most in (1, 7, 100_000):
        monkeypatch.setattr(sampled_pieces, "DECODE_PIECES", most)
        assert vocabulary.decode_all(rows) == want
    assert vocabulary.decode_all([]) == []
    assert vocabulary.decode([-1, vocabulary.size, None, *rows[0].tolist(), 1 << 30]) == texts[0]


def test_lattices_are_kept_from_chunk_to_chunk(pieces, monkeypatch):
    vocabulary = sampled_pieces.Vocabulary(pieces, 3e-5)
    chunks = [["it the n tin", "an odd \u2460 one", ""], ["the tin an", "it"], ["other words, the odd one"], ["it the n tin"]]
    sample = lambda texts, *known: [
        [(s["ids"].tolist(), s["log_prob"], s["inclusion"]) for s in samples] for samples in sampled_pieces.sample_chunk(vocabulary, texts, [1, 2, 3][: len(texts)], 3, *known)
    ]
    want = [sample(texts) for texts in chunks]
    made = []
    build = sampled_pieces.Lattices
    monkeypatch.setattr(sampled_pieces, "Lattices", lambda v, units: made.extend(units) or build(v, units))
    for kept, again in ((600_000, False), (25, True)):
        made.clear()
        monkeypatch.setattr(sampled_pieces, "KEPT_CHARS", kept)
        known = sampled_pieces.Known(vocabulary)
        assert [sample(texts, known) for texts in chunks] == want
        assert (len(made) > len(set(made))) == again


def test_samples_are_gumbel_top_k(pieces):
    vocabulary = sampled_pieces.Vocabulary(pieces, 3e-5)
    for text in ("it the", "n tin", "\u2460 an"):
        exact = all_segmentations(text, pieces, vocabulary)
        # With k beyond their number, all come out, best perturbed first.
        for samples in sampled_pieces.sample_chunk(vocabulary, [text] * 3, [1, 2, 3], 10_000):
            got = {tuple(s["ids"].tolist()): s["log_prob"] for s in samples}
            assert len(got) == len(samples) == len(exact)
            assert all(got[k] == pytest.approx(v, abs=1e-6) for k, v in exact.items())
            assert all(s["inclusion"] == 1.0 for s in samples)
        runs = sampled_pieces.sample_chunk(vocabulary, [text] * 6000, list(range(6000)), 2)
        first = collections.Counter(tuple(s[0]["ids"].tolist()) for s in runs)
        second = collections.Counter(tuple(s[1]["ids"].tolist()) for s in runs)
        for path, log in sorted(exact.items(), key=lambda x: -x[1])[:4]:
            p = math.exp(log)
            q = sum(math.exp(o) * p / (1 - math.exp(o)) for k, o in exact.items() if k != path)
            assert first[path] / 6000 == pytest.approx(p, abs=0.025)
            assert second[path] / 6000 == pytest.approx(q, abs=0.025)
            # Sums weighted by inclusion are unbiased (Horvitz and Thompson).
            estimate = sum(p / s["inclusion"] for run in runs for s in run if tuple(s["ids"].tolist()) == path) / 6000
            assert estimate == pytest.approx(p, abs=0.04)


def test_round_trip_and_row_keys(spark, odd, none):
    encoded = sampled_pieces.encode_samples(odd, k=3)
    rows = encoded.collect()
    assert len(rows) == odd.count()
    again = {(r["doc_id"], str(r["samples"])) for r in sampled_pieces.encode_samples(odd.repartition(5), k=3).collect()}
    assert again == {(r["doc_id"], str(r["samples"])) for r in rows}
    for r in rows:
        paths = [tuple(s["ids"]) for s in r["samples"]]
        assert len(paths) == len(set(paths)) >= 1
    flat = encoded.select("doc_id", F.explode("samples").alias("s")).select("doc_id", "s.ids")
    want = {(r["doc_id"], r["text"] or "") for r in odd.collect()}
    assert {(r["doc_id"], r["text"]) for r in sampled_pieces.decode_pieces(flat).collect()} == want
    assert sampled_pieces.encode_samples(none).count() == sampled_pieces.decode_pieces(flat.limit(0)).count() == 0


def test_encoding_queries_decode_every_sample(spark, docs, odd):
    for rows, got in ((docs, queries.op7_sampled_pieces(spark, DATA)), (odd, corpus_pipeline.encode(spark, odd, DATA))):
        got = got.collect()
        want = {(r["doc_id"], zlib.crc32((r["text"] or "").encode())) for r in rows.collect()}
        assert {(r["doc_id"], s["text_crc32"]) for r in got for s in r["samples"]} == want
        assert all(s["round_trip"] for r in got for s in r["samples"])
        assert max(len(r["samples"]) for r in got) == 4


# 8 language model


def plain_scores(rows, min_count, depth=3):
    """The suffix tree by dictionaries: {(id, text): (held out, tokens, known, base, score)}."""
    end, begin, rare = b" ", b"  ", b"   "
    tokens = [(i, t, (t or "").encode().lower().split() + [end]) for i, t in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    words = collections.Counter(w for i, _, own in tokens if not held(i) for w in own)
    n, v = sum(words.values()), len(words)
    symbol = lambda w: w if words[w] >= min_count or (w == end and words[w]) else rare
    rare_total = sum(c + 1 for w, c in words.items() if symbol(w) == rare) + 1
    before = {}
    counts = collections.defaultdict(collections.Counter)
    for i, t, own in tokens:
        symbols = [begin] + [symbol(w) for w in own]
        before[i, t] = [tuple(tuple(symbols[at - size : at]) for size in range(1, min(depth, at) + 1)) for at in range(1, len(symbols))]
        if not held(i):
            for contexts, s in zip(before[i, t], symbols[1:], strict=True):
                for context in contexts:
                    counts[context][s] += 1

    def p(context, s):
        if not context:
            return (rare_total if s == rare else words[s] + 1) / (n + v + 1)
        own = counts[context]
        size, kinds = sum(own.values()), len(own)
        return (own[s] + kinds * p(context[1:], s)) / (size + kinds)

    kept = set()
    for context, own in counts.items():
        size = sum(own.values())
        if rare not in context and size >= min_count:
            gain = 0.0
            for s, c in own.items():
                kinds = len(own) - (c == 1)
                if size > 1:
                    gain += c * math.log((c - 1 + kinds * p(context[1:], s)) / (size - 1 + kinds) / p(context[1:], s))
            if gain > math.log(size):
                kept |= {context[at:] for at in range(len(context))}
    out = {}
    for i, t, own in tokens:
        score = 0.0
        for contexts, w in zip(before[i, t], own, strict=True):
            state = next((c for c in reversed(contexts) if c in kept), ())
            score += math.log10(p(state, symbol(w)))
            if symbol(w) == rare:
                score += math.log10((words[w] + 1) / rare_total)
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in own)
        out[i, t] = (held(i), len(own), sum(words[w] > 0 for w in own), base, score)
    return n, kept, out


@pytest.mark.parametrize(("min_count", "depth", "share"), [(5, 3, 1.0), (20, 3, 1e-4), (1, 2, 1e-3), (50, 4, 2.5e-7)])
def test_scores_equal_plain_tree(docs, min_count, depth, share):
    n, kept, want = plain_scores([(r["doc_id"], r["text"]) for r in docs.collect()], min_count, depth)
    assert any(len(c) == 1 for c in kept) and (min_count > 5 or any(len(c) == depth for c in kept))
    own = texts(docs)
    for r in suffix_tree_lm.score_texts(docs, min_count=min_count, depth=depth, share=share).collect():
        held, tokens, known, base, score = want[r["doc_id"], own[r["doc_id"]]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, tokens, known, n)
        assert (r["base_score"], r["score"]) == (pytest.approx(base), pytest.approx(score))


def test_floors_rise_only_where_keys_are_too_many(docs, monkeypatch):
    train = docs.select("text")
    free = suffix_tree_lm.SuffixTree(train, 5, 3)
    monkeypatch.setattr(suffix_tree_lm, "MAX_PLACES", len(free.contexts.words) // 2)
    tight = suffix_tree_lm.SuffixTree(train, 5, 3)
    assert free.floor == 5 and tight.floor > 5
    assert all((tight.contexts.suffixes(length) >= 0).all() for length in range(2, 1 + len(tight.levels)))
    # More text, more contexts.
    half = suffix_tree_lm.SuffixTree(train.limit(100), 5, 3)
    assert sum(x.kept.sum() for x in half.levels) < sum(x.kept.sum() for x in free.levels)


@pytest.mark.parametrize(("places", "min_count"), [(0, 5), (100, 5), (7300, 2)])
def test_contexts_too_many_to_send_are_joined(docs, odd, monkeypatch, places, min_count):
    """The scores of the whole model, whether the words (0, 100) or only the contexts (7300) are too many."""
    monkeypatch.setattr(suffix_tree_lm, "MAX_PLACES", places)
    joined = []
    plain = suffix_tree_lm.joined_scores
    monkeypatch.setattr(suffix_tree_lm, "joined_scores", lambda *a: joined.append(1) or plain(*a))
    test_scores_equal_plain_tree(docs, min_count, 3, 2.5e-7)
    assert joined
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    _, _, want = plain_scores(rows, 1)
    got = suffix_tree_lm.score_texts(odd, min_count=1).collect()
    assert sorted(round(r["score"], 6) for r in got) == sorted(round(want[row][4], 6) for row in rows)
    assert suffix_tree_lm.score_texts(odd, held_out=F.lit(True)).count() == len(rows)


def test_scores_of_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    _, _, want = plain_scores(rows, 50)
    got = suffix_tree_lm.score_texts(odd).collect()
    assert len(got) == len(rows)
    assert sorted(round(r["score"], 6) for r in got) == sorted(round(want[row][4], 6) for row in rows)
    assert suffix_tree_lm.score_texts(none).count() == 0
    # Nothing to train on.
    assert suffix_tree_lm.score_texts(odd, held_out=F.lit(True)).count() == len(rows)


# 9 decontamination


def plain_hits(text, items, window):
    words = decontaminate.plain_words(text)
    hit, found = set(), set()
    for item, own in items:
        for run in decontaminate.windows(decontaminate.plain_words(own), window):
            for at in range(len(words) - len(run) + 1):
                if tuple(words[at : at + len(run)]) == run:
                    hit |= set(range(at, at + len(run)))
                    found.add(item)
    return len(words), len(hit), found


@pytest.mark.parametrize("block_chars", [8_000_000, 60])
def test_hits_equal_brute_force(spark, block_chars):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["Aa", "b", "c", "D-d"]) for _ in range(n))
    items = [(i, say(rng.randint(1, 14))) for i in range(25)] + [(3, say(12)), (77, None), (78, " .,"), (79, "")]
    rows = [(i, say(rng.randint(0, 60)), "en", "s", 1) for i in range(40)] + [(2, None, None, None, None)]
    rows += [rows[5]]
    got = decontaminate.contamination_report(table(spark, rows), bench(spark, items), block_chars=block_chars, window=5).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for i, text, *_ in rows:
        n, hits, found = plain_hits(text, items, 5)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        want[i, n, hits, len(found), digest, hits > 0] += 1
    assert collections.Counter(tuple(r) for r in got) == want


def test_decontamination_of_odd_rows(spark, odd, none):
    some = bench(spark, [(1, "other words"), (None, "no id but text"), (2, None), (1, "other words")])
    rows = decontaminate.contamination_report(odd, some).collect()
    assert sum(r["contaminated"] for r in rows) == 3 and len(rows) == odd.count()
    kept = decontaminate.drop_contaminated(odd, some)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert decontaminate.drop_contaminated(odd, some.limit(0)).count() == odd.count()
    assert decontaminate.contamination_report(none, some).count() == 0


# 10 urls


def test_urls(spark):
    rows = [
        (1, "https://WWW.Example.com/en/1?x"), (2, "http://example.com/en/2"), (3, "http://a.example.com/de/"), (4, "http://x.net/fr/ok"),
        (5, "http://x.net/de/casino"), (6, "http://x.net/de/casinos"), (7, "http://win.x.net/free-x"), (8, "http://win.x.net/window"),
        (9, None), (10, ""), (11, "no scheme casino"), (12, "http://example.com"), (12, "http://example.com"), (None, "a://b?c/d"),
        (13, "http://win-win.net/" + "a" * 5000),
    ]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, host string, rule string")
    got = url_filter.filter_urls(pages).collect()
    found = collections.defaultdict(set)
    for r in got:
        found[r["page_id"]].add((r["host"], r["rule"], r["verdict"]))
    assert len(got) == len(rows)
    assert found[1] == {("www.example.com", "www.example.com/en/", "allow")}
    assert found[2] == {("example.com", "example.com/en/", "block")} and found[3] == {("a.example.com", "com/", "allow")}
    assert found[4] == {("x.net", "net/fr/", "block")} and found[5] == {("x.net", None, "block")}
    assert found[6] == {("x.net", None, "allow")} and found[7] == {("win.x.net", None, "block")} and found[8] == {("win.x.net", None, "allow")}
    assert found[9] == found[10] == {("", None, "allow")} and found[11] == {("", None, "block")}
    assert found[12] == {("example.com", None, "allow")} and found[None] == {("b", None, "allow")} and found[13] == {("win-win.net", None, "allow")}
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


# pipeline


def test_stages_take_odd_rows(spark, odd, none):
    for rows in (odd, none):
        left = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, left, DATA)
            assert after.columns == rows.columns, name
            left = spark.createDataFrame(after.collect(), rows.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, rows, DATA).count() == rows.count()


def test_pipeline_equals_plain_python(spark, docs):
    given = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = {r["doc_id"]: r for r in quality_rules.quality_verdicts(docs, given).collect()}
    left = {i: t for i, t in texts(docs).items() if rows[i]["kept"]}
    frame = corpus_pipeline.keep_quality(spark, docs, DATA)
    assert texts(frame) == left
    frame = spark.createDataFrame(corpus_pipeline.dedup_lines(spark, frame, DATA).collect(), docs.schema)
    shorter = texts(frame)
    assert shorter.keys() == left.keys() and all(len(shorter[i]) <= len(left[i]) for i in left)
    order = sorted(shorter)
    kept = {order[g[0]] for g in similar_groups([shorter[i] for i in order]).values()}
    frame = spark.createDataFrame(corpus_pipeline.dedup_documents(spark, frame, DATA).collect(), docs.schema)
    assert set(texts(frame)) == kept
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {i for i in kept if not plain_hits(shorter[i], items, 10)[1]}
    frame = corpus_pipeline.drop_benchmark(spark, frame, DATA)
    assert set(texts(frame)) == clean
    encoded = corpus_pipeline.run(spark, DATA)
    flat = encoded.select("doc_id", F.col("samples")[0]["ids"].alias("ids"))
    assert texts(sampled_pieces.decode_pieces(flat)) == {i: shorter[i] for i in clean}
