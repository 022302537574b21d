"""The operators applied to their whole tables, with SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import (
    cotraining,
    decontaminate,
    graph_search,
    line_templates,
    near_dup,
    prefix_trie,
    quality_rules,
    sampled_pieces,
    sharding,
    suffix_tree_lm,
    token_counts,
    turn_repair,
    url_filter,
)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# What is masked before texts are counted again.
MASKS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "<EMAIL>"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<IP>"),
    (r"\b\d{12,19}\b", "<NUMBER>"),
)


def op1_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every document before and after its personal data is masked."""
    return token_counts.masked_counts(_table(spark, sf, "documents"), MASKS)


def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    verdicts = quality_rules.quality_verdicts(_table(spark, sf, "documents"), _table(spark, sf, "labels"))
    return verdicts.select("doc_id", *quality_rules.BASE_COUNTS, "base_failed", "kept")


def op3_simhash_near_dup(spark: SparkSession, sf: str) -> DataFrame:
    found = near_dup.near_duplicates(_table(spark, sf, "documents"))
    return found.select("doc_id", near_dup.fingerprint_text(F.col("bits")).alias("fingerprint"), "component_id")


def op4_line_templates(spark: SparkSession, sf: str) -> DataFrame:
    return line_templates.drop_recurring_lines(_table(spark, sf, "documents"), detail=True).select("doc_id", "text", "n_lines", "n_dropped")


def op5_byte_shards(spark: SparkSession, sf: str) -> DataFrame:
    placed = sharding.shard_by_bytes(_table(spark, sf, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_cotraining(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    return cotraining.classify(docs, cotraining.fit_views(docs, _table(spark, sf, "labels")))


def op7_sampled_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return sampled_pieces.encode_samples(_table(spark, sf, "documents"), k=4)


def op8_suffix_tree_lm(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_tree_lm.score_texts(_table(spark, sf, "documents"))


def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contamination_report(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op10_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf, "pages")).drop("url", "soft_weight")


def op11_graph_search(spark: SparkSession, sf: str) -> DataFrame:
    return graph_search.nearest_neighbours(_table(spark, sf, "embeddings"), k=20, every=20)


def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    """The trie of rebuilt conversations: each begins like the first of its family of five."""
    turns, convs = prefix_trie.rebuilt_turns(prefix_trie.ordered_turns(_table(spark, sf, "conversations")))
    return prefix_trie.prefix_trie(turns, convs)


def op13_turn_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations after damage by hash, repaired."""
    conversations = _table(spark, sf, "conversations")
    return turn_repair.repair(turn_repair.damaged(conversations), conversations.select("conv_id"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_quality_rules, op3_simhash_near_dup, op4_line_templates, op5_byte_shards,
        op6_cotraining, op7_sampled_pieces, op8_suffix_tree_lm, op9_decontamination, op10_url_filter,
        op11_graph_search, op12_prefix_trie, op13_turn_repair,
    )
}


def _grid_sql() -> str:
    return ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, g in quality_rules.GRIDS.items() for v in g)


def _quality_sql(alpha: float = 0.05, delta: float = 0.05, cost: float = 20.0) -> str:
    rate = alpha / len(quality_rules.GRIDS)
    signals = {
        "symbols": "n_symbols / n_words", "repeats": "n_repeat_words / n_words", "dup_lines": "n_dup_lines / n_lines",
        "capitals": "n_capitals / word_chars", "exclamations": "n_exclamations / n_words", "word_length": "word_chars / n_words",
    }
    values = " UNION ALL ".join(
        f"SELECT rid, doc_id, stratum, '{k}' AS signal, CASE WHEN {v.split(' / ')[1]} > 0 THEN CAST({v.split(' / ')[0]} AS DOUBLE) / {v.split(' / ')[1]} ELSE 0 END AS value FROM c"
        for k, v in signals.items()
    )
    removed = lambda s: f"length(t) - length(regexp_replace(t, '{s}', '', 'g'))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
x AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x09-\x0D ]+'), lambda y: y <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\x09-\x0D ]')) AS l FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM x)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
p AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS k(k) GROUP BY rid),
c AS (SELECT x.rid, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x09-\x0D ]', '', 'g')) AS BIGINT) AS word_chars,
  CAST({removed('[#*$%&|<>]')} AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, {removed('[A-Z]')} AS n_capitals, {removed('!')} AS n_exclamations
  FROM x LEFT JOIN p USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
v AS ({values}),
q AS (SELECT doc_id, max(quality) >= 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
cal AS (SELECT v.*, good FROM v JOIN q USING (doc_id) JOIN f USING (rid) WHERE NOT f.base_failed),
grid(signal, cutoff) AS (VALUES {_grid_sql()}),
tests AS (SELECT stratum, signal, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND value > cutoff) AS k,
  count(*) FILTER (NOT good AND value > cutoff) AS gain FROM cal JOIN grid USING (signal) GROUP BY ALL),
tail AS (SELECT *, (SELECT count(*) FROM tests) AS m, CASE WHEN k <= n * {rate!r} THEN list_sum(list_transform(range(0, k + 1),
  lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({rate!r}) + (n - j) * ln(1 - {rate!r})))) ELSE 1.0 END AS tail FROM tests),
best AS (SELECT *, row_number() OVER (PARTITION BY stratum, signal ORDER BY gain - {cost} * k DESC, cutoff DESC) AS rank
  FROM tail WHERE tail * m <= {delta} AND gain - {cost} * k > 0),
out AS (SELECT DISTINCT v.rid FROM v JOIN best USING (stratum, signal) WHERE rank = 1 AND value > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rid NOT IN (SELECT rid FROM out) AS kept FROM f"""


def _lines_sql(depth: int = 4, similarity: float = 0.8) -> str:
    levels = []
    for i in range(line_templates.LEVELS):
        node = "n, head, node"
        levels.append(rf"""
tok{i} AS (SELECT {node}, w, unnest(w) AS tok, unnest(range(len(w))) AS place FROM forms{i}),
cnt{i} AS (SELECT {node}, place, tok, count(*) AS seen, sum(count(*)) OVER (PARTITION BY {node}, place) AS total FROM tok{i} GROUP BY {node}, place, tok),
mix{i} AS (SELECT {node} FROM forms{i} GROUP BY {node} HAVING count(*) > 1),
fol{i} AS (SELECT n, head, node, w, hits >= {similarity} * n AS follows FROM (SELECT t.n, t.head, t.node, t.w, count(c.tok) AS hits FROM tok{i} t JOIN mix{i} USING (n, head, node)
  LEFT JOIN cnt{i} c ON t.n = c.n AND t.head = c.head AND t.node = c.node AND t.place = c.place AND t.tok = c.tok AND 2 * c.seen > c.total GROUP BY ALL)),
split{i} AS (SELECT {node}, (min({{'kinds': kinds, 'place': place}})).place AS place FROM (SELECT {node}, place, count(*) AS kinds FROM cnt{i} GROUP BY ALL) WHERE kinds > 1 GROUP BY {node}),
forms{i + 1} AS (SELECT f.n, f.head, list_append(list_append(f.node, CAST(place AS VARCHAR)), f.w[place + 1]) AS node, f.w FROM fol{i} f JOIN split{i} USING (n, head, node) WHERE NOT follows)""")
    shared = " UNION ALL ".join(f"SELECT n, head, w, node, {i} AS level FROM fol{i} WHERE follows" for i in range(line_templates.LEVELS))
    return rf"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
t AS (SELECT *, list_transform(list_filter(regexp_split_to_array(line, '[\x09-\x0D ]+'), lambda y: y <> ''),
  lambda y: CASE WHEN regexp_matches(y, '[0-9]') THEN '<*>' ELSE y END) AS w FROM l),
k AS (SELECT doc_id, text, pos, w, len(w) AS n, w[1:{depth}] AS head FROM t WHERE len(w) > 0),
forms0 AS (SELECT DISTINCT n, head, CAST([] AS VARCHAR[]) AS node, w FROM k),{",".join(levels)},
shared AS ({shared}),
key AS (SELECT k.doc_id, k.text, k.pos, k.n, k.head, CASE WHEN s.w IS NULL THEN k.w END AS form, s.node, s.level
  FROM k LEFT JOIN shared s ON k.n = s.n AND k.head = s.head AND k.w = s.w),
seen AS (SELECT *, dense_rank() OVER (PARTITION BY n, head, form, node, level ORDER BY doc_id, text) AS doc_rank,
  row_number() OVER (PARTITION BY n, head, form, node, level ORDER BY doc_id, text, pos) AS line_rank FROM key),
rec AS (SELECT *, max(doc_rank) OVER (PARTITION BY n, head, form, node, level) AS docs FROM seen),
drops AS (SELECT doc_id, text, pos FROM rec WHERE docs >= CASE WHEN n < 5 THEN 10 ELSE 2 END AND line_rank > 1),
kept AS (SELECT l.doc_id, l.text, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (x.pos IS NULL), '') AS shorter,
  count(*) AS n_lines, count(x.pos) AS n_dropped FROM l LEFT JOIN drops x ON l.doc_id = x.doc_id AND l.text = x.text AND l.pos = x.pos GROUP BY l.doc_id, l.text)
SELECT o.doc_id, kept.shorter AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM documents o LEFT JOIN kept ON o.doc_id = kept.doc_id AND o.text = kept.text"""


_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '{_PLAIN}'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format('text')}, '{_PLAIN}') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT item_id, len(w) AS n, array_to_string(w, ' ') AS g FROM b WHERE len(w) BETWEEN 1 AND 9
  UNION ALL SELECT item_id, 10, array_to_string(w[i:i + 9], ' ') FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM b WHERE len(w) >= 10)),
sizes AS (SELECT DISTINCT n FROM win),
docwin AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
hit AS (SELECT rid, i, docwin.n, item_id FROM docwin JOIN win ON docwin.n = win.n AND docwin.g = win.g),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)"""


def _url_sql() -> str:
    lower = _LOWER.format("coalesce(url, '')")
    found = lambda t: f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS BIGINT)"
    strict = " + ".join(found(t) for t in url_filter.STRICT_TERMS)
    soft = " + ".join(found(t) for t in url_filter.SOFT_TERMS)
    rules = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in url_filter.RULES)
    return rf"""
WITH p AS (SELECT page_id, {lower} AS u, {_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(action, rhost, rpath) AS (VALUES {rules}),
m AS (SELECT *, ({strict}) AS n_strict, ({soft}) AS n_soft FROM p)
SELECT page_id, host, path, (SELECT rhost || rpath FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
    ORDER BY length(rhost || rpath) DESC LIMIT 1) AS rule,
  coalesce((SELECT action FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
    ORDER BY length(rhost || rpath) DESC LIMIT 1), CASE WHEN n_strict >= 1 OR n_soft >= 2 THEN 'block' ELSE 'allow' END) AS verdict,
  n_strict, n_soft FROM m"""


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text: bytes are xored in, each followed by eight shifts (-1)."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda b: [CAST(ord(b) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c // 2, (c % 2) * 3988292384) END))"


_TURN_KEY = "left(sha256(CAST(strlen({r}) AS VARCHAR) || ':' || {r} || {t}), 32)"

_TRIE = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, {_TURN_KEY.format(r='r', t='x')} AS k, turn, strlen(x) AS b FROM t),
own AS (SELECT conv_id, list(k ORDER BY turn NULLS FIRST, k) AS ks, list(b ORDER BY turn NULLS FIRST, k) AS bs FROM k GROUP BY conv_id),
h AS (SELECT own.*, {_crc32_sql('CAST(conv_id AS VARCHAR)')} % 9 AS h FROM own),
re AS (SELECT h.conv_id, list_concat(coalesce(f.ks[1:h.h], []), h.ks[h.h + 1:]) AS ks, list_concat(coalesce(f.bs[1:h.h], []), h.bs[h.h + 1:]) AS bs
  FROM h LEFT JOIN own f ON f.conv_id = h.conv_id - h.conv_id % 5),
mem AS (SELECT conv_id, d, array_to_string(ks[1:d], '') AS name, array_to_string(ks[1:d - 1], '') AS parent, coalesce(bs[d], 0) AS b, len(ks) = d AS is_end
  FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM re)),
node AS (SELECT d, name, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, min(b) AS b,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256 FROM mem GROUP BY d, name),
kid AS (SELECT parent AS name, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
val AS (SELECT node.*, coalesce(kid.n, 0) AS n_children FROM node LEFT JOIN kid ON node.name = kid.name AND node.d = kid.d),
up AS (SELECT left(name, 32 * a) AS name, a AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum((n_convs - 1) * b) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM val) GROUP BY ALL)
SELECT val.conv_id, val.d AS depth, p.conv_id AS parent_conv_id, val.n_convs, val.n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, val.ends_sha256
FROM val JOIN up ON up.name = val.name AND up.d = val.d LEFT JOIN node p ON val.d > 0 AND p.name = val.parent AND p.d = val.d - 1"""


_SPACES = r"[\x09-\x0D ]"

_REPAIR = rf"""
WITH RECURSIVE c AS (SELECT *, {_crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS f FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE coalesce(role, ' ') END AS r,
  CASE f WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS x, unnest(range(CASE f WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE f <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_TURN_KEY.format(r='r', t='x')}, copy) AS i FROM d),
w AS (SELECT *, left(r, 1) AS q, lead(left(r, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS q2, row_number() OVER (PARTITION BY conv_id, r, x ORDER BY i) AS nth,
  regexp_replace(x, '{_SPACES}+$', '') AS y FROM o),
row_ AS (SELECT *, CASE WHEN y = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN NOT regexp_matches(y, '[.!?]$') THEN 't' ELSE '' END AS fault FROM w),
ins(s, t, n, pieces) AS (VALUES (0, 0, 0, CAST([] AS VARCHAR[])), (1, 1, 0, []), (2, 2, 0, []), (3, 3, 0, []), (0, 2, 1, ['user:']), (1, 2, 1, ['user:']), (3, 2, 1, ['user:']),
  (2, 3, 1, ['assistant:']), (0, 3, 2, ['user:', 'assistant:']), (1, 3, 2, ['user:', 'assistant:'])),
act(e, s, t, q, price, name) AS (VALUES ('D', 0, 0, NULL, 2, NULL), ('D', 1, 1, NULL, 2, NULL), ('D', 2, 2, NULL, 2, NULL), ('D', 3, 3, NULL, 2, NULL),
  ('K', 0, 1, 's', 0, NULL), ('K', 0, 2, 'u', 0, NULL), ('K', 1, 2, 'u', 0, NULL), ('K', 3, 2, 'u', 0, NULL), ('K', 2, 3, 'a', 0, NULL),
  ('R', 0, 2, NULL, 1, 'user'), ('R', 1, 2, NULL, 1, 'user'), ('R', 3, 2, NULL, 1, 'user'), ('R', 2, 3, NULL, 1, 'assistant')),
ids AS (SELECT DISTINCT conv_id FROM conversations),
st AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, {{'cost': 0, 'audit': '', 'pieces': CAST([] AS VARCHAR[])}} AS best FROM ids
  UNION ALL SELECT st.conv_id, row_.i, act.t, min({{'cost': st.best.cost + 5 * ins.n + act.price + CASE WHEN e <> 'D' AND fault = 't' THEN 5 ELSE 0 END,
    'audit': st.best.audit || repeat('I', ins.n) || e,
    'pieces': list_concat(list_concat(st.best.pieces, ins.pieces), CASE WHEN e = 'D' THEN [] ELSE [coalesce(name, r) || ':' || x] END)}})
  FROM st JOIN row_ ON row_.conv_id IS NOT DISTINCT FROM st.conv_id AND row_.i = st.i + 1 JOIN ins ON ins.s = st.s JOIN act ON act.s = ins.t
  WHERE (e = 'D' OR fault NOT IN ('b', 'd')) AND (act.q IS NULL OR act.q = row_.q) GROUP BY st.conv_id, row_.i, act.t),
done AS (SELECT conv_id, min({{'cost': best.cost + 5 * n, 'audit': best.audit || repeat('I', n), 'pieces': list_concat(best.pieces, ins.pieces)}}) AS best
  FROM st JOIN ins USING (s) WHERE ins.t IN (0, 3) AND i = (SELECT count(*) FROM row_ WHERE row_.conv_id IS NOT DISTINCT FROM st.conv_id) GROUP BY conv_id),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (q2 IS NOT NULL AND q || q2 NOT IN ('su', 'ua', 'au')) AS illegal FROM row_ GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, sha256(array_to_string(best.pieces, chr(10))) AS repaired_sha256
FROM ids LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM ids.conv_id JOIN done ON done.conv_id IS NOT DISTINCT FROM ids.conv_id"""


SQL = {
    "op2_quality_rules": _quality_sql(),
    "op4_line_templates": _lines_sql(),
    "op9_decontamination": _DECONTAMINATION,
    "op10_url_filter": _url_sql(),
    "op12_prefix_trie": _TRIE,
    "op13_turn_repair": _REPAIR,
}
