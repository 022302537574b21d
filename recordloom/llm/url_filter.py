"""URL filter: ordered path rules, then a weighted vocabulary found by Aho-Corasick.

Every defined case: a null url, or one without ``://``, has an empty host and path and meets
no rule; the vocabulary is still searched (null: nothing found). Repeated rows are judged
alike. Extra input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import ascii_lower, map_batches

# Terms that reject alone, and terms that reject together (with weights).
STRICT_TERMS = ("adult", "casino", "escort", "hentai", "porn", "sexcam", "spam", "viagra", "xxx")
SOFT_TERMS = {
    "bet": 1.0, "bonus": 1.0, "cam": 1.0, "cheap": 1.0, "dating": 1.0, "farm": 1.0, "free": 1.0, "jackpot": 1.0,
    "loan": 1.0, "nude": 1.0, "pills": 1.0, "poker": 1.0, "sex": 1.0, "slots": 1.0, "win": 1.0,
}
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, action) of the longest rule that fits, else null. Equal lengths: the longer host, then the text."""
    found = None
    for action, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(action).alias("action"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    if found is None:
        return F.lit(None).cast("struct<rule:string,action:string>")
    return found


def term_hits(
    urls: DataFrame, keep: Sequence[str], url: str = "url",
    strict: Sequence[str] = STRICT_TERMS, soft: Mapping[str, float] = SOFT_TERMS,
) -> DataFrame:
    """``keep`` columns, n_strict and n_soft (distinct terms found), soft_weight (their summed weights).

    A term counts only between boundaries: no letter or digit of ASCII next to it. All terms
    are found in one pass over the lower-cased url, whatever their number.
    """
    kinds = {t: ("strict", 1.0) for t in strict} | {t: ("soft", w) for t, w in soft.items() if t not in set(strict)}
    inner = urls.select(*keep, F.col(url).alias("_url_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1])

    def task():
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term in kinds:
            machine.add_word(term, term)
        if kinds:
            machine.make_automaton()
        inside = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

        def terms_in(text):
            found = set()
            for end, term in machine.iter(text) if kinds else ():
                start = end - len(term) + 1
                if (start == 0 or text[start - 1] not in inside) and (end + 1 == len(text) or text[end + 1] not in inside):
                    found.add(term)
            return found

        lower = {c: c + 32 for c in range(65, 91)}

        def handle(columns):
            hits = [terms_in((t or "").translate(lower)) for t in columns["_url_text"].to_pylist()]
            yield {k: columns[k] for k in keep} | {
                "n_strict": [sum(kinds[t][0] == "strict" for t in h) for h in hits],
                "n_soft": [sum(kinds[t][0] == "soft" for t in h) for h in hits],
                "soft_weight": [float(sum(kinds[t][1] for t in sorted(h) if kinds[t][0] == "soft")) for h in hits],
            }

        return handle

    return map_batches(inner, schema + ", n_strict long, n_soft long, soft_weight double", task)


def filter_urls(
    pages: DataFrame, id_column: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES,
    strict: Sequence[str] = STRICT_TERMS, soft: Mapping[str, float] = SOFT_TERMS, soft_limit: int = 2, weight_limit: float = 2.0,
) -> DataFrame:
    """(id, url, host, path, rule, verdict, n_strict, n_soft, soft_weight) for every page.

    The verdict is the rule's; without a rule, ``block`` on one strict term, or on
    ``soft_limit`` distinct soft terms whose weights reach ``weight_limit``.
    """
    narrow = pages.select(F.col(id_column).alias("_id"), F.col(url).alias("_url"))
    hits = term_hits(narrow, ["_id", "_url"], "_url", strict, soft)
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    blocked = (F.col("n_strict") >= 1) | ((F.col("n_soft") >= soft_limit) & (F.col("soft_weight") >= weight_limit))
    return (
        hits.withColumn("host", host_of(F.col("_url")))
        .withColumn("path", path_of(F.col("_url")))
        .withColumn("_rule", rule)
        .select(
            F.col("_id").alias(id_column), F.col("_url").alias(url), "host", "path", F.col("_rule.rule").alias("rule"),
            F.coalesce(F.col("_rule.action"), F.when(blocked, "block").otherwise("allow")).alias("verdict"),
            "n_strict", "n_soft", "soft_weight",
        )
    )
