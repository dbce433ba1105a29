"""URL filters: host and path rules first, a weighted vocabulary for the rest.

The vocabulary is searched by an Aho-Corasick automaton over the lower-cased host and path. A hit counts only
between boundaries: neither the character before nor the one after may be an ASCII letter or digit. One strict
term, or `soft_limit` different soft terms, block a page.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path). A rule fits its host and all subdomains if the path starts with the rule's path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
STRICT = ["casino", "jackpot", "malware", "phishing", "porn", "viagra", "warez", "xxx"]
SOFT = ["ad", "ads", "bet", "bonus", "cheap", "click", "coupon", "deal", "free", "loan", "offer", "promo", "sale", "spam", "utm_source", "win"]
SOFT_LIMIT = 2


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits (length of host and path together), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def automaton(strict: Sequence[str], soft: Sequence[str]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (2, strict)):
        for t in terms:
            made.add_word(t.lower(), (weight, t.lower()))
    made.make_automaton()
    return made


def blocked(text: str, made, soft_limit: int = SOFT_LIMIT) -> bool:
    """Whether a lower-cased text has one strict term, or soft_limit different soft terms, between boundaries."""
    soft = set()
    inside = lambda c: c.isascii() and c.isalnum()
    for end, (weight, term) in made.iter(text):
        start = end + 1 - len(term)
        if (start and inside(text[start - 1])) or (end + 1 < len(text) and inside(text[end + 1])):
            continue
        if weight == 2:
            return True
        soft.add(term)
        if len(soft) >= soft_limit:
            return True
    return False


def filter_urls(pages: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """Add host, path, rule and verdict (allow or block) to every row of pages.

    host: after the first :// up to /, ? or #, A-Z lower-cased; path: from there up to ? or #; both empty for
    a null url or one without ://. The longest rule that fits decides; without one, the vocabulary does,
    over the lower-cased part of the url after :// (query and fragment too; the whole url without ://). A null
    or empty url is allowed; very long ones are searched whole. Of rules of equal length the last one decides. Rows that repeat are
    judged one by one. An empty table gives an empty result; columns of the added names are replaced, others may have any name.

    Rules become one chain of tests, and so should be hundreds at most; the vocabulary is one automaton per task, of any
    size that fits in a worker.
    """
    if not soft and not strict:
        raise ValueError("the vocabulary is empty")

    @F.pandas_udf("boolean")
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = automaton(strict, soft)  # once for each task
        for texts in parts:
            yield texts.map(lambda t: t is not None and blocked(t, made, soft_limit))

    # Every column of pages is in one struct, so that no name can clash.
    own = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    rows = pages.select(F.struct(*own).alias("row"), F.col(f"`{url_col}`").alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    text = F.translate(F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"^(?s).*?://", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # What a rule has decided goes to Python as null.
    rows = rows.withColumn("blocked", judged(F.when(F.col("found").isNull(), text)))
    return rows.select("row.*", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("url")


def _oracle() -> str:
    rule = "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{h + p}' THEN '{v}'" for v, h, p in RULES)
    hit = lambda t: f"regexp_matches(t, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    strict, soft = " OR ".join(map(hit, STRICT)), " + ".join(f"{hit(t)}::INT" for t in SOFT)
    return f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
b AS (SELECT page_id, translate(regexp_extract(u, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(u, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path,
             translate(regexp_replace(u, '^(?s:.*?)://', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM a),
c AS (SELECT *, {rule} AS rule FROM b)
SELECT page_id, host, path, rule, {verdict} ELSE CASE WHEN {strict} OR {soft} >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END END AS verdict FROM c"""


ORACLE = {"op3_url_filters": _oracle()}
