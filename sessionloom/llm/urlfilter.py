"""URL filter: host and path rules, then a weighted vocabulary counted by Aho-Corasick."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import per_worker

#: Verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: One hit rejects.
STRICT = ("porn", "porno", "pornography", "xxx", "hentai", "milf", "camgirls", "escorts", "warez", "keygen", "phishing")
#: Several distinct hits reject.
SOFT = ("adult", "sex", "nude", "casino", "poker", "betting", "gambling", "slots", "loan", "payday", "viagra", "cialis",
        "pills", "torrent", "crack", "free", "cheap", "dating", "escort", "hot", "win", "bonus", "replica", "coupon")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path by the text alone; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a longer one overrides
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def term_hits(url: Column, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT) -> Column:
    """Struct (strict, soft) of the distinct terms found in a URL as whole words.

    One automaton over both lists reads each URL once; a hit counts if no ASCII letter or digit
    stands right before or after it. Letter case is ignored. Null or empty: no hits.
    """
    terms = {**{t: 1 for t in soft}, **{t: 0 for t in strict}}
    key = ("url terms", tuple(sorted(terms.items())))

    def build():
        import ahocorasick

        found = ahocorasick.Automaton()
        for t, kind in terms.items():
            found.add_word(t, (t, kind))
        found.make_automaton()
        return found

    @F.pandas_udf("strict int, soft int")
    def hits(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = per_worker(key, build)
        word = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        for batch in urls:
            rows = []
            for u in batch.fillna("").str.lower():
                seen = set()
                for end, (t, kind) in automaton.iter(u):
                    before = end - len(t)
                    if (before < 0 or u[before] not in word) and (end + 1 == len(u) or u[end + 1] not in word):
                        seen.add((kind, t))
                n = sum(kind for kind, _ in seen)
                rows.append((len(seen) - n, n))
            yield pd.DataFrame(rows, columns=["strict", "soft"])

    return hits(url)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT,
               soft: Sequence[str] = SOFT, soft_limit: int = 2) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits of every row.

    The longest rule that fits decides; else one strict term, or ``soft_limit`` distinct soft
    terms, blocks. Null or malformed URLs have an empty host and path and are judged by their
    terms alone. Every row gives a row, repeated ones too; other columns are ignored. No shuffle.
    """
    urls = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    hits = F.col("hits")
    worded = F.when((hits["strict"] >= 1) | (hits["soft"] >= soft_limit), "block").otherwise("allow")
    return (
        urls.withColumn("hits", term_hits(F.col("url"), strict, soft))
        .withColumns({"host": host, "path": path})
        .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, worded).alias("verdict"),
                hits["strict"].alias("strict_hits"), hits["soft"].alias("soft_hits"))
    )
