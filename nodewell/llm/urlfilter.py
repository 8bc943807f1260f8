"""URL filters: host and path rules, and a list of canonical URLs behind a blocked Bloom filter."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from nodewell.llm.common import fresh, materialise, possible_members

#: (host, path, verdict); a rule fits its host and all subdomains if the path starts with the rule's.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Parameters that only track, as a pattern of their names.
TRACKING = "^(utm_.*|ref|gclid|fbclid)(=.*)?$"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first :// up to / ? # or end, A-Z lower-cased; then up to ? # or end. Null or no ://: both empty."""
    whole = F.coalesce(url, F.lit(""))
    has = F.instr(whole, "://") > 0
    rest = F.substring_index(whole, "://", 1)
    after = F.when(has, F.substring(whole, F.length(rest) + 4, F.length(whole))).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(after, "(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(after, "(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def canonical_url(url: Column) -> Column:
    """host/path?query in one spelling: no scheme, www. or m., default port, fragment, tracking parameter,
    closing slash or .html; parameters sorted. Null or no ://: the empty string, which no list contains."""
    host, path = split_url(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^[^?#]*\\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    left = F.regexp_replace(F.regexp_replace(host, "^(www|m)\\.", ""), ":(80|443)$", "")
    page = F.regexp_replace(F.regexp_replace(path, "/+$", ""), "\\.html?$", "")
    return F.concat(left, page, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    fitting = F.lit(None).cast("struct<rule: string, verdict: string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fitting = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fitting)
    return fitting


def match_listed(df: DataFrame, url: str, listed: DataFrame, max_filter_mb: int = 8, bits_per_url: int = 12) -> DataFrame:
    """df with a boolean column `listed`: whether its canonical URL is in listed (one column, url, of canonical URLs).

    The filter has 512-bit blocks, as many as the list needs but max_filter_mb at most, so its broadcast is bounded
    by construction; a list beyond that only lets more rows through to the exact join. Rows that the filter passes
    are joined with the list by hash; the others never leave their task. URLs of any length are taken whole. Null or malformed URLs are not listed,
    repeated ones count once, rows and other columns of df are kept as they are.
    """
    df = df.drop("listed")
    names = materialise(listed.select("url").where("url <> ''").distinct(), "listed-urls")
    own, on_it, maybe = (fresh(df, c) for c in ("_nw_c", "_nw_in", "_nw_maybe"))
    canon = df.withColumn(own, canonical_url(F.col(url)))
    exact = names.select(F.col("url").alias(own), F.lit(True).alias(on_it))
    probed = possible_members(canon, exact, [own], maybe, max_filter_mb, bits_per_url)
    passed = probed.where(F.col(maybe)).join(exact, own, "left").withColumn("listed", F.coalesce(on_it, F.lit(False)))
    rest = probed.where(~F.col(maybe)).withColumn("listed", F.lit(False))
    return passed.select(*df.columns, "listed").unionByName(rest.select(*df.columns, "listed"))


def judge_urls(df: DataFrame, listed: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """df with host, path, rule, listed and verdict: the longest fitting rule's, else block if the URL is listed, else allow.

    Columns of df with these names are replaced; see match_listed for nulls and repeated rows."""
    df = df.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url])
    host, path = split_url(F.col(url))
    out = match_listed(df, url, listed).withColumns({"host": host, "path": path})
    own = fresh(out, "_nw_r")
    out = out.withColumn(own, rule_of(F.col("host"), F.col("path"), rules))
    return out.withColumns({"rule": F.col(f"{own}.rule"), "verdict": F.coalesce(f"{own}.verdict", F.when(F.col("listed"), "block").otherwise("allow"))}).drop(own)
