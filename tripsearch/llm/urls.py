"""URL filters: site rules and pattern rules behind one index of rare literal tokens.

A rule is fetched by one token only, the rarest of its literal tokens among the URLs at hand, and
only fetched rules run their regular expression. Verdicts are made per distinct URL and joined
back, so a URL that a third of all rows share costs one evaluation per task.

Pattern syntax: literal text, ``*`` for any text, ``^`` for one separator or the end, ``|`` at either
end for an anchor. Patterns are matched against the URL with A-Z lower-cased.

Defined results: a null URL, or one without ``://``, has an empty host and path; it fits no site
rule, and a null URL fits no pattern either. Repeated rows give repeated results. Of fitting site
rules the longest wins (ties: the smaller text); without one, an allowing pattern beats a
blocking one; without any, the verdict is ``allow``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules are written by people; more than this many belong in a table of their own.
MOST_RULES = 100_000

#: (action, host, path) of the site rules, fixed values of the registered query.
SITE_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: (action, pattern) for URLs that no site rule fits.
PATTERN_RULES = (
    ("block", "utm_source=feed^"),
    ("block", "://m.*/de/"),
    ("block", "?page=*&ref="),
    ("allow", "://blog.*.org/de/"),
    ("block", "^login^"),
    ("block", ".exe|"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def site_regex(host: str, path: str) -> str:
    """On ``host || path``; a host has no slash and a path is empty or starts with one."""
    return rf"^(?:[^/]*\.)?{re.escape(host)}(?=/|\z){re.escape(path)}"


def pattern_regex(pattern: str) -> str:
    inner = pattern.removeprefix("|").removesuffix("|")
    parts = {"*": ".*", "^": r"(?:[^a-z0-9_.%-]|\z)"}
    body = "".join(parts.get(c, re.escape(c)) for c in inner)
    start = r"\A" if pattern.startswith("|") else ""
    end = r"\z" if pattern.endswith("|") and len(pattern) > 1 else ""
    return f"(?s){start}{body}{end}"


def literal_tokens(text: str) -> list[str]:
    """Runs of letters and digits that any match holds as whole tokens: no wildcard beside them."""
    found = []
    for m in re.finditer(r"[a-z0-9]+", text):
        before, after = text[: m.start()][-1:], text[m.end() :][:1]
        if before not in ("", "*") and after not in ("", "*"):
            found.append(m[0])
    return found


def rule_rows(sites: Sequence[tuple], patterns: Sequence[tuple]) -> list[tuple]:
    """(rule number, kind, action, text, regex, literal tokens)."""
    rows = []
    for action, host, path in sites:
        # the host ends at a slash or the end and starts at a dot or the start: its labels are whole
        rows.append(("site", action, host + path, site_regex(host, path), literal_tokens(f".{host}/") + literal_tokens(path)))
    for action, pattern in patterns:
        anchored = re.sub(r"^\||\|$", "^", pattern)
        rows.append(("pattern", action, pattern, pattern_regex(pattern), literal_tokens(anchored)))
    if len(rows) > MOST_RULES:
        raise ValueError(f"{len(rows)} rules; write them as a table")
    return [(i, *r) for i, r in enumerate(rows)]


def _tokens(url: Column) -> Column:
    """Distinct tokens, and the empty token that fetches rules without a literal one."""
    return F.array_distinct(F.split(F.concat(F.lit("/"), F.translate(url, UPPER, LOWER), F.lit("/")), "[^a-z0-9]+"))


def token_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per rule with the token that fetches it: its rarest among ``urls`` (url_text)."""
    wanted = rules.select("rule_no", F.explode_outer("literals").alias("literal"))
    seen = (
        urls.select(F.explode(_tokens(F.col("url_text"))).alias("literal"))
        .groupBy("literal").agg(F.count("*").alias("uses"))
    )
    return (
        wanted.join(seen, "literal", "left")
        .groupBy("rule_no")
        .agg(F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("literal", F.lit("")).alias("literal"))).alias("rarest"))
        .select("rule_no", F.col("rarest.literal").alias("literal"))
    )


def filter_urls(
    pages: DataFrame,
    sites: Sequence[tuple] = SITE_RULES,
    patterns: Sequence[tuple] = PATTERN_RULES,
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """``key``, host, path, rule (the site rule that decided, else null), verdict."""
    spark = pages.sparkSession
    rows = pages.select(F.col(key).alias("row_key"), F.col(url).alias("row_url"))
    urls = rows.filter("row_url is not null").select(F.col("row_url").alias("url_text")).distinct()
    rules = spark.createDataFrame(
        rule_rows(sites, patterns),
        "rule_no int, kind string, action string, text string, regex string, literals array<string>",
    )
    index = token_index(urls, rules).join(rules.drop("literals"), "rule_no")
    fetched = urls.select("url_text", F.explode(_tokens(F.col("url_text"))).alias("literal")).join(index, "literal")
    subject = F.when(
        F.col("kind") == "site", F.concat(host_of(F.col("url_text")), path_of(F.col("url_text")))
    ).otherwise(F.translate("url_text", UPPER, LOWER))
    fits = fetched.filter(F.regexp_like(subject, F.col("regex")))
    site, pattern = F.col("kind") == "site", F.col("kind") == "pattern"
    decided = fits.groupBy("url_text").agg(
        F.min(F.when(site, F.struct((-F.length("text")).alias("size"), "text", "action"))).alias("site"),
        F.max(F.when(pattern, F.col("action") == "allow")).alias("spared"),
        F.max(F.when(pattern, F.col("action") == "block")).alias("struck"),
    )
    by_pattern = F.when(F.coalesce("struck", F.lit(False)) & ~F.coalesce("spared", F.lit(False)), "block").otherwise("allow")
    return rows.join(decided, rows["row_url"] == decided["url_text"], "left").select(
        F.col("row_key").alias(key),
        F.coalesce(host_of(F.col("row_url")), F.lit("")).alias("host"),
        F.coalesce(path_of(F.col("row_url")), F.lit("")).alias("path"),
        F.col("site.text").alias("rule"),
        F.coalesce(F.col("site.action"), by_pattern).alias("verdict"),
    )
