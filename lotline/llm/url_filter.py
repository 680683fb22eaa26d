"""URL filters: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: An index of more rules than this is joined on tokens; a smaller one is part of the expression, so that no URL is shuffled.
PLAIN_RULES = 1_000


class Rule(NamedTuple):
    """A pattern on URLs. literals: tokens that every URL it fits has."""

    name: str
    kind: str  # "place" (host and path, decides first) or "pattern" (whole URL, lower-cased)
    regex: str
    literals: tuple[str, ...]
    verdict: str
    weight: int = 0  # of place rules that fit, the largest decides


def place(text: str, verdict: str) -> Rule:
    """A rule such as "example.org/es/": the host and its subdomains, paths that begin so."""
    host, _, path = text.partition("/")
    path = "/" + path
    whole = re.split(r"[^A-Za-z0-9]+", path)[:-1]  # the last token may go on in a URL
    literals = [t for t in [*re.split(r"[^a-z0-9]+", host), *(t.lower() for t in whole)] if t]
    quoted = "\\Q" + (host + path) + "\\E"
    return Rule(text, "place", rf"^(?:[^/]*\.)?{quoted}", tuple(dict.fromkeys(literals)), verdict, len(text) * 1000 + len(host))


def pattern(name: str, regex: str, literals: tuple[str, ...], verdict: str = "block") -> Rule:
    """A regular expression on the lower-cased URL."""
    return Rule(name, "pattern", regex, literals, verdict)


#: The rules on places that the query applies.
PLACES = (place("org/", "allow"), place("example.org/es/", "block"), place("example.org/en/1", "block"), place("com/fr/", "allow"), place("com/de/", "block"))

#: Patterns for unwanted pages where no place rule fits. Words that may be joined are a rule each, as they are one token.
PATTERNS = (
    pattern("casino", r"://[^/?#]*\bcasino\b", ("casino",)),
    pattern("pills", r"://[^/?#]*\b(?:cheap|buy|discount)[-_.]pills?\b", ("pills",)),
    *(pattern("pills", rf"://[^/?#]*\b{x}\b", (x,)) for x in ("cheappills", "cheappill", "buypills", "buypill", "discountpills", "discountpill")),
    pattern("pill", r"://[^/?#]*\b(?:cheap|buy|discount)[-_.]pill\b", ("pill",)),
    pattern("bets", r"://[^/?#]*\b(?:free|best|live)[-_.]bets?\b", ("bets",)),
    pattern("bet", r"://[^/?#]*\b(?:free|best|live)[-_.]bet\b", ("bet",)),
    *(pattern("adult", rf"://[^/?#]*\b{x}\b", (x,)) for x in ("xxx", "porn", "adult")),
    pattern("replica", r"\breplica[-_.](?:watch|watches|bags)\b", ("replica",)),
    *(pattern("replica", rf"\b{x}\b", (x,)) for x in ("replicawatch", "replicawatches", "replicabags")),
    *(pattern("loan", rf"\b{x}[-_.]loans?\b", (x,)) for x in ("payday", "quick", "instant")),
    pattern("download", r"\b(?:crack|keygen|warez)\b.*\bdownload\b", ("download",)),
)


def tokens(url):
    """The distinct tokens of a URL, lower-cased; "" is a token of each."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(ascii_lower(url), "[^a-z0-9]+")))


#: Of a rule in the index.
RULE = "struct<rule_no: int, name: string, kind: string, regex: string, rule_verdict: string, weight: int>"


def _index(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(token, rules): each rule under that one of its literals which is rarest among the tokens of all URLs.

    A rule without literals stands under "", which every URL has.
    """
    table = rows.sparkSession.createDataFrame([(i, *r[:3], list(r.literals) or [""], r.verdict, r.weight) for i, r in enumerate(rules)], "rule_no int, name string, kind string, regex string, literals array<string>, rule_verdict string, weight int")
    literals = table.select("rule_no", F.explode("literals").alias("token"))
    asked = literals.select("token").distinct()
    seen = rows.select(F.explode(tokens(F.col("url"))).alias("token")).groupBy("token").agg(F.count("*").alias("df")).join(asked, "token", "left_semi")
    rarest = literals.join(seen, "token", "left").groupBy("rule_no").agg(F.min_by("token", F.struct(F.coalesce("df", F.lit(0)), "token")).alias("token"))
    return table.join(rarest, "rule_no").groupBy("token").agg(F.sort_array(F.collect_list(F.struct("rule_no", "name", "kind", "regex", "rule_verdict", "weight"))).alias("rules"))


def _fits(rule, url, place):
    return F.rlike(F.when(rule["kind"] == "place", place).otherwise(url), rule["regex"])


def judged(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = PLACES + PATTERNS) -> DataFrame:
    """Each page's host, path, deciding rule and verdict.

    Each rule stands in the index under that one of its literals which is rarest
    among the URLs' tokens (counted over all rows). A URL's tokens fetch candidate
    rules, and only those run their regular expression. The place rule of the
    largest weight decides; else a fitting pattern does, block before allow; else
    allow. An index of up to PLAIN_RULES rules is a map in the expression and no
    URL is shuffled; the tokens of URLs are joined with a larger one.

    Null URLs and URLs without "://" have empty host and path and fit no place
    rule. Repeated rows are returned as often as they come. Only key and URL are
    read.
    """
    rows = pages.select(F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"))
    index = _index(rows, rules)
    parsed = rows.select("key", ascii_lower(F.col("url")).alias("low"), "url", ascii_lower(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("host"), F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("path"))
    if len(rules) <= PLAIN_RULES:
        found = index.collect()
        fetch = F.create_map(*(c for r in found for c in (F.lit(r["token"]), F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in x.asDict().items())) for x in r["rules"])))))
        none = F.array().cast(f"array<{RULE}>")
        candidates = F.flatten(F.transform(tokens(F.col("url")), lambda t: F.coalesce(F.try_element_at(fetch.cast(f"map<string, array<{RULE}>>"), t), none))) if found else none
        judged = parsed.withColumn("tried", candidates)
    else:
        # rows get a number, as keys and URLs may repeat; URLs of which no token is in the index need no join
        numbered = written(parsed.withColumn("row", F.monotonically_increasing_id()), "url-rows")
        met = numbered.select("row", F.explode(tokens(F.col("url"))).alias("token")).join(index, "token").groupBy("row").agg(F.flatten(F.collect_list("rules")).alias("tried"))
        judged = numbered.join(met, "row", "left")
    place = F.concat("host", "path")
    fitting = lambda kind: F.filter("fitting", lambda r: r["kind"] == kind)
    judged = judged.withColumn("fitting", F.filter("tried", lambda r: _fits(r, F.col("low"), place)))
    best = judged.withColumn("place", F.array_max(F.transform(fitting("place"), lambda r: F.struct(r["weight"], r["name"], r["rule_verdict"])))).withColumn("pattern", F.array_max(F.transform(fitting("pattern"), lambda r: F.struct((r["rule_verdict"] == "block").alias("block"), r["name"], r["rule_verdict"]))))
    return best.select(
        F.col("key").alias(key),
        "host",
        "path",
        F.col("place.name").alias("rule"),
        F.coalesce("place.rule_verdict", "pattern.rule_verdict", F.lit("allow")).alias("verdict"),
        F.when(F.col("place").isNull(), F.col("pattern.name")).alias("pattern"),
        F.coalesce(F.size("tried"), F.lit(0)).cast("long").alias("rules_tried"),
    )
