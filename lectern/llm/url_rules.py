"""URL filter: pattern rules indexed by their rarest literal token.

Each rule is a regular expression with the literal tokens that every matching address must hold. A rule is filed under
the one of its tokens that the fewest addresses hold; an address fetches the rules filed under its own tokens, and only
those run their expressions. A rule without a literal token is filed under the empty token, which every address holds.

Nulls and addresses without `://` have an empty host and path, match no rule that has tokens, and are allowed. Repeated
addresses are judged once and every row gets the verdict; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import shielded

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """`name` is reported for place rules and null for patterns; `rank` orders the rules that match, highest first."""

    name: str | None
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def place_rule(verdict: str, place: str) -> Rule:
    """Rule for a host with all its subdomains, and for the paths that start with the one given, as in `org/es/`.

    The last part of the path may go on in the address, so it is no literal token unless a slash ends it.
    """
    whole = re.sub(r"[^/.\-]+$", "", place)
    tokens = tuple(t for t in re.split("[^a-z0-9]+", whole.lower()) if t)
    return Rule(place, verdict, rf"^(?:[^/]*\.)?{_quoted(place)}", tokens, len(place))


def pattern_rule(pattern: str, *tokens: str) -> Rule:
    """Blocks the addresses (host and path) that match, unless a place rule fits them."""
    return Rule(None, "block", pattern, tokens, 0)


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


#: The place rules of the contract.
PLACES = (
    place_rule("allow", "org/"),
    place_rule("block", "example.org/es/"),
    place_rule("block", "example.org/en/1"),
    place_rule("allow", "com/fr/"),
    place_rule("block", "com/de/"),
)
#: Hosts and paths that a corpus builder leaves out wherever they stand.
PATTERNS = (
    pattern_rule(r"^(?:[^/]*[.-])?casino[.-]", "casino"),
    pattern_rule(r"^(?:[^/]*[.-])?(?:cheap|online)-pills[.-]", "pills"),
    pattern_rule(r"^(?:[^/]*[.-])?free-bets[.-]", "free", "bets"),
    pattern_rule(r"^(?:[^/]*[.-])?poker[.-]", "poker"),
    pattern_rule(r"^(?:[^/]*[.-])?adult-", "adult"),
    pattern_rule(r"^(?:[^/]*[.-])?spam-", "spam"),
    pattern_rule(r"^(?:[^/]*[.-])?ads?-track[.-]", "track"),
    pattern_rule(r"/(?:login|signin)(?:/|$)"),
)


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(i).alias("_rule"),
            F.lit(r.name).cast("string").alias("name"),
            F.lit(r.verdict).alias("verdict"),
            F.lit(r.pattern).alias("pattern"),
            F.array(*[F.lit(t) for t in r.tokens or ("",)]).alias("tokens"),
            F.lit(r.rank).alias("rank"),
        )
        for i, r in enumerate(rules)
    ]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def rule_index(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """`rules` with the token each is filed under: the one that the fewest rows of `tokens` hold, ties to the first."""
    held = rules.select("_rule", F.explode(F.array_distinct("tokens")).alias("_token"))
    wanted = held.select("_token").distinct()
    counts = tokens.join(wanted, "_token", "left_semi").groupBy("_token").agg(F.count(F.lit(1)).alias("_n"))
    rarest = (
        held.join(counts, "_token", "left")
        .groupBy("_rule")
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_token").alias("token"))).alias("_r"))
    )
    return rules.join(rarest, "_rule").select("_rule", F.col("_r.token").alias("_token"), "name", "verdict", "pattern", "rank")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The winning rule of each distinct `url` that any rule matches: `url`, `name`, `verdict`.

    The highest rank wins, ties to the smaller name, then to the earlier rule.
    """
    place = F.concat(host(F.col("url")), path(F.col("url")))
    words = F.split(F.translate(place, UPPER, LOWER), "[^a-z0-9]+")
    held = urls.select("url").where("url IS NOT NULL").distinct().select(
        "url", place.alias("_place"), F.explode(F.array_distinct(F.concat(words, F.array(F.lit(""))))).alias("_token")
    )
    index = rule_index(held.select("_token"), rules)
    return (
        held.join(index, "_token")
        .where(F.rlike("_place", F.col("pattern")))
        .groupBy("url")
        .agg(F.min(F.struct((-F.col("rank")).alias("r"), "name", "_rule", "verdict")).alias("_best"))
        .select("url", F.col("_best.name").alias("name"), F.col("_best.verdict").alias("verdict"))
    )


@shielded()
def judge(pages: DataFrame, rules: tuple[Rule, ...] = PLACES + PATTERNS) -> DataFrame:
    """`pages` with `host`, `path`, `rule` (null where no place rule fits) and `verdict` (`allow` or `block`)."""
    best = matches(pages, rule_table(pages.sparkSession, rules)).select(
        F.col("url").alias("_url"), F.col("name").alias("_name"), F.col("verdict").alias("_verdict")
    )
    kept = [pages[c] for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return pages.join(best, pages["url"] == F.col("_url"), "left").select(
        *kept,
        host(pages["url"]).alias("host"),
        path(pages["url"]).alias("path"),
        F.col("_name").alias("rule"),
        F.coalesce("_verdict", F.lit("allow")).alias("verdict"),
    )
