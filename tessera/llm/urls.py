"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression that can only match a URL holding certain literal tokens. Tokens of all URLs are
counted, each rule is filed under its rarest one, and a URL's tokens fetch its candidate rules by a join: a regular
expression runs only on the URLs that hold its token.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import shared_table, skew_join

#: What parts tokens.
GAP = "[^A-Za-z0-9]+"


@dataclass(frozen=True)
class UrlRule:
    """name, verdict, priority (a longer host-and-path rule wins; word rules come after all of them), regular
    expression over host and path, and the literal tokens that it needs."""

    name: str
    verdict: str
    rank: int
    pattern: str
    literals: tuple[str, ...]


def path_rule(verdict: str, host: str, path: str) -> UrlRule:
    """A rule for a host with all its subdomains and a path prefix."""
    whole = path.rpartition("/")[0]  # what stands after the last slash may be part of a token
    literals = tuple(t for t in re.split(GAP, host + whole) if t)
    dots = re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", host + path)
    return UrlRule(host + path, verdict, len(host + path), rf"^(?:[^/]*\.)?{dots}", literals)


def word_rule(verdict: str, *words: str) -> UrlRule:
    """A rule for hosts that hold these words as tokens, one after another."""
    name = "-".join(words)
    return UrlRule(name, verdict, 0, r"^(?:[^/]*[^A-Za-z0-9/])?" + "[^A-Za-z0-9/]+".join(words) + "(?:[^A-Za-z0-9]|$)", words)


#: The contract's rules.
BASE_RULES = [
    path_rule("block", "net", "/"),
    path_rule("allow", "example.net", "/en/"),
    path_rule("block", "example.com", "/de/"),
    path_rule("allow", "org", "/fr/"),
]
#: The method's own, for URLs that no rule above fits: words that tell what a host sells, and pairs of a word that
#: praises or prices with one that needs it to tell.
WORDS = "casino poker roulette jackpot viagra cialis porn xxx escort warez keygen".split()
PRAISE = "free cheap best buy online discount live instant no easy fast win top order".split()
WARES = "bets betting slots pills pharmacy meds loans payday credit dating cams essays replica watches followers crack serial lottery".split()
WORD_RULES = [word_rule("block", w) for w in WORDS] + [word_rule("block", a, b) for a in PRAISE for b in WARES]
#: Rules that a broadcast may hold; more meet the tokens by a shuffle.
MOST_RULES = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path, as they are written; both empty without ``://``."""
    found = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(url, found, 1), upper, upper.lower()), F.regexp_extract(url, found, 2)


RULE_SCHEMA = "rule string, verdict string, rank int, pattern string, literals array<string>"


def rule_table(spark: SparkSession, rules: list[UrlRule]) -> DataFrame:
    return spark.createDataFrame([(r.name, r.verdict, r.rank, r.pattern, list(r.literals)) for r in rules], RULE_SCHEMA)


def read_rules(listed: DataFrame) -> DataFrame:
    """Rules of a table of verdict, host, path and words: a row gives a host-and-path rule, or where host is null a
    rule for the words, which blanks part. The table may come from any source and be of any length."""
    quoted = F.regexp_replace(F.concat("host", F.coalesce("path", F.lit("/"))), r"([^A-Za-z0-9/_-])", r"\\$1")
    name = F.concat("host", F.coalesce("path", F.lit("/")))
    before_last = F.regexp_extract(name, "^(.*)/", 1)
    parts = F.array_remove(F.split(F.trim("words"), " +"), "")
    of_words = F.concat(F.lit(r"^(?:[^/]*[^A-Za-z0-9/])?"), F.array_join(parts, "[^A-Za-z0-9/]+"), F.lit("(?:[^A-Za-z0-9]|$)"))
    by_host = F.col("host").isNotNull()
    return listed.where(by_host | (F.size(parts) > 0)).select(
        F.when(by_host, name).otherwise(F.array_join(parts, "-")).alias("rule"), "verdict",
        F.when(by_host, F.length(name)).otherwise(0).alias("rank"),
        F.when(by_host, F.concat(F.lit(r"^(?:[^/]*\.)?"), quoted)).otherwise(of_words).alias("pattern"),
        F.when(by_host, F.array_remove(F.split(before_last, GAP), "")).otherwise(parts).alias("literals"),
    )


def rule_index(tokens: DataFrame, table: DataFrame) -> DataFrame:
    """token, rule, verdict, rank, pattern: each rule of table under its literal with the fewest URLs.

    tokens holds a row per URL and distinct token.
    """
    wanted = table.select("rule", "verdict", "rank", "pattern", F.explode("literals").alias("token"))
    # Tokens are counted before they meet the rules, so that a frequent one is no single task.
    counts = tokens.groupBy("token").agg(F.count("*").alias("n")).join(wanted.select("token").distinct(), "token", "left_semi")
    rarest = Window.partitionBy("rank", "rule").orderBy(F.coalesce("n", F.lit(0).cast("long")), "token")
    placed = wanted.join(counts, "token", "left").withColumn("o", F.row_number().over(rarest))
    return placed.where("o = 1").select("token", "rule", "verdict", "rank", "pattern")


def judge(pages: DataFrame, rules: list[UrlRule] | DataFrame | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages.

    rule names the longest fitting host-and-path rule, null without one; verdict is that rule's, else a word
    rule's, else the default. Null URLs and those without ``://`` have empty host and path, and fit no rule. Rules
    are a list, or a table as of read_rules(). Repeated rows are judged each, by one look at their host and path;
    columns of pages beside page_id and url are not looked at.
    """
    rules = BASE_RULES + WORD_RULES if rules is None else rules
    table = rules if isinstance(rules, DataFrame) else rule_table(pages.sparkSession, rules)
    host, path = host_and_path(pages["url"])
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    places = shared_table(rows.groupBy("host", "path").agg(F.count("*").alias("_n")), "places")
    whole = F.concat("host", "path")
    tokens = places.select("host", "path", F.explode(F.array_distinct(F.split(whole, GAP))).alias("token"))
    index = shared_table(rule_index(tokens, table), "rules")
    index = F.broadcast(index) if index.count() <= MOST_RULES else index
    fits = tokens.join(index, "token").where(F.regexp_like(whole, F.col("pattern")))
    best = fits.groupBy("host", "path").agg(
        F.max_by(F.struct("rule", "verdict", "rank"), F.struct("rank", F.col("rule"))).alias("best")
    )
    judged = shared_table(places.join(best, ["host", "path"], "left"), "judged")
    found = skew_join(rows, judged, ["host", "path"], pages.count())
    return found.select(
        "page_id", "host", "path",
        F.when(F.col("best.rank") > 0, F.col("best.rule")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
