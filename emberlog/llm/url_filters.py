"""URL rules looked up by their rarest literal token, in DataFrame functions only.

A rule is a regular expression with the literal tokens that any match must hold. It is indexed under
the token that the fewest URLs have. The tokens of a URL fetch candidate rules by an equi-join, and
only those run their expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.llm._store import spread_join, written

RULES = "rule string, pattern string, tokens array<string>, verdict string, tier int, weight int"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Host and path rules of the contract.
HOST_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Patterns of hosts and paths that sell or spam.
SPAM_PATTERNS = (
    "||spam-farm.", "||*.spam-farm.", "||cheap-pills^", "||cheap-pills.", "||casino.", "||casino^", "-casino.*/bonus^", "||viagra.", "/free-money^", "||xxx.", "/buy-*-online^", "||*/wp-login.php|",
)
#: The token of every url, for patterns that have none of their own.
ANY = "*"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end; empty without ``://`` or url."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def host_rule(text: str, verdict: str) -> tuple:
    """A row of ``RULES`` for ``host/path``: the host with its subdomains, and paths that start alike."""
    host, _, path = text.partition("/")
    tokens = re.findall(r"[a-z0-9]+", host.lower()) + re.findall(r"[a-z0-9]+(?=[^a-z0-9])", path.lower())
    return text, rf"\A(?:[^/]*\.)?\Q{host}/{path}\E", tokens, verdict, 1, len(text)


def pattern_rules(patterns: DataFrame) -> DataFrame:
    r"""``RULES`` of a table (pattern, verdict) of any size, which yield to any host rule.

    A pattern is matched against host and path: ``*`` is any run, ``^`` one sign that is no letter,
    digit, ``_``, ``-``, ``.`` or ``%``, or the end; ``||`` at the start is the start of a host or of a name in it, ``|`` at an
    end is that end; all else is itself, with A-Z lower-cased. The literal tokens of a pattern are its
    runs of letters and digits that no ``*`` and no open end touches: those are whole tokens of all that
    it matches. A pattern without one is tried on every url. A null or empty pattern is no rule.
    """
    p = F.translate("pattern", UPPER, LOWER)
    inner = F.regexp_replace(F.regexp_replace(p, r"\A\|{1,2}", ""), r"\|\z", "")
    body = F.regexp_replace(inner, r"([^a-z0-9*^])", r"\\$1")
    body = F.regexp_replace(F.regexp_replace(body, r"\*+", ".*"), r"\^", r"(?:[^a-z0-9_.%-]|\\z)")
    begin = F.when(p.startswith("||"), r"\A(?:[^/]*\.)?").when(p.startswith("|"), r"\A").otherwise("")
    end = F.when((F.length(p) > 1) & p.endswith("|"), r"\z").otherwise("")
    # an open end counts as a run of anything
    closed = F.concat(F.when(p.startswith("|"), "|").otherwise("*"), inner, F.when(end != "", "|").otherwise("*"))
    tokens = F.regexp_extract_all(closed, F.lit(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])"), F.lit(0))
    rules = patterns.where(F.length("pattern") > 0).select(
        F.col("pattern").alias("rule"), F.concat(F.lit("(?s)"), begin, body, end).alias("pattern"),
        F.when(F.size(tokens) > 0, F.array_distinct(tokens)).otherwise(F.array(F.lit(ANY))).alias("tokens"), "verdict", F.lit(0).alias("tier"), F.length("pattern").alias("weight"),
    )
    return rules.distinct()


def rule_table(spark: SparkSession, host_rules: Iterable[tuple[str, str]] = HOST_RULES, patterns: DataFrame | Iterable[str] = SPAM_PATTERNS) -> DataFrame:
    """``RULES`` of host rules and of patterns, a table (pattern, verdict) or some that block."""
    hosts = spark.createDataFrame([host_rule(*x) for x in host_rules], RULES)
    table = patterns if isinstance(patterns, DataFrame) else spark.createDataFrame([(x, "block") for x in patterns], "pattern string, verdict string")
    return hosts.unionByName(pattern_rules(table))


def tokens_of(address: Column) -> Column:
    found = F.filter(F.split(F.translate(address, UPPER, LOWER), "[^a-z0-9]+", -1), lambda x: x != "")
    return F.array_append(F.array_distinct(found), ANY)


def indexed(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """``rules`` with ``token``, the one of theirs that the fewest addresses have; ``tokens``: one row for each address and token."""
    numbered = rules.withColumn("_rule", F.monotonically_increasing_id())
    each = numbered.select("_rule", F.explode("tokens").alias("token"))
    counts = tokens.join(each.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("_n"))
    place = F.row_number().over(W.partitionBy("_rule").orderBy(F.coalesce("_n", F.lit(0)), "token"))
    best = each.join(counts, "token", "left").withColumn("_place", place).where("_place = 1")
    return numbered.join(best.select("_rule", "token"), "_rule").drop("_rule")


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", otherwise: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule, pattern_rule, verdict for each row of ``pages``.

    Host rules are matched to the host and path as they are, patterns to both with A-Z lower-cased.
    ``rule`` is the longest host rule that fits, or null; without one the pattern rules decide, and
    without those ``otherwise``. Of rules that are equally long the first in the alphabet is taken.
    A null url, or one without ``://``, has an empty host and path and fits no rule. Repeated rows each
    have a verdict; the work is done once for each distinct host and path.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = written(rows.withColumn("address", F.concat("host", "path")), "page_addresses")
    tokens = rows.where("address <> ''").select("address").distinct().withColumn("token", F.explode(tokens_of(F.col("address"))))
    tokens = written(tokens, "address_tokens")
    rules = written(rules.where("rule is not null"), "rules")
    index = written(indexed(rules, tokens).select("token", "pattern", "tier", "rule", "verdict", "weight"), "rule_index")
    # only rules whose token the address has run their expressions
    tried = tokens.join(index, "token").withColumn("subject", F.when(F.col("tier") == 1, F.col("address")).otherwise(F.translate("address", UPPER, LOWER)))
    fits = tried.where(F.expr("subject rlike pattern"))
    best = fits.groupBy("address").agg(F.min(F.struct((-F.col("tier")).alias("t"), (-F.col("weight")).alias("w"), "rule", "verdict")).alias("_best"))
    out = spread_join(rows, written(best, "best_rules"), "address", "page_id", "left")
    host_rules = F.col("_best.t") == -1
    return out.select(
        "page_id", "url", "host", "path",
        F.when(host_rules, F.col("_best.rule")).alias("rule"),
        F.when(~host_rules, F.col("_best.rule")).alias("pattern_rule"),
        F.coalesce(F.col("_best.verdict"), F.lit(otherwise)).alias("verdict"),
    )
