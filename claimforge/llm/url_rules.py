"""URL filters by pattern rules, each indexed by its rarest literal token.

A rule is a pattern over ``host + path``: literal text, ``*`` for anything, ``^`` for one separator (not a
letter or digit) or the end, and ``||`` in front for "the host or any subdomain". Its literal tokens are
the runs of letters and digits that must appear whole in a fitting URL. Tokens are counted over all URLs;
a rule is filed under its rarest one. A URL's own tokens fetch the rules filed under them, and only those
run as regular expressions. Rules without a whole literal token are filed under none and meet every URL.
A rule with a name stands for a site and its path is read in its own case; a nameless rule stands for words
and is matched in lower case, host and path alike.

Everything is DataFrame expressions. URLs are judged once per distinct text, so repeated URLs do not
repeat the work and a hot one is reduced before the shuffle.

Defined cases: a null URL or one without ``://`` has empty host and path and fits no rule; repeated rows
and null keys are kept; of fitting rules the longest wins, then the smaller pattern; an empty table gives
an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

BROADCAST_RULES = 50_000
TOKEN = "[\\p{L}\\p{N}]+"
ALLOW, BLOCK = "allow", "block"

#: Words that, standing alone in a host or path, mark pages no corpus wants.
UNWANTED_WORDS = ["ads", "adult", "bet", "bets", "betting", "casino", "casinos", "escort", "gambling", "pills", "poker", "porn", "spam", "viagra", "warez", "xxx"]


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, "(?s)\\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "(?s)\\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def site_rule(host: str, path: str, verdict: str) -> tuple[str, str, str, int]:
    """A rule for a host, its subdomains and every path that starts with ``path``: ``name, pattern, verdict, rank``."""
    return (host + path, f"||{host}{path}", verdict, len(host + path))


def word_rules(words: Sequence[str] = UNWANTED_WORDS) -> list[tuple[str, str, str, int]]:
    """Nameless rules of the lowest rank that block a word standing alone."""
    return [(None, f"^{w}^", BLOCK, 0) for w in words]


def rule_table(spark: SparkSession, rules: Sequence[tuple[str | None, str, str, int]]) -> DataFrame:
    """``rule, pattern, verdict, rank``; larger tables can be read from storage in this form."""
    return spark.createDataFrame(list(rules), "rule string, pattern string, verdict string, rank int")


def _compiled(rules: DataFrame) -> DataFrame:
    """Add ``regex`` and ``tokens``, the literal tokens that are bounded on both sides inside the pattern."""
    anchored = F.col("pattern").startswith("||")
    body = F.when(anchored, F.substring("pattern", 3, 1_000_000)).otherwise(F.col("pattern"))
    body = F.when(F.col("rule").isNull(), F.lower(body)).otherwise(body)
    quoted = F.regexp_replace(body, "([\\\\\\[\\](){}.+?$|])", "\\\\$1")
    pieces = F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("^"), F.lit("(?:[^\\p{L}\\p{N}]|\\z|\\A)"))
    regex = F.concat(F.when(anchored, F.lit("(?s)\\A(?:[^/]*\\.)?")).otherwise(F.lit("(?s)")), pieces)
    # A run touching an open end of the pattern or a star may be part of a longer run in the URL.
    edged = F.concat(F.when(anchored, F.lit("/")).otherwise(F.lit("*")), ascii_lower(body), F.lit("*"))
    tokens = F.regexp_extract_all(edged, F.lit("(?<![\\p{L}\\p{N}*])" + TOKEN + "(?![\\p{L}\\p{N}*])"), 0)
    return rules.withColumns({"regex": regex, "tokens": F.array_distinct(tokens)})


def index_rules(rules: DataFrame, token_counts: DataFrame) -> DataFrame:
    """File each rule under its rarest literal token: ``_token, rule, regex, verdict, rank, pattern``."""
    parts = _compiled(rules).withColumn("_token", F.explode_outer("tokens"))
    counted = parts.join(token_counts, "_token", "left")
    rarest = F.min_by("_token", F.struct(F.coalesce(F.col("_n"), F.lit(0)), F.col("_token")))
    return counted.groupBy("rule", "pattern", "regex", "verdict", "rank").agg(rarest.alias("_token"))


def judge_urls(df: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """``key, host, path, rule, verdict`` of each row; without a fitting rule ``rule`` is null and the verdict allow.

    Rules are counted first: up to ``broadcast_rules`` they are broadcast, beyond that joined by a shuffle.
    """
    pages = df.select(key, F.col(url).alias("_url"))
    known = pages.where(F.instr("_url", "://") > 0).select("_url").distinct()
    sites = known.select("_url", F.concat(host_of(F.col("_url")), path_of(F.col("_url"))).alias("_site"))
    # Lower-casing would make the dotted capital I two characters; one is what the words are written with.
    sites = sites.withColumn("_lower", F.lower(F.translate("_site", "\u0130", "i")))
    plain = F.regexp_extract_all(ascii_lower(F.col("_site")), F.lit(TOKEN), 0)
    # Letters beyond A-Z may be lower-cased into other tokens, which nameless rules are fetched by.
    folded = F.concat(plain, F.regexp_extract_all("_lower", F.lit(TOKEN), 0))
    tokens = F.array_distinct(F.when(F.col("_lower") == ascii_lower(F.col("_site")), plain).otherwise(folded))
    small = rules.limit(broadcast_rules + 1).count() <= broadcast_rules
    wanted = _compiled(rules).select(F.explode("tokens").alias("_token")).distinct()
    seen = sites.select(F.explode(tokens).alias("_token"))
    counts = seen.join(F.broadcast(wanted) if small else wanted, "_token", "left_semi").groupBy("_token").agg(F.count(F.lit(1)).alias("_n"))
    index = index_rules(rules, counts).withColumn("_token", F.coalesce("_token", F.lit("")))
    # The empty token stands for the rules without one.
    asked = sites.select("_url", "_site", "_lower", F.explode(F.concat(tokens, F.array(F.lit("")))).alias("_token"))
    fits = asked.join(F.broadcast(index) if small else index, "_token").where(F.expr("if(rule IS NULL, _lower, _site) rlike regex"))
    best = fits.groupBy("_url").agg(F.max_by(F.struct("rule", "verdict"), F.struct("rank", F.length("pattern"), "pattern")).alias("_best"))
    out = pages.join(best, "_url", "left")
    return out.select(
        key, host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(ALLOW)).alias("verdict"),
    )
