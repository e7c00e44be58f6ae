"""URL filter: pattern rules indexed by their rarest literal token (built-in functions only).

A rule is a regular expression over "host/path" with the literal tokens that any match must hold. Each rule is filed
under the one of its tokens that the fewest different URLs hold. A URL looks up its own tokens, and only the rules it
finds there run their expression. Rules whose literals no URL holds are never run; rules without a literal are tried on every URL.

Different URLs are judged once and joined back, so a hot URL costs one verdict. Null URLs, and URLs without "://", have
an empty host and path; no rule fits them. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import as_row

TOKEN = "[^a-z0-9]+"
RULE_SCHEMA = "rule string, pattern string, verdict string, priority int, tokens array<string>"
#: The index is broadcast up to this many rules; beyond it Spark joins by shuffling.
BROADCAST_RULES = 20_000
#: Tasks that share the rows of one URL when verdicts are joined back; only URLs that a rule fits have verdicts to deal out.
SALTS = 16


@dataclass(frozen=True)
class UrlRule:
    """rule: the name that is reported, null for the filter's own patterns. Higher priorities win."""

    rule: str | None
    pattern: str
    verdict: str
    priority: int
    tokens: tuple[str, ...]


def prefix_rule(verdict: str, host: str, path: str) -> UrlRule:
    """Fits the host and its subdomains where the path begins with the given one."""
    tokens = tuple(dict.fromkeys(t for t in re.split(TOKEN, f"{host}".lower()) if t))
    # The path's last piece may go on in the URL, so only whole pieces are literals.
    tokens += tuple(t for t in re.split(TOKEN, path.rpartition("/")[0].lower()) if t and t not in tokens)
    return UrlRule(host + path, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", verdict, 1000 + len(host + path), tokens)


#: The rules of the contract.
RULES = (
    prefix_rule("allow", "com", "/"),
    prefix_rule("block", "example.com", "/en/"),
    prefix_rule("allow", "www.example.com", "/en/"),
    prefix_rule("block", "net", "/es/"),
    prefix_rule("block", "net", "/fr/"),
)
#: Fixed values, what the filter adds for URLs that no rule of the contract fits. Words of a host that suffice for themselves:
HOST_WORDS = ("casino", "porn", "xxx", "viagra", "escorts", "warez", "doubleclick")
#: words of one part of a host that tell in this order, others between them or not: any of the first with any of the second;
HOST_PAIRS = (
    (("cheap", "free", "buy", "discount", "online"), ("pills", "meds", "bets", "loans", "replicas", "essays")),
    (("adult", "sexy"), ("x", "cams", "chat", "videos")),
    (("ad", "ads", "click", "pixel"), ("track", "tracker", "server", "network")),
    (("spam", "link", "content"), ("farm", "farms")),
)
#: whole pieces of a path, of pages without text of their own;
PATH_PIECES = ("login", "signin", "signup", "logout", "register", "cart", "checkout", "wishlist")
#: and ends of a path, of files that are no pages.
FILE_ENDS = ("zip", "rar", "exe", "msi", "dmg", "iso", "apk", "mp3", "mp4", "avi")


def own_patterns() -> tuple[UrlRule, ...]:
    """A rule for each word, pair, piece and end, with its literals; letters of a path may be in either case."""
    before, after = r"^(?:[^/]*[.@-])?", r"(?:[.@:/-]|\z)"
    out = [UrlRule(None, f"{before}{w}{after}", "block", 10, (w,)) for w in HOST_WORDS]
    out += [UrlRule(None, f"{before}{a}-(?:[^.@:/]*-)?{b}{after}", "block", 10, (a, b)) for first, second in HOST_PAIRS for a in first for b in second]
    out += [UrlRule(None, rf"(?is)^[^/]*/(?:.*/)?{w}(?:[./]|\z)", "block", 10, (w,)) for w in PATH_PIECES]
    return (*out, *(UrlRule(None, rf"(?is)^[^/]*/.*\.{w}\z", "block", 10, (w,)) for w in FILE_ENDS))


PATTERNS = own_patterns()


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_frame(spark: SparkSession, rules) -> DataFrame:
    return spark.createDataFrame([(r.rule, r.pattern, r.verdict, r.priority, list(r.tokens)) for r in rules], RULE_SCHEMA)


def index_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule with the rarest of its tokens as `token`; `urls` has a column `tokens` per different URL."""
    mine = rules.withColumn("token", F.explode("tokens"))
    seen = urls.select(F.explode("tokens").alias("token")).join(mine.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    ranked = mine.join(seen, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return ranked.groupBy("rule", "pattern", "verdict", "priority").agg(F.min(F.struct("n", "token")).getField("token").alias("token"))


def filter_urls(df: DataFrame, rules, url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule and verdict; existing columns of these names are replaced."""
    spark = df.sparkSession
    rules = list(rules)
    frame = rule_frame(spark, rules)
    own = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    df = df.select(as_row(df, own).alias("row"), F.coalesce(F.col(url), F.lit("")).alias("_u_key"))
    subject = F.concat(F.col("host"), F.col("path"))
    different = (
        df.select("_u_key").distinct().withColumn("host", host_of(F.col("_u_key"))).withColumn("path", path_of(F.col("_u_key")))
        .withColumn("subject", subject)
        .withColumn("tokens", F.array_distinct(F.array_remove(F.split(F.lower("subject"), TOKEN), "")))
    )
    index = index_rules(different, frame.where(F.size("tokens") > 0))
    if len(rules) <= BROADCAST_RULES:
        index = F.broadcast(index)
    asked = different.select("_u_key", "subject", F.explode("tokens").alias("token")).join(index, "token").drop("token")
    free = [r for r in rules if not r.tokens]
    if free:  # a stated list of patterns against all URLs
        asked = asked.unionByName(
            different.select("_u_key", "subject", F.explode(F.array(*[F.struct(F.lit(r.rule).cast("string").alias("rule"), F.lit(r.pattern).alias("pattern"), F.lit(r.verdict).alias("verdict"), F.lit(r.priority).alias("priority")) for r in free])).alias("r")).select("_u_key", "subject", "r.*")
        )
    best = (
        asked.where(F.expr("subject RLIKE pattern"))
        .groupBy("_u_key")
        .agg(F.max(F.struct("priority", F.coalesce("rule", F.lit("")).alias("named"), "rule", "verdict")).alias("best"))
        .select("_u_key", "best.rule", "best.verdict")
    )
    # A URL may stand in a third of all rows: its verdict is dealt to SALTS tasks.
    df = df.withColumn("_u_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    best = best.withColumn("_u_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("_u_salt", F.col("_u_salt").cast("long"))
    judged = df.join(best, ["_u_key", "_u_salt"], "left")
    place = F.col("row").getField(url)
    return judged.select(*[F.col("row").getField(c).alias(c) for c in own], host_of(place).alias("host"), path_of(place).alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
