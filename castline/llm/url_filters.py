"""URL filters: host-suffix and path-prefix expressions against a table of rules.

Every URL becomes the expressions ``host suffix + path prefix`` that a rule could have; they
meet the rules in an equi-join on the first eight hex digits of their SHA-256, and a match
counts only if the full digests agree and the path starts with the rule's path. The longest
rule decides. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rule tables of at most so many rows are broadcast (about 100 bytes a row); larger ones are shuffled.
BROADCAST_RULES = 20_000
#: Shares into which the URLs with one expression are dealt, where rules are shuffled.
SHARES = 32
#: Hex digits of the digest on which rows meet before the whole digest is compared.
SHORT = 8


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_keys(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with the key under which they are found.

    The key's path ends at the rule path's last slash, so that it is one of the prefixes
    into which URLs are expanded; ``startswith`` confirms what follows that slash.
    """
    path = F.coalesce(F.col("path"), F.lit(""))
    host = F.translate(F.coalesce(F.col("host"), F.lit("")), UPPER, LOWER)
    key = F.concat(host, F.lit("\n"), F.regexp_extract(path, r"(?s)^(.*/)?", 1))
    return rules.select(
        host.alias("rule_host"), path.alias("rule_path"), F.col("verdict").alias("rule_verdict"),
        F.sha2(key, 256).alias("rule_digest"), F.substring(F.sha2(key, 256), 1, SHORT).alias("short"),
        F.size(F.split(host, r"\.")).alias("labels"), (F.size(F.split(path, "/")) - 1).alias("slashes"),
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judge every row of ``pages`` (page_id, url) by ``rules`` (host, path, verdict).

    A rule fits its host and all subdomains, if the URL's path starts with the rule's. The
    longest rule (host and path together) wins; of equally long ones that with the longer
    host, then ``block``. Without a rule the verdict is ``default`` and ``rule`` is null.

    Null and malformed URLs have an empty host and path and fit no rule; repeated rows and null
    ids come back as often as they went in; an empty table gives no rows; other columns of
    ``pages`` are not read. Very long URLs are expanded no further than the rules' own numbers
    of labels and slashes.
    """
    keyed = rule_keys(rules)
    # A few numbers about the rule table, not about the pages.
    facts = keyed.agg(F.count("*"), F.max("labels"), F.max("slashes")).first()
    n_rules, labels, slashes = facts[0], facts[1] or 1, facts[2] or 0
    keyed = keyed.drop("labels", "slashes")
    # Equal rows travel once, with their number, so a hot URL is one row here.
    urls = pages.groupBy("page_id", "url").agg(F.count("*").cast("int").alias("copies"))
    urls = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    hosts = F.expr(
        f"transform(sequence(1, least(size(split(host, '[.]')), {labels})),"
        " i -> substring_index(host, '.', -i))"
    )
    paths = F.expr(
        f"concat(array(''), transform(sequence(0, least(size(split(path, '/')) - 1, {slashes})),"
        " i -> if(i = 0, '', concat(substring_index(path, '/', i), '/'))))"
    )
    both = F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, F.lit("\n"), p)))))
    wide = (
        urls.select("*", F.explode(both).alias("expression"))
        .withColumn("digest", F.sha2("expression", 256))
        .withColumn("short", F.substring("digest", 1, SHORT))
        .drop("expression")
    )
    if n_rules <= BROADCAST_RULES:
        met = wide.join(F.broadcast(keyed), "short", "left")
    else:
        # All URLs of a top-level domain have its expression: they are dealt out, and each rule stands in every share.
        shares = keyed.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        met = wide.withColumn("share", F.pmod(F.xxhash64("page_id", "url"), F.lit(SHARES)).cast("int")).join(shares, ["short", "share"], "left")
    fits = (F.col("digest") == F.col("rule_digest")) & F.col("path").startswith(F.col("rule_path"))
    rank = F.when(
        fits,
        F.struct(
            (F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"),
            F.col("rule_verdict").alias("verdict"), F.concat("rule_host", "rule_path").alias("rule"),
        ),
    )
    # Already dealt out by (page_id, url): the second grouping needs no further shuffle.
    best = met.groupBy("page_id", "url", "host", "path", "copies").agg(F.max(rank).alias("best"))
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
