"""URL rules by host suffix and path prefix, matched through short hash prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.llm.common import lower_ascii, scalars


def split_url(url):
    """(host, path) columns of a url: null or without ``://`` gives two empty strings."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _prepared(rules: DataFrame) -> DataFrame:
    """One row a (host, path): digest of its host and of its path up to the last slash."""
    known = rules.select(
        lower_ascii(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")
    ).filter(F.col("rule_host").isNotNull() & F.col("rule_path").isNotNull() & F.col("rule_verdict").isin("allow", "block"))
    known = known.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))
    stem = F.regexp_extract("rule_path", r"^(?s:.*/)?", 0)
    digest = F.sha2(F.concat("rule_host", stem), 256)
    return known.select("*", digest.alias("rule_digest"), F.substring(digest, 1, 8).alias("short"))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Every row of ``pages`` with the columns host, path, rule and verdict.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host and
    all subdomains where the url's path starts with its path. The longest rule
    wins, of equally long ones the one with the longer host; a rule given as both
    allow and block blocks. A url that no rule fits has a null rule and the
    default verdict, so has a null url. Rules with a null part or another
    verdict are ignored. Columns of ``pages`` that carry one of the four new
    names are replaced; repeated rows each get their verdict.

    Each distinct (host, path) is expanded once into its host suffixes and slash-ended
    path prefixes, no deeper than the deepest rule. The expressions meet the rules
    by the first eight digits of their digest; the whole digest and the rest of the
    rule's path confirm a hit. A url that fills a third of the pages is one row there.
    """
    host, path = split_url(F.col(url_col))
    pages = pages.withColumns({"host": host, "path": path})
    rules = _prepared(rules)
    depth = scalars(
        rules.agg(
            F.max(F.size(F.split("rule_host", r"\.", -1))).alias("labels"),
            F.max(F.size(F.split("rule_path", "/", -1)) - 1).alias("slashes"),
        )
    )
    labels, slashes = depth["labels"] or 1, depth["slashes"] or 0
    urls = pages.select("host", "path").distinct()
    parts, steps = F.split("host", r"\.", -1), F.split("path", "/", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.lit(labels), F.size(parts))),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."),
    )
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(F.lit(slashes), F.size(steps) - 1)),
        lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(steps, F.lit(1), F.greatest(n, F.lit(1))), "/"), F.lit("/"))),
    )
    expressions = (
        urls.select("host", "path", F.explode(suffixes).alias("suffix"))
        .select("host", "path", "suffix", F.explode(prefixes).alias("prefix"))
        .select("host", "path", F.sha2(F.concat("suffix", "prefix"), 256).alias("digest"))
        .withColumn("short", F.substring("digest", 1, 8))
    )
    hits = expressions.join(rules, "short").filter(
        (F.col("digest") == F.col("rule_digest")) & F.col("path").startswith(F.col("rule_path"))
    )
    rule = F.concat("rule_host", "rule_path")
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct(F.length(rule).alias("long"), F.length("rule_host").alias("host_long"), rule.alias("rule"), "rule_verdict")).alias("best")
    )
    best = best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("verdict"))
    kept = [c for c in pages.columns if c not in ("rule", "verdict", "host", "path")]
    return (
        pages.select("host", "path", *kept)
        .join(best, ["host", "path"], "left")
        .select(*kept, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    )
