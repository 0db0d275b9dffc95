"""Operator 5: URL filter with explicit rules and empirical-Bayes host reputation, SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminar.storage import stage

# The rules (verdict, host, path prefix).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host`` and ``path``; a null url, or one without ``://``, has both empty."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": host, "path": path})


def rule_columns(rules: tuple = RULES) -> tuple:
    """Columns (rule, verdict) of the longest rule that fits ``host`` and ``path``, else null."""
    name = verdict = None
    for kind, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name = F.when(fits, host + path) if name is None else name.when(fits, host + path)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return name, verdict


def _strength(counts: DataFrame, mean: str, least: float, most: float) -> DataFrame:
    """Method of moments: how many outcomes the prior of a level is worth, from the spread of its groups."""
    return counts.agg(
        F.coalesce(
            F.greatest(F.lit(least), F.least(F.lit(most),
                F.expr(f"(sum(n * {mean} * (1D - {mean})) / sum(n)) / greatest(1e-9D, sum(n * pow(bad / n - {mean}, 2)) / sum(n) - (sum({mean} * (1D - {mean})) / sum(n))) - 1D"))),
            F.lit(most),
        ).alias("k")
    )


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645, least: float = 2.0, most: float = 500.0) -> DataFrame:
    """Per host: ``host, n, bad, mean, low, base``: labelled outcomes, posterior mean and lower bound of the bad share, share of all pages.

    ``pages`` has ``page_id, host``; ``outcomes`` has ``page_id, bad`` (0 or 1). Each level's prior is a
    beta with the mean of the level above (all pages, suffix, registered domain) and a strength estimated
    from the spread between its groups; the host's posterior is beta-binomial, its bound the normal
    approximation ``mean - z * sd``. The suffix is the last label of the host, the registered domain the
    last two. Hosts without labelled pages keep their domain's posterior. Counts are aggregated before
    anything is joined, so a host with a third of all pages is a row like any other.
    """
    labelled = pages.select("page_id", "host").join(outcomes, "page_id", "left")
    hosts = labelled.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
    hosts = hosts.withColumns({"n": F.col("n").cast("double"), "suffix": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2)})
    hosts = stage(hosts, "hosts")  # every level reads it several times
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0.0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 1.0)).alias("above"))

    def level(counts: DataFrame, above: DataFrame, on: list[str]) -> DataFrame:
        joined = counts.crossJoin(F.broadcast(above)) if not on else counts.join(above, on)
        k = _strength(joined.where("n > 0"), "above", least, most)
        with_k = joined.crossJoin(F.broadcast(k))  # one row
        return with_k.withColumn("mean", (F.col("bad") + F.col("k") * F.col("above")) / (F.col("n") + F.col("k")))

    s = level(suffixes, top, []).select("suffix", F.col("mean").alias("above"))
    d = level(domains, s, ["suffix"]).select("suffix", "domain", F.col("mean").alias("above"))
    h = level(hosts, d, ["suffix", "domain"])
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("k") + 1))
    base = F.broadcast(top.select(F.col("above").alias("base")))  # one row
    return h.crossJoin(base).select("host", "n", "bad", "mean", (F.col("mean") - z * sd).alias("low"), "base")


def judge_urls(pages: DataFrame, outcomes: DataFrame, max_bad: float | None = None, rules: tuple = RULES, z: float = 1.645) -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_low`` for each row of ``pages``.

    The longest fitting rule decides; otherwise a page is blocked when the lower bound of its host's bad
    share is above ``max_bad``, by default the bad share of all pages: a host that is worse than the rest beyond doubt. Outcomes are one per page id (the worst, if several); outcomes of unknown
    pages and null ids or values are ignored. Repeated rows give a row each. Other columns are not read.
    """
    parsed = split_url(pages.select("page_id", "url")).select("page_id", "host", "path")
    worst = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    known = host_reputation(parsed, worst, z).select("host", "low", "base")
    rule, verdict = rule_columns(rules)
    mine = F.when(F.col("low") > (F.col("base") if max_bad is None else F.lit(max_bad)), "block").otherwise("allow")
    return parsed.join(known, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mine).alias("verdict"), F.round("low", 6).alias("bad_low"))
