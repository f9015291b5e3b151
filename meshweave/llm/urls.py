"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes are counted per host, registered domain (last two labels of the name) and suffix (last label).
At each level a beta-binomial prior is centred on the posterior mean of the level above, with a strength found by the
method of moments over that level's units, so a host with few outcomes leans on its domain, and a domain on its
suffix. A host is blocked when the lower posterior bound of its share of bad pages is over a limit and its domain has
any outcome at all. Rules come first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

RULES = ("allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Settings:
    """bad_limit: the share of bad pages that the bound is held against; z: the bound's distance in standard deviations; strength: limits of a prior's weight in pages."""

    bad_limit: float = 0.5
    z: float = 1.645
    strength: tuple[float, float] = (2.0, 1000.0)
    max_rules: int = 500


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[str, ...], max_rules: int) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict. Rules are text such as "block example.com/en/" and part of the plan, so their number is limited."""
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; the limit is {max_rules}")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.split(" ", 1)[1]), r)):  # the last one that fits is the outermost test
        kind, at = rule.split(" ", 1)
        of, slash, prefix = at.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + prefix)
        name, verdict = F.when(fits, F.lit(at)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def reputation(outcomes: DataFrame, s: Settings = Settings()) -> DataFrame:
    """host, n, bad, around (outcomes in its domain), mean and low (posterior mean and lower bound of the bad share) from rows host, bad (0, 1 or null for not labelled)."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"))
    hosts = hosts.withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)\.?$", 1)).withColumn("suffix", F.regexp_extract("host", r"([^.]+)\.?$", 1))
    hosts, _ = written(hosts, "url-hosts")  # five steps read it; the pages are read once
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    least, most = s.strength

    def strength(units: DataFrame) -> DataFrame:
        """One row: the prior's weight by the method of moments for beta-binomial shares of unequal sizes."""
        seen = units.where("n > 0").select("n", "b", (F.col("b") / F.col("n")).alias("r"))
        # sum n (r - p)^2 = sum b r - p sum b, so one pass serves
        total = seen.agg(F.sum("n").alias("N"), F.sum("b").alias("B"), F.count("*").alias("k"), F.sum(F.col("b") * F.col("r")).alias("br"), F.sum(F.col("n") * F.col("n")).alias("nn"))
        p = F.try_divide("B", "N")
        pq, spread = p * (1 - p), F.col("br") - p * F.col("B")
        rho = F.try_divide(spread - (F.col("k") - 1) * pq, pq * (F.col("N") - F.try_divide("nn", "N") - (F.col("k") - 1)))
        weight = F.when(rho > 0, F.greatest(F.lit(least), F.least(F.lit(most), 1 / rho - 1))).otherwise(F.lit(most))
        return total.select(F.coalesce(weight, F.lit(most)).alias("m"), ((F.coalesce("B", F.lit(0)) + 1) / (F.coalesce("N", F.lit(0)) + 2)).alias("p"))

    # each is a single row, so the joins carry a constant along
    top, middle, bottom = (strength(x).first() for x in (suffixes, domains, hosts))
    suffixes = suffixes.select(F.col("suffix"), ((F.col("b") + F.lit(top["m"] * top["p"])) / (F.col("n") + F.lit(top["m"]))).alias("over"))
    domains = domains.join(suffixes, "suffix").select("suffix", "domain", F.col("n").alias("around"), ((F.col("b") + F.lit(middle["m"]) * F.col("over")) / (F.col("n") + F.lit(middle["m"]))).alias("over"))
    weight = F.col("n") + F.lit(bottom["m"])
    mean = (F.col("b") + F.lit(bottom["m"]) * F.col("over")) / weight
    return hosts.join(domains, ["suffix", "domain"]).select("host", "n", F.col("b").alias("bad"), "around", mean.alias("mean"), (mean - s.z * F.sqrt(mean * (1 - mean) / (weight + 1))).alias("low"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[str, ...] = RULES, s: Settings = Settings(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and the host's n, mean and low for every page.

    outcomes: rows id_col, bad (1 or 0); of repeated ids the worst counts. A null or malformed url has an empty host,
    which is judged like any other. Null ids have no outcome. Repeated rows are judged each; an empty table gives no rows.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    known = outcomes.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.col("bad").cast("long")).alias("bad"))
    counted = rows.select(id_col, "host").join(known, id_col, "left")
    # As a table the hosts' size is known: the planner broadcasts it if small, else joins with skewed hosts split.
    table, _ = written(reputation(counted.select("host", "bad"), s), "url-reputation")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules, s.max_rules)
    out = rows.join(table, "host", "left").withColumn("rule", name)
    return out.select(id_col, "host", "path", "rule", F.coalesce(verdict, F.when((F.col("low") > s.bad_limit) & (F.col("around") > 0), "block").otherwise("allow")).alias("verdict"), "n", "mean", "low")
