"""URL rules and empirical-Bayes host reputation.

A labelled page is good or bad.  Bad rates are shrunk through beta-binomial priors: the suffix
towards all pages, the registered domain towards its suffix, the host towards its domain.  How
strongly a level is pulled follows from how much its rates really differ (method of moments).  A
host is blocked when the lower bound of its posterior bad rate is above the threshold.

Every step is a grouped aggregation; the driver sees five sums per level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.runtime import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (rule, verdict): host and path prefix; a rule fits its host and all subdomains, the longest wins.
RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: The registered domain: two labels, or three under a two-letter suffix with one of these labels.
DOMAIN = r"([^.]+\.(?:(?:ac|co|com|edu|gov|net|org)\.[a-z][a-z]|[^.]+))$"
THRESHOLD, BOUND_SD = 0.5, 1.0
#: Range of the prior's weight, in pages.
WEIGHT_RANGE = (1.0, 1000.0)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def domain_of(host: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", "")
    found = F.regexp_extract(bare, DOMAIN, 1)
    return F.when(found == "", bare).otherwise(found)


def suffix_of(domain: Column) -> Column:
    return F.regexp_replace(domain, r"(?s)^[^.]*\.?", "")


def rule_and_verdict(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits; the list is a short policy."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def prior_weight(units: DataFrame) -> tuple[float, float]:
    """Mean bad rate and prior weight of units with ``n`` labelled and ``bad`` bad pages."""
    r = units.where("n > 0").agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum("bad").alias("bad"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("s"),
    ).first()
    if not r["k"]:
        return 0.0, WEIGHT_RANGE[1]
    mean = r["bad"] / r["n"]
    noise = mean * (1 - mean)
    room = r["n"] - r["nn"] / r["n"] - (r["k"] - 1)
    between = (r["s"] - r["n"] * mean * mean - (r["k"] - 1) * noise) / room if room > 0 else 0.0
    weight = noise / between - 1 if between > 0 else WEIGHT_RANGE[1]
    return mean, min(max(weight, WEIGHT_RANGE[0]), WEIGHT_RANGE[1])


def reputation(labelled: DataFrame) -> DataFrame:
    """``host, n, bad, rate, low, reputation`` from ``host, n, bad``, one row per host."""
    hosts = labelled.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain")))
    domains = materialize(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = materialize(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    mean, k_suffix = prior_weight(suffixes)
    _, k_domain = prior_weight(domains)
    _, k_host = prior_weight(hosts)

    def shrunk(weight: float, prior: Column) -> Column:
        return (F.col("bad") + F.lit(weight) * prior) / (F.col("n") + F.lit(weight))

    by_suffix = suffixes.select("suffix", shrunk(k_suffix, F.lit(mean)).alias("suffix_rate"))
    by_domain = domains.join(by_suffix, "suffix").select(
        "domain", shrunk(k_domain, F.col("suffix_rate")).alias("domain_rate")
    )
    rate = shrunk(k_host, F.col("domain_rate"))
    posterior = hosts.join(by_domain, "domain").select("host", "n", "bad", rate.alias("rate"))
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.lit(k_host) + 1))
    return posterior.withColumn("low", F.col("rate") - F.lit(BOUND_SD) * spread).withColumn(
        "reputation", F.when(F.col("low") > THRESHOLD, "block").otherwise("allow")
    )


def judge(
    pages: DataFrame,
    labels: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    label_id_col: str = "doc_id",
) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict``.

    A page's outcome is the label with its number; bad is toxic or of low quality, a null label
    value counts as good.  Repeated labels of a page count as one, bad if one of them is.  Rows that
    share a page id are all judged and each counts as an outcome.  Null urls and urls without
    ``://`` have empty host and path, which form a host like any other.  Without labels nothing is
    blocked but by rule.  An empty table gives an empty result; other columns are not read.
    """
    parsed = pages.select(
        F.col(f"`{id_col}`").alias("page_id"),
        host_of(F.col(f"`{url_col}`")).alias("host"),
        path_of(F.col(f"`{url_col}`")).alias("path"),
    )
    bad = (F.coalesce("toxic", F.lit(0)) != 0) | (F.coalesce("quality", F.lit(1)) == 0)
    outcomes = (
        labels.where(F.col(f"`{label_id_col}`").isNotNull())
        .groupBy(F.col(f"`{label_id_col}`").alias("page_id"))
        .agg(F.max(bad.cast("int")).alias("bad"))
    )
    per_host = materialize(
        parsed.join(outcomes, "page_id", "left")
        .groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    )
    judged = parsed.join(reputation(per_host).select("host", "reputation"), "host")
    rule, verdict = rule_and_verdict(F.col("host"), F.col("path"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "reputation").alias("verdict"))
