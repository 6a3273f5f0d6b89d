"""Empirical-Bayes host reputation and url rules.

Labelled page outcomes (1: bad) are summed per host, registered domain and suffix.  Each level's bad rate is shrunk
towards its parent's posterior mean by a beta-binomial prior: suffix to all pages, domain to suffix, host to domain.
A level's prior strength is estimated from the over-dispersion of its own rates about their parents' means (method of
moments), clamped to [1, 1000].  A host is blocked when the lower bound of its posterior bad rate exceeds ``max_bad``: the bound is the beta
quantile at 1 - ``confidence``, and it exceeds a rate just if the posterior leaves less than that to the rates below, which the incomplete
beta function says exactly.
Explicit rules (host, path prefix) come first; the longest that fits wins.

Everything shuffled is a pre-aggregated count per host; the three strengths are single rows.  A hot host costs one
partial count per task and its pages are joined to one row.

Cases: a null url, or one without ``://``, has an empty host and path and no rule, and takes the prior of all pages; hosts
without labelled pages take their domain's prior; repeated label rows for a page count once (bad if any is); ``A-Z``
only is lower-cased; an empty table gives an empty result; rules of equal length fall back to text order.  A host keeps its user
part, port and last dot and is judged with them, but they don't count for its domain; a numeric address is a domain of its own, and
all of them share one suffix.  Urls of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxloom.functions.special import beta_cdf
from taxloom.llm.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of more than one label, unless the caller gives a longer list; a registered domain has one label more than its suffix.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br")
NUMERIC = r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*)$"
ADDRESSES = "*"
MAX_BAD, CONFIDENCE = 0.25, 0.95
LEAST_STRENGTH, MOST_STRENGTH, DEFAULT_STRENGTH = 1.0, 1000.0, 10.0


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user part, port and last dot."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@|:[0-9]*$", ""), r"\.$", "")


def _labels(name: Column, suffixes: tuple[str, ...], more: int) -> Column:
    """The last labels of ``name``: those of its longest suffix, and ``more`` before them."""
    found = F.substring_index(name, ".", -1 - more)
    for n in sorted({x.count(".") + 1 for x in suffixes}):
        found = F.when(F.substring_index(name, ".", -n).isin(*[x for x in suffixes if x.count(".") + 1 == n]), F.substring_index(name, ".", -n - more)).otherwise(found)
    return found


def suffix_of(name: Column, suffixes: tuple[str, ...] = LONG_SUFFIXES) -> Column:
    return F.when(name.rlike(NUMERIC), F.lit(ADDRESSES)).otherwise(_labels(name, suffixes, 0))


def domain_of(name: Column, suffixes: tuple[str, ...] = LONG_SUFFIXES) -> Column:
    return F.when(name.rlike(NUMERIC), name).otherwise(_labels(name, suffixes, 1))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null.  ``rules`` is a list of the caller's (host, path, verdict)."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _strength(level: DataFrame) -> float:
    """Prior strength from (n, x, m): how far rates x/n scatter about their parents' means m beyond binomial noise."""
    v = F.col("m") * (1 - F.col("m"))
    row = level.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("x") / F.col("n") - F.col("m"), F.lit(2))).alias("s"), F.sum(v).alias("v"), F.sum(v * (F.col("n") - 1)).alias("w")
    ).first()
    if not row["w"]:
        return DEFAULT_STRENGTH
    rho = (row["s"] - row["v"]) / row["w"]
    rho = min(max(rho, 1 / (1 + MOST_STRENGTH)), 1 / (1 + LEAST_STRENGTH))
    return round(1 / rho - 1, 6)


def _posterior(level: DataFrame, s: float) -> DataFrame:
    a, b = F.col("x") + F.col("m") * s, F.col("n") - F.col("x") + (1 - F.col("m")) * s
    return level.withColumn("a", a).withColumn("b", b).withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))


def reputation(pages: DataFrame, outcomes: DataFrame, max_bad: float = MAX_BAD, confidence: float = CONFIDENCE, suffixes: tuple[str, ...] = LONG_SUFFIXES) -> DataFrame:
    """(host, n, x, bad_rate, p_over, blocked) from ``pages`` (page_id, host) and ``outcomes`` (page_id, bad)."""
    marks = outcomes.groupBy("page_id").agg(F.max("bad").alias("bad"))
    seen = pages.join(marks, "page_id", "left")
    hosts = seen.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("x"))
    name = name_of(F.col("host"))
    hosts = materialize(hosts.withColumn("domain", domain_of(name, suffixes)).withColumn("suffix", suffix_of(name, suffixes)), "hosts")
    whole = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("x"), F.lit(0)).alias("x")).first()
    mean = (whole["x"] + 1) / (whole["n"] + 2)

    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).withColumn("m", F.lit(mean))
    suffixes = _posterior(suffixes, _strength(suffixes)).select("suffix", F.col("mean").alias("m"))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).join(suffixes, "suffix")
    domains = _posterior(domains, _strength(domains)).select("domain", F.col("mean").alias("m"))
    level = hosts.join(domains, "domain")
    level = _posterior(level, _strength(level))
    level = materialize(level.select("host", "n", "x", F.round("mean", 9).alias("bad_rate"), (1 - beta_cdf(max_bad, F.col("a"), F.col("b"))).alias("p_over")), "reputation")
    return level.withColumn("blocked", F.col("p_over") > confidence)


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], max_bad: float = MAX_BAD, confidence: float = CONFIDENCE, suffixes: tuple[str, ...] = LONG_SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url)."""
    parts = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    known = reputation(parts.select("page_id", "host"), outcomes, max_bad, confidence, suffixes).select("host", "blocked")
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    judged = parts.join(known, "host", "left").withColumn("_rule", rule)
    own = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", own).alias("verdict"))
