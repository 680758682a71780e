"""URL filter: host rules, and empirical-Bayes host reputation where no rule fits.

Labelled pages (outcome 1 bad, 0 good) are counted per host.  Hosts sit below
registered domains, domains below suffixes.  At each level the counts of the
children give one over-dispersion ``rho`` of the beta-binomial by moments,

    rho = (sum (k - n p)^2 / (p (1 - p)) - sum n) / sum n (n - 1),

with p the mean of the child's parent, held between ``RHO_MIN`` and
``RHO_MAX``; 1/rho - 1 is the weight of the parent's mean as a prior.  A
page is blocked if the lower bound ``mean - z * sd`` of its host's beta
posterior exceeds the threshold, so only well-supported bad hosts go.

Defined results: a null url, or one without ``://``, has an empty host and
path; a host without labels takes its domain's mean as posterior, a domain
without labels its suffix's; without any labels the mean is 1/2 and nothing is
blocked; a level whose children all have fewer than two labels takes
``RHO_MAX``.  Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadworthy.llm.common import ascii_lower, written

#: Fixed values: (host and path prefix, verdict).
RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]
#: Suffixes of two labels under which domains are registered; all others have one label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "org.uk")
RHO_MIN, RHO_MAX = 0.001, 0.9
THRESHOLD, Z = 0.5, 1.645


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is asked first
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def domain_parts(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host."""
    last = F.substring_index(host, ".", -1)
    last_two = F.substring_index(host, ".", -2)
    two = last_two.isin(*TWO_LABEL_SUFFIXES)
    suffix = F.when(two, last_two).otherwise(last)
    return F.when(two, F.substring_index(host, ".", -3)).otherwise(last_two), suffix


def _level(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Children (n, k) with their posterior's parameters a, b and mean p."""
    joined = child.join(parent.select(key, F.col("p").alias("_p")), key)
    n, k, p = F.col("n"), F.col("k"), F.col("_p")
    pairs = F.sum(n * (n - 1))
    rho = joined.agg(
        F.when(pairs > 0, (F.sum((k - n * p) * (k - n * p) / (p * (1 - p))) - F.sum(n)) / pairs)
        .otherwise(F.lit(RHO_MAX)).alias("rho")
    ).select(F.least(F.greatest(F.coalesce("rho", F.lit(RHO_MAX)), F.lit(RHO_MIN)), F.lit(RHO_MAX)))
    weight = 1 / rho.scalar() - 1
    joined = joined.withColumn("_w", weight)
    a, b = k + F.col("_w") * p, (n - k) + F.col("_w") * (1 - p)
    return joined.withColumns({"a": a, "b": b, "p": a / (a + b)}).drop("_w", "_p")


def reputation(outcomes: DataFrame) -> DataFrame:
    """One row per host: host, domain, suffix, n, k, mean, bound.

    ``outcomes`` has ``host`` and ``bad`` (1, 0, or null for a page without label).
    """
    domain, suffix = domain_parts(F.col("host"))
    hosts = written(
        outcomes.groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("k"))
        .withColumns({"domain": domain, "suffix": suffix, "root": F.lit("")}),
        "host-counts",
    )
    count = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = hosts.groupBy("domain", "suffix").agg(*count)
    suffixes = hosts.groupBy("suffix", "root").agg(*count)
    root = hosts.groupBy("root").agg(*count).withColumn("p", (F.col("k") + 1) / (F.col("n") + 2))
    # Each level is read twice by the next (rows and rho), so it is written once.
    suffixes = written(_level(suffixes, root, "root"), "suffixes")
    # A registered domain has one suffix, so its name alone is the key below.
    domains = written(_level(domains, suffixes, "suffix"), "domains")
    posterior = _level(hosts, domains, "domain")
    a, b = F.col("a"), F.col("b")
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return posterior.select("host", "domain", "suffix", "n", "k", F.col("p").alias("mean"),
                            (F.col("p") - Z * sd).alias("bound"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, outcomes: DataFrame | None = None,
          threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``pages`` with host, path, rule and verdict.

    ``outcomes`` (host, bad) are labelled pages; by default the pages on which
    a rule decides are the labelled ones.  Input columns called host, path,
    rule or verdict are replaced.
    """
    host, path = split_url(F.col("url"))
    seen = pages.withColumns({"host": host, "path": path}).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    if outcomes is None:
        outcomes = seen.select("host", (F.col("_rule.verdict") == "block").cast("int").alias("bad"))
    else:
        outcomes = outcomes.select("host", "bad").unionByName(seen.select("host", F.lit(None).cast("int").alias("bad")))
    bad_hosts = reputation(outcomes).where(F.col("bound") > threshold).select("host", F.lit(True).alias("_bad"))
    return (
        seen.join(bad_hosts, "host", "left")
        .withColumn("rule", F.col("_rule.rule"))
        .withColumn("verdict", F.coalesce(F.col("_rule.verdict"), F.when(F.col("_bad"), "block").otherwise("allow")))
        .drop("_rule", "_bad")
    )
