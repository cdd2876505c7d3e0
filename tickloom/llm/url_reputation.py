"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes are counted by host. A host's rate of good pages is shrunk towards its registered domain's,
that towards its public suffix's, and that towards the overall rate, each through a beta-binomial prior whose strength
is fitted by the method of moments. A page passes if the lower bound of its host's posterior reaches a threshold.
Rules (host, path) settle the pages that they fit before that.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import ascii_lower, cut

#: A suffix has two labels if the last is a country's (two letters) and one of these stands before it. what
#: registries name their second levels.
SECOND_LEVELS = ("ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "govt", "gv", "id", "info", "ltd", "me", "mil", "ne", "net", "nhs", "nic", "nom", "or", "org", "plc", "sch", "web")
TWO_LABELS = rf"^(?:{'|'.join(SECOND_LEVELS)})\.[a-z]{{2}}$"
LEVELS = ("suffix", "domain", "host_name")


class Rule(NamedTuple):
    verdict: str
    rule: str  # host and path, like example.org/es/

    @property
    def host(self) -> str:
        return self.rule.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.split("/", 1)[1]


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_levels(df: DataFrame) -> DataFrame:
    """Adds host_name (host without user, port and final dots), domain (registered) and suffix."""
    name = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r"(:[0-9]*)?\.*$", "")
    df = df.withColumn("host_name", name)
    last = lambda n: F.substring_index("host_name", ".", -n)
    two = last(2).rlike(TWO_LABELS)
    address = F.col("host_name").rlike(r"^[0-9.]+$")
    return df.withColumn("suffix", F.when(address, F.col("host_name")).when(two, last(2)).otherwise(last(1))).withColumn(
        "domain", F.when(address, F.col("host_name")).when(two, last(3)).otherwise(last(2))
    )


def host_posteriors(outcomes: DataFrame, least_rho: float = 1e-3, most_rho: float = 0.5, z: float = 1.645) -> DataFrame:
    """One row for each host_name with the counts n and k, the posterior's mean and its lower bound.

    outcomes has host_name, domain, suffix, n (labelled pages) and k (good ones), in any number of rows for a host.
    At each level the prior's mean is the parent's posterior mean m and its strength is 1/rho - 1, with rho the moment
    estimate sum((k-nm)^2 - nm(1-m)) / sum(n(n-1)m(1-m)), held within least_rho and most_rho.
    """
    hosts = cut(outcomes.groupBy(*LEVELS).agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "hosts")  # each level reads it
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    overall = suffixes.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2.0)).alias("m"))

    def shrink(level: DataFrame) -> DataFrame:
        """From n, k and m (the parent's mean) to mean and strength."""
        spread = F.col("n") * F.col("m") * (1 - F.col("m"))
        rho = F.try_divide(F.sum((F.col("k") - F.col("n") * F.col("m")) ** 2 - spread), F.sum((F.col("n") - 1) * spread))
        fit = level.agg(F.least(F.greatest(F.coalesce(rho, F.lit(least_rho)), F.lit(least_rho)), F.lit(most_rho)).alias("rho"))
        strength = 1 / fit.scalar() - 1
        return level.withColumn("strength", strength).withColumn("mean", (F.col("strength") * F.col("m") + F.col("k")) / (F.col("strength") + F.col("n")))

    top = shrink(suffixes.withColumn("m", overall.scalar())).select("suffix", F.col("mean").alias("m"))
    mid = cut(shrink(domains.join(top, "suffix")).select("suffix", "domain", F.col("mean").alias("m")), "domains")
    low = shrink(hosts.join(mid, ["suffix", "domain"]))
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("strength") + F.col("n") + 1))
    return low.select("host_name", "n", "k", "mean", (F.col("mean") - z * deviation).alias("bound"))


def rule_of(rules: Sequence[Rule], host: Column, path: Column, value: str) -> Column:
    """The rule or verdict of the longest rule that fits the host or a parent domain of it, and starts the path; else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, value))).otherwise(out)
    return out


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = (), threshold: float = 0.5, url: str = "url", key: str = "page_id") -> DataFrame:
    """pages with host, path, rule, verdict (allow or block), n_labelled and bound.

    outcomes has the key and good (1 or 0; other values and nulls count as no label); labels of a key add up, and all
    rows of a repeated key share them. Every row of pages is kept, in any state: a null or odd url has host and path
    empty, an unlabelled host the bound that its domain's prior gives. Columns of those names in pages are replaced;
    no labels at all leave the rate at 1/2. An empty table gives an empty result.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "n_labelled", "bound", *LEVELS)
    pages = with_levels(pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}))
    labels = outcomes.where(F.col("good").isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"), F.sum("good").alias("_k"))
    keyed = pages.select(F.col(key).alias("_key"), *LEVELS).join(labels, "_key", "left")
    counts = keyed.groupBy(*LEVELS).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_k"), F.lit(0)).alias("k"))
    posterior = host_posteriors(counts).select("host_name", F.col("n").alias("n_labelled"), "bound")
    host, path = F.col("host"), F.col("path")
    judged = pages.join(posterior, "host_name", "left").withColumns({"rule": rule_of(rules, host, path, "rule"), "verdict": F.coalesce(rule_of(rules, host, path, "verdict"), F.when(F.col("bound") >= threshold, "allow").otherwise("block"))})
    return judged.drop(*LEVELS)
