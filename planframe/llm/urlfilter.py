"""URL filters: explicit rules, and elsewhere a host's reputation by empirical Bayes.

Labelled pages give each host bad outcomes out of all its labelled ones. Rates shrink
from host to registered domain to suffix to all, through beta-binomial priors whose
weights come from the spread at each level. A host is blocked when even the lower bound
of its posterior bad rate exceeds ``most_bad``. DataFrame functions only.

Scale: urls are read once; labelled outcomes are counted before they are shuffled, so a
host with a third of all pages is one row from each task.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .shrink import posterior_mean, strength

# Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "org.uk")
MOST_BAD = 0.5
Z = 1.645


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. ``rules``: (verdict, host, path).

    A rule fits its host and all subdomains when the url's path starts with the rule's.
    """
    rule = verdict = None
    for says, at, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        rule = F.when(fits, at + start) if rule is None else rule.when(fits, at + start)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule.otherwise(none), verdict.otherwise(none))


def reputation(outcomes: DataFrame) -> DataFrame:
    """``outcomes`` (host, bad: 0 or 1) -> (host, n, rate, low): posterior mean and lower bound.

    Null outcomes don't count, but their host gets its parents' rate. Without any outcome
    all rates are 0.
    """
    hosts = checkpoint(
        outcomes.groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
        .withColumn("domain", domain_of(F.col("host")))
        .withColumn("suffix", suffix_of(F.col("host")))
    )
    total = hosts.agg(F.coalesce(F.try_divide(F.sum("k"), F.sum("n")), F.lit(0.0)).alias("m"))
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    suffixes = hosts.groupBy("suffix").agg(*sums).crossJoin(F.broadcast(total))  # one row
    suffixes = suffixes.crossJoin(F.broadcast(strength(suffixes))).select("suffix", posterior_mean(F.col("n"), F.col("k"), F.col("m"), F.col("kappa")).alias("m"))
    domains = hosts.groupBy("domain", "suffix").agg(*sums).join(suffixes, "suffix")
    domains = domains.crossJoin(F.broadcast(strength(domains))).select("domain", posterior_mean(F.col("n"), F.col("k"), F.col("m"), F.col("kappa")).alias("m"))
    hosts = hosts.join(domains, "domain")
    a, b = F.col("k") + F.col("kappa") * F.col("m"), F.col("n") - F.col("k") + F.col("kappa") * (1 - F.col("m"))
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.crossJoin(F.broadcast(strength(hosts))).select("host", "n", (a / (a + b)).alias("rate"), (a / (a + b) - F.lit(Z) * sd).alias("low"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = (), url_col: str = "url", id_col: str = "page_id", most_bad: float = MOST_BAD) -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_rate``, one row per page, repeats included.

    ``outcomes`` has ``page_id`` and ``bad`` (0, 1 or null); several outcomes of an id
    count as their largest. A rule decides where one fits; else a host whose posterior
    lower bound exceeds ``most_bad`` is blocked and any other allowed. A null url, or one
    without ``://``, has an empty host and path. An empty table gives an empty result.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    known = outcomes.where("page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = reputation(urls.select("page_id", "host").join(known, "page_id", "left"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return urls.join(hosts, "host").select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("low") > most_bad, "block").otherwise("allow")).alias("verdict"),
        F.col("rate").alias("bad_rate"),
    )
