"""URL filters: empirical-Bayes reputation of hosts, shrunk from suffix to registered domain to host."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lumensift.llm.common import cut
from lumensift.operators.skew import with_row

#: Public suffixes of two labels (fixed values; extend by parameter).
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "com.br", "co.in", "co.kr", "com.cn", "co.nz", "co.za")
#: More rules than this do not belong into one expression.
MAX_RULES = 500


@dataclass(frozen=True)
class Rule:
    """``host`` fits itself and all its subdomains; ``path`` is a prefix of the URL's path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    bare = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    return F.coalesce(F.when(F.instr(bare, "/") > 0, F.substring(bare, F.instr(bare, "/"), F.length(bare))), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without its port."""
    return F.regexp_replace(host, ":[0-9]*$", "")


def with_levels(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """``hosts`` with suffix and registered domain (the suffix and one label more) of each host's name.

    A name ends in a suffix of two labels if ``suffixes`` (column suffix) or, without that table, ``TWO_LABEL_SUFFIXES`` has it, else in
    its last label. An address in digits or brackets is its own suffix and domain.
    """
    name = name_of(F.col("host"))
    two = F.substring_index(name, ".", -2)
    d = hosts.withColumn("_two", two)
    if suffixes is None:
        d = d.withColumn("_long", F.col("_two").isin(list(TWO_LABEL_SUFFIXES)))
    else:
        d = d.join(suffixes.select(F.lower("suffix").alias("_two"), F.lit(True).alias("_long")).distinct(), "_two", "left").withColumn("_long", F.coalesce("_long", F.lit(False)))
    address = name.rlike(r"^[0-9.]*[0-9]$|^\[")
    pick = lambda n: F.when(address, name).when(F.col("_long"), F.substring_index(name, ".", -n - 1)).otherwise(F.substring_index(name, ".", -n))
    return d.withColumns({"suffix": pick(1), "domain": pick(2)}).drop("_two", "_long")


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits as struct(rule, verdict), or null; ties go to the rule given first."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    out = None
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        hit = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _shrunk(child: DataFrame, parent: DataFrame, key: str, level: str, floor: float, ceiling: float) -> DataFrame:
    """Posterior mean and strength of each child under a beta prior around its parent's mean.

    The prior's strength is one number for the level, by moments: with p = k/n and the parent's mean m,
    E[n (p - m)^2] = m (1 - m) (1 + (n - 1) rho); strength = (1 - rho) / rho.
    """
    j = cut(child.join(parent, key))  # its moments and its posteriors read it
    m, n = F.col("prior"), F.col("n")
    have = F.when(n > 0, 1.0).otherwise(0.0)
    dev = F.when(n > 0, n * F.pow(F.col("k") / n - m, F.lit(2.0))).otherwise(0.0)
    moments = j.agg(F.sum(dev - have * m * (1 - m)).alias("over"), F.sum(have * m * (1 - m) * (n - 1)).alias("room"))
    rho = F.when(F.col("room") > 0, F.greatest(F.lit(floor), F.least(F.lit(ceiling), F.col("over") / F.col("room")))).otherwise(F.lit(ceiling))
    strength = moments.select(((1 - rho) / rho).alias("strength"))  # one row
    j = with_row(j, strength)
    return j.withColumn("a", F.col("k") + F.col("strength") * m).withColumn("b", n - F.col("k") + F.col("strength") * (1 - m)).withColumn("level", F.lit(level))


def host_reputation(hosts: DataFrame, floor: float = 0.001, ceiling: float = 0.5, suffixes: DataFrame | None = None) -> DataFrame:
    """host, n, k, a, b: the beta posterior of a bad page for every host in ``hosts`` (host, n labelled, k bad; one row a host).

    Means run from the whole table to suffix, registered domain and host; a level without labels has its parent's mean. All work is on
    one row per host or less, written once for all levels.
    """
    h = cut(with_levels(hosts.select("host", F.col("n").cast("double").alias("n"), F.col("k").cast("double").alias("k")), suffixes))
    total = h.agg(((F.coalesce(F.sum("k"), F.lit(0.0)) + 1.0) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 2.0)).alias("prior"))  # one row
    mean = (F.col("a") / (F.col("a") + F.col("b"))).alias("prior")
    suffixes = h.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("all", F.lit(1))
    s = _shrunk(suffixes, total.withColumn("all", F.lit(1)), "all", "suffix", floor, ceiling).select("suffix", mean)
    domains = h.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    d = _shrunk(domains, s, "suffix", "domain", floor, ceiling).select("domain", mean)
    return _shrunk(h.select("host", "domain", "n", "k"), d, "domain", "host", floor, ceiling).select("host", "n", "k", "a", "b")


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = (), max_bad: float = 0.25, z: float = 1.6448536269514722, suffixes: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule, verdict for every page.

    ``outcomes`` (host, bad 0/1) are labelled pages. A rule decides first. Otherwise a page is blocked when the lower posterior bound of its
    host's bad share, mean - z * deviation, exceeds ``max_bad``. Hosts without labels have their domain's or suffix's prior; the empty host
    (null url, no ``://``) is judged like any other. Repeated rows are judged each; null labels do not count; extra columns are ignored.
    Only the url columns are shuffled: counts are summed before the exchange, and one host row meets many pages in a join that may be split.
    """
    p = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    counts = p.select("host", F.lit(0).alias("n"), F.lit(0).alias("k")).unionByName(
        outcomes.where(F.col("bad").isNotNull() & F.col("host").isNotNull()).select("host", F.lit(1).alias("n"), F.col("bad").cast("int").alias("k")))
    hosts = counts.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    rep = host_reputation(hosts, suffixes=suffixes)
    a, b = F.col("a"), F.col("b")
    bound = a / (a + b) - F.lit(z) * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    rep = rep.select(F.col("host").alias("_host"), F.when(bound > max_bad, "block").otherwise("allow").alias("_method"))
    hit = matched_rule(F.col("host"), F.col("path"), rules)
    out = p.withColumn("_hit", hit).join(rep, F.col("host") == F.col("_host"), "left")
    return out.select("page_id", "url", "host", "path", F.col("_hit.rule").alias("rule"), F.coalesce(F.col("_hit.verdict"), F.col("_method"), F.lit("allow")).alias("verdict"))
