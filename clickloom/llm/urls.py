"""URL filters: explicit rules first, then the reputation of the host by empirical Bayes.

A page's outcome is good or bad where a label says so. Counts of bad among labelled pages go up from
host to registered domain to suffix, and priors come down: the suffix's rate is shrunk towards the
rate of all, the domain's towards its suffix's, the host's towards its domain's, each by a
beta-binomial prior whose strength is estimated from how far the rates of that level differ (the
method of moments). A page is blocked if the lower bound of its host's posterior bad rate is over
a limit. Everything is counted by host before any join, so a host with a third of all pages is one
row; the joins of pages with hosts are split by Spark where a host is hot.

Defined cases: a null url, or one without ``://``, has an empty host and path, which is a host like
any other; a null key or null label counts nowhere; several labels of one document count once, bad if
one is; a host without labels has the prior alone; where all levels agree the strength is the most
allowed; without any label the rate is the prior guess. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.session import stored

#: Suffixes of two labels; a name under one of them is a registered domain.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.in", "co.nz")
#: The least and the most that units of one level may be alike, and the rate without any label.
LEAST_RHO, MOST_RHO, GUESS = 1e-4, 0.5, 0.1


def parsed(pages: DataFrame, url: str) -> DataFrame:
    """The pages with ``host`` and ``path``."""
    whole = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    has = F.instr(whole, "://") > 0
    host = F.regexp_extract(whole, r"(?s)\A.*?://([^/?#]*)", 1)
    path = F.regexp_extract(whole, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return pages.withColumn(
        "host", F.when(has, F.translate(host, upper, lower)).otherwise("")
    ).withColumn("path", F.when(has, path).otherwise(""))


def registered(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host without port; an address is its own domain."""
    name = F.regexp_replace(host, r":[0-9]*\z", "")
    two = F.substring_index(name, ".", -2)
    wide = two.isin(*TWO_LABEL_SUFFIXES)
    address = name.rlike(r"\A[0-9.]+\z") | name.startswith("[")
    domain = F.when(address, name).when(wide, F.substring_index(name, ".", -3)).otherwise(two)
    suffix = F.when(address, "").when(wide, two).otherwise(F.substring_index(name, ".", -1))
    return domain, suffix


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains, and paths that start so."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_rules(hosts: DataFrame, rules: list[Rule]) -> DataFrame:
    """For each host that any rule fits: those rules, the longest first."""
    table = hosts.sparkSession.createDataFrame(
        [(r.verdict, r.host, r.path, r.name) for r in rules],
        "verdict string, rule_host string, rule_path string, rule string",
    )
    labels = F.split("host", r"\.")
    tails = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    fitting = hosts.select("host", F.explode(tails).alias("rule_host")).join(table, "rule_host")
    ranked = F.struct(
        (-F.length("rule")).alias("size"), F.col("rule"), F.col("rule_path"), F.col("verdict")
    )
    return fitting.groupBy("host").agg(F.array_sort(F.collect_list(ranked)).alias("rules"))


def _strength(units: DataFrame, parents: int) -> float:
    """The prior strength of a level from its units' n, x and their parent's rate ``up``."""
    held = units.filter("n > 0")
    spread = F.col("n") * F.pow(F.col("x") / F.col("n") - F.col("up"), 2)
    found = held.agg(
        F.sum(spread / (F.col("up") * (1 - F.col("up")))).alias("spread"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n")).alias("squares"),
        F.count("*").alias("units"),
    ).first()
    rho = LEAST_RHO
    if found.units > parents:
        free = found.units - parents
        room = found.n - found.squares / found.n - free
        if room > 0:
            rho = min(MOST_RHO, max(LEAST_RHO, (found.spread - free) / room))
    return 1 / rho - 1


def reputation(hosts: DataFrame, z: float = 1.645) -> DataFrame:
    """For hosts with n labelled pages, x of them bad: posterior mean and lower bound of the rate.

    The bound is the mean less z standard deviations of the host's beta posterior.
    """
    domain, suffix = registered(F.col("host"))
    base = hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "x")
    total = base.agg(F.sum("n").alias("n"), F.sum("x").alias("x")).first()
    rate = total.x / total.n if total.n else GUESS
    rate = min(max(rate, 1e-6), 1 - 1e-6)

    def shrunk(units: DataFrame, parents: int) -> tuple[DataFrame, float]:
        k = _strength(units, parents)
        return units.withColumn("mean", (F.col("x") + k * F.col("up")) / (F.col("n") + k)), k

    def summed(*by: str) -> DataFrame:
        return base.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("x").alias("x"))

    suffixes, _ = shrunk(summed("suffix").withColumn("up", F.lit(rate)), 1)
    ups = suffixes.select("suffix", F.col("mean").alias("up"))
    domains, _ = shrunk(summed("domain", "suffix").join(ups, "suffix"), suffixes.count())
    ups = domains.select("domain", "suffix", F.col("mean").alias("up"))
    found, k = shrunk(base.join(ups, ["domain", "suffix"]), domains.count())
    weight = F.col("n") + k
    mean = F.col("mean")
    deviation = F.sqrt(mean * (1 - mean) / (weight + 1))
    return found.select("host", "mean", (mean - z * deviation).alias("bound"))


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[Rule],
    limit: float = 0.5,
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """Every page's host, path, rule, verdict and its host's bound.

    ``outcomes`` has a page key and whether the page is bad; pages and outcomes meet by the key.
    """
    named = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"))
    named = parsed(named, "url")
    known = outcomes.groupBy("key").agg(F.max("bad").alias("bad")).filter("bad is not null")
    hosts = stored(
        named.select("key", "host")
        .join(known, "key", "left")
        .groupBy("host")
        .agg(F.count("bad").alias("n"), F.count_if("bad").alias("x")),
        "hosts",
    )
    judged = reputation(hosts).join(host_rules(hosts, rules), "host", "left")
    judged = stored(judged.select("host", "bound", "rules"), "host-verdicts")
    fits = F.filter("rules", lambda rule: F.col("path").startswith(rule["rule_path"]))
    first = F.get(fits, F.lit(0))
    return (
        named.join(judged, "host")
        .withColumn("first", first)
        .select(
            "key",
            "host",
            "path",
            F.col("first.rule").alias("rule"),
            F.coalesce(
                "first.verdict", F.when(F.col("bound") > limit, "block").otherwise("allow")
            ).alias("verdict"),
            F.col("bound").alias("bad_bound"),
        )
    )
