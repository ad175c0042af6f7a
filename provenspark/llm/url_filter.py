"""URL filters: rules first, then empirical-Bayes host reputation.

Outcomes of labelled pages are counted by host.  A beta-binomial prior is
passed down from all hosts to the public suffix, the registered domain and the
host: at each level the parent's posterior mean is the prior mean and the prior
strength comes from the moments of the children's rates.  A host is blocked
where the lower bound of its posterior bad rate is above ``most``; a host
without an outcome is judged by its domain, else by its suffix.

Counts are aggregated map-side, so a host with a third of all pages costs one
row per task; levels join on aggregates and only the last join touches pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenspark.llm.shared import cut

#: Fixed rules: (action, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Public suffixes of two labels; every other suffix is the last label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in", "com.cn", "co.za")
#: Standard deviations below the mean, bad rate to block above, and bounds of a prior's strength in pages.
Z, MOST, STRENGTH = 1.0, 0.2, (2.0, 1000.0)
#: Rules up to which they are compiled to one column; more are joined by host suffix.
COMPILED = 200


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1)) if suffixes else F.substring_index(host, ".", -1)


def domain_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The suffix and one label before it."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(two) if suffixes else two


def parents(hosts: DataFrame, suffixes: tuple[str, ...] | DataFrame = SUFFIXES) -> DataFrame:
    """hosts (host distinct, ...) with domain and suffix.

    suffixes: public suffixes of two labels, or a table (suffix string) of any
    size, whose longest entry that ends the host counts; a host without one has
    its last label.  An address or a host of one label is its own domain.
    """
    if not isinstance(suffixes, DataFrame):
        return hosts.select("*", domain_of(F.col("host"), suffixes).alias("domain"), suffix_of(F.col("host"), suffixes).alias("suffix"))
    labels = F.split("host", r"\.")
    tails = hosts.select("host", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("at", "suffix"))
    known = tails.join(suffixes.select(F.lower("suffix").alias("suffix")).distinct(), "suffix").groupBy("host").agg(F.min("at").alias("at"))
    placed = hosts.join(known, "host", "left").withColumn("_at", F.coalesce("at", F.size(labels) - 1)).drop("at")
    part = lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    return placed.select(*hosts.columns, part(F.greatest(F.lit(1), F.col("_at"))).alias("domain"), part(F.col("_at") + 1).alias("suffix"))


def _rule_column(host: Column, path: Column, rules, pick: int) -> Column:
    out = None
    for action, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.lit((rule_host + rule_path, action)[pick])
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("string") if out is None else out


def with_rules(rows: DataFrame, rules=RULES) -> DataFrame:
    """rows (host, path, ...) with rule and action: the longest rule that fits, ties to the smaller text."""
    if len(rules) <= COMPILED:
        return rows.withColumn("rule", _rule_column(F.col("host"), F.col("path"), rules, 0)).withColumn("action", _rule_column(F.col("host"), F.col("path"), rules, 1))
    table = rows.sparkSession.createDataFrame([(h, p, h + p, a) for a, h, p in rules], "rule_host string, rule_path string, rule string, action string")
    labels = F.split("host", r"\.")
    ends = rows.select("host", "path").distinct().withColumn("rule_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    fits = ends.join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = fits.groupBy("host", "path").agg(F.min_by(F.struct("rule", "action"), F.struct(-F.length("rule"), F.col("rule"))).alias("b")).select("host", "path", "b.*")
    return rows.join(best, ["host", "path"], "left")


def _prior(children: DataFrame, mean: Column) -> DataFrame:
    """children with prior strength m: the moments of their rates around the parent's mean, over the whole level."""
    spread = (
        children.groupBy()
        .agg(
            F.sum(F.col("n") * (F.col("k") / F.col("n") - mean) * (F.col("k") / F.col("n") - mean)).alias("ss"),
            F.sum(mean * (1 - mean)).alias("binomial"),
            F.sum(F.col("n") * mean * (1 - mean)).alias("scale"),
        )
        .select(
            # E[ss] = sum of p(1-p) * (1 + (n-1) * rho), with rho = 1 / (m + 1)
            F.when((F.col("scale") > F.col("binomial")), F.greatest(F.lit(0.0), (F.col("ss") - F.col("binomial")) / (F.col("scale") - F.col("binomial")))).otherwise(F.lit(0.0)).alias("rho")
        )
        .select(F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), F.when(F.col("rho") > 0, 1 / F.col("rho") - 1).otherwise(F.lit(STRENGTH[1])))).alias("m"))
    )
    return children.join(F.broadcast(spread))  # one row


def _posterior(level: DataFrame) -> tuple[Column, Column]:
    """(mean, bound) of a level's rows (n, k, up, m)."""
    a, b = F.col("m") * F.col("up") + F.col("k"), F.col("m") * (1 - F.col("up")) + F.col("n") - F.col("k")
    mean = a / (a + b)
    return mean.alias("mean"), (mean - Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("bound")


def reputations(outcomes: DataFrame, suffixes: tuple[str, ...] | DataFrame = SUFFIXES) -> dict[str, DataFrame]:
    """By level (host, domain, suffix): (its name, n, k, mean, bound), the posterior bad rates of all names with an outcome.

    Null hosts or outcomes are left out; an empty table gives no rows.
    """
    counted = outcomes.where("host is not null and bad is not null").groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("k"))
    hosts = cut(parents(counted, suffixes), "hosts")  # every level reads these counts, not the outcomes
    total = hosts.groupBy().agg(((F.sum("k") + 1) / (F.sum("n") + 2)).alias("up"))
    by_suffix = _prior(hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(F.broadcast(total)), F.col("up"))
    by_suffix = cut(by_suffix.select("suffix", "n", "k", *_posterior(by_suffix)), "suffixes")
    by_domain = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(by_suffix.select("suffix", F.col("mean").alias("up")), "suffix")
    by_domain = _prior(by_domain, F.col("up"))
    by_domain = cut(by_domain.select("domain", "n", "k", *_posterior(by_domain)), "domains")
    by_host = _prior(hosts.join(by_domain.select("domain", F.col("mean").alias("up")), "domain"), F.col("up"))
    return {"host": cut(by_host.select("host", "n", "k", *_posterior(by_host)), "hosts"), "domain": by_domain, "suffix": by_suffix}


def host_reputation(outcomes: DataFrame, suffixes: tuple[str, ...] | DataFrame = SUFFIXES) -> DataFrame:
    """(host, n, k, mean, bound) from outcomes (host string, bad int): posterior bad rate of every labelled host."""
    return reputations(outcomes, suffixes)["host"]


def judge(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, most: float = MOST, suffixes: tuple[str, ...] | DataFrame = SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate, bound) for every row of pages.

    A null url or one without :// has an empty host and path.  A rule's action
    stands; else a page is blocked where its host's bound is above most, or that
    of its domain or suffix where the host or domain has no labelled page; pages
    of a suffix without any are allowed.  Null and repeated ids are judged row
    for row; other columns are not read; an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    names = parents(rows.select("host").distinct(), suffixes)
    for level, known in reputations(outcomes, suffixes).items():
        names = names.join(known.select(level, F.struct("mean", "bound").alias(f"by_{level}")), level, "left")
    # hosts with their numbers are a table of known size: small ones go out to the pages, else the planner splits the pages of a hot host
    names = cut(names.select("host", F.coalesce("by_host", "by_domain", "by_suffix").alias("by")).select("host", F.col("by.mean").alias("bad_rate"), F.col("by.bound").alias("bound")), "names")
    judged = with_rules(rows, rules).join(names, "host", "left")
    verdict = F.coalesce("action", F.when(F.col("bound") > most, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "bad_rate", "bound")
