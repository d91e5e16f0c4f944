"""URL filter: rules first, then empirical-Bayes reputation of hosts.  DataFrame functions only.

Pages that a rule judges are the labelled outcomes.  Their good shares are shrunk down a
hierarchy: a suffix towards all pages, a registered domain towards its suffix, a host
towards its domain.  The strength of each prior comes from the spread between the groups
of that level (beta-binomial, by moments).  A page without a rule is blocked if the upper
bound of its host's good share is below one half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, settle

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Rules are spelt out in the plan, so their number is bounded.
MOST_RULES = 1000
#: Second-level labels that form a suffix together with a country's label.
SECOND = ("ac", "co", "com", "edu", "gov", "net", "org")
WIDTH = 2.0  # posterior standard deviations
WEAK, STRONG = 1.0, 1000.0  # pages that a prior may count as


def host_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for null or where no scheme is."""
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, URL, 1)), F.regexp_extract(url, URL, 2)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (pattern, verdict) that fits, as (length, rule, verdict), or null.

    A pattern is a host, a slash and the start of a path; it fits the host and its
    subdomains.  Of equal lengths the later in alphabetical order counts.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    fits = []
    for pattern, verdict in rules:
        name, _, rest = pattern.partition("/")
        fit = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        fits.append(F.when(fit, F.struct(F.lit(len(pattern)).alias("length"), F.lit(pattern).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def domain_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without port and user; a bare name is its own."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    labels = F.split(name, r"\.")
    n = F.size(labels)
    number = name.rlike(r"^[0-9.]+$") | (n < 2)
    second = (n >= 3) & F.get(labels, n - 2).isin(*SECOND) & (F.length(F.get(labels, n - 1)) == 2)
    tail = lambda k: F.concat_ws(".", F.slice(labels, -k, k))
    domain = F.when(number, name).when(second, tail(3)).otherwise(tail(2))
    return domain, F.when(number, name).when(second, tail(2)).otherwise(F.element_at(labels, -1))


def _exact(x: Column) -> Column:
    """Sums of it are the same in any order."""
    return F.sum(F.round(x, 9).cast("decimal(28,9)"))


def _shrunk(groups: DataFrame) -> DataFrame:
    """Adds ``mean`` and ``weight``: groups (good, seen, parent) shrunk to their parents' mean by one strength."""
    rate, v = F.col("good") / F.col("seen"), F.col("parent") * (1 - F.col("parent"))
    spread = (rate - F.col("parent")) * (rate - F.col("parent")) - v / F.col("seen")
    sums = groups.where("seen > 0").agg(_exact(spread).cast("double"), _exact(v * (1 - 1 / F.col("seen"))).cast("double")).first()
    share = sums[0] / sums[1] if sums[1] else 0.0
    share = min(max(share, 1 / (STRONG + 1)), 1 / (WEAK + 1))
    weight = F.lit(1 / share - 1)
    return groups.withColumn("weight", weight).withColumn("mean", (F.col("good") + weight * F.col("parent")) / (F.col("seen") + weight))


def reputations(outcomes: DataFrame) -> DataFrame:
    """Per host of ``outcomes(host, good)``: mean and upper bound of its good share.

    ``good`` is 1, 0 or null for a page without a label; hosts without labels get their
    domain's prior.  What reaches the driver are two sums per level.
    """
    seen = (F.count("good").alias("seen"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    hosts = outcomes.groupBy("host").agg(*seen)
    domain, suffix = domain_suffix(F.col("host"))
    hosts = settle(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "seen", "good"), "hosts")
    up = (F.sum("seen").alias("seen"), F.sum("good").alias("good"))
    domains = settle(hosts.groupBy("domain", "suffix").agg(*up), "domains")
    suffixes = domains.groupBy("suffix").agg(*up)
    total = domains.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("seen"), F.lit(0))).first()
    suffixes = settle(_shrunk(settle(suffixes.withColumn("parent", F.lit((total[0] + 1) / (total[1] + 2))), "suffixes")).select("suffix", F.col("mean").alias("parent")), "suffixes")
    domains = settle(_shrunk(settle(domains.join(suffixes, "suffix"), "domains")).select("domain", "suffix", F.col("mean").alias("parent")), "domains")
    hosts = _shrunk(settle(hosts.join(domains, ["domain", "suffix"]), "hosts"))
    size = F.col("seen") + F.col("weight")
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1))
    return hosts.select("host", F.round("mean", 6).alias("reputation"), F.round(F.col("mean") + WIDTH * deviation, 6).alias("bound"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict, reputation and bound of its host.

    Null and malformed urls have an empty host and path, no rule, and the reputation of the
    empty host.  Repeated rows each count and each get a row; an empty table gives an empty
    result; other columns are ignored.
    """
    host, path = host_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    good = F.when(F.col("_rule").isNotNull(), (F.col("_rule.verdict") == "allow").cast("int"))
    known = settle(reputations(rows.select("host", good.alias("good"))), "reputations")
    out = rows.join(known, "host", "left")
    method = F.when(F.col("bound") < 0.5, "block").otherwise("allow")
    return out.select(F.col("page_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), method).alias("verdict"), "reputation", "bound")


def keep_allowed(pages: DataFrame, rules: list[tuple[str, str]], *, url_col: str = "url") -> DataFrame:
    """The rows of pages, with all their columns, whose url is allowed."""
    host, path = host_path(F.col(url_col).cast("string"))
    rows = pages.withColumns({"_llm_host": host, "_llm_rule": matching_rule(host, path, rules)})
    good = F.when(F.col("_llm_rule").isNotNull(), (F.col("_llm_rule.verdict") == "allow").cast("int"))
    known = settle(reputations(rows.select(F.col("_llm_host").alias("host"), good.alias("good"))), "reputations")
    known = known.select(F.col("host").alias("_llm_host"), F.col("bound").alias("_llm_bound"))
    allowed = F.coalesce(F.col("_llm_rule.verdict") == "allow", F.col("_llm_bound") >= 0.5)
    return rows.join(known, "_llm_host", "left").where(allowed).select(*pages.columns)
