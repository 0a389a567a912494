"""URL filters: explicit rules, and an empirical-Bayes reputation of hosts where none fits. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first :// up to /, ? or # in lower case, and from there up to ? or #; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0), F.lit(""))


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without user and port; a country's two-part suffixes (co.uk) count as one."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    suffix = F.regexp_extract(name, r"((?:\.(?:co|com|org|net|ac|gov|edu)\.[a-z]{2})|(?:\.[^.]*))$", 1)
    suffix = F.when(suffix == "", name).otherwise(F.substr(suffix, F.lit(2)))
    label = F.regexp_extract(F.substr(name, F.lit(1), F.greatest(F.length(name) - F.length(suffix) - 1, F.lit(0))), r"[^.]*$", 0)
    return F.when(label == "", suffix).otherwise(F.concat(label, F.lit("."), suffix)), suffix


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (host/path, allow or block) that fits: its host or a subdomain, and a path that begins with its own."""
    known = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(r.partition("/")[0]).alias("host"), F.lit("/" + r.partition("/")[2]).alias("path")) for r, v in sorted(rules, key=lambda x: (-len(x[0]), x[0]))]).cast("array<struct<rule:string,verdict:string,host:string,path:string>>")
    return F.try_element_at(F.filter(known, lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"])), F.lit(1))


def spread(children: DataFrame) -> float:
    """Prior strength of one level by moments of the beta-binomial: n labelled and k good pages of each child, its parent's mean."""
    e = F.col("n") * F.col("mean") * (1 - F.col("mean"))
    above, below = children.agg(F.sum((F.col("k") - F.col("n") * F.col("mean")) ** 2 - e), F.sum(e * (F.col("n") - 1))).first()
    rho = min(0.95, max(0.001, above / below)) if below else 0.001
    return 1 / rho - 1


def judge_pages(
    pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], page_id: str = "page_id", url: str = "url", good: str = "good", least_good: float = 0.5, deviations: float = 1.0
) -> DataFrame:
    """A verdict for each page's url: (page_id, host, path, rule, verdict, mean, bound).

    The project has no url records, so this is general. The longest fitting rule decides; rule is null where none fits.
    Else the host's reputation does: outcomes holds url and good (0/1) of labelled pages; their shares are shrunk through
    beta-binomial priors from host to registered domain to suffix, each prior's strength fitted to the level below by
    moments, and a page is allowed if the posterior mean less so many standard deviations reaches least_good. Hosts,
    domains and suffixes without labels take the prior of the level above. A null url or one without :// has an empty
    host and path, no rule and the verdict of the unlabelled. Null outcomes don't count. Every row is returned, repeated
    ones and null ids too; further columns are ignored. rules is a list in code.
    """
    host, path = host_and_path(F.col("url"))
    seen = outcomes.select(F.col(url).cast("string").alias("url"), F.col(good).cast("int").alias("good")).where("good is not null").select(host.alias("host"), "good")
    hosts = seen.groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("k"))
    domain, suffix = levels(F.col("host"))
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    n, k = hosts.agg(F.sum("n"), F.sum("k")).first()
    whole = ((k or 0) + 1) / ((n or 0) + 2)
    posterior = lambda s: (F.col("k") + s * F.col("mean")) / (F.col("n") + s)
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("mean", F.lit(whole))
    of_suffix = suffixes.select("suffix", posterior(spread(suffixes)).alias("suffix_mean"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(of_suffix, "suffix").withColumnRenamed("suffix_mean", "mean")
    # Domain co.uk stands under suffix uk for host co.uk and under co.uk for host .co.uk, so the two together are the key.
    of_domain = domains.select("domain", "suffix", posterior(spread(domains)).alias("domain_mean"))
    under = hosts.join(of_domain, ["domain", "suffix"]).withColumnRenamed("domain_mean", "mean")
    strength = spread(under)
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url")).select("id", host.alias("host"), path.alias("path"))
    rows = rows.withColumns(dict(zip(("domain", "suffix"), levels(F.col("host")), strict=True)))
    known = rows.join(hosts.select("host", "n", "k"), "host", "left").join(of_domain, ["domain", "suffix"], "left").join(of_suffix, "suffix", "left")
    prior = F.coalesce("domain_mean", "suffix_mean", F.lit(whole))
    a = strength * prior + F.coalesce("k", F.lit(0))
    b = strength * (1 - prior) + F.coalesce("n", F.lit(0)) - F.coalesce("k", F.lit(0))
    known = known.withColumns({"a": a, "b": b}).withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))
    known = known.withColumn("bound", F.col("mean") - deviations * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("a") + F.col("b") + 1)))
    known = known.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    return known.select(F.col("id").alias(page_id), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(F.col("bound") >= least_good, "allow").otherwise("block")).alias("verdict"), "mean", "bound")
