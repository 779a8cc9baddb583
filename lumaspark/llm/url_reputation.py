"""URL filtering by empirical-Bayes host reputation, with built-in functions only.

Labelled outcomes are counted by host, registered domain and suffix. A suffix's bad rate is shrunk towards the overall
rate, a domain's towards its suffix's, a host's towards its domain's, each by a beta prior whose strength is
estimated from how much the rates of that level vary beyond chance. A host is blocked if the lower bound of its
posterior bad rate exceeds a limit. Fixed rules come first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .uneven import join_uneven

#: (host, path, verdict); a rule fits its host and all subdomains if the path starts with the rule's.
Rule = tuple[str, str, str]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Second-level labels below which country suffixes register domains.
SECOND_LEVEL = (
    "ac", "asn", "co", "com", "edu", "firm", "gen", "go", "gob", "gouv", "gov", "govt", "gv", "id", "ind", "info", "lg", "ltd", "me", "mil", "ne", "net", "nhs", "nom",
    "or", "org", "plc", "police", "sch", "school", "web",
)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null and without ``://``."""
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.when(url.contains("://"), F.translate(host, _UPPER, _LOWER)).otherwise("")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null and without ``://``."""
    return F.when(url.contains("://"), F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _rest(url: Column) -> Column:
    return F.substr(url, F.instr(url, "://") + 3)


def server_of(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def _numeric(server: Column) -> Column:
    return server.rlike(r"^[0-9.]+$") | server.startswith("[")


def suffix_of(host: Column) -> Column:
    """The last label, or the last two where a country label follows a registry's (``co.uk``). Addresses in numbers have no
    suffix but themselves."""
    server = server_of(host)
    last = F.substring_index(server, ".", -1)
    second = F.substring_index(F.substring_index(server, ".", -2), ".", 1)
    named = F.when((F.length(last) == 2) & second.isin(*SECOND_LEVEL) & server.contains("."), F.concat_ws(".", second, last)).otherwise(last)
    return F.when(_numeric(server), server).otherwise(named)


def domain_of(host: Column) -> Column:
    """The suffix and one label more; ports do not make a domain."""
    server, suffix = server_of(host), suffix_of(host)
    named = F.when(suffix.contains("."), F.substring_index(server, ".", -3)).otherwise(F.substring_index(server, ".", -2))
    return F.when(_numeric(server), server).otherwise(named)


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, nulls if none fits; of equally long ones the first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, decides in reversed(sorted(rules, key=lambda r: -len(r[0] + r[1]))):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule, verdict = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, decides).otherwise(verdict)
    return rule, verdict


def _prior(level: DataFrame, least: float = 1.0, most: float = 1000.0) -> tuple[Column, Column]:
    """Overall rate of ``(n, bad)`` rows and the prior's strength by the method of moments, as scalar subqueries."""
    sums = level.agg(F.sum("bad").alias("b"), F.sum("n").alias("n"), F.count("*").alias("groups"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("squares"))
    rate = F.when(F.col("n") > 0, F.col("b") / F.col("n")).otherwise(0.5)
    chance = rate * (1 - rate)
    between = F.when(F.col("n") > 0, (F.col("squares") / F.col("n") - rate * rate) - chance * F.col("groups") / F.col("n")).otherwise(0.0)
    strength = F.when(between > 0, F.greatest(F.lit(least), F.least(F.lit(most), chance / between - 1))).otherwise(F.lit(most))
    return sums.select(rate).scalar(), sums.select(strength).scalar()


def host_reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """``(host, n, bad, mean, bound)`` from labelled ``outcomes(host, bad)``: posterior mean of the bad rate and its lower
    bound (mean less ``z`` posterior standard deviations). Rows with a null or empty host or a null outcome do not count.

    Counts are combined before they are shuffled, so a host with a third of all rows costs one row a task, and written once, as
    every level and prior is made of them. The levels' priors are scalar subqueries; nothing is collected."""
    hosts = outcomes.where("host <> '' and bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    hosts = Scratch(outcomes.sparkSession).keep(hosts, "hosts")
    hosts = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    def shrunk(level: DataFrame, prior: Column | None, name: str) -> DataFrame:
        rate, strength = _prior(level)
        level = level.withColumn("strength", strength)
        return level.withColumn(name, (F.col("bad") + F.col("strength") * (rate if prior is None else prior)) / (F.col("n") + F.col("strength")))

    s = shrunk(suffixes, None, "suffix_mean").select("suffix", "suffix_mean")
    d = shrunk(domains.join(s, "suffix"), F.col("suffix_mean"), "domain_mean").select("domain", "domain_mean")
    h = shrunk(hosts.join(d, "domain"), F.col("domain_mean"), "mean")
    return h.select("host", "n", "bad", "mean", (F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("strength") + 1))).alias("bound"))


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = (), limit: float = 0.5, z: float = 1.645, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, bound)`` of every row: the rule's verdict where one fits, else ``block`` if the
    host's lower bound exceeds ``limit``, else ``allow``. ``outcomes(page_id, bad)`` labels pages by 1 or 0.

    Hosts without outcomes have a null bound and are allowed, so are null urls and urls without ``://``, whose host
    and path are empty. An id labelled more than once counts once, by its largest label. Repeated rows give repeated
    results, null ids stay null, other columns are ignored, an empty table gives an empty table; very long urls are taken whole;
    of equally long rules the first counts. ``rules`` is a short list written in code; it becomes one expression. Bounds of hosts that
    very many pages share are joined by broadcast.
    """
    url = pages[url_col].cast("string")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    marks = outcomes.where("bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    reputation = host_reputation(rows.select("page_id", "host").join(marks, "page_id").select("host", "bad"), z).select("host", "bound")
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    bounds = rows.groupBy("host").agg(F.count("*").alias("weight")).join(reputation, "host", "left")
    judged = join_uneven(rows, Scratch(pages.sparkSession).keep(bounds, "bounds"), ["host"], "bound", F.xxhash64("page_id", "path"))
    found = F.coalesce(verdict, F.when(F.col("bound") > limit, "block").otherwise("allow"))
    return judged.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), rule.alias("rule"), found.alias("verdict"), "bound")
