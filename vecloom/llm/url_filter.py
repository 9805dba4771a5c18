"""URL verdicts by rules and, where no rule fits, by empirical-Bayes host reputation."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import cut, join_counted, table

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Suffixes of more than one label that the query knows; any other suffix has one.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "gov.uk", "org.uk")
#: Hosts that are addresses.
ADDRESS = r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*)$"
MOST_BAD = 0.3
Z = 1.645


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def suffix_and_domain(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """The public suffix of a host without its port, and the registered domain: the suffix and one label.

    `suffixes` are rules as public suffix lists write them: `co.uk`, `*.ck` for any label there, `!www.ck` for an exception, which takes
    away the rule's first label. Exceptions go first, then the rule of most labels; a host that none fits has a suffix of one label.
    An address in digits or brackets shares nothing: it is its own suffix and domain, as is a host that is a suffix.
    """
    bare = F.regexp_replace(host, ":[0-9]*$", "")
    last = lambda n: F.substring_index(bare, ".", -n)
    labels = F.size(F.split(bare, "\\."))
    by_depth: dict[tuple[str, int], list[str]] = {}
    for rule in suffixes:
        kind = rule[0] if rule[0] in "!*" else ""
        by_depth.setdefault((kind, rule.count(".") + 1), []).append(rule.removeprefix("!").removeprefix("*."))
    suffix = F.when(bare.rlike(ADDRESS), bare)
    for (kind, depth), names in sorted(by_depth.items(), key=lambda x: (x[0][0] != "!", -x[0][1], x[0][0])):
        if kind == "*":
            suffix = suffix.when((labels >= depth) & last(depth - 1).isin(*names), last(depth))
        else:
            suffix = suffix.when(last(depth).isin(*names), last(depth - 1) if kind else last(depth))
    suffix = suffix.otherwise(last(1))
    before = bare.substr(F.lit(1), F.length(bare) - F.length(suffix) - 1)
    return suffix, F.when(bare == suffix, bare).otherwise(F.concat_ws(".", F.substring_index(before, ".", -1), suffix))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does. One comparison a rule and row."""
    rule = verdict = None
    for says, text in sorted(rules, key=lambda r: -len(r[1])):
        at, _, rest = text.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(f"/{rest}"))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if rule is None else (rule, verdict)


def _strength(counts: DataFrame) -> tuple[float, float]:
    """Mean and prior strength of a beta-binomial over the groups' (bad, n), by moments.

    The correlation inside groups is held to 0.001 .. 0.5, so the strength to 1 .. 999.
    """
    row = counts.where("n > 0").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("x"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("xx"), F.sum(F.col("n") * F.col("n").cast("double")).alias("nn")
    ).first()
    if not row["n"]:
        return 0.5, 1.0
    mean = (row["x"] + 1) / (row["n"] + 2)
    spread = row["xx"] - row["x"] * row["x"] / row["n"]
    free = row["n"] - row["nn"] / row["n"] - (row["k"] - 1)
    rho = (spread / (mean * (1 - mean)) - (row["k"] - 1)) / free if free > 0 else 0.5
    rho = min(0.5, max(0.001, rho))
    return mean, (1 - rho) / rho


def host_reputation(pages: DataFrame, suffixes_known: Sequence[str] = SUFFIXES) -> DataFrame:
    """host, pages, n, bad, alpha, beta for (host, outcome) rows; outcome is 1 for bad, 0 for good, null where unknown.

    The prior of a host is its domain's posterior mean, that of a domain its suffix's, that of a
    suffix the overall mean; each level's strength is fitted by moments. Only the fitted
    constants, three pairs of numbers, come to the driver; a hot host is summed before the shuffle.
    """
    suffix, domain = suffix_and_domain(F.col("host"), suffixes_known)
    counts = pages.groupBy("host").agg(F.count("*").alias("pages"), F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).alias("bad"))
    hosts = cut(counts.withColumns({"domain": domain, "suffix": suffix}))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    mean, of_suffixes = _strength(suffixes)
    _, of_domains = _strength(domains)
    _, of_hosts = _strength(hosts)
    shrunk = lambda prior, strength: (F.col("bad") + strength * prior) / (F.col("n") + strength)
    suffixes = suffixes.select("suffix", shrunk(F.lit(mean), of_suffixes).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk(F.col("suffix_mean"), of_domains).alias("domain_mean"))
    return hosts.join(domains, "domain").select(
        "host", "pages", "n", "bad", (F.col("bad") + of_hosts * F.col("domain_mean")).alias("alpha"), (F.col("n") - F.col("bad") + of_hosts * (1 - F.col("domain_mean"))).alias("beta")
    )


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, most_bad: float = MOST_BAD, z: float = Z, key: str = "page_id", url: str = "url", suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """key, host, path, rule, verdict, bad_bound for every row of `pages`.

    `outcomes` has (key, outcome): 1 for a bad page, 0 for a good one; of several rows of a key the
    worst counts. A page that no rule fits is blocked if the lower bound of its host's bad rate, the
    posterior mean less z standard deviations, is above `most_bad`. A null url or one without ``://``
    has an empty host and path, which no rule fits and which has a reputation like any host. Null keys
    have no outcome. Of rules of equal length the first given wins. Repeated rows give repeated rows, an empty table an
    empty one; other columns are not read. Hosts of very many pages meet their reputation by a broadcast of bounded size.
    """
    rows = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    known = outcomes.groupBy(F.col(key).alias("key")).agg(F.max("outcome").alias("outcome"))
    reputation = host_reputation(rows.join(known, "key", "left").select("host", "outcome"), suffixes)
    total = F.col("alpha") + F.col("beta")
    bound = F.col("alpha") / total - z * F.sqrt(F.col("alpha") * F.col("beta") / (total * total * (total + 1)))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_bound") > most_bad, "block").otherwise("allow")
    return join_counted(rows, reputation.select("host", "pages", bound.alias("bad_bound")), "host", "pages").select(F.col("key").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bad_bound")


def op8_url_filters(spark, sf_dir):
    """page_id, host, path, rule and verdict of every page; see judge_urls for nulls, ties, repeats and empty tables."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("outcome"))
    return judge_urls(table(spark, sf_dir, "pages"), labels).drop("bad_bound")


_SUFFIXES = ", ".join(f"'{s}'" for s in SUFFIXES)


def _strength_sql(groups: str) -> str:
    return f"""(SELECT CASE WHEN coalesce(n, 0) = 0 THEN 0.5 ELSE (x + 1.0) / (n + 2) END AS mean, CASE WHEN coalesce(n, 0) = 0 THEN 1.0 ELSE (1 - rho) / rho END AS strength FROM (
  SELECT n, x, least(0.5, greatest(0.001, CASE WHEN n - nn / n - (k - 1) > 0 THEN ((xx - x * x / n) / ((x + 1) / (n + 2) * (1 - (x + 1) / (n + 2))) - (k - 1)) / (n - nn / n - (k - 1)) ELSE 0.5 END)) AS rho
  FROM (SELECT count(*)::DOUBLE AS k, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS x, sum(bad::DOUBLE * bad / n) AS xx, sum(n::DOUBLE * n) AS nn FROM {groups} WHERE n > 0)))"""


ORACLE_SQL = f"""
WITH labelled AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS outcome FROM labels GROUP BY doc_id),
urls AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
counts AS (SELECT host, regexp_replace(host, ':[0-9]*$', '') AS bare, count(outcome) AS n, coalesce(sum(outcome), 0)::BIGINT AS bad FROM urls LEFT JOIN labelled USING (page_id) GROUP BY host),
parts AS (SELECT *, string_split(bare, '.') AS p FROM counts),
hosts AS (SELECT *, CASE WHEN regexp_matches(bare, '{ADDRESS}') THEN bare WHEN array_to_string(p[-2:], '.') IN ({_SUFFIXES}) THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain, CASE WHEN regexp_matches(bare, '{ADDRESS}') THEN bare WHEN array_to_string(p[-2:], '.') IN ({_SUFFIXES}) THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix FROM parts),
domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM domains GROUP BY suffix),
s AS {_strength_sql("suffixes")}, d AS {_strength_sql("domains")}, h AS {_strength_sql("hosts")},
suffix_means AS (SELECT suffix, (bad + s.strength * s.mean) / (n + s.strength) AS m FROM suffixes, s),
domain_means AS (SELECT domain, (bad + d.strength * suffix_means.m) / (n + d.strength) AS m FROM domains JOIN suffix_means USING (suffix), d),
posterior AS (SELECT host, bad + h.strength * m AS a, n - bad + h.strength * (1 - m) AS b FROM hosts JOIN domain_means USING (domain), h),
bounds AS (SELECT host, a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM posterior),
ruled AS (SELECT urls.*, bound, CASE
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM urls JOIN bounds USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound > {MOST_BAD} THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
