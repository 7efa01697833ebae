"""URL filter by empirical-Bayes host reputation, in DataFrame operations only.

Labelled pages are counted by host, registered domain (the label before the suffix, with it) and suffix (the
last label, or the last two where these are among the given suffixes of two labels).  The rate of bad pages of a host has a beta prior centred on its domain's posterior mean,
that of a domain one centred on its suffix's, that of a suffix one centred on the overall rate.  The
strength of each prior comes from the data: the intraclass correlation of its level, by moments.  A page
is blocked where the lower posterior bound of its host's rate exceeds a limit.  Block and allow rules go
before the reputation.

A page is bad if its label says toxic, or of no quality.

Edge cases: a null url, or one without `://`, has an empty host and path, and is judged under the empty
host; hosts without labelled pages get the bound of their prior; without any label nothing is blocked;
pages with several labels are bad if one says so; repeated rows are judged one by one; a hot host costs
one row a task before the shuffle, and the join back is one that Spark can split; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import stored, table

#: Rules as "host/path", with what they say.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: A host is blocked where more than a quarter of its pages are bad with a chance of 95 in 100: one clean page in
#: four doesn't make up for three bad ones, and 1.645 deviations leave 5 in 100 below.
LIMIT, DEVIATIONS = 0.25, 1.645
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and what it says; nulls where none does.  For a handful of rules."""
    rule = said = F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, said = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(said)
    return rule, said


def strength(groups: DataFrame, rate: float) -> float:
    """Prior strength of a level with columns n and bad: 1/rho - 1 for the intraclass correlation rho."""
    p = F.col("bad") / F.col("n")
    row = groups.where("n > 0").agg(F.count("*").alias("g"), F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("sq"), F.sum(F.col("n") * (p - rate) * (p - rate)).alias("s")).first()
    if not row["g"] or row["g"] < 2 or rate <= 0 or rate >= 1:
        return 100.0
    spare = row["t"] - row["sq"] / row["t"] - (row["g"] - 1)
    rho = (row["s"] / (rate * (1 - rate)) - (row["g"] - 1)) / spare if spare > 0 else 0.0
    rho = min(max(rho, 0.001), 0.9)
    return round(1 / rho - 1, 6)


def domain_and_suffix(host: Column, two_labels: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """The registered domain and the suffix of a host; ``two_labels`` are suffixes such as `co.uk`."""
    last, two, three = (F.regexp_extract(host, rf"([^.]*\.){{0,{k}}}[^.]*$", 0) for k in range(3))
    long = two.isin(*two_labels) if two_labels else F.lit(False)
    return F.when(long, three).otherwise(two), F.when(long, two).otherwise(last)


def reputation(pages: DataFrame, two_labels: tuple[str, ...] = ()) -> DataFrame:
    """(host, n, bad) of labelled pages to (host, mean, lower): the posterior mean rate and its lower bound."""
    hosts = pages.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domain, suffix = domain_and_suffix(F.col("host"), two_labels)
    # One row a host, written once: the strengths, the total and the posteriors all read it.
    hosts = stored(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    rate = total["bad"] / total["n"] if total["n"] else 0.0
    of_suffix, of_domain, of_host = (strength(x, rate) for x in (suffixes, domains, hosts))
    suffixes = suffixes.select("suffix", ((F.col("bad") + of_suffix * rate) / (F.col("n") + of_suffix)).alias("above"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", ((F.col("bad") + of_domain * F.col("above")) / (F.col("n") + of_domain)).alias("prior"))
    joined = hosts.join(domains, ["domain", "suffix"])
    size = F.col("n") + of_host
    mean = (F.col("bad") + of_host * F.col("prior")) / size
    rows = joined.select("host", mean.alias("mean"), size.alias("size"))
    return rows.select("host", "mean", (F.col("mean") - DEVIATIONS * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("size") + 1))).alias("lower"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, limit: float = LIMIT, two_labels: tuple[str, ...] = (), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, lower) for every page; ``outcomes`` is (id, bad)."""
    url = F.col(url_col).cast("string")
    seen = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    marks = outcomes.dropna().groupBy("id").agg(F.max("bad").alias("bad"))
    counted = seen.select("id", "host").join(marks, "id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.round("lower", 9) > limit, "block").otherwise("allow")
    return seen.join(reputation(counted, two_labels), "host", "left").select("id", "host", "path", rule.alias("rule"), F.coalesce(said, method).alias("verdict"), F.round("lower", 6).alias("lower"))


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int").alias("bad"))
    return judge(table(spark, sf_dir, "pages"), labels).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def _level(name: str, source: str, key: str, prior: str, above: str) -> str:
    """SQL for one level: its strength by moments, and the posterior mean of each of its groups."""
    return f"""
{name}_k AS (
  SELECT CASE WHEN g IS NULL OR g < 2 OR rate <= 0 OR rate >= 1 THEN 100.0
    ELSE round(1 / least(greatest(CASE WHEN t - sq / t - (g - 1) > 0 THEN (s / (rate * (1 - rate)) - (g - 1)) / (t - sq / t - (g - 1)) ELSE 0.0 END, 0.001), 0.9) - 1, 6) END AS k
  FROM (SELECT count(*) AS g, sum(n)::DOUBLE AS t, sum(n * n)::DOUBLE AS sq, sum(n * (bad::DOUBLE / n - rate) * (bad::DOUBLE / n - rate)) AS s, any_value(rate) AS rate
        FROM (SELECT * FROM {source} WHERE n > 0), total)),
{name}_p AS (
  SELECT {key}, (bad + k * {prior}) / (n + k) AS mean_{name}, n + k AS size_{name} FROM {source}{above}, {name}_k, total)"""


ORACLE = f"""
WITH marks AS (
  SELECT doc_id, max(CAST(toxic = 1 OR quality = 0 AS INT)) AS bad FROM labels WHERE (toxic = 1 OR quality = 0) IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
seen AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
hosts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, regexp_extract(host, '([^.]*\\.)?[^.]*$', 0) AS domain, regexp_extract(host, '[^.]*$', 0) AS suffix
  FROM seen LEFT JOIN marks ON page_id = doc_id GROUP BY host),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY suffix, domain),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
total AS (SELECT CASE WHEN sum(n) > 0 THEN sum(bad)::DOUBLE / sum(n) ELSE 0.0 END AS rate FROM suffixes),
{_level("suffix", "suffixes", "suffix", "rate", "")},
{_level("domain", "domains", "domain, suffix", "mean_suffix", " JOIN suffix_p USING (suffix)")},
{_level("host", "hosts", "host", "mean_domain", " JOIN domain_p USING (domain, suffix)")},
judged AS (
  SELECT page_id, host, path, CASE
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    mean_host - {DEVIATIONS} * sqrt(mean_host * (1 - mean_host) / (size_host + 1)) AS lower
  FROM seen LEFT JOIN host_p USING (host))
SELECT page_id, host, path, rule,
  CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
    ELSE CASE WHEN round(lower, 9) > {LIMIT} THEN 'block' ELSE 'allow' END END AS verdict
FROM judged
"""
