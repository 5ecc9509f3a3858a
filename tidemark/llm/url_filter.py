"""URL filters: fixed rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes are shrunk through beta-binomial priors: suffix towards the whole, registered domain towards its
suffix, host towards its registered domain. At each level the prior's strength comes from the data by the method of
moments over the groups' rates. A page is blocked if the lower bound of its host's posterior (mean - Z standard
deviations of the beta) exceeds LIMIT. Everything is DataFrame functions; labels are summed by host before anything is
joined, and pages meet hosts in one equi-join whose hot keys adaptive execution splits.

Defined cases: a url that is null or has no `://` has an empty host and path, fits no rule, and is judged as the host
''; hosts without labels take their domain's posterior, domains their suffix's, suffixes the whole's; with no labels at
all, nothing is blocked; repeated pages are judged alike; a label counts once for each page row it meets; null labels
count as clean; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: (verdict, host, path): the rule fits the host and its subdomains, for paths that begin with its path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
Z, LIMIT = 2.0, 0.6
#: A rule list is one expression; longer lists belong in a table.
MOST_RULES = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. Equal lengths: the alphabetically first."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one name more."""
    return F.substring_index(host, ".", -2)


def _strength(groups: DataFrame, within: list[str]) -> DataFrame:
    """Prior strength for the groups (n, bad) of each parent: method of moments on weighted rates, kept in [1, 1000]."""
    rate = F.col("bad") / F.col("n")
    sums = groups.groupBy(*within).agg(F.count("*").alias("k"), F.sum("n").alias("sn"), F.sum("bad").alias("sb"), F.sum(rate * rate * F.col("n")).alias("s2"))
    mean = F.col("sb") / F.col("sn")
    spread = F.col("s2") / F.col("sn") - mean * mean
    noise = mean * (1 - mean) * F.col("k") / F.col("sn")
    between = spread - noise
    value = F.when(between > 0, mean * (1 - mean) / between - 1).otherwise(F.lit(1000.0))
    return sums.select(*within, F.round(F.greatest(F.lit(1.0), F.least(F.lit(1000.0), value)), 6).alias("strength"))


def reputation(labelled: DataFrame) -> DataFrame:
    """host, domain, suffix, n, bad and the posterior mean and lower bound, from (host, bad 0/1) rows."""
    hosts = labelled.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").cast("long").alias("bad"))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).select((F.col("bad") / F.col("n")).alias("m"))

    def shrunk(strength: str, prior: str) -> Column:
        return (F.col("bad") + F.col(strength) * F.col(prior)) / (F.col("n") + F.col(strength))

    s0 = _strength(suffixes, []).withColumnRenamed("strength", "s0")
    s1 = _strength(domains, ["suffix"]).withColumnRenamed("strength", "s1")
    s2 = _strength(hosts, ["suffix", "domain"]).withColumnRenamed("strength", "s2")
    one = F.broadcast(whole.join(F.broadcast(s0)))  # one row each
    top = suffixes.join(one).select("suffix", shrunk("s0", "m").alias("m0"))
    mid = domains.join(top, "suffix").join(s1, "suffix").select("suffix", "domain", shrunk("s1", "m0").alias("m1"))
    low = hosts.join(mid, ["suffix", "domain"]).join(s2, ["suffix", "domain"])
    mean = shrunk("s2", "m1")
    weight = F.col("n") + F.col("s2")
    bound = mean - F.lit(Z) * F.sqrt(mean * (1 - mean) / (weight + 1))
    return low.select("host", F.col("n").alias("host_labels"), F.round(mean, 6).alias("posterior"), F.round(bound, 6).alias("bound"))


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, posterior and bound of its host (null: never labelled) for (page_id, url) rows;
    labelled: (url, bad)."""
    known = labelled.select(host_of(F.col("url")).alias("host"), F.coalesce(F.col("bad"), F.lit(0)).alias("bad"))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    out = rows.join(reputation(known), "host", "left")
    own = F.when(F.col("bound") > LIMIT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), own).alias("verdict"), "posterior", "bound")


def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of a page is that of the document with its number: bad if of low quality or toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return judge(pages, pages.join(labels, "page_id").select("url", "bad"))


def _rules_sql() -> str:
    arms = ""
    for verdict, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        arms += f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{verdict} {h}{p}'"
    return f"CASE{arms} END"


def _strength_sql(source: str, by: str) -> str:
    return f"""SELECT {by or '0 AS one'}, round(greatest(1.0::DOUBLE, least(1000.0::DOUBLE, CASE WHEN s2 / sn - m * m - m * (1 - m) * k / sn > 0
    THEN m * (1 - m) / (s2 / sn - m * m - m * (1 - m) * k / sn) - 1 ELSE 1000.0 END)), 6) AS s
  FROM (SELECT {by + ',' if by else ''} count(*)::DOUBLE AS k, sum(n)::DOUBLE AS sn, sum(bad)::DOUBLE / sum(n)::DOUBLE AS m,
    sum((bad::DOUBLE / n) * (bad::DOUBLE / n) * n) AS s2 FROM {source} {'GROUP BY ' + by if by else ''})"""


SQL_OP4 = rf"""
WITH p AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
h AS (SELECT host, split_part(host, '.', -1) AS suffix,
    CASE WHEN contains(host, '.') THEN split_part(host, '.', -2) || '.' || split_part(host, '.', -1) ELSE host END AS domain,
    count(*) AS n, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM p JOIN labels ON doc_id = page_id GROUP BY ALL),
d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
x AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
w AS (SELECT sum(bad)::DOUBLE / sum(n)::DOUBLE AS m FROM x),
s0 AS ({_strength_sql('x', '')}), s1 AS ({_strength_sql('d', 'suffix')}), s2 AS ({_strength_sql('h', 'suffix, domain')}),
t AS (SELECT suffix, (bad::DOUBLE + s * m) / (n::DOUBLE + s) AS m0 FROM x, s0, w),
u AS (SELECT suffix, domain, (bad::DOUBLE + s * m0) / (n::DOUBLE + s) AS m1 FROM d JOIN t USING (suffix) JOIN s1 USING (suffix)),
v AS (SELECT host, (bad::DOUBLE + s * m1) / (n::DOUBLE + s) AS m, n::DOUBLE + s AS wt FROM h JOIN u USING (suffix, domain) JOIN s2 USING (suffix, domain)),
r AS (SELECT host, round(m, 6) AS posterior, round(m - {Z} * sqrt(m * (1 - m) / (wt + 1)), 6) AS bound FROM v),
f AS (SELECT *, {_rules_sql()} AS fit FROM p LEFT JOIN r USING (host))
SELECT page_id, host, path, split_part(fit, ' ', 2) AS rule,
  coalesce(split_part(fit, ' ', 1), CASE WHEN bound > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, posterior, bound FROM f"""
