r"""URL verdicts: fixed rules first, then the empirical-Bayes reputation of the host.

Labelled pages give each host, registered domain and suffix (bad, all) counts. Suffixes are shrunk towards the rate of
all pages, domains towards their suffix, hosts towards their domain, each by a beta prior whose weight is fitted from
the spread of the rates of the units under one parent. A url is blocked if the lower bound of the posterior
of the bad rate (mean less z standard deviations) of its host lies over the limit; a host without labels has its parent's posterior.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanspark.llm.shared import lower_ascii, stored

#: (verdict, host, path) in the order given; the longest host and then path that fits wins.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: A host is hot where so many like it would have all pages.
HOT = 10_000


def url_host(url: Column) -> Column:
    """The part after the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


#: Public suffixes of two labels; all others are the last label. A parameter of the functions below.
SUFFIXES = (
    "ac.jp", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.eg", "com.es",
    "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph", "com.pk", "com.pl", "com.pt", "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "edu.tw", "go.jp",
    "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "net.uk", "nhs.uk", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.nz", "org.uk", "org.za",
)


def host_name(host: Column) -> Column:
    """A host without user, port and the dot at the end."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.?(:[0-9]*)?$", "")


def is_address(name: Column) -> Column:
    return name.rlike(r"^(\[.*\]|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$")


def host_suffix(host: Column, suffixes: tuple = SUFFIXES) -> Column:
    """The public suffix of a host: its last label, or its last two where they are in suffixes; an address is its own."""
    name = host_name(host)
    two = F.regexp_extract(name, r"([^.]*\.)?[^.]*$", 0)
    return F.when(is_address(name), name).when(two.isin(*suffixes), two).otherwise(F.regexp_extract(name, r"([^.]*)$", 1))


def host_domain(host: Column, suffixes: tuple = SUFFIXES) -> Column:
    """The registered domain of a host: the suffix and one label more, if there is one; an address is its own."""
    name = host_name(host)
    two = F.regexp_extract(name, r"([^.]*\.)?[^.]*$", 0)
    return F.when(is_address(name), name).when(two.isin(*suffixes), F.regexp_extract(name, r"([^.]*\.){0,2}[^.]*$", 0)).otherwise(two)


def rule_columns(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the url's or a parent of it and whose path starts the url's (of equally long ones the last given); else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _prior_weight(units: DataFrame) -> float:
    """Moments: units has n, bad and mu (the mean of the unit's prior); the weight in pages of the prior."""
    v = F.col("mu") * (1 - F.col("mu"))
    got = units.filter(F.col("n") > 0).agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("mu"), 2)).alias("spread"),
        F.sum(v).alias("chance"),
        F.sum(v * (F.col("n") - 1)).alias("more"),
    ).first()
    if not got or got["spread"] is None or not got["more"]:
        return 1e6
    rho = min(max((got["spread"] - got["chance"]) / got["more"], 1e-6), 0.999)
    return (1 - rho) / rho


def host_reputation(counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """counts: host, bad (0, 1 or null: not labelled), pages. Posteriors alpha and beta of the bad rate by host, domain and suffix; the rate of all pages.

    Every unit with a page has a row, labelled or not. Only sums over levels reach the driver.
    """
    known = F.when(F.col("bad").isNotNull(), F.col("pages")).otherwise(0)
    hosts = counts.groupBy("host").agg(F.sum(known).alias("n"), F.sum(F.when(F.col("bad") == 1, F.col("pages")).otherwise(0)).alias("bad"))
    hosts = hosts.withColumn("domain", host_domain(F.col("host"))).withColumn("suffix", host_suffix(F.col("host")))
    both = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*both)
    total = hosts.agg(*both).first()
    rate = (total["bad"] or 0) / total["n"] if total["n"] else 0.0

    def posterior(units: DataFrame) -> DataFrame:
        m = F.lit(_prior_weight(units))
        return units.withColumns({"alpha": m * F.col("mu") + F.col("bad"), "beta": m * (1 - F.col("mu")) + F.col("n") - F.col("bad")})

    mean = (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("mu")
    suffixes = posterior(domains.groupBy("suffix").agg(*both).withColumn("mu", F.lit(rate)))
    domains = posterior(domains.join(suffixes.select("suffix", mean), "suffix"))
    hosts = posterior(hosts.join(domains.select("domain", mean), "domain"))
    return hosts, domains, suffixes, rate


def judge_urls(pages: DataFrame, labels: DataFrame, rules: tuple = RULES, z: float = 1.645, limit: float | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_low of every row of pages (page_id, url).

    A page is labelled through the number that follows in its path: the doc_id of labels (quality, toxic); it is bad if its quality
    is 0 or it is toxic. Of several labels for one doc_id the worst counts; rows with a null doc_id never join. bad_low is the posterior mean of
    the host's bad rate less z standard deviations. Repeated rows each get their row; other columns of pages are not read. Hosts of a ten-thousandth of
    all pages or more, HOT at most, are known to every task, so no host's pages meet in one. Where no rule fits, the url is blocked if it is over limit (None: the
    bad rate of all labelled pages), allowed otherwise, and so is a null or malformed url (host empty) by the posterior of the empty host.
    """
    host, path = url_host(F.col("url").cast("string")), url_path(F.col("url").cast("string"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    number = F.expr("try_cast(regexp_extract(path, '/([0-9]{1,18})', 1) AS bigint)")
    told = labels.groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    # Pages of one host and number are counted first; those without a number meet no label.
    counted = urls.select("host", number.alias("doc_id")).groupBy("host", "doc_id").agg(F.count(F.lit(1)).alias("pages"))
    counted = stored(counted, "host-pages")
    none = counted.filter("doc_id IS NULL").select("host", F.lit(None).cast("int").alias("bad"), "pages")
    seen = counted.filter("doc_id IS NOT NULL").join(told, "doc_id", "left").select("host", "bad", "pages").unionByName(none)
    seen = stored(seen.groupBy("host", "bad").agg(F.sum("pages").alias("pages")), "host-counts")
    hosts, _, _, rate = host_reputation(seen)
    a, b = F.col("alpha"), F.col("beta")
    low = a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    total = counted.agg(F.sum("pages")).first()[0] or 0
    often = seen.groupBy("host").agg(F.sum("pages").alias("pages")).filter(F.col("pages") * HOT >= total).select("host")
    bounds = stored(hosts.select("host", low.alias("bad_low")), "host-bounds")
    known = F.broadcast(bounds.join(often, "host", "left_semi"))
    rest = urls.join(known.select("host"), "host", "left_anti").join(bounds.join(often, "host", "left_anti"), "host", "left")
    out = urls.join(known, "host").unionByName(rest)
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_low") > (rate if limit is None else limit), "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bad_low")


OP9_SQL = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
told AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
t AS (
  SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:[0-9]*)?$', '') AS name,
         TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})', 1) AS BIGINT) AS number
  FROM p),
q AS (
  SELECT host, number, name, regexp_matches(name, '^(\[.*\]|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$') AS address,
         regexp_extract(name, '([^.]*\.)?[^.]*$', 0) AS two
  FROM t),
h AS (
  SELECT host, any_value(CASE WHEN address THEN name WHEN two IN {SUFFIXES} THEN regexp_extract(name, '([^.]*\.){{0,2}}[^.]*$', 0) ELSE two END) AS domain,
         any_value(CASE WHEN address THEN name WHEN two IN {SUFFIXES} THEN two ELSE regexp_extract(name, '([^.]*)$', 1) END) AS suffix,
         CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad
  FROM q LEFT JOIN told ON told.doc_id = number GROUP BY host),
r AS (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0) AS rate FROM h),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT rate FROM r) AS mu FROM h GROUP BY suffix),
sm AS (
  SELECT (1 - rho) / rho AS m FROM (
    SELECT least(greatest((sum(n * pow(bad / n - mu, 2)) - sum(mu * (1 - mu))) / sum(mu * (1 - mu) * (n - 1)), 1e-6), 0.999) AS rho FROM s0 WHERE n > 0)),
s1 AS (SELECT suffix, ((SELECT m FROM sm) * mu + bad) / ((SELECT m FROM sm) + n) AS mu FROM s0),
d0 AS (SELECT domain, h.suffix, sum(n) AS n, sum(bad) AS bad, any_value(s1.mu) AS mu FROM h JOIN s1 USING (suffix) GROUP BY domain, h.suffix),
dm AS (
  SELECT (1 - rho) / rho AS m FROM (
    SELECT least(greatest((sum(n * pow(bad / n - mu, 2)) - sum(mu * (1 - mu))) / sum(mu * (1 - mu) * (n - 1)), 1e-6), 0.999) AS rho FROM d0 WHERE n > 0)),
d1 AS (SELECT domain, ((SELECT m FROM dm) * mu + bad) / ((SELECT m FROM dm) + n) AS mu FROM d0),
h0 AS (SELECT host, n, bad, mu FROM h JOIN d1 USING (domain)),
hm AS (
  SELECT (1 - rho) / rho AS m FROM (
    SELECT least(greatest((sum(n * pow(bad / n - mu, 2)) - sum(mu * (1 - mu))) / sum(mu * (1 - mu) * (n - 1)), 1e-6), 0.999) AS rho FROM h0 WHERE n > 0)),
h1 AS (SELECT host, (SELECT m FROM hm) * mu + bad AS a, (SELECT m FROM hm) * (1 - mu) + n - bad AS b FROM h0),
j AS (
  SELECT page_id, host, path, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > (SELECT rate FROM r) AS poor,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
         WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule
  FROM p JOIN h1 USING (host))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN poor THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""
