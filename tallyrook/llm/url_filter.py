"""URL filters: longest-prefix rules, then empirical-Bayes host reputation, with Spark expressions only.

Outcomes are labelled pages: a page is bad if its label says quality 0 or toxic 1 (labels' doc_id is the page_id).
Bad pages of a host are binomial; each host's rate is shrunk to its registered domain's, that to its suffix's, and that
to the rate of all labelled pages: a level's beta prior has its parent's mean, and the weight (pseudo-pages) that the
spread of rates on its level calls for by the method of moments, between MIN_WEIGHT and MAX_WEIGHT. A page without a
rule is blocked if the posterior's lower bound (mean less Z deviations) is above max_bad.

Names: reputation is of the host without user part, port and a last dot. An IP address (four numbers, or in brackets) is
its own domain, below the suffix `ip`. A suffix is the last label, or two labels if the last has two letters and the one
before is one of SECOND_LEVEL, or one of the PLATFORMS, below which anyone registers; a parameter can name others.

Outcomes are counted by host in one scan of the pages and written once; a second scan gives the verdicts. Levels are sums
of that table; their four prior numbers (one rate, three weights) go through the driver. A page meets its host's row by
host name, so a hot host is a skewed key of a join with one row a key, which adaptive execution splits.

Cases: a url without `://`, or null, has an empty host and path and no rule, and its pages are a host of their own; a url
of any length is taken whole; a null page_id has no label; repeated labels of a page count once (the worst); an empty
table of labels leaves each host the prior of no pages (rate 1/2 with little weight: below the bound of 0.25 nothing is
blocked); an empty table of pages gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrook.session import materialize

#: (verdict, host, path) of the production rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Labels below a two-letter country below which names are registered (fixed values).
SECOND_LEVEL = "ac asn co com edu firm gen go gob gouv gov gub id ind info ltd me mil ne net nhs nic nom or org plc pro sch web".split()
#: Hosts of two labels below which anyone registers (fixed values).
PLATFORMS = "appspot.com azurewebsites.net blogspot.com cloudfront.net fly.dev github.io gitlab.io glitch.me herokuapp.com netlify.app pages.dev vercel.app web.app wordpress.com workers.dev".split()
MIN_WEIGHT, MAX_WEIGHT, Z = 2.0, 200.0, 1.64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    rest = F.regexp_extract(F.substring(F.col(url), F.locate("://", F.col(url)) + F.lit(3), F.lit(2**31 - 1)), "^[^/?#]*", 0)
    return F.when(F.locate("://", F.col(url)) > 0, F.translate(rest, _UPPER, _LOWER)).otherwise("")


def path_of(url: str) -> Column:
    rest = F.substring(F.col(url), F.locate("://", F.col(url)) + F.lit(3), F.lit(2**31 - 1))
    return F.when(F.locate("://", F.col(url)) > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def site_of(host: Column) -> Column:
    """A host without user part, port and last dot."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":[0-9]*$", "")
    return F.regexp_replace(bare, r"\.$", "")


def _levels(site: Column, platforms) -> tuple[Column, Column, Column]:
    """Whether a site is an address, whether its suffix has two labels, and its last two labels."""
    two = F.substring_index(site, ".", -2)
    address = site.rlike(r"^[0-9]+(\.[0-9]+){3}$|^\[.*\]$")
    return address, two.isin(*platforms) | two.rlike(rf"^({'|'.join(SECOND_LEVEL)})\.[a-z][a-z]$"), two


def registered_domain(site: Column, platforms=PLATFORMS) -> Column:
    address, long, two = _levels(site, platforms)
    return F.when(address, site).when(long, F.substring_index(site, ".", -3)).otherwise(two)


def suffix(site: Column, platforms=PLATFORMS) -> Column:
    address, long, two = _levels(site, platforms)
    return F.when(address, "ip").when(long, two).otherwise(F.substring_index(site, ".", -1))


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of host and path: of the rules that fit, the longest."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _weight(rows: DataFrame, parent: str) -> float:
    """(n, bad, parent rate) of the names of a level -> the pseudo-pages of the level's prior.

    With p the parent's rate, n pages of a name and weight w, E[(bad - n p)^2] = n p (1 - p) (1 + (n - 1) / (w + 1)).
    """
    p = F.col(parent)
    spread = F.sum((F.col("bad") - F.col("n") * p) * (F.col("bad") - F.col("n") * p))
    plain = F.sum(F.col("n") * p * (1 - p))
    steep = F.sum(F.col("n") * (F.col("n") - 1) * p * (1 - p))
    excess = (spread - plain) / F.nullif(steep, F.lit(0.0))  # 1 / (w + 1)
    w = F.when((steep > 0) & (excess > 0), 1 / F.nullif(excess, F.lit(0.0)) - 1).when(F.sum("n") > 0, F.lit(MAX_WEIGHT)).otherwise(F.lit(MIN_WEIGHT))
    return rows.agg(F.round(F.greatest(F.lit(MIN_WEIGHT), F.least(F.lit(MAX_WEIGHT), w)), 6)).first()[0]


def host_reputation(outcomes: DataFrame, platforms=PLATFORMS) -> DataFrame:
    """(site, n, bad): labelled pages of each site, n may be 0 -> site, mean, low: of its posterior rate of bad pages.

    outcomes is read several times: hand over a table.
    """
    sites = outcomes.select("site", "n", "bad", registered_domain(F.col("site"), platforms).alias("domain"), suffix(F.col("site"), platforms).alias("suffix"))
    domains = sites.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    rate = outcomes.agg((F.coalesce(F.sum("bad"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("n"), F.lit(0)) + 2.0)).first()[0]

    def shrink(rows: DataFrame, parent: str) -> DataFrame:
        w = F.lit(_weight(rows, parent))
        return rows.withColumn("size", F.col("n") + w).withColumn("mean", (F.col("bad") + w * F.col(parent)) / F.col("size"))

    suffixes = shrink(suffixes.withColumn("rate", F.lit(rate)), "rate").select("suffix", F.col("mean").alias("suffix_rate"))
    domains = shrink(domains.join(suffixes, "suffix"), "suffix_rate").select("domain", "suffix", F.col("mean").alias("domain_rate"))
    sites = shrink(sites.join(domains, ["domain", "suffix"]), "domain_rate")
    return sites.select("site", "mean", (F.col("mean") - Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("size") + 1))).alias("low"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, max_bad: float = 0.25, platforms=PLATFORMS) -> DataFrame:
    """pages (page_id, url, ...), labels (doc_id, quality, toxic, ...) -> page_id, host, path, rule, verdict."""
    rows = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    bad = F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("long"))
    marks = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.coalesce(bad, F.lit(0)).alias("bad"))
    labelled = rows.select("page_id", site_of(F.col("host")).alias("site")).join(marks, "page_id", "left")
    outcomes, _ = materialize(labelled.groupBy("site").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "op5-outcomes")
    known = host_reputation(outcomes, platforms).select("site", F.when(F.col("low") > max_bad, "block").otherwise("allow").alias("by_host"))
    known, _ = materialize(known, "op5-verdicts")
    rule, verdict = rule_columns(rules)
    return (
        rows.withColumns({"rule": rule, "by_rule": verdict, "site": site_of(F.col("host"))})
        .join(known, "site", "left")
        .select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_host").alias("verdict"))
    )


ORACLE = r"""
with u as (select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages),
r as (select page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u),
v as (select *, case
    when (host = 'www.example.com' or suffix(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or suffix(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or suffix(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or suffix(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or suffix(host, '.com')) and starts_with(path, '/') then 'com/' end as rule from r),
marks as (select doc_id, coalesce(max(case when quality = 0 or toxic = 1 then 1 else 0 end), 0) as bad from labels group by doc_id),
sites as (select page_id, host, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.$', '') as site from r),
parts as (select site as host, string_split(site, '.') as p, count(bad) as n, coalesce(sum(bad), 0)::bigint as bad from sites left join marks on sites.page_id = marks.doc_id group by site),
h2 as (select *, array_to_string(p[-2:], '.') as two, array_to_string(p[-3:], '.') as three, p[-1] as one from parts),
h as (select host, n, bad, case when address then host when long then three else two end as domain, case when address then 'ip' when long then two else one end as sfx
      from (select *, regexp_matches(host, '^[0-9]+(\.[0-9]+){3}$|^\[.*\]$') as address,
                   regexp_matches(two, '^(ac|asn|co|com|edu|firm|gen|go|gob|gouv|gov|gub|id|ind|info|ltd|me|mil|ne|net|nhs|nic|nom|or|org|plc|pro|sch|web)\.[a-z][a-z]$')
                   or two in ('appspot.com','azurewebsites.net','blogspot.com','cloudfront.net','fly.dev','github.io','gitlab.io','glitch.me','herokuapp.com',
                              'netlify.app','pages.dev','vercel.app','web.app','wordpress.com','workers.dev') as long from h2)),
d as (select domain, sfx, sum(n)::bigint as n, sum(bad)::bigint as bad from h group by all),
s as (select sfx, sum(n)::bigint as n, sum(bad)::bigint as bad from d group by all),
t as (select (sum(bad) + 1.0::double) / (sum(n) + 2.0::double) as rate from s),
s1 as (select s.*, t.rate as p from s, t),
sa as (select sum((bad - n * p) * (bad - n * p)) as spread, sum(n * p * (1 - p)) as plain, sum(n * (n - 1) * p * (1 - p)) as steep, sum(n) as n from s1),
sw as (select round(greatest(2.0::double, least(200.0::double, case when steep > 0 and (spread - plain) / steep > 0 then 1 / ((spread - plain) / steep) - 1 when n > 0 then 200.0::double else 2.0::double end)), 6) as w from sa),
s2 as (select sfx, (bad + w * p) / (n + w) as p from s1, sw),
d1 as (select d.*, s2.p from d join s2 using (sfx)),
da as (select sum((bad - n * p) * (bad - n * p)) as spread, sum(n * p * (1 - p)) as plain, sum(n * (n - 1) * p * (1 - p)) as steep, sum(n) as n from d1),
dw as (select round(greatest(2.0::double, least(200.0::double, case when steep > 0 and (spread - plain) / steep > 0 then 1 / ((spread - plain) / steep) - 1 when n > 0 then 200.0::double else 2.0::double end)), 6) as w from da),
d2 as (select domain, sfx, (bad + w * p) / (n + w) as p from d1, dw),
h1 as (select h.*, d2.p from h join d2 using (domain, sfx)),
ha as (select sum((bad - n * p) * (bad - n * p)) as spread, sum(n * p * (1 - p)) as plain, sum(n * (n - 1) * p * (1 - p)) as steep, sum(n) as n from h1),
hw as (select round(greatest(2.0::double, least(200.0::double, case when steep > 0 and (spread - plain) / steep > 0 then 1 / ((spread - plain) / steep) - 1 when n > 0 then 200.0::double else 2.0::double end)), 6) as w from ha),
h3 as (select host, (bad + w * p) / (n + w) as m, n + w as size from h1, hw),
k as (select host as site, case when m - 1.64::double * sqrt(m * (1 - m) / (size + 1)) > 0.25::double then 'block' else 'allow' end as by_host from h3)
select v.page_id, v.host, v.path, v.rule,
       coalesce(case when v.rule in ('com/', 'www.example.com/en/') then 'allow' when v.rule is not null then 'block' end, k.by_host) as verdict
from v join sites using (page_id) left join k using (site)
"""
