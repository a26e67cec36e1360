"""Listings: normal form, identity, classifiers, policy, score and rank. Everything here is narrow but the rank."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrook.functions import rules as R
from tallyrook.functions import text as X
from tallyrook.functions import urls as U
from tallyrook.session import materialize

SNIPPET = 2500


@dataclass(frozen=True)
class Policy:
    """What a profile accepts. profile is `front` or `back`."""

    profile: str = "front"
    allowed_levels: tuple[str, ...] = ("junior", "mid", "senior", "staff_lead", "unknown")
    accept_global: bool = True
    region_only_needs_home: bool = True
    default_region_to_verify: bool = True


def legacy_key(company: str = "company", title: str = "title") -> Column:
    return F.concat(X.normalize_text(F.col(company)), F.lit("::"), X.normalize_text(F.col(title)))


def url_key(url: Column) -> Column:
    return F.when(U.is_http(url), F.concat(F.lit("url::"), U.canonical_url(url)))


def legacy_url_key(url: Column) -> Column:
    return F.when(U.is_http(url), F.concat(F.lit("url::"), U.canonical_url_legacy(url)))


def provider_key(adapter: Column, job_id: Column) -> Column:
    return F.when(F.coalesce(job_id, F.lit("")) != "", F.concat(adapter, F.lit("::"), X.normalize_text(job_id)))


def normalize(raw: DataFrame) -> DataFrame:
    """Raw listings -> listings: texts cleaned (the description twice, as feeds encode it twice), scope and level."""
    out = raw.withColumns({
        "company": X.clean_text(F.col("company")),
        "title": X.clean_text(F.col("title")),
        "location": X.trimmed(X.decode_entities(F.col("location"))),
        "description": X.strip_html(X.strip_html(F.col("description"))),
        "url": X.trimmed(F.col("url")),
    })
    return out.withColumns({"remote_scope": remote_scope(), "level": level()})


def with_identity(listings: DataFrame) -> DataFrame:
    """Adds url_key, provider_key, legacy_key, legacy_url_key, dedupe_key (the first of them that there is) and aliases."""
    http = F.lower(F.col("__url")[0]).isin("http", "https")
    out = listings.withColumn("__url", U.parsed(F.col("url"))).withColumns({
        "url_key": F.when(http, F.concat(F.lit("url::"), U.canonical_of(F.col("__url")))), "provider_key": provider_key(F.col("adapter"), F.col("source_job_id")),
        "legacy_key": legacy_key(), "legacy_url_key": F.when(http, F.concat(F.lit("url::"), U.legacy_of(F.col("__url")))),
    }).drop("__url")
    out = out.withColumn("dedupe_key", F.coalesce("url_key", "provider_key", "legacy_key"))
    keys = F.array("dedupe_key", "legacy_key", "url_key", "legacy_url_key", "provider_key")
    return out.withColumn("aliases", F.array_distinct(F.array_compact(keys)))


def haystack() -> Column:
    return F.concat(F.coalesce("location", F.lit("")), F.lit("\n"), F.coalesce("description", F.lit("")))


def remote_scope() -> Column:
    """global, emea, regional or unknown: the place's own words first, then place and text."""
    place, both = F.trim(F.col("location")), haystack()
    return (
        F.when(R.says(place, ("worldwide",)), "global")
        .when(R.says(place, ("emea",)), "emea")
        .when(R.says(place, R.SCOPE_GLOBAL), "global")
        .when(R.says(place, R.SCOPE_RESTRICTED), "regional")
        .when(R.says(both, R.SCOPE_GLOBAL), "global")
        .when(R.says(both, R.SCOPE_REGION), "emea")
        .when(R.says(both, R.SCOPE_RESTRICTED), "regional")
        .when(R.says(both, ("remote",)), "unknown")
        .otherwise("regional")
    )


def level() -> Column:
    text, out = F.concat_ws(" ", "title", "description"), F.lit("unknown")
    for name, phrases in reversed(R.LEVELS):
        out = F.when(R.says(text, phrases), name).otherwise(out)
    return out


def matches_front(title: str = "title", description: str = "description") -> Column:
    t, snippet = F.col(title), F.substring(F.col(description), 1, SNIPPET)
    named = R.says(t, R.FRONT_TITLE)
    excluded = R.says(t, R.FRONT_EXCLUDE) & ~(named & R.says(t, R.FRONT_RESCUE))
    low = F.lower(t)
    rival = (low.contains(R.FRONT_RIVALS[0]) | low.contains(R.FRONT_RIVALS[1]) | low.contains(R.FRONT_RIVALS[2])) & ~low.contains("react")
    return ~excluded & F.when(named, ~rival).otherwise(R.says(t, R.GENERIC_TITLE) & R.says(snippet, R.FRONT_SIGNAL))


def matches_back(title: str = "title", description: str = "description") -> Column:
    t, snippet = F.col(title), F.substring(F.col(description), 1, SNIPPET)
    explicit = R.says(t, R.BACK_EXPLICIT)
    return explicit | (~R.says(t, R.BACK_EXCLUDE) & R.says(t, R.BACK_GENERIC) & R.says(F.concat_ws("\n", t, snippet), R.BACK_EXPLICIT))


def matches_role(profile: str) -> Column:
    return matches_front() if profile == "front" else matches_back()


def title_role(profile: str, title: str = "title") -> Column:
    """The discovery funnel's filter, on titles alone."""
    t = F.col(title)
    include, exclude, rescue = (
        (R.TITLE_FRONT, R.TITLE_FRONT_EXCLUDE, R.TITLE_FRONT_RESCUE) if profile == "front" else (R.TITLE_BACK, R.TITLE_BACK_EXCLUDE, R.TITLE_BACK_RESCUE)
    )
    return R.says(t, include) & (~R.says(t, exclude) | R.says(t, rescue))


def geo_tier(policy: Policy) -> Column:
    """eligible, verify or excluded: exclusions, region without home, welcome words, then the scope."""
    both, unsure = haystack(), F.lit("verify" if policy.default_region_to_verify else "excluded")
    region_only = R.says("location", ("emea",)) & ~R.says("location", ("worldwide", "global(?:ly)?"))
    out = F.when(R.says(both, R.GEO_EXCLUSION), "excluded")
    if policy.region_only_needs_home:
        out = out.when(region_only & ~R.says(both, R.HOME_EXPLICIT), unsure)
    return (
        out.when(R.says(both, R.GEO_POSITIVE), "eligible")
        .when(F.col("remote_scope") == "global", "eligible" if policy.accept_global else "verify")
        .when(F.col("remote_scope") == "regional", "excluded")
        .otherwise("verify" if policy.default_region_to_verify else "eligible")
    )


def geo_reason() -> Column:
    both = haystack()
    return (
        F.when(R.says(both, R.GEO_NOT_HOME), "home continent explicitly excluded")
        .when(R.says(both, R.GEO_EXCLUSION), "region, hybrid or on-site signals")
        .when(F.col("remote_scope") == "regional", "remote scope too restricted")
        .otherwise("unlikely eligible from home")
    )


def discovery_geo(policy: Policy) -> Column:
    """A hit without any text can't be eligible, only worth a look."""
    tier = geo_tier(policy)
    return F.when((F.trim(haystack()) == "") & (tier == "eligible"), "verify").otherwise(tier)


def apply_policy(listings: DataFrame, policy: Policy) -> DataFrame:
    """Adds geo and reason: the first rule that a listing fails, null if it passes all. One pass, no shuffle."""
    out = listings.withColumn("geo", geo_tier(policy))
    role = F.when(~matches_role(policy.profile), "role mismatch")
    lev = F.when(~F.col("level").isin(*policy.allowed_levels), F.concat(F.lit("level not allowed: "), "level"))
    geo = F.when(F.col("geo") == "excluded", geo_reason())
    scope = F.when((F.col("remote_scope") == "regional") & (F.col("geo") != "eligible"), "remote scope too restricted")
    return out.withColumn("reason", F.coalesce(role, lev, geo, scope))


def not_blocklisted(listings: DataFrame, blocklist: DataFrame, kind: str = "left_anti") -> DataFrame:
    """Rows whose firm's normal form isn't on the list (company); the list is a dimension, left to the planner."""
    listed = blocklist.select(X.normalize_text(F.col("company")).alias("blocked")).distinct()
    return listings.join(listed, X.normalize_text(F.col("company")) == F.col("blocked"), kind)


def blocked_apply_url(url: Column, slugs: list[str], domains: tuple[str, ...]) -> Column:
    """Whether the host is, or is below, a listed domain, or holds a blocked firm's name of four letters or more."""
    host = F.lower(U.part(url, 3))
    out = F.lit(False)
    for d in domains:
        out = out | (host == d) | host.endswith("." + d)
    for s in slugs:
        if len(s) >= 4:
            out = out | host.contains(s)
    return F.coalesce(out & (host != ""), F.lit(False))


def relevance(profile: str) -> Column:
    snippet = F.substring("description", 1, SNIPPET)
    if profile == "front":
        strong, moderate = R.hits("title", R.FRONT_STRONG), R.hits("title", R.FRONT_MODERATE)
        return (
            F.when(strong >= 2, 0.95).when(strong == 1, 0.85).when(moderate >= 1, 0.7)
            .when(R.says("title", R.GENERIC_TITLE) & R.says(snippet, R.FRONT_SIGNAL), 0.65).when(matches_front(), 0.55).otherwise(0.35)
        )
    moderate, told = R.hits("title", R.BACK_MODERATE) >= 1, R.says(snippet, R.BACK_EXPLICIT)
    return F.when(R.says("title", R.BACK_EXPLICIT), 0.95).when(moderate & told, 0.8).when(moderate, 0.6).when(matches_back(), 0.5).otherwise(0.35)


def geo_confidence() -> Column:
    """Welcome words come before exclusions here, unlike in geo_tier()."""
    both, scope, geo = haystack(), F.col("remote_scope"), F.col("geo")
    return (
        F.when(R.says(both, R.HOME_COUNTRY), 0.98).when(R.says(both, R.HOME_CONTINENT), 0.95).when(R.says(both, R.GEO_POSITIVE), 0.9)
        .when(scope == "global", 0.85).when(R.says(both, R.GEO_EXCLUSION), 0.15)
        .when((geo == "verify") & (scope == "emea"), 0.35).when(geo == "verify", 0.45)
        .when(scope == "unknown", 0.5).when(geo == "eligible", 0.75).otherwise(0.4)
    )


def age_days(reference: Column, posted: str = "posted_at") -> Column:
    """Days since posting, 0 if that lies ahead, null without a date."""
    days = (F.unix_micros(reference) - F.unix_micros(F.col(posted).cast("timestamp_ltz"))) / 864e8
    return F.when(days.isNotNull(), F.greatest(F.lit(0.0), days))


def freshness(age: Column) -> Column:
    out = F.when(age.isNull(), 0.4)
    for days, score in ((7, 1.0), (14, 0.9), (30, 0.75), (45, 0.55), (75, 0.35)):
        out = out.when(age <= days, score)
    return out.otherwise(0.15)


def scored(matched: DataFrame, profile: str, reference: str) -> DataFrame:
    """Adds relevance, geo_confidence, freshness, total (of rounded parts, rounded), likely_expired and reasons."""
    age = age_days(F.lit(reference).cast("timestamp"))
    out = matched.withColumns({
        "relevance": X.round2(relevance(profile)), "geo_confidence": X.round2(geo_confidence()), "freshness": X.round2(freshness(age)),
        "likely_expired": F.coalesce(age > 75, F.lit(False)),
    })
    total = F.col("relevance") * 0.5 + F.col("geo_confidence") * 0.3 + F.col("freshness") * 0.2
    told = F.array(*[F.concat(F.lit(f"{n}="), F.format_number(n, 2)) for n in ("relevance", "geo_confidence", "freshness")])
    return out.withColumn("total", X.round2(total)).withColumn("reasons", told)


def ranked(scores: DataFrame) -> DataFrame:
    """Adds tier_rank: the place within the geo tier by total, firm and key; posting_id names a row.

    What the scores cost is paid once: rows are written as they come, and of these the order's five columns alone are
    dealt by ranges of the whole order and sorted there, so as many tasks work as there are shuffle partitions, whatever
    the number of tiers. A row's place is its place in its part plus the tier's rows in the parts before; of the parts
    only counts move, a row a part and tier. Places are then joined to the rows.
    """
    n = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("geo"), F.desc("total"), F.asc("company"), F.asc("dedupe_key"), F.asc("posting_id")]
    rows, _ = materialize(scores, "scored")
    keys = rows.select("geo", "total", "company", "dedupe_key", "posting_id").repartitionByRange(n, *order).sortWithinPartitions(*order)
    keys = keys.select("geo", "posting_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"))
    keys, _ = materialize(keys, "ranked")
    counts = keys.groupBy("geo", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("geo").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    places = keys.join(counts, ["geo", "part"]).select(F.col("posting_id").alias("__id"), (F.col("at") - F.col("first") + F.col("before") + 1).cast("int").alias("tier_rank"))
    return rows.join(places.hint("merge"), F.col("posting_id") == F.col("__id")).drop("__id")
