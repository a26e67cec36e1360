"""Queries of the listing pipeline on derived inputs, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrook.functions import rules as R
from tallyrook.functions import text as X
from tallyrook.functions import urls as U
from tallyrook.operators import listings as L
from tallyrook.operators import resolve as E
from tallyrook.session import materialize, spread
from tallyrook.plans.derived import BLOCKLIST, RAW_SQL, REFERENCE_DATE, raw_postings, table

POLICY = L.Policy(profile="front", allowed_levels=("junior", "mid", "senior", "unknown"))
#: Strings beside the tables' own, to meet every branch of the URL functions (fixed values).
_W = "\\b(?:{})\\b"


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.with_identity(L.normalize(raw_postings(spark, sf_dir)))


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def says_sql(column: str, phrases) -> str:
    return f"coalesce(regexp_matches({column}, {_q(_W.format('|'.join(phrases)))}, 'i'), false)"


def hits_sql(column: str, phrases) -> str:
    return "(" + " + ".join(f"{says_sql(column, (p,))}::int" for p in phrases) + ")"


WS = "[\\s\\x0B\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"


def entities_sql(x: str) -> str:
    """Only named entities stand in the derived texts; numeric ones are tested on fixtures."""
    for name, char in X.NAMED:
        x = f"regexp_replace({x}, '&{name};', {_q(char)}, 'gi')"
    return x


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def strip_sql(x: str) -> str:
    x = f"regexp_replace(regexp_replace({x}, '<br{WS}*/?>', chr(10), 'gi'), '</p>|</li>', chr(10), 'gi')"
    x = f"regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '{WS}+\\n', chr(10), 'g')"
    return entities_sql(trim_sql(f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"))


def clean_sql(x: str) -> str:
    return trim_sql(f"regexp_replace({entities_sql(x)}, '{WS}+', ' ', 'g')")


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^A-Za-z0-9_/+.-]+', ' ', 'g'), ' +', ' ', 'g'))"


_SHAPE = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]/?#]*\]|[^/?#:@ ]+)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part_sql(u: str, k: int) -> str:
    return f"regexp_extract({u}, {_q(_SHAPE)}, {k})"


def url_parts_sql(source: str, columns: str) -> str:
    """`columns` and the parts of `url` of a relation."""
    tracks = f"(starts_with(lower(split_part(p, '=', 1)), 'utm_') or lower(split_part(p, '=', 1)) in ({', '.join(map(_q, U.TRACKING))}))"
    return f"""
    parts0 as (select {columns}, lower({part_sql('url', 1)}) as scheme, {part_sql('url', 2)} as usr, {part_sql('url', 3)} as host, {part_sql('url', 4)} as port,
      case when rtrim({part_sql('url', 5)}, '/') = '' then '/' else rtrim({part_sql('url', 5)}, '/') end as path,
      list_filter(string_split({part_sql('url', 6)}, '&'), lambda p: p <> '') as params from {source}),
    parts1 as (select *, scheme in ('http', 'https') as is_http, len(list_filter(params, lambda p: {tracks})) as n_track,
      case when port = '' or (scheme = 'http' and port = '80') or (scheme = 'https' and port = '443') then '' else ':' || port end as p,
      array_to_string(list_sort(list_filter(params, lambda p: not {tracks})), '&') as query from parts0),
    parts as (select *, case when is_http then scheme || '://' || lower(host) || p || path || case when query = '' then '' else '?' || query end else {norm_sql('url')} end as canonical,
      case when is_http then lower(scheme || '://' || case when usr = '' then '' else usr || '@' end || host || p || path) else {norm_sql('url')} end as legacy,
      case when scheme <> '' then n_track else 0 end as tracking,
      case when lower(host) in ('localhost', '[::1]', '::1') or suffix(lower(host), '.local') then false
        when regexp_matches(host, '^\\d+\\.\\d+\\.\\d+\\.\\d+$') then not regexp_matches(host, '^(10\\.|127\\.|169\\.254\\.|172\\.(1[6-9]|2\\d|3[01])\\.|192\\.168\\.)')
        else contains(host, '.') end as public from parts1)"""


def _scope_sql() -> str:
    hay = "(location || chr(10) || description)"
    return f"""case when {says_sql('location', ('worldwide',))} then 'global' when {says_sql('location', ('emea',))} then 'emea'
      when {says_sql('location', R.SCOPE_GLOBAL)} then 'global' when {says_sql('location', R.SCOPE_RESTRICTED)} then 'regional'
      when {says_sql(hay, R.SCOPE_GLOBAL)} then 'global' when {says_sql(hay, R.SCOPE_REGION)} then 'emea'
      when {says_sql(hay, R.SCOPE_RESTRICTED)} then 'regional' when {says_sql(hay, ('remote',))} then 'unknown' else 'regional' end"""


def _level_sql() -> str:
    text = "(title || ' ' || description)"
    return "case " + " ".join(f"when {says_sql(text, p)} then '{n}'" for n, p in R.LEVELS) + " else 'unknown' end"


def _front_sql() -> str:
    named = says_sql("title", R.FRONT_TITLE)
    rival = "(" + " or ".join(f"contains(lower(title), '{x}')" for x in R.FRONT_RIVALS) + ") and not contains(lower(title), 'react')"
    return f"""(not ({says_sql('title', R.FRONT_EXCLUDE)} and not ({named} and {says_sql('title', R.FRONT_RESCUE)}))
      and case when {named} then not ({rival}) else {says_sql('title', R.GENERIC_TITLE)} and {says_sql('description[:2500]', R.FRONT_SIGNAL)} end)"""


def _back_sql() -> str:
    e = says_sql("title", R.BACK_EXPLICIT)
    return f"""({e} or (not {says_sql('title', R.BACK_EXCLUDE)} and {says_sql('title', R.BACK_GENERIC)} and {says_sql("(title || chr(10) || description[:2500])", R.BACK_EXPLICIT)}))"""


def _title_sql(include, exclude, rescue) -> str:
    return f"({says_sql('title', include)} and (not {says_sql('title', exclude)} or {says_sql('title', rescue)}))"


HAY = "(location || chr(10) || description)"


def _geo_sql() -> str:
    region_only = f"{says_sql('location', ('emea',))} and not {says_sql('location', ('worldwide', 'global', 'globally'))}"
    return f"""case when {says_sql(HAY, R.GEO_EXCLUSION)} then 'excluded' when {region_only} and not {says_sql(HAY, R.HOME_EXPLICIT)} then 'verify'
      when {says_sql(HAY, R.GEO_POSITIVE)} then 'eligible' when remote_scope = 'global' then 'eligible' when remote_scope = 'regional' then 'excluded' else 'verify' end"""


def _reason_sql() -> str:
    return f"""case when {says_sql(HAY, R.GEO_NOT_HOME)} then 'home continent explicitly excluded' when {says_sql(HAY, R.GEO_EXCLUSION)} then 'region, hybrid or on-site signals'
      when remote_scope = 'regional' then 'remote scope too restricted' else 'unlikely eligible from home' end"""


LISTING_SQL = f"""
with {RAW_SQL},
n0 as (select posting_id, source_id, adapter, source_job_id, {clean_sql('company')} as company, {clean_sql('title')} as title, url,
   {trim_sql(entities_sql('location'))} as location, {strip_sql(strip_sql('description'))} as description, posted_at from raw),
n1 as (select *, {_scope_sql()} as remote_scope, {_level_sql()} as level from n0),
{url_parts_sql('n1', '*')},
ident as (select * exclude (scheme, usr, host, port, path, params, n_track, p, query), case when is_http then 'url::' || canonical end as url_key,
   case when source_job_id <> '' then adapter || '::' || {norm_sql('source_job_id')} end as provider_key,
   {norm_sql('company')} || '::' || {norm_sql('title')} as legacy_key, case when is_http then 'url::' || legacy end as legacy_url_key from parts),
listing as (select *, coalesce(url_key, provider_key, legacy_key) as dedupe_key from ident),
judged0 as (select *, {_geo_sql()} as geo, {_front_sql()} as front, {_back_sql()} as back,
   {_title_sql(R.TITLE_FRONT, R.TITLE_FRONT_EXCLUDE, R.TITLE_FRONT_RESCUE)} as title_front, {_title_sql(R.TITLE_BACK, R.TITLE_BACK_EXCLUDE, R.TITLE_BACK_RESCUE)} as title_back,
   {_reason_sql()} as geo_reason from listing),
judged as (select *, coalesce(case when not front then 'role mismatch' end, case when level = 'staff_lead' then 'level not allowed: ' || level end,
   case when geo = 'excluded' then geo_reason end, case when remote_scope = 'regional' and geo <> 'eligible' then 'remote scope too restricted' end) as reason from judged0),
blocked as (select distinct {norm_sql('b')} as b from (values {', '.join(f"({_q(b)})" for b in BLOCKLIST)}) as t(b))"""

_snip = "description[:2500]"
SCORE_SQL = f"""{LISTING_SQL},
s0 as (select *, floor((case when {hits_sql('title', R.FRONT_STRONG)} >= 2 then 0.95 when {hits_sql('title', R.FRONT_STRONG)} = 1 then 0.85 when {hits_sql('title', R.FRONT_MODERATE)} >= 1 then 0.7
     when {says_sql('title', R.GENERIC_TITLE)} and {says_sql(_snip, R.FRONT_SIGNAL)} then 0.65 when front then 0.55 else 0.35 end)::double * 100 + 0.5) / 100 as relevance,
   floor((case when {says_sql(HAY, R.HOME_COUNTRY)} then 0.98 when {says_sql(HAY, R.HOME_CONTINENT)} then 0.95 when {says_sql(HAY, R.GEO_POSITIVE)} then 0.9
     when remote_scope = 'global' then 0.85 when {says_sql(HAY, R.GEO_EXCLUSION)} then 0.15 when geo = 'verify' and remote_scope = 'emea' then 0.35 when geo = 'verify' then 0.45
     when remote_scope = 'unknown' then 0.5 when geo = 'eligible' then 0.75 else 0.4 end)::double * 100 + 0.5) / 100 as geo_confidence,
   greatest(0.0::double, (epoch_us(timestamp '{REFERENCE_DATE}') - epoch_us(posted_at)) / 864e8::double) as age from judged),
s1 as (select *, floor((case when age is null or posted_at is null then 0.4 when age <= 7 then 1.0 when age <= 14 then 0.9 when age <= 30 then 0.75 when age <= 45 then 0.55 when age <= 75 then 0.35 else 0.15 end)::double * 100 + 0.5) / 100 as freshness,
   coalesce(age > 75 and posted_at is not null, false) as likely_expired from s0),
scored as (select *, floor((relevance * 0.5::double + geo_confidence * 0.3::double + freshness * 0.2::double) * 100 + 0.5) / 100 as total from s1)"""


def policy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.apply_policy(listings(spark, sf_dir), POLICY)


def blocklist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b,) for b in BLOCKLIST], "company string")


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.scored(policy_rows(spark, sf_dir), "front", REFERENCE_DATE)


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def view(name: str, frame, columns, sql: str | None) -> None:
    """Registers frame(spark, sf_dir).select(columns()) and its twin."""
    QUERIES[name] = lambda spark, sf_dir: frame(spark, sf_dir).select(*[(F.expr(v) if isinstance(v, str) else v).alias(k) for k, v in columns().items()])
    if sql:
        ORACLES[name] = sql


def _listing_view(name: str, columns, sql_columns: str, frame=listings, relation: str = "listing", prelude: str = LISTING_SQL) -> None:
    view(name, frame, columns, f"{prelude} select {sql_columns} from {relation}")


_id = {"posting_id": "posting_id"}
view("b01_decode_entities", raw_postings, lambda: _id | {"title": X.decode_entities(F.col("title")), "company": X.decode_entities(F.col("company"))},
     f"with {RAW_SQL} select posting_id, {entities_sql('title')} as title, {entities_sql('company')} as company from raw")
view("b02_strip_html", lambda s, d: spread(table(s, d, "pages").select("page_id", "html"), "page_id"), lambda: {"page_id": "page_id", "text_md5": F.md5(X.strip_html(F.col("html"))), "n": F.length(X.strip_html(F.col("html")))},
     f"select page_id, md5({strip_sql('html')}) as text_md5, length({strip_sql('html')}) as n from pages")
view("b03_clean_text", raw_postings, lambda: _id | {"company": X.clean_text(F.col("company")), "title": X.clean_text(F.col("title"))},
     f"with {RAW_SQL} select posting_id, {clean_sql('company')} as company, {clean_sql('title')} as title from raw")
view("b04_normalize_text", lambda s, d: spread(table(s, d, "documents").select("doc_id", "text"), "doc_id"), lambda: {"doc_id": "doc_id", "text_md5": F.md5(X.normalize_text(F.col("text")))},
     f"select doc_id, md5({norm_sql('text')}) as text_md5 from documents")
_urls = f"with {url_parts_sql('pages', 'page_id, url')}"
_pages = lambda s, d: table(s, d, "pages")
view("b05_canonical_url", _pages, lambda: {"page_id": "page_id", "canonical": U.canonical_url(F.col("url"))}, f"{_urls} select page_id, canonical from parts")
view("b06_canonical_url_legacy", _pages, lambda: {"page_id": "page_id", "legacy": U.canonical_url_legacy(F.col("url"))}, f"{_urls} select page_id, legacy from parts")
view("b07_tracking_count", _pages, lambda: {"page_id": "page_id", "tracking": U.tracking_count(F.col("url"))}, f"{_urls} select page_id, tracking from parts")
_listing_view("b08_identity_keys", lambda: _id | {"dedupe_key": "dedupe_key", "legacy_key": "legacy_key", "legacy_url_key": "legacy_url_key", "aliases": "array_join(aliases, '|')"},
    "posting_id, dedupe_key, legacy_key, legacy_url_key, array_to_string(list_filter([dedupe_key, case when legacy_key <> dedupe_key then legacy_key end, case when legacy_url_key is distinct from url_key then legacy_url_key end, case when provider_key is distinct from dedupe_key then provider_key end], lambda x: x is not null), '|') as aliases")
view("b09_link_signals", lambda s, d: E.link_signals(listings(s, d)), lambda: {"posting_id": "posting_id", "signal": "signal"},
     f"{LISTING_SQL} select posting_id, provider_key as signal from listing where provider_key is not null union all select posting_id, url_key from listing where url_key is not null")
_listing_view("b10_url_quality", lambda: _id | {"rank": U.url_quality(F.col("url"))["rank"], "tracking": U.url_quality(F.col("url"))["tracking"], "size": U.url_quality(F.col("url"))["size"]},
    "posting_id, case when not regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') then 5 when not is_http then 4 when public and starts_with(lower(url), 'https') then 0 when public then 1 when starts_with(lower(url), 'https') then 2 else 3 end as rank, tracking, case when is_http then length(canonical) else length(url) end as size")
_listing_view("b11_public_host", lambda: _id | {"public": U.is_public_host(U.part(F.col("url"), 3))}, "posting_id, public")
_apply = lambda: F.concat(F.lit("https://jobs.lever.co/"), F.regexp_replace(F.lower("s_name"), "#", "-"), F.lit("/apply?id="), F.col("s_suppkey"))
view("b12_company_from_apply_url", lambda s, d: table(s, d, "supplier"), lambda: {"s_suppkey": "s_suppkey", "company": U.company_from_apply_url(_apply())},
     "select s_suppkey, upper(s_name[1]) || lower(replace(s_name, '#', ' '))[2:] as company from supplier")
_prof = lambda: F.concat(F.lit("https://www.example.com/company/"), F.replace("s_name", F.lit("#"), F.lit("-")), F.lit("%20Ltd?x=1"))
view("b13_company_from_profile_url", lambda s, d: table(s, d, "supplier"), lambda: {"s_suppkey": "s_suppkey", "company": U.company_from_profile_url(_prof()), "id": U.id_from_urn(F.concat(F.lit("urn:x:posting:("), F.col("s_suppkey"), F.lit(",SEARCH)")))},
     "select s_suppkey, replace(s_name, '#', ' ') || ' Ltd' as company, s_suppkey::varchar as id from supplier")
_listing_view("b14_themes", lambda: _id | {"themes": F.array_join(R.themes(F.concat_ws(" ", "title", "description")), ",")},
    "posting_id, array_to_string(list_filter([" + ", ".join(f"case when {says_sql(chr(40) + 'title' + chr(32) + '|| chr(32) || description)', (w,))} then '{w}' end" for w in R.THEMES) + "], lambda x: x is not null), ',') as themes")
view("b16_year_month", lambda s, d: table(s, d, "orders"), lambda: {"o_orderkey": "o_orderkey", "month": X.year_month(F.when(F.col("o_orderkey") % 9 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.lit("n/a")))},
     "select o_orderkey, case when o_orderkey % 9 <> 0 then strftime(o_orderdate, '%Y-%m') else 'unknown' end as month from orders")
_listing_view("b18_safe_http_url", lambda: _id | {"safe": U.safe_http_url(F.col("url"))}, "posting_id, case when is_http then regexp_replace(url, '^([A-Za-z]+://)[^/?#@]*@', '\\1') end as safe")
view("b24_rounding", lambda s, d: table(s, d, "lineitem"), lambda: {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "x": X.round2(F.col("l_extendedprice") * F.col("l_discount"))},
     "select l_orderkey, l_linenumber, floor(l_extendedprice * l_discount * 100 + 0.5) / 100 as x from lineitem")
view("c01_blocklist", lambda s, d: L.not_blocklisted(listings(s, d), blocklist(s)), lambda: _id, f"{LISTING_SQL} select posting_id from listing where {norm_sql('company')} not in (select b from blocked)")
_listing_view("c02_blocked_apply_url", lambda: _id | {"blocked": L.blocked_apply_url(F.col("url"), ["board", "org"], ("example.com", "easyapply.jobs"))},
    "posting_id, coalesce(regexp_matches(url, '(?i)^https?://([^/]*@)?([^/]*\\.)?example\\.com[:/]') or regexp_matches(url, '(?i)^https?://([^/]*@)?[^/]*board'), false) as blocked")
_listing_view("c03_remote_scope", lambda: _id | {"remote_scope": "remote_scope"}, "posting_id, remote_scope")
_listing_view("c04_level", lambda: _id | {"level": "level"}, "posting_id, level")
_listing_view("c05_role_front", lambda: _id | {"front": L.matches_front()}, "posting_id, front", relation="judged")
_listing_view("c06_role_back", lambda: _id | {"back": L.matches_back()}, "posting_id, back", relation="judged")
_listing_view("c07_title_role", lambda: _id | {"front": L.title_role("front"), "back": L.title_role("back")}, "posting_id, title_front as front, title_back as back", relation="judged")
QUERIES["c08_allowed_level"] = lambda s, d: listings(s, d).where(F.col("level").isin(*POLICY.allowed_levels)).select("posting_id", "level")
ORACLES["c08_allowed_level"] = f"{LISTING_SQL} select posting_id, level from listing where level <> 'staff_lead'"
_listing_view("c09_geo_tier", lambda: _id | {"geo": L.geo_tier(POLICY)}, "posting_id, geo", relation="judged")
_listing_view("c10_geo_reason", lambda: _id | {"reason": L.geo_reason()}, "posting_id, geo_reason as reason", relation="judged")
view("c11_policy_filter", policy_rows, lambda: _id | {"reason": "reason", "geo": "geo"}, f"{LISTING_SQL} select posting_id, reason, geo from judged")
_listing_view("c12_discovery_geo", lambda: _id | {"geo": L.discovery_geo(POLICY)}, f"posting_id, case when trim({HAY}) = '' and geo = 'eligible' then 'verify' else geo end as geo", relation="judged")
view("f21_pattern_hits", listings, lambda: _id | {"hits": R.hits("title", R.FRONT_STRONG)}, f"{LISTING_SQL} select posting_id, {hits_sql('title', R.FRONT_STRONG)} as hits from listing")
view("g01_relevance_front", listings, lambda: _id | {"relevance": L.relevance("front")}, f"{SCORE_SQL} select posting_id, relevance from scored")
view("g02_relevance_back", listings, lambda: _id | {"relevance": L.relevance("back")},
     f"{LISTING_SQL} select posting_id, (case when {says_sql('title', R.BACK_EXPLICIT)} then 0.95 when {hits_sql('title', R.BACK_MODERATE)} >= 1 and {says_sql(_snip, R.BACK_EXPLICIT)} then 0.8 when {hits_sql('title', R.BACK_MODERATE)} >= 1 then 0.6 when back then 0.5 else 0.35 end)::double as relevance from judged")
view("g03_geo_confidence", score_rows, lambda: _id | {"geo_confidence": "geo_confidence"}, f"{SCORE_SQL} select posting_id, geo_confidence from scored")
view("g04_freshness", score_rows, lambda: _id | {"freshness": "freshness", "likely_expired": "likely_expired"}, f"{SCORE_SQL} select posting_id, freshness, likely_expired from scored")
view("g05_total", score_rows, lambda: _id | {"total": "total"}, f"{SCORE_SQL} select posting_id, total from scored")
view("g06_rank", lambda s, d: L.ranked(score_rows(s, d).select("posting_id", "geo", "total", "company", "dedupe_key")), lambda: _id | {"geo": "geo", "tier_rank": "tier_rank"},
     f"{SCORE_SQL} select posting_id, geo, row_number() over (partition by geo order by total desc, company, dedupe_key, posting_id) as tier_rank from scored")


def _ranked_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which active listings to act on: blocklist, exact dedupe by key, policy, score, rank."""
    from pyspark.sql import Window

    rows = L.not_blocklisted(listings(spark, sf_dir), blocklist(spark))
    first = F.row_number().over(Window.partitionBy("dedupe_key").orderBy("posting_id"))
    rows = L.apply_policy(rows.withColumn("nth", first).where("nth = 1"), POLICY).where("reason is null")
    return L.ranked(L.scored(rows, "front", REFERENCE_DATE)).select("posting_id", "geo", "company", "title", "total", "tier_rank")


QUERIES["plan_ranked_listings"] = _ranked_listings
ORACLES["plan_ranked_listings"] = f"""{SCORE_SQL},
kept as (select * from scored where {norm_sql('company')} not in (select b from blocked) qualify row_number() over (partition by dedupe_key order by posting_id) = 1)
select posting_id, geo, company, title, total, row_number() over (partition by geo order by total desc, company, dedupe_key, posting_id) as tier_rank from kept where reason is null"""

# entity resolution; the twin closes the signal graph by a recursive query
ENTITY_SQL = LISTING_SQL.replace("with ", "with recursive ", 1) + """,
sig0 as (select posting_id, provider_key as signal from listing where provider_key is not null union select posting_id, url_key from listing where url_key is not null),
per as (select legacy_key, source_id, count(*) as n from listing where legacy_key <> '::' group by all),
sure as (select legacy_key from per group by 1 having count(*) >= 2 and max(n) = 1),
sig as (select * from sig0 union select posting_id, 'name::' || legacy_key from listing where legacy_key in (select legacy_key from sure)),
star as (select posting_id as a, min(posting_id) over (partition by signal) as b from sig),
edge as (select distinct a, b from star where a <> b union select distinct b, a from star where a <> b),
reach as (select posting_id as a, posting_id as b from listing union select r.a, e.b from reach r join edge e on r.b = e.a),
member as (select a as posting_id, min(b) as entity_id from reach group by a)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).select("posting_id", "source_id", "url_key", "provider_key", "legacy_key")
    return E.entities(materialize(rows, "listings")[0])


view("e03_entity_resolution", members, lambda: {"posting_id": "posting_id", "entity_id": "entity_id"}, f"{ENTITY_SQL} select posting_id, entity_id from member")
view("e04_cautious_names", lambda s, d: E.cautious_groups(listings(s, d)), lambda: {"posting_id": "posting_id", "signal": "signal"},
     f"{ENTITY_SQL} select posting_id, 'name::' || legacy_key as signal from listing where legacy_key in (select legacy_key from sure)")


def entity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = materialize(listings(spark, sf_dir).drop("remote_scope", "level", "dedupe_key", "aliases", "legacy_url_key"), "listings")
    return E.merged(rows, E.entities(rows))


_rich = lambda c: f"coalesce((arg_min({c}, (-length({c}), {c})) filter (where {c} <> '')), '') as {c}"
MERGED_SQL = f"""{ENTITY_SQL},
ranked_url as (select *, row_number() over (partition by entity_id order by case when not regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') then 5 when not is_http then 4 when public and starts_with(lower(url), 'https') then 0 when public then 1 when starts_with(lower(url), 'https') then 2 else 3 end,
   tracking, case when is_http then length(canonical) else length(url) end, case when is_http then canonical else url end, url) as nth from listing join member using (posting_id)),
ent as (select entity_id, count(*) as members, {_rich('company')}, {_rich('title')}, {_rich('location')}, {_rich('description')}, max(case when nth = 1 then url end) as url,
   min(posted_at) as posted_at, array_to_string(list_sort(list_distinct(list(source_id))), ',') as source_ids from ranked_url group by entity_id),
ent2 as (select *, {_scope_sql()} as remote_scope, {_level_sql()} as level from ent)"""
view("e06_survivorship", entity_rows, lambda: {"entity_id": "entity_id", "members": "members", "company": "company", "title": "title", "location": "location", "description": "description", "url": "url",
     "posted_at": "posted_at", "source_ids": "array_join(source_ids, ',')", "remote_scope": "remote_scope", "level": "level"},
     f"{MERGED_SQL} select * from ent2")
view("f01_dedupe_summary", lambda s, d: E.dedupe_summary(members(s, d)), lambda: {"n_input": "n_input", "n_output": "n_output", "n_merged": "n_merged"},
     f"{ENTITY_SQL} select count(*) as n_input, count(distinct entity_id) as n_output, count(*) - count(distinct entity_id) as n_merged from member")
