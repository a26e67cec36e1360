"""Landed feed payloads -> (raw listings, quarantine). An adapter maps a table (source_id, page, payload) to records.

Each record is judged once: skipped (neither listing nor quarantine), quarantined with a reason, or valid. ADAPTERS is
the extension point: any function of that shape can be added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrook.functions.text import decode_entities, strip_html, trimmed
from tallyrook.operators.nested import field, kind, string

RAW = ("source_id", "source_job_id", "company", "title", "url", "location", "description", "posted_at", "ordinal")
MAX_EPOCH = 253402300799


def _records(payloads: DataFrame, schema: str, field: str | None) -> DataFrame:
    """One row a record of a JSON payload's array; a payload without the array gives none (see shape_errors())."""
    rows = payloads.select("source_id", "page", F.from_json("payload", f"struct<{field}: array<{schema}>>" if field else f"array<{schema}>").alias("p"))
    records = F.col(f"p.{field}") if field else F.col("p")
    return rows.select("source_id", "page", F.posexplode(records).alias("pos", "r")).withColumn("ordinal", F.struct("page", "pos"))


def _text(name: str) -> Column:
    return F.nullif(trimmed(F.col(f"r.{name}")), F.lit(""))


def _first(*values: Column) -> Column:
    return F.coalesce(*values)


def _finish(rows: DataFrame, reason: Column, skip: Column | None = None, **columns: Column) -> tuple[DataFrame, DataFrame]:
    rows = rows.withColumn("reason", reason)
    if skip is not None:
        rows = rows.where(~F.coalesce(skip, F.lit(False)))
    valid = rows.where("reason is null").select("source_id", *[columns[c].alias(c) for c in RAW[1:-1]], "ordinal")
    bad = rows.where("reason is not null").select("source_id", "ordinal", "reason", columns["source_job_id"].alias("identifier"), columns["title"].alias("title"))
    return valid, bad


def shape_errors(payloads: DataFrame, field: str | None) -> DataFrame:
    """Sources with a payload that lacks the array: these fail as a whole."""
    v = F.try_parse_json("payload")
    shown = F.try_variant_get(v, f"$.{field}" if field else "$", "array<variant>")
    return payloads.where(shown.isNull()).select("source_id").distinct()


def himalayas(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = _records(payloads, "struct<guid: string, title: string, companyName: string, description: string, excerpt: string, applicationLink: string, pubDate: string, locationRestrictions: variant>", "jobs")
    title, company, places = _text("title"), _text("companyName"), F.try_variant_get("r.locationRestrictions", "$", "array<variant>")
    odd = F.exists(places, lambda x: F.schema_of_variant(x) != "STRING")
    none = F.col("r.locationRestrictions").isNull() | F.coalesce(F.is_variant_null("r.locationRestrictions"), F.lit(False)) | F.coalesce(F.size(places) == 0, F.lit(False))
    joined = F.array_join(F.transform(places, lambda x: F.try_variant_get(x, "$", "string")), ", ")
    reason = F.when(title.isNull() | company.isNull(), "missing_fields").when(~none & (places.isNull() | F.coalesce(odd, F.lit(True))), "malformed")
    slug = F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-")
    return _finish(
        rows, reason, source_job_id=_first(_text("guid"), F.concat_ws("-", company, title)), company=company, title=title,
        url=_first(_text("applicationLink"), F.concat(F.lit("https://himalayas.app/jobs/"), slug)), location=F.when(none, "Worldwide").otherwise(joined),
        description=_first(_text("description"), _text("excerpt"), F.lit("")), posted_at=F.try_to_timestamp(_text("pubDate")),
    )


def _numbered(payloads: DataFrame, schema: str, title: str, company: str, place: str, description: list[str], date: str) -> tuple[DataFrame, DataFrame]:
    rows = _records(payloads, schema, "jobs")
    need = F.col("r.id").isNull() | _text("url").isNull() | _text(title).isNull() | _text(company).isNull()
    return _finish(
        rows, F.when(need, "missing_fields"), source_job_id=F.col("r.id").cast("string"), company=_text(company), title=_text(title), url=_text("url"),
        location=_first(_text(place), F.lit("Remote")), description=_first(*map(_text, description), F.lit("")), posted_at=F.try_to_timestamp(_text(date)),
    )


def jobicy(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _numbered(payloads, "struct<id: bigint, url: string, jobTitle: string, companyName: string, jobGeo: string, jobDescription: string, jobExcerpt: string, pubDate: string>", "jobTitle", "companyName", "jobGeo", ["jobDescription", "jobExcerpt"], "pubDate")


def remotive(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _numbered(payloads, "struct<id: bigint, url: string, title: string, company_name: string, candidate_required_location: string, publication_date: string, description: string>", "title", "company_name", "candidate_required_location", ["description"], "publication_date")


def arbeitnow(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = _records(payloads, "struct<slug: string, company_name: string, title: string, description: string, remote: boolean, url: string, location: string, created_at: bigint>", "data")
    need = _text("slug").isNull() | _text("url").isNull() | _text("title").isNull() | _text("company_name").isNull()
    epoch = F.col("r.created_at")
    return _finish(
        rows, F.when(need, "missing_fields"), source_job_id=_text("slug"), company=_text("company_name"), title=_text("title"), url=_text("url"),
        location=F.when(F.col("r.remote"), "Remote").otherwise(_first(_text("location"), F.lit("Unknown"))), description=_first(_text("description"), F.lit("")),
        posted_at=F.when(epoch.between(0, MAX_EPOCH), F.timestamp_seconds(epoch)),
    )


#: What marks a description as spam (fixed values).
SPAM = r"(?i)beta feature to avoid spam applicants|there are no articles in this category"


def _truthy(value: Column) -> Column:
    """A field that is there and not null, false, 0 or empty."""
    t = kind(value)
    number = F.coalesce(F.try_variant_get(value, "$", "double") != 0, F.lit(True))
    out = F.when(t == "STRING", F.try_variant_get(value, "$", "string") != "").when(t == "BOOLEAN", F.try_variant_get(value, "$", "boolean")).when(t.isin("OBJECT", "ARRAY"), True).when(t == "VOID", False).otherwise(number)
    return F.coalesce(F.when(value.isNotNull(), out), F.lit(False))


def _told(value: Column) -> Column:
    """A field's text where it is a string or a number."""
    return F.when(~kind(value).isin("VOID", "OBJECT", "ARRAY"), F.try_variant_get(value, "$", "string"))


def remoteok(payloads: DataFrame, spam: str = SPAM) -> tuple[DataFrame, DataFrame]:
    """An array of records. One with `legal`, or with `last_updated` and nothing that names a job, is metadata and skipped; one
    that is no object is malformed; a title, a company and the listing's own url are needed, even beside an apply_url."""
    records = F.try_variant_get(F.try_parse_json("payload"), "$", "array<variant>")
    rows = payloads.select("source_id", "page", F.posexplode(records).alias("pos", "r")).withColumn("ordinal", F.struct("page", "pos"))
    get = lambda name: field(F.col("r"), name)
    plain = lambda name: F.nullif(trimmed(decode_entities(string(get(name)))), F.lit(""))
    title, company, url, apply_url = plain("position"), plain("company"), F.nullif(string(get("url")), F.lit("")), string(get("apply_url"))
    named = _truthy(get("id")) | _truthy(get("slug")) | (F.coalesce(trimmed(string(get("position"))), F.lit("")) != "") | (F.coalesce(trimmed(string(get("company"))), F.lit("")) != "")
    record = F.coalesce(kind(F.col("r")) == "OBJECT", F.lit(False))
    metadata = record & (_truthy(get("legal")) | (~named & get("last_updated").isNotNull()))
    description = F.coalesce(strip_html(string(get("description"))), F.lit(""))
    reason = F.when(~record, "malformed").when(title.isNull() | company.isNull() | url.isNull(), "missing_fields").when(description.rlike(spam), "low_quality")
    return _finish(
        rows, reason, metadata, source_job_id=_first(_told(get("id")), _told(get("slug")), F.concat_ws("-", company, title)), company=company, title=title, url=_first(apply_url, url),
        location=_first(F.nullif(decode_entities(string(get("location"))), F.lit("")), F.lit("Remote")), description=description, posted_at=F.try_to_timestamp(string(get("date"))),
    )


def wwr(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """RSS texts. Of items with one link the first counts, before titles are looked at; `Company: Role` is split."""
    item = lambda tag: F.nullif(trimmed(F.regexp_replace(F.regexp_extract("i", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1), r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")), F.lit(""))
    items = payloads.select("source_id", "page", F.posexplode(F.regexp_extract_all("payload", F.lit("(?s)<item>(.*?)</item>"), F.lit(1))).alias("pos", "i")).withColumn("ordinal", F.struct("page", "pos"))
    rows = items.select("source_id", "ordinal", item("title").alias("t"), item("link").alias("link"), item("region").alias("region"), item("description").alias("d"), item("pubDate").alias("date"))
    nth = F.row_number().over(Window.partitionBy("source_id", "link").orderBy("ordinal"))
    rows = rows.withColumn("nth", nth).where("link is null or nth = 1")
    colon = F.locate(":", F.col("t"))
    company = F.when(colon > 0, F.nullif(trimmed(F.substring("t", F.lit(1), colon - 1)), F.lit("")))
    title = F.when(colon > 0, trimmed(F.substring("t", colon + 1, F.length("t")))).otherwise(F.col("t"))
    day = F.regexp_replace(F.regexp_replace("date", "^[A-Za-z]{3}, *", ""), " *([A-Z]{2,4}|[+-][0-9]{4})$", "")
    return _finish(
        rows, F.when(F.col("t").isNull() | F.col("link").isNull() | (title == ""), "missing_fields"), source_job_id=F.col("link"), company=F.coalesce(company, F.lit("Unknown")),
        title=title, url=F.col("link"), location=F.coalesce("region", F.lit("Remote")), description=F.coalesce("d", F.lit("")),
        posted_at=F.try_to_timestamp(day, F.lit("dd MMM yyyy HH:mm:ss")),
    )


def hn_hiring(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A hiring thread: its top-level comments. The first line is `Company | Role | Place`, or split at a dash, or the role."""
    thread = F.try_parse_json("payload")
    rows = payloads.select("source_id", "page", _told(field(thread, "id")).alias("thread"), string(field(thread, "created_at")).alias("at"), F.posexplode(F.try_variant_get(thread, "$.children", "array<variant>")).alias("pos", "r"))
    rows = rows.withColumn("ordinal", F.struct("page", "pos"))
    get = lambda name: field(F.col("r"), name)
    number = F.coalesce(kind(get("id")).isin("BIGINT", "DECIMAL", "DOUBLE"), F.lit(False))
    said = get("text").isNull() | F.coalesce(kind(get("text")).isin("VOID", "STRING"), F.lit(False))
    author, text = string(get("author")), F.coalesce(decode_entities(string(get("text"))), F.lit(""))
    line = trimmed(F.regexp_replace(F.split(text, "\n|<p>")[0], r"^[-*]\s*", ""))
    pipe = F.transform(F.split(line, r"\|"), trimmed)
    dash = r"^(.+?)\s[-–—]\s(.+)$"
    piped, dashed, long = F.size(pipe) > 1, line.rlike(dash), F.length(line) >= 8
    company = F.when(piped, pipe[0]).when(dashed, trimmed(F.regexp_extract(line, dash, 1))).when(long, author).otherwise(line)
    title = F.when(piped, F.coalesce(F.nullif(F.get(pipe, 1), F.lit("")), F.lit(ROLE))).when(dashed, trimmed(F.regexp_extract(line, dash, 2))).when(long, line).otherwise(F.lit(ROLE))
    record = F.coalesce(kind(F.col("r")) == "OBJECT", F.lit(False))
    reason = F.when(~record, "malformed").when(~number | author.isNull() | ~said, "missing_fields").when((F.length(text) < 20) | (F.length(title) < 2), "malformed")
    comment = _told(get("id"))
    return _finish(
        rows, reason, source_job_id=F.concat_ws("-", "thread", comment), company=F.when(F.length(company) < 2, author).otherwise(company), title=title,
        url=F.concat(F.lit("https://news.ycombinator.com/item?id="), comment), location=F.when(text.rlike(r"(?i)(?<![A-Za-z0-9_])remote(?![A-Za-z0-9_])"), "Remote").otherwise("Verify geo"),
        description=strip_html(text), posted_at=F.try_to_timestamp("at"),
    )


#: The role of a comment whose first line names none (fixed value).
ROLE = "Engineering role"


def hiring_thread(hits: DataFrame, pattern: str = r"(?i)who is hiring") -> DataFrame:
    """(thread_id, title, pos) -> the first hit whose title fits."""
    return hits.where(F.col("title").rlike(pattern)).agg(F.min_by("thread_id", "pos").alias("thread_id"))


ADAPTERS = {"himalayas": himalayas, "jobicy": jobicy, "remotive": remotive, "arbeitnow": arbeitnow, "remoteok": remoteok, "wwr": wwr, "hn-hiring": hn_hiring}


def quarantine_report(bad: DataFrame, samples: int = 5, width: int = 120) -> DataFrame:
    """reason, n, samples: the first titles, cut to width with an ellipsis."""
    nth = F.row_number().over(Window.partitionBy("reason").orderBy("source_id", "ordinal"))
    short = F.when(F.length("title") > width, F.concat(F.substring("title", 1, width - 1), F.lit("…"))).otherwise(F.coalesce("title", F.lit("")))
    some = bad.withColumn("nth", nth).where(F.col("nth") <= samples).groupBy("reason").agg(F.array_sort(F.collect_list(F.struct("nth", short.alias("t")))).alias("s"))
    return bad.groupBy("reason").agg(F.count("*").alias("n")).join(some, "reason").select("reason", "n", F.transform("s", lambda x: x["t"]).alias("samples"))


def applied_lines(lines: DataFrame) -> DataFrame:
    """Report lines (path, line_no, text) -> ticked entries: company, title, url."""
    shape = r"^\s*- \[[xX]\] (.+?) — (.+?) — (https?://\S+)"
    plain = lambda k: F.regexp_replace(F.regexp_extract("text", shape, k), r"\\([\\`*_{}\[\]()#+\-.!|<>])", "$1")
    return lines.where(F.col("text").rlike(shape)).select("path", "line_no", plain(1).alias("company"), plain(2).alias("title"), F.regexp_extract("text", shape, 3).alias("url"))


def source_dimension(base: DataFrame, profile: str, fields: list[str]) -> DataFrame:
    """Enabled sources with a profile's option, else the top-level one, field by field."""
    over = F.try_element_at("profile_options", F.lit(profile))
    return base.where("enabled").select("source_id", "adapter", "min_poll_hours", *[F.coalesce(F.try_element_at(over, F.lit(f)), F.try_element_at("options", F.lit(f))).alias(f) for f in fields])
