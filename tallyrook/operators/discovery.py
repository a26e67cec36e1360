"""Discovery funnel: entity-graph payloads (variant) -> hits -> details -> block filters -> counts."""

from __future__ import annotations

import json
import re
import sys

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyrook.functions import urls as U
from tallyrook.functions.text import _BLANKS, normalize_text
from tallyrook.operators.listings import Policy, blocked_apply_url, discovery_geo, remote_scope, title_role

_NOT_NAME = re.compile("[^a-z0-9_/+.-]+")
_LISTS = ("$.included", "$.data.included", "$.data.elements")


def search_hits(payloads: DataFrame) -> DataFrame:
    """(payload_id, payload json) -> job_id, title, company, url: the first mention of a job, in payload and list order."""
    v = payloads.select("payload_id", F.try_parse_json("payload").alias("v"))
    lists = F.array(*[F.struct(F.lit(k).alias("k"), F.try_variant_get("v", p, "array<variant>").alias("items")) for k, p in enumerate(_LISTS)])
    items = v.select("payload_id", F.explode(lists).alias("l")).select("payload_id", "l.k", F.posexplode("l.items").alias("pos", "x"))
    text = lambda p: F.try_variant_get("x", p, "string")
    told = items.select("payload_id", "k", "pos", text("$.entityUrn").alias("entity"), text("$.title").alias("title"), F.coalesce(text("$.companyDetails.company"), text("$.companyUrn")).alias("urn"), text("$.companyName").alias("own"), text("$.name").alias("name"))
    # an item with a name is the firm of its URN, one with a title a hit of a firm: both meet by URN, from one reading of a payload
    firm = F.when(F.col("name").isNotNull(), F.struct(F.col("entity").alias("urn"), "name", F.lit(None).cast("string").alias("job_id")))
    hit = F.when(F.col("title").isNotNull(), F.struct("urn", F.lit(None).cast("string").alias("name"), U.id_from_urn(F.col("entity")).alias("job_id")))
    roles = told.select("payload_id", "k", "pos", "title", "own", F.explode(F.array_compact(F.array(firm, hit))).alias("r")).select("payload_id", "k", "pos", "title", "own", "r.*").where("name is not null or job_id is not null")
    named = F.min("name").over(Window.partitionBy("payload_id", "urn"))
    hits = roles.withColumn("name", F.when(F.col("payload_id").isNotNull() & F.col("urn").isNotNull(), named)).where("job_id is not null")
    nth = F.row_number().over(Window.partitionBy("job_id").orderBy("payload_id", "k", "pos"))
    return hits.withColumn("nth", nth).where("nth = 1").select("job_id", "title", F.coalesce("name", "own", F.lit("Unknown")).alias("company"), F.col("payload_id").alias("page"))


#: The network's own host: a link to it is no external application (fixed value).
OWN_HOST = "linkedin.com"
#: The field that says how to apply.
_NAMED = "applyMethod"


#: (field, field of it or none) in the order in which they are looked at.
_TOLD, _NAME = (("companyName", None), ("company", None)), (("name", None), ("companyName", None), ("universalName", None))
_PLACE = (("formattedLocation", None), ("locationDescription", None), ("defaultLocalizedName", None), ("shortLocationName", None), ("secondaryDescription", None))
_ABOUT = (("description", None), ("jobDescription", None), ("descriptionText", None), ("description", "rawText"), ("localizedDescription", "rawText"), ("localizedDescription", "text"))


def _once(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a name is repeated")
    return out


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


_NESTED = (dict, list)
#: JSON as Spark's variant takes it: no NaN, each name of an object once, whatever follows.
_JSON = json.JSONDecoder(object_pairs_hook=_once, parse_constant=_no_constant)


def _first_text(record: object, paths: tuple[tuple[str, str | None], ...]) -> str | None:
    """The first text among some fields, trimmed: a string, or the `text` of an object."""
    if isinstance(record, dict):
        for name, inner in paths:
            x = record.get(name)
            if inner is not None:
                x = x.get(inner) if isinstance(x, dict) else None
            if isinstance(x, dict):
                x = x.get("text")
            if isinstance(x, str) and (x := x.strip(_BLANKS)):
                return x
    return None


def _said(record: dict, *names: str) -> str:
    """The first of some fields that isn't null, as text."""
    x = next((x for n in names if (x := record.get(n)) is not None), "")
    return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def _way(record: dict, own_host: str) -> tuple[str | None, bool] | None:
    """How a record says to apply: by a link beyond the network, else on the site (no link, True); None if neither."""
    method = record[_NAMED]
    if not isinstance(method, dict):
        return None
    offsite = next((x for n in ("offsiteApply", "companyApplyUrl") if isinstance(x := method.get(n), _NESTED)), None)
    url = _first_text(method, (("companyApplyUrl", None),)) or _first_text(offsite, (("companyApplyUrl", None), ("url", None)))
    if url and own_host not in url:
        return url, False
    return (None, True) if "OnsiteApply" in _said(method, "$type", "type") else None


def _first_way(value: dict | list, own_host: str) -> tuple[list[int], tuple[str | None, bool]] | None:
    """The first way of a value or of what is in it, parents before children, behind its place at each level."""
    if isinstance(value, dict):
        if _NAMED in value and (found := _way(value, own_host)):
            return [], found
        value = value.values()
    for k, x in enumerate(value):
        if isinstance(x, _NESTED) and (below := _first_way(x, own_host)):
            return [k, *below[0]], below[1]
    return None


def _detail(payload: str | None, own_host: str) -> list[tuple | None]:
    """What a payload tells: (place in it, value) of company, location, description and way; None for what it doesn't."""
    company = location = description = way = None
    try:
        root = _JSON.raw_decode(payload.lstrip(" \t\r\n"))[0] if payload else None
    except (ValueError, RecursionError):
        root = None
    if isinstance(root, _NESTED):
        way = _first_way(root, own_host)
    if isinstance(root, dict):
        data = root.get("data")
        included = [y for x in (root, data) if isinstance(x, dict) and isinstance(x.get("included"), list) for y in x["included"]]
        for at, x in enumerate((root, data, *included)):
            if not isinstance(x, dict):
                continue
            firm = posting = False
            if at > 1:
                urn, type_ = _said(x, "entityUrn"), _said(x, "$type", "type")
                posting = "jobPosting" in urn or "JobPosting" in type_
                firm = "company" in urn or "organization" in urn or "Company" in type_ or "Organization" in type_
            if company is None and at != 1:
                text = (firm and _first_text(x, _NAME)) or ((posting or at == 0) and _first_text(x, _TOLD + _NAME))
                company = (at, text) if text else None
            if posting or at < 2:
                if location is None and (text := _first_text(x, _PLACE)):
                    location = at, text
                if description is None and (text := _first_text(x, _ABOUT)):
                    description = at, text
    return [company, location, description, way]


def _encodable(text: str | None) -> str | None:
    """Half of a pair of surrogates becomes a question mark, as in Java."""
    return text if text is None or text.isascii() else text.encode("utf-8", "replace").decode()


_TEXT = "struct<at: int, text: string>"
_DETAILS = f"company {_TEXT}, location {_TEXT}, description {_TEXT}, way struct<at: array<int>, url: string, easy: boolean>"


def _details_of(own_host: str):
    def column(found: list[tuple | None], at: pa.DataType, **values) -> pa.Array:
        arrays = [pa.array([x and x[0] for x in found], at), *(pa.array([None if x is None else f(x[1]) for x in found], kind) for f, kind in values.values())]
        return pa.StructArray.from_arrays(arrays, ["at", *values], mask=pa.array([x is None for x in found]))

    def run(batches):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 5000))  # Spark's parser takes 1000 levels
        for batch in batches:
            found = [_detail(x, own_host) for x in batch.column("payload").to_pylist()]
            texts = [column([x[k] for x in found], pa.int32(), text=(_encodable, pa.string())) for k in range(3)]
            ways = column([x[3] for x in found], pa.list_(pa.int32()), url=(lambda x: _encodable(x[0]), pa.string()), easy=(lambda x: x[1], pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column("job_id"), *texts, ways], ["job_id", "company", "location", "description", "way"])

    return run


def details(payloads: DataFrame, own_host: str = OWN_HOST) -> DataFrame:
    """(job_id, payload json) -> company, location, description, apply_url, easy_apply_only.

    The first record with a way to apply decides, at any depth, parents before children, in the payload's own order. The
    company is the payload's, else the first included company's or posting's; place and text are the payload's, its data's,
    or the first included posting's. A payload that is no JSON, or repeats a name in an object, has nothing. A payload is
    parsed once, however deep it is.
    """
    rows = payloads.select("job_id", F.col("payload").cast("string").alias("payload"))
    rows = rows.mapInArrow(_details_of(own_host), f"job_id {rows.schema['job_id'].dataType.simpleString()}, {_DETAILS}")
    whole = rows.groupBy("job_id").agg(*[F.min(c).alias(c) for c in ("company", "location", "description", "way")])
    return whole.select("job_id", *[F.col(f"{c}.text").alias(c) for c in ("company", "location", "description")], F.col("way.url").alias("apply_url"), F.coalesce("way.easy", F.lit(False)).alias("easy_apply_only"))


def enrich(hits: DataFrame, other: DataFrame, detail: DataFrame) -> DataFrame:
    """Firms from the hit, a second hit set, the detail, then the apply URL."""
    known = lambda c: F.nullif(F.col(c), F.lit("Unknown"))
    rows = hits.join(other.select("job_id", F.col("company").alias("company2")), "job_id", "left").join(detail.withColumnRenamed("company", "company3"), "job_id", "left")
    company = F.coalesce(known("company"), known("company2"), known("company3"), U.company_from_apply_url(F.col("apply_url")), F.lit("Unknown"))
    return rows.withColumn("company", company).drop("company2", "company3")


def judged(hits: DataFrame, policy: Policy, slugs: list[str], domains: tuple[str, ...], blocked_firms: list[str]) -> DataFrame:
    rows = hits.withColumns({"location": F.coalesce("location", F.lit("")), "description": F.coalesce("description", F.lit(""))}).withColumn("remote_scope", remote_scope())
    return rows.withColumns({
        "role_ok": title_role(policy.profile), "geo": discovery_geo(policy), "blocked_url": blocked_apply_url(F.col("apply_url"), slugs, domains),
        "blocklisted": normalize_text(F.col("company")).isin(*[_NOT_NAME.sub(" ", b.lower()).strip() for b in blocked_firms]),
    })


def funnel(rows: DataFrame) -> DataFrame:
    """One row of counts; a hit can be blocked both by URL and by firm."""
    on = F.col("role_ok")
    free = on & ~F.coalesce("easy_apply_only", F.lit(False)) & ~F.col("blocked_url") & ~F.col("blocklisted")
    flags = {
        "raw": F.lit(True), "role_filtered": on, "external": on & F.col("apply_url").isNotNull(), "easy_apply_only": on & F.coalesce("easy_apply_only", F.lit(False)),
        "blocked_url": on & F.col("blocked_url"), "blocklisted": on & F.col("blocklisted"), **{t: free & (F.col("geo") == t) for t in ("eligible", "verify", "excluded")},
    }
    return rows.agg(*[F.count_if(c).alias(k) for k, c in flags.items()])


def hits_by_page(hits: DataFrame) -> DataFrame:
    return hits.groupBy("page").agg(F.count("*").alias("n"))
