"""URL columns: canonical forms, quality, public hosts. A URL is taken apart by one regular expression, which can't fail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyrook.functions.text import let, normalize_text, trimmed

#: Query parameters that only track (fixed values); any that begins with utm_ does too.
TRACKING = ("fbclid", "gclid", "gclsrc", "dclid", "msclkid", "mc_cid", "mc_eid", "igshid", "mkt_tok", "ref", "ref_src", "ref_url", "_ga", "_gl", "yclid")
# scheme, user, host, port, path, query
_SHAPE = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]/?#]*\]|[^/?#:@ ]+)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
#: Hosts on which firms publish applications: the firm's name is in the path or the host (fixed values).
APPLY_SHAPES = (
    r"(?i)^https?://(?:job-)?boards\.greenhouse\.io/([^/?#]+)",
    r"(?i)^https?://jobs\.lever\.co/([^/?#]+)",
    r"(?i)^https?://jobs\.ashbyhq\.com/([^/?#]+)",
    r"(?i)^https?://apply\.workable\.com/([^/?#]+)",
    r"(?i)^https?://([^./]+)\.(?:recruitee|bamboohr|teamtailor)\.com",
)


_CUT = "\u0001"


def parsed(url: Column) -> Column:
    """The URL's six parts (scheme, user, host, port, path, query), its trimmed text last, from one regular expression; empty
    parts if it has no such shape."""
    marked = let(trimmed(url), lambda t: F.array(t, F.regexp_replace(F.replace(t, F.lit(_CUT), F.lit("")), _SHAPE, _CUT.join(f"$${k}" for k in range(1, 7)).replace("$$", "$"))))
    return let(marked, lambda m: let(F.split(m[1], _CUT), lambda p: F.when(F.size(p) == 6, F.concat(p, F.slice(m, 1, 1))).otherwise(F.concat(F.array_repeat(F.lit(""), 6), F.slice(m, 1, 1)))))


def part(url: Column, k: int) -> Column:
    """Part k of a URL, from 1."""
    return F.get(parsed(url), F.lit(k - 1))


def _is_http(p: Column) -> Column:
    return F.lower(p[0]).isin("http", "https")


def is_http(url: Column) -> Column:
    return _is_http(parsed(url))


def _params(p: Column) -> Column:
    return F.filter(F.split(p[5], "&"), lambda x: x != "")


def _tracks(param: Column) -> Column:
    name = F.lower(F.substring_index(param, "=", 1))
    return name.startswith("utm_") | name.isin(*TRACKING)


def _tracking(p: Column) -> Column:
    return F.when(p[0] != "", F.size(F.filter(_params(p), _tracks))).otherwise(0)


def tracking_count(url: Column) -> Column:
    return let(parsed(url), _tracking)


def _path(p: Column) -> Column:
    path = F.rtrim(p[4], F.lit("/"))
    return F.when(path == "", "/").otherwise(path)


def _port(p: Column) -> Column:
    scheme, port = F.lower(p[0]), p[3]
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return F.when(default, "").otherwise(F.concat(F.lit(":"), port))


def canonical_of(p: Column) -> Column:
    """canonical_url() of a parsed() URL."""
    query = F.array_join(F.array_sort(F.filter(_params(p), lambda x: ~_tracks(x))), "&")
    tail = let(query, lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    out = F.concat(F.lower(p[0]), F.lit("://"), F.lower(p[2]), _port(p), _path(p), tail)
    return F.when(_is_http(p), out).otherwise(normalize_text(p[6]))


def canonical_url(url: Column) -> Column:
    """Scheme and host lower-cased; user, default port, fragment and tracking parameters dropped; the rest sorted."""
    return let(parsed(url), canonical_of)


def legacy_of(p: Column) -> Column:
    """canonical_url_legacy() of a parsed() URL."""
    user = F.when(p[1] == "", "").otherwise(F.concat(p[1], F.lit("@")))
    return F.when(_is_http(p), F.lower(F.concat(p[0], F.lit("://"), user, p[2], _port(p), _path(p)))).otherwise(normalize_text(p[6]))


def canonical_url_legacy(url: Column) -> Column:
    """The older form: no query, no fragment, all lower-cased; the user part stays."""
    return let(parsed(url), legacy_of)


def is_public_host(host: Column) -> Column:
    host = F.regexp_replace(F.lower(host), r"^\[|\]$", "")
    ipv4 = host.rlike(r"^\d+\.\d+\.\d+\.\d+$")
    private = host.rlike(r"^(10\.|127\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.)")
    local = host.isin("localhost", "::1") | host.endswith(".local")
    return F.when(local, False).when(ipv4, ~private).otherwise(host.contains("."))


def url_quality(url: Column) -> Column:
    """A struct whose least value is the best URL: public https, public http, private ..., few tracking parameters, short."""

    def of(p: Column) -> Column:
        https = (F.lower(p[0]) == "https").cast("int")
        rank = F.when(p[0] == "", 5).when(~_is_http(p), 4).otherwise(F.when(is_public_host(p[2]), 1).otherwise(3) - https)
        canonical = F.when(p[0] == "", p[6]).otherwise(canonical_of(p))
        return let(canonical, lambda c: F.struct(rank.alias("rank"), _tracking(p).alias("tracking"), F.length(c).alias("size"), c.alias("canonical"), p[6].alias("url")))

    return let(parsed(url), of)


def safe_http_url(url: Column) -> Column:
    """The URL without its user part, null if it isn't http or https."""
    return F.when(is_http(url), F.regexp_replace(trimmed(url), r"^([A-Za-z]+://)[^/?#@]*@", "$1"))


def company_from_apply_url(url: Column) -> Column:
    slug = F.coalesce(*[F.nullif(F.regexp_extract(url, s, 1), F.lit("")) for s in APPLY_SHAPES])
    words = F.filter(F.split(slug, "[-_]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def company_from_profile_url(url: Column) -> Column:
    """The name in a /company/<name> URL, its dashes as blanks."""
    return F.nullif(F.replace(F.try_url_decode(F.regexp_extract(url, r"/company/([^/?#]+)", 1)), F.lit("-"), F.lit(" ")), F.lit(""))


def id_from_urn(urn: Column) -> Column:
    return F.nullif(F.regexp_extract(urn, r":\(?([0-9]+)", 1), F.lit(""))
