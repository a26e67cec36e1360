"""Text columns: entities, markup, normal forms, path redaction, rounding. All are plain expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of a browser's regular expressions: ASCII, and the Unicode spaces that Java leaves out.
WS = r"[\s\u000B   -     　﻿]"
_BLANKS = " \t\n\u000b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"  # WS, one by one
#: What normalize_text() keeps, one by one: a class of single characters is looked up in a table, one of ranges is tried range by range.
_KEPT = string.ascii_letters + string.digits + r"_/+.\-"
NAMED = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&"))
URL = r"(?i)https?://[^\s\"'`<>|]+"
WINDOWS_PATH = r"(?<![A-Za-z0-9])[A-Za-z]:[\\/][^\s\"'`<>|]*"
UNC_PATH = r"\\\\[^\s\"'`<>|]+"
POSIX_PATH = r"(^|[\s\"'`(=:,])/(?:[A-Za-z0-9._-]+/)*[A-Za-z0-9._-]+/?"
REDACTED, MAX_ARTIFACT = "[redacted-path]", 4096


def let(value: Column, body) -> Column:
    """body(value) with value evaluated, and written into the plan, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def _numeric(text: Column, shape: str, code) -> Column:
    """Replaces each distinct numeric entity by its code point; one that is none stays as it is."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(shape), F.lit(0)))

    def put(acc: Column, entity: Column) -> Column:
        point = code(entity)
        valid = point.isNotNull() & (point > 0) & (point <= 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, point).otherwise(F.lit(32))), 8, "0")), "UTF-32")
        return F.when(valid, F.replace(acc, entity, char)).otherwise(acc)

    return F.when(text.isNotNull(), F.aggregate(found, text, put))


def decode_entities(text: Column) -> Column:
    """Hexadecimal, then decimal, then six named entities, each in one pass; `&amp;` is the last of the names."""
    hexed, decimal = "(?i)&#x[0-9a-f]+;", "&#[0-9]+;"
    of_hex = lambda e: F.conv(F.substring(F.regexp_extract(e, "([0-9a-fA-F]+);", 1), 1, 8), 16, 10).cast("long")
    of_decimal = lambda e: F.substring(F.regexp_extract(e, "([0-9]+)", 1), 1, 9).cast("long")

    def decoded(t: Column) -> Column:
        out = F.when(t.contains("&#"), let(_numeric(t, hexed, of_hex), lambda h: _numeric(h, decimal, of_decimal))).otherwise(t)
        for name, char in NAMED:
            out = F.regexp_replace(out, f"(?i)&{name};", char)
        return out

    return let(text, lambda t: F.when(t.contains("&"), decoded(t)).otherwise(t))


def strip_html(text: Column) -> Column:
    """Line breaks for <br>, </p> and </li>, a space for any other tag, runs of blanks collapsed, then entities."""

    def plain(t: Column) -> Column:
        out = F.regexp_replace(t, rf"(?i)<br{WS}*/?>", "\n")
        out = F.regexp_replace(out, "(?i)</p>|</li>", "\n")
        return F.when(t.contains("<"), F.regexp_replace(out, "<[^>]+>", " ")).otherwise(t)

    def collapsed(t: Column) -> Column:
        out = F.regexp_replace(F.regexp_replace(t, f"{WS}+\n", "\n"), "[ \t]+", " ")
        return F.when(t.contains("\n") | t.contains("\t") | t.contains("  "), out).otherwise(t)

    return decode_entities(trimmed(let(let(text, plain), collapsed)))


def clean_text(text: Column) -> Column:
    """Entities decoded, white space collapsed."""
    return trimmed(F.regexp_replace(decode_entities(text), f"(?![!-~])(?: (?={WS})|(?! ){WS}){WS}*", " "))  # a blank alone stays


def normalize_text(text: Column) -> Column:
    """Lower case; what isn't an ASCII letter, digit or one of _ / + . - becomes a blank; blanks collapsed."""
    other = f"[^{_KEPT}]"
    return F.trim(F.regexp_replace(F.lower(text), f"(?: (?={other})|(?! ){other}){other}*", " "))  # a blank alone stays


def year_month(date: Column) -> Column:
    return F.when(F.length(date) >= 7, F.substring(date, 1, 7)).otherwise("unknown")


def round2(x: Column) -> Column:
    """Half up on the double."""
    return F.floor(x * 100 + 0.5) / 100


def redact_paths(text: Column, limit: int = MAX_ARTIFACT) -> Column:
    """Absolute paths replaced outside URLs; URLs lose their user part; cut at `limit` with an ellipsis."""
    plain = F.split(text, URL)
    urls = F.regexp_extract_all(text, F.lit(URL), F.lit(0))

    def redact(part: Column) -> Column:
        part = F.regexp_replace(part, WINDOWS_PATH, REDACTED)
        part = F.regexp_replace(part, UNC_PATH, REDACTED)
        return F.regexp_replace(part, POSIX_PATH, "$1" + REDACTED)

    bare = F.transform(urls, lambda u: F.regexp_replace(u, r"^(?i)(https?://)[^/?#@]*@", "$1"))
    out = F.array_join(F.flatten(F.transform(plain, lambda p, i: F.array(redact(p), F.coalesce(F.get(bare, i), F.lit(""))))), "")
    return F.when(F.length(out) <= limit, out).otherwise(F.concat(F.substring(out, 1, limit - 1), F.lit("…")))


def has_sensitive_path(text: Column) -> Column:
    rest = F.regexp_replace(text, URL, "")
    return rest.rlike(WINDOWS_PATH) | rest.rlike(UNC_PATH) | rest.rlike(POSIX_PATH)


def one_line(text: Column) -> Column:
    """Control characters dropped, line ends unified."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")


def unescape_markdown(text: Column) -> Column:
    """Takes the backslash from punctuation that a report has escaped."""
    return F.regexp_replace(text, r"\\([\\`*_{}\[\]()#+\-.!|<>])", "$1")


def redact_leaves(schema_column: str, fields: list[str]) -> Column:
    """A struct with every string field redacted: nested artefacts are redacted leaf by leaf."""
    return F.struct(*[redact_paths(F.col(f"{schema_column}.{f}")).alias(f) for f in fields])
