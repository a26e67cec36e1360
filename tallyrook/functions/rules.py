"""Rule tables: phrases that classifiers look for, as whole words and in any case.

A word boundary is ASCII (a letter with an accent doesn't count as part of a word). Phrases may hold regular-expression
syntax. Every table can be replaced: operators take tables as parameters, these are the seed sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The seed phrases.
SCOPE_GLOBAL = (
    "worldwide", "global remote", "work from anywhere", "anywhere in the world", "remote anywhere", "home based\\b.*\\bworldwide",
    "globally remote", "open to applicants located anywhere",
)
SCOPE_REGION = ("emea", "europe", "eu", "uk", "united kingdom", "remote-first", "home based")
SCOPE_RESTRICTED = ("us only", "united states only", "hybrid", "on-?site", "nyc", "san francisco", "poland only")
LEVELS = (
    ("staff_lead", ("staff", "lead", "principal", "director", "head of")),
    ("senior", ("senior", "sr\\.\\w+")),
    ("junior", ("junior", "entry[- ]level", "graduate", "intern")),
    ("mid", ("mid[- ]level", "intermediate")),
)
HOME_EXPLICIT = ("nigeria", "africa", "african", "emea timezones?", "europe,\\s*the middle east and africa", "middle east and africa")
HOME_COUNTRY, HOME_CONTINENT = ("nigeria",), ("africa", "african")
GEO_POSITIVE = HOME_EXPLICIT + (
    "any country", "anywhere (?:around the globe|in the world|on earth)", "work from anywhere", "worldwide", "global(?:ly)? remote",
    "no location restriction", "all countries", "open to (?:global|international|all) candidates", "open to applicants located anywhere",
    "remote — anywhere",
)
GEO_NOT_HOME = ("not africa", "(?:excluding|except) africa")
GEO_EXCLUSION = GEO_NOT_HOME + (
    "geo-limited,\\s*not africa", "eu only", "eea only", "european union only",
    "right to work in (?:the )?(?:eu|eea|uk|europe|united kingdom)",
    "(?:eligible|legally authorized|legally entitled) to work in (?:the )?(?:eu|eea|uk|europe|united kingdom)",
    "must be (?:based|located|resident|living) in (?:the )?(?:eu|eea|uk|europe|united kingdom)",
    "(?:must|need to) be based in (?:a )?(?:specific )?(?:eu|european|uk|eea)", "uk (?:only|nationals?|citizens?|residents? only)",
    "(?:poland|germany|france|spain|italy|netherlands|ireland|sweden|portugal|romania|czechia|hungary|austria|belgium|denmark|finland|norway|switzerland) only",
    "located in (?:the )?(?:united kingdom|uk|eu|europe|eea)", "(?:us|u\\.s\\.|united states) only", "within (?:the )?(?:eu|eea|uk)",
    "(?:eu|eea|uk) (?:citizens?|nationals?|passport)", "hybrid", "on-?site",
)
FRONT_TITLE = (
    "frontend", "front-end", "front end", "react", "next\\.?js", "web engineer", "web developer", "ui engineer", "product engineer",
    "design engineer", "javascript engineer", "typescript engineer", "growth engineer", "full[- ]stack", "fullstack",
)
FRONT_EXCLUDE = (
    "engineering manager", "manager", "director", "customer success", "sales", "sdr", "support engineer", "sustaining",
    "operations engineer", "delivery lead", "recruiter", "account executive", "technical author", "golang", "python engineer",
    "rust engineer", "openstack", "cloud engineering", "backend engineer", "platform engineer", "devops", "sre", "observability",
)
FRONT_RESCUE = ("frontend", "react", "web ui", "design engineer")
FRONT_SIGNAL = ("react", "next\\.?js", "react\\.js")
FRONT_RIVALS = ("angular", "vue 3", "vue.js")
BACK_EXPLICIT = ("node\\.?js", "nestjs", "express")
BACK_GENERIC = (
    "backend engineer", "back-end engineer", "back end engineer", "server[- ]side", "api engineer", "backend developer",
    "back-end developer", "software engineer",
)
BACK_EXCLUDE = (
    "frontend engineer", "front-end engineer", "front end engineer", "react engineer", "ui engineer", "ux engineer",
    "engineering manager", "director", "customer success", "sales", "support engineer", "golang", "go engineer", "python engineer",
    "rust engineer", "java engineer", "kotlin engineer", "scala engineer", "php engineer", "ruby engineer", "devops", "sre",
)
GENERIC_TITLE = ("software engineer",)
FRONT_STRONG = ("react", "frontend", "front-end", "front end", "next\\.?js", "web engineer", "ui engineer", "design engineer")
FRONT_MODERATE = ("web developer", "product engineer", "javascript engineer", "typescript engineer", "full[- ]stack", "fullstack")
BACK_MODERATE = ("backend engineer", "back-end engineer", "back end engineer", "server[- ]side", "api engineer", "backend developer")
TITLE_FRONT = (
    "frontend", "front-end", "front end", "react", "next\\.?js", "web engineer", "web developer", "ui engineer", "javascript engineer",
    "typescript engineer", "full[- ]stack", "fullstack",
)
TITLE_FRONT_EXCLUDE = (
    "engineering manager", "director", "customer success", "sales", "support engineer", "backend engineer", "platform engineer",
    "devops", "sre", "golang", "python engineer", "rust engineer",
)
TITLE_FRONT_RESCUE = ("frontend", "react", "web ui")
TITLE_BACK = ("node\\.?js", "backend engineer", "back-end engineer", "server[- ]side", "nestjs", "express", "api engineer", "platform engineer")
TITLE_BACK_EXCLUDE = ("frontend engineer", "front-end engineer", "react engineer", "ui engineer", "ux engineer")
TITLE_BACK_RESCUE = ("full[- ]stack", "fullstack", "node\\.?js", "backend")
THEMES = (
    "accessibility", "api", "backend", "css", "data", "devops", "docs", "frontend", "infra", "mobile", "platform", "react", "security",
    "test", "typescript", "ui", "ux",
)


def _first(phrases: Iterable[str]) -> set[str] | None:
    """The characters that phrases can begin with; None if they aren't plain letters, digits or groups of such."""
    out: set[str] = set()
    for p in phrases:
        if group := re.match(r"\(\?:([^()]*)\)(?![?*{])", p):
            some = _first(group[1].split("|"))
            if some is None:
                return None
            out |= some
        elif re.match(r"[A-Za-z0-9](?![?*{])", p) and "|" not in re.sub(r"\([^()]*\)", "", p):
            out.add(p[0].lower())
        else:
            return None
    return out


def pattern(phrases: Iterable[str]) -> str:
    """One alternation for a whole table. Where all phrases begin with plain characters, places without one of them are passed first."""
    phrases = tuple(phrases)
    first = _first(phrases)
    ahead = f"(?=[{''.join(sorted(first))}])" if first else ""
    return f"(?i){ahead}(?<!\\w)(?:{'|'.join(phrases)})(?!\\w)"


def says(text: Column | str, phrases: Iterable[str]) -> Column:
    """Whether the text has one of the phrases; false for null."""
    return F.coalesce((F.col(text) if isinstance(text, str) else text).rlike(pattern(phrases)), F.lit(False))


def hits(text: Column | str, phrases: Iterable[str]) -> Column:
    """How many of the phrases the text has, not how often."""
    total = F.lit(0)
    for phrase in phrases:
        total = total + says(text, (phrase,)).cast("int")
    return total


def themes(text: Column | str) -> Column:
    """The theme words of a text, sorted."""
    return F.filter(F.array(*[F.when(says(text, (w,)), F.lit(w)) for w in THEMES]), lambda w: w.isNotNull())
