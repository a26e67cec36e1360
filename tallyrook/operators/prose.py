"""Prose audit by a table of phrases, contrast frames and the rhythm of sentences; each document within its own row.

Phrases are found as word sequences: a text's words are looked up by a phrase's first word, and only there its other words
are compared, so a text is gone through once whatever the number of phrases. A word is a run of letters and digits with
inner hyphens and apostrophes, lower-cased; so `delve` isn't in `delver`, and `game-changer` is one word.

Cases: a null text is empty and passes everything; counts are of places, so phrases that overlap count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"
#: Verbs that are tells in every form of theirs (fixed values).
VERBS = ("delve", "leverage", "harness", "foster", "navigate", "utilize", "commence", "ascertain", "endeavor", "showcase", "underscore", "embark")
#: Phrases of each check (fixed values).
PHRASES = {
    "vocabulary": (
        "robust", "seamless", "seamlessly", "comprehensive", "comprehensively", "pivotal", "holistic", "holistically", "landscape", "landscapes", "tapestry", "tapestries", "realm", "realms",
        "paradigm", "paradigms", "cutting-edge", "game-changer", "game-changers", "transformative", "testament to", "actionable", "impactful", "learnings",
    ),
    "chat": ("i hope this helps", "great question", "certainly", "feel free to reach out", "let me know if you need anything else", "let's dive in", "in this article we will explore"),
    "intensifiers": ("genuinely", "truly", "quite frankly", "it's worth noting", "notably", "interestingly"),
    "copulas": ("serves as", "features", "boasts", "presents"),
    "transitions": ("moreover", "furthermore", "additionally", "in today's", "when it comes to"),
    "inflation": ("pivotal moment", "watershed", "game-changing"),
    "closers": ("excited to apply", "passion for excellence", "the future looks bright", "only time will tell"),
    "hedges": ("could potentially", "may eventually", "might potentially", "could possibly", "may possibly", "might eventually"),
}
_IS, _ISNT = r"(?:is|are|was|were)", r"(?:(?:is|are|was|were) not|isn['’]t|aren['’]t|wasn['’]t|weren['’]t)"
#: Frames of contrast (fixed values): not just, X is not Y; it is Z, a negation that the next sentence answers, X, not Y, and
#: a countdown of negations.
FRAMES = (
    r"(?i)\bnot (?:just|only)\b",
    rf"(?i)\b{_ISNT} [^.;!?\n]+[;,] *(?:it|they|this|that) {_IS}\b",
    rf"(?i)\b{_ISNT} [^.!?\n]+[.!?]\s+the real\b",
    r"(?i), not (?:an? |the )?[a-z]",
    r"(?i)\bit(?:['’]s| is) not [^.!?\n]+[.!?]\s+it(?:['’]s| is) not\b",
)
DASHES = r"—|--"
#: A paragraph that ends with three things in a row.
TRIAD = r"(?i)[a-z0-9]+, [^,.;!?]+,? and [^,.;!?]+[.!?]*\s*$"
#: Sentences on end whose lengths differ by so many words at most are of one length.
RUN, ALIKE = 5, 2


def forms(verb: str) -> tuple[str, ...]:
    """A regular verb's forms: showcase, showcases, showcased, showcasing; embark, embarks, embarked, embarking."""
    stem = verb.removesuffix("e")
    return (verb, f"{verb}es" if verb.endswith("s") else f"{verb}s", f"{stem}ed", f"{stem}ing")


def rules() -> dict[str, tuple[str, ...]]:
    """All phrases of each check."""
    return PHRASES | {"vocabulary": PHRASES["vocabulary"] + tuple(f for v in VERBS for f in forms(v))}


def words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.translate(w, "’", "'"))


def found(text_words: str, table: dict[str, tuple[str, ...]]) -> Column:
    """The checks of all phrases of a table in an array of words, one for each place."""
    by_first: dict[str, list] = {}
    for check, phrases in table.items():
        for p in phrases:
            by_first.setdefault(p.split()[0], []).append(F.struct(F.array(*map(F.lit, p.split())).alias("words"), F.lit(check).alias("check")))
    tree = F.map_from_arrays(F.array(*map(F.lit, by_first)), F.array(*[F.array(*x) for x in by_first.values()]))
    places = F.filter(F.transform(text_words, lambda w, i: F.struct(F.try_element_at(tree, w).alias("rules"), i.alias("i"))), lambda x: x["rules"].isNotNull())
    here = lambda x: F.filter(x["rules"], lambda r: F.slice(text_words, x["i"] + 1, F.size(r["words"])) == r["words"])
    return F.flatten(F.transform(places, lambda x: F.transform(here(x), lambda r: r["check"])))


def _count(hits: str, check: str) -> Column:
    return F.size(F.filter(hits, lambda h: h == check))


def sentence_sizes(text: Column) -> Column:
    """Words of each sentence."""
    return F.transform(F.filter(F.split(text, r"[.!?]+\s+"), lambda s: F.trim(s) != ""), lambda s: F.size(F.split(F.trim(s), r"\s+")))


def uniform_runs(sizes: str) -> Column:
    """How many times RUN sentences on end are of one length."""
    starts = F.when(F.size(sizes) >= RUN, F.sequence(F.lit(1), F.size(sizes) - RUN + 1)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(starts, lambda i: F.array_max(F.slice(sizes, i, RUN)) - F.array_min(F.slice(sizes, i, RUN)) <= ALIKE))


def audit(documents: DataFrame) -> DataFrame:
    """doc_id, the count of each check, the report's four verdicts, and pass: these four, and no chat phrase.

    Of the hard bans none may occur; triads are paragraphs that end with one, and fail where all of two or more do. The
    other counts are what a polish pass trims: polished tells whether there is nothing to trim.
    """
    checks = list(rules())
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", text.alias("text"), words(text).alias("w"), sentence_sizes(text).alias("sizes"))
    paragraphs = F.filter(F.split("text", r"\n\s*\n"), lambda p: F.trim(p) != "")
    frames = F.lit(0)
    for f in FRAMES:
        frames = frames + F.regexp_count("text", F.lit(f))
    rows = rows.select(
        "doc_id", F.regexp_count("text", F.lit(DASHES)).alias("dashes"), frames.alias("contrasts"), found("w", rules()).alias("hits"), uniform_runs("sizes").alias("uniform_runs"),
        F.size(paragraphs).alias("paragraphs"), F.size(F.filter(paragraphs, lambda p: p.rlike(TRIAD))).alias("triads"),
    )
    rows = rows.select("doc_id", "dashes", "contrasts", *[_count("hits", c).alias(c) for c in checks], "triads", "uniform_runs", "paragraphs")
    rows = rows.withColumns({"no_dashes": F.col("dashes") == 0, "no_contrasts": F.col("contrasts") == 0, "vocabulary_clean": F.col("vocabulary") == 0, "rhythm_varied": F.col("uniform_runs") == 0})
    trimmed = F.lit(True)
    for c in checks:
        trimmed = trimmed & (F.col(c) == 0)
    spam = (F.col("paragraphs") > 1) & (F.col("triads") == F.col("paragraphs"))
    rows = rows.withColumns({"pass": F.expr("no_dashes and no_contrasts and vocabulary_clean and rhythm_varied and chat = 0"), "polished": trimmed & ~spam})
    return rows.drop("paragraphs")
