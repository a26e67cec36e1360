"""Audits of a document corpus: structure, diagnostics, evidence tags, style, secrets, paths, inline spans. No joins but
with rule tables; each document is judged within its own row, or by a window over its own lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrook.functions import text as X
from tallyrook.functions.rules import pattern

#: (label, pattern): fixed values.
SECRETS = (
    ("code host token", "ghp_[A-Za-z0-9]{20,}"),
    ("code host fine-grained token", "github_pat_[A-Za-z0-9_]{20,}"),
    ("api key", "(?<![A-Za-z0-9_])sk-[A-Za-z0-9]{20,}(?![A-Za-z0-9_])"),
    ("private key header", "-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----"),
)
TAGS = r"(?i)`(?:verified-from-github|needs-your-confirmation)`"
#: What a metadata comment begins with.
MARKERS = ("doc:meta", "doc-meta:")


def lines(documents: DataFrame) -> DataFrame:
    """doc_id, line_no (from 1), line."""
    return documents.select("doc_id", F.posexplode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n", "\n"), "\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("line_no"), "line")


def structure(documents: DataFrame) -> DataFrame:
    """Blocks of structured text: doc_id, line_no, section, role, kind, text. Headings are carried down their document."""
    t = F.trim("line")
    rows = lines(documents).withColumn("t", t)
    section, role = F.when(F.col("t").rlike(r"^## "), F.substring("t", F.lit(4), F.length("t"))), F.when(F.col("t").rlike(r"^### "), F.substring("t", F.lit(5), F.length("t")))
    down = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.last(section, ignorenulls=True).over(down))
    in_section = Window.partitionBy("doc_id", "section").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("role", F.last(role, ignorenulls=True).over(in_section))
    kind = (
        F.when(F.col("t").rlike(r"^- "), "bullet").when(F.col("t").rlike(r"(?i)^\*\*stack:?\*\*"), "stack").when(F.col("t").rlike(r"^> "), "note")
        .when(F.col("t").rlike(r"^\*[^*]+\*$"), "meta").otherwise("paragraph")
    )
    return rows.where((F.col("t") != "") & ~F.col("t").rlike(r"^#{1,6}\s") & ~F.col("t").rlike(r"^---+\s*$")).select("doc_id", "line_no", "section", "role", kind.alias("kind"), F.col("t").alias("text"))


def diagnostics(documents: DataFrame) -> DataFrame:
    """doc_id, line_no, code of constructs that the structure doesn't know; the first rule that fits a line counts."""
    rows = lines(documents).withColumn("t", F.trim("line"))
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    name = F.col("t").startswith("# ")
    rows = rows.withColumn("named", F.coalesce(F.max(name).over(before), F.lit(False)))
    code = (
        F.when((F.col("t") == "") | F.col("t").rlike(r"^---+\s*$"), None)
        .when(name, F.when(F.col("named"), "unsupported_heading"))
        .when(F.col("t").rlike(r"^#{4,}\s"), "unsupported_heading").when(F.col("t").rlike(r"^#{1,3}\s"), None)
        .when(F.col("t").rlike(r"^\|.+\|") | F.col("t").rlike(r"^:?-{3,}:?\s*(?:\||$)"), "unsupported_table")
        .when(F.col("line").rlike(r"!\[[^\]]*\]\([^)]+\)"), "unsupported_image").when(F.col("line").rlike(r"^\s+- "), "unsupported_nested_list")
        .when(F.col("line").rlike(r"<[a-zA-Z][^>]*>"), "unsupported_raw_html")
    )
    found = rows.select("doc_id", "line_no", code.alias("code")).where("code is not null")
    unnamed = rows.groupBy("doc_id").agg(F.max(name).alias("n")).where("not n").select("doc_id", F.lit(1).alias("line_no"), F.lit("missing_name_heading").alias("code"))
    return found.unionByName(unnamed)


def orphans(documents: DataFrame) -> DataFrame:
    """doc_id, line_no of lines between the rule that ends the header and the first section: no section holds them. Documents
    that don't begin with a name heading have none. Positions are found within the row's own lines."""
    rows = documents.select("doc_id", F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n", "\n"), "\n").alias("a"))
    blank, rule = lambda x: ~x.rlike(r"\S"), lambda x: x.rlike(r"^\s*---+\s*$")
    first = lambda f: F.array_position(F.transform("a", f), F.lit(True))
    rows = rows.withColumns({"name": first(lambda x: ~blank(x)), "rule": first(rule), "section": first(lambda x: x.startswith("## "))})
    rows = rows.where((F.col("rule") > 0) & F.try_element_at("a", F.col("name").cast("int")).startswith("# "))
    lost = rows.select("doc_id", "rule", "section", F.posexplode("a").alias("p", "line")).withColumn("line_no", F.col("p") + 1)
    inside = (F.col("line_no") > F.col("rule")) & ((F.col("section") == 0) | (F.col("line_no") < F.col("section")))
    return lost.where(inside & ~blank(F.col("line")) & ~rule(F.col("line"))).select("doc_id", "line_no")


def remove_tags(documents: DataFrame, markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """doc_id, text without evidence tags and metadata comments, n_tags, n_meta, leaked (whether some is left)."""
    named = "|".join(map(re.escape, markers))
    meta = rf"(?i)<!--\s*(?:{named})[\s\S]*?-->"
    out = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), meta, ""), " ?" + TAGS + " ?", " ")
    rows = documents.select("doc_id", F.trim(out).alias("clean"), F.regexp_count("text", F.lit(TAGS)).alias("n_tags"), F.regexp_count("text", F.lit(meta)).alias("n_meta"))
    return rows.withColumn("leaked", F.col("clean").rlike(f"(?i)verified-from-github|needs-your-confirmation|{named}"))


def letter_limits(documents: DataFrame, max_paragraphs: int = 3, max_words: int = 650) -> DataFrame:
    paragraphs = F.filter(F.split(F.coalesce("text", F.lit("")), r"\n\s*\n"), lambda p: F.trim(p) != "")
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n]+"), lambda w: w != ""))
    openings = F.array_distinct(F.transform(paragraphs, lambda p: F.lower(F.regexp_extract(p, r"([A-Za-z]+)", 1))))
    rows = documents.select("doc_id", F.size(paragraphs).alias("paragraphs"), words.alias("words"), F.size(openings).alias("openings"))
    return rows.withColumn("pass", (F.col("paragraphs") <= max_paragraphs) & (F.col("words") <= max_words) & ((F.col("paragraphs") <= 1) | (F.col("openings") > 1)))


def secrets(documents: DataFrame) -> DataFrame:
    """doc_id, label of each kind of secret that a document holds."""
    found = F.filter(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in SECRETS]), lambda x: x.isNotNull())
    return documents.select("doc_id", F.explode(found).alias("label"))


def path_policy(path: Column) -> Column:
    """The first rule that a file path breaks, null if none."""
    base = F.substring_index(path, "/", -1)
    env = (base != ".env.example") & ((base == ".env") | base.startswith(".env.") | base.endswith(".pem") | base.endswith(".pat"))
    return (
        F.when(env, "secrets or env file").when(path.startswith("profile/") & (path != "profile/ONBOARDING.md"), "personal profile file")
        .when(path.startswith("jobs/") & (path != "jobs/.gitkeep"), "application artefact")
        .when(path.isin("config/github-repos.json", "config/job-search.json", "config/job-search-nodejs-backend.json"), "personal config")
    )


def redacted(documents: DataFrame) -> DataFrame:
    out = X.redact_paths(F.col("text"))
    return documents.select("doc_id", out.alias("redacted"), X.has_sensitive_path(F.col("text")).alias("had"), X.has_sensitive_path(out).alias("left"))


def inline_spans(documents: DataFrame) -> DataFrame:
    """Counts of strong, em, code and link spans, and the links' targets."""
    text = F.coalesce("text", F.lit(""))
    links = F.regexp_extract_all(text, F.lit(r"\[[^\]\n]+\]\(([^)\n]+)\)"), F.lit(1))
    return documents.select(
        "doc_id", F.regexp_count(text, F.lit(r"\*\*[^*\n]+\*\*")).alias("strong"), F.regexp_count(text, F.lit(r"(?<!\*)\*[^*\n]+\*(?!\*)")).alias("em"),
        F.regexp_count(text, F.lit(r"`[^`\n]+`")).alias("code"), F.size(links).alias("links"), F.array_join(links, " ").alias("hrefs"),
    )


def evidence_search(terms: DataFrame, evidence: DataFrame, per_term: int = 5, enough: int = 3) -> tuple[DataFrame, DataFrame]:
    """terms (term, word: the term or a synonym), evidence (id, text, merged, at) -> the best finds of each term, and the
    terms with fewer than `enough`. Both sides meet by word, so nothing is compared with everything.

    Evidence is dealt once, by id, before a word stands for its terms: each row that has a word of any term moves once, however many
    terms share the word.
    """
    words = evidence.select("id", "merged", "at", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9.]+"))).alias("word"))
    words = words.join(terms.select("word").distinct(), "word", "left_semi").repartition("id").groupBy("word", "id").agg(F.max("merged").alias("merged"), F.max("at").alias("at"))
    found = words.join(terms, "word").groupBy("term", "id").agg(F.max("merged").alias("merged"), F.max("at").alias("at"))
    order = Window.partitionBy("term").orderBy(F.desc("merged"), F.desc("at"), "id")
    best = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_term)
    known = found.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= enough)
    return best, terms.select("term").distinct().join(known, "term", "left_anti")
