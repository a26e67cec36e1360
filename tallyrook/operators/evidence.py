"""Activity evidence: author filters, keyed upserts of commits and pull requests, roll-ups, watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrook.functions.rules import themes

NOISE = r"(?i)^(merge|v\d|version bump|bump)"


def project_commits(raw: DataFrame) -> DataFrame:
    """repo, sha, message, author_date, committer_date, author_name, author_login -> repo, sha, subject, date, author."""
    return raw.select(
        "repo", "sha", F.split("message", "\n")[0].alias("subject"), F.coalesce("author_date", "committer_date").alias("date"),
        F.coalesce(F.nullif("author_name", F.lit("")), "author_login").alias("author"),
    )


def own_commits(commits: DataFrame, logins: list[str], names: list[str]) -> DataFrame:
    """Commits whose login is one of ours, or whose author's or committer's name is, or begins with, one of our names.

    Names are looked at only for repositories without any login match: the flag is a maximum over the repository.
    """
    named = F.lit(False)
    for column in ("author_name", "committer_name"):
        for n in names:
            low = F.lower(column)
            named = named | F.coalesce((low == n.lower()) | low.startswith(n.lower() + " "), F.lit(False))
    by_login = F.coalesce(F.lower("login").isin(*[x.lower() for x in logins]), F.lit(False))
    any_login = commits.groupBy("repo").agg(F.max(by_login).alias("any_login"))
    out = commits.withColumns({"by_login": by_login, "by_name": named}).where("by_login or by_name").join(any_login, "repo")
    return out.where("by_login or (by_name and not any_login)").drop("by_login", "by_name", "any_login")


def own_pulls(pulls: DataFrame, logins: list[str]) -> DataFrame:
    """Pull requests (login, ...) that one of our logins has opened, whatever its case; a null login is nobody's."""
    return pulls.where(F.lower("login").isin(*[x.lower() for x in logins]))


def theme_set(texts: DataFrame, column: str = "text") -> DataFrame:
    """(theme, n): the themes that any text has, and in how many texts. Themes combine before the shuffle."""
    return texts.select(F.explode(themes(column)).alias("theme")).groupBy("theme").agg(F.count("*").alias("n"))


def upsert(prior: DataFrame, fetched: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """The snapshot after a fetch, with op: added, updated (a compared field differs), unchanged, or kept (not fetched).

    Fetched rows that repeat a key count once (the least); prior rows are never deleted; a second run changes nothing.
    """
    new = fetched.groupBy(*keys).agg(F.min(F.struct(*compared)).alias("new"))
    old = prior.select(*keys, F.struct(*compared).alias("old"))
    out = old.join(new, keys, "full")
    op = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "kept").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("updated")
    return out.select(*keys, *[F.coalesce(F.col("new"), F.col("old"))[c].alias(c) for c in compared], op.alias("op"))


def delta_totals(commits: DataFrame, pulls: DataFrame) -> DataFrame:
    """Added and updated commits and pull requests of each repository, and of all (repo null)."""
    both = commits.select("repo", "op", F.lit("commits").alias("kind")).unionByName(pulls.select("repo", "op", F.lit("pulls").alias("kind")))
    sums = [F.count_if((F.col("kind") == k) & (F.col("op") == o)).alias(f"{k}_{o}") for k in ("commits", "pulls") for o in ("added", "updated")]
    return both.rollup("repo").agg(*sums)


def timeline(commits: DataFrame, pulls: DataFrame) -> DataFrame:
    """month, commits, pulls, repos from rows with repo and month."""
    both = commits.select("repo", "month", F.lit(1).alias("c")).unionByName(pulls.select("repo", "month", F.lit(0).alias("c")))
    return both.groupBy("month").agg(F.sum("c").alias("commits"), F.sum(1 - F.col("c")).alias("pulls"), F.count_distinct("repo").alias("repos"))


def repo_evidence(commits: DataFrame, pulls: DataFrame) -> DataFrame:
    c = commits.groupBy("repo").agg(F.count("*").alias("commits"))
    p = pulls.groupBy("repo").agg(F.count("*").alias("pulls"), F.count_if("merged").alias("merged"), F.count_if(~F.col("merged")).alias("open"))
    return c.join(p, "repo", "full").na.fill(0, ["commits", "pulls", "merged", "open"])


def notable(commits: DataFrame, k: int = 8) -> DataFrame:
    """The k newest commits of each repository, those with a noisy subject only to fill up. A window limit."""
    order = Window.partitionBy("repo").orderBy(F.col("subject").rlike(NOISE), F.desc("date"), "sha")
    return commits.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def capped(rows: DataFrame, by: str, order: list[Column], cap: int) -> DataFrame:
    """At most cap rows of each group, and truncated: whether it has reached the cap. 0: no cap."""
    if not cap:
        return rows.withColumn("truncated", F.lit(False))
    nth = rows.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("nth") <= cap)
    return nth.withColumn("truncated", F.max("nth").over(Window.partitionBy(by)) >= cap).drop("nth")


def merge_candidates(lists: list[DataFrame]) -> DataFrame:
    """Lists of (name, pushed_at, language, source) -> one row a name: sources in order, latest push, first fields."""
    rows = lists[0].withColumn("rank", F.lit(0))
    for k, other in enumerate(lists[1:], 1):
        rows = rows.unionByName(other.withColumn("rank", F.lit(k)))
    sources = F.transform(F.array_sort(F.collect_set(F.struct("rank", "source"))), lambda s: s["source"])
    return rows.groupBy("name").agg(F.max("pushed_at").alias("pushed_at"), F.min_by("language", F.struct("rank", "language")).alias("language"), F.array_distinct(sources).alias("sources"))


def active_since(candidates: DataFrame, now: Column, years: int) -> DataFrame:
    return candidates.where(F.col("pushed_at").isNull() | (F.col("pushed_at") >= F.add_months(now, -12 * years)))


def next_watermark(repos: DataFrame) -> DataFrame:
    """repo, ok, truncated, last_indexed, run_at -> last_indexed moved to run_at only where the fetch was whole."""
    return repos.withColumn("last_indexed", F.when(F.col("ok") & ~F.col("truncated"), F.col("run_at")).otherwise(F.col("last_indexed")))


def completeness(repos: DataFrame) -> DataFrame:
    """What a fetch leaves known of each repository's history.

    repo, first_run, with_pulls, commit_limit, pull_limit (0: none), commits_fetched, pulls_fetched, commits_were_complete,
    pulls_were_complete, commits_cut, pulls_cut (the fetch says that it was cut) -> repo, commits_complete, pulls_complete,
    commits_truncated, pulls_truncated. A first run is complete without a limit; a later one if all before was.
    """
    def flags(kind: str, asked: Column) -> tuple[Column, Column]:
        limit, cut = F.col(f"{kind}_limit"), F.col(f"{kind}s_cut")
        full = asked & (limit > 0) & (F.col(f"{kind}s_fetched") >= limit)
        before = F.when(F.col("first_run"), limit == 0).otherwise(F.col(f"{kind}s_were_complete"))
        return (~asked | (before & ~full)) & ~cut, full | cut

    (c, ct), (p, pt) = flags("commit", F.lit(True)), flags("pull", F.col("with_pulls"))
    return repos.select("repo", c.alias("commits_complete"), p.alias("pulls_complete"), ct.alias("commits_truncated"), pt.alias("pulls_truncated"))


def commit_order() -> list[Column]:
    """Newest first, dates that can't be read last, then by hash."""
    return [F.desc(F.coalesce(F.expr("try_cast(`date` as date)"), F.lit("1970-01-01").cast("date"))), F.asc("sha")]


def repo_themes(texts: DataFrame) -> DataFrame:
    """(repo, text) of subjects and titles -> repo, themes (sorted). Texts are never joined into one; a repository's set has at
    most as many entries as there are themes."""
    each = texts.select("repo", F.explode(themes("text")).alias("theme")).distinct()
    return each.groupBy("repo").agg(F.array_sort(F.collect_list("theme")).alias("themes"))


def since(last_indexed: Column, complete: Column, overlap_seconds: int = 3600) -> Column:
    """From when to fetch: the watermark less the overlap; null, so everything, without a whole history."""
    return F.when(complete, last_indexed - F.make_dt_interval(secs=F.lit(overlap_seconds)))


def refresh(selected: DataFrame, prior: DataFrame, outcome: DataFrame) -> DataFrame:
    """Repositories to be kept: prior fields where the fetch failed or left a field empty."""
    rows = selected.join(prior.select("repo", F.struct("*").alias("p")), "repo", "left").join(outcome.select("repo", F.struct("*").alias("o")), "repo", "left")
    ok = F.coalesce(F.col("o.ok"), F.lit(False))
    pick = lambda f: F.when(ok, F.coalesce(F.nullif(F.col(f"o.{f}"), F.lit("")), F.col(f"p.{f}"))).otherwise(F.col(f"p.{f}"))
    return rows.select("repo", pick("branch").alias("branch"), pick("pushed_at").alias("pushed_at"), F.when(ok, "fetched").otherwise("prior").alias("from"))
