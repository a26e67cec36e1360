"""Queries of activity evidence and corpus audits, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrook.functions.rules import THEMES
from tallyrook.operators import corpus as K
from tallyrook.operators import evidence as V
from tallyrook.operators import prose as P
from tallyrook.plans.derived import table
from tallyrook.session import spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_TOPICS = ("React UI kit", "data platform", "API docs", "an infrared lamp", "Security tests, test data", "mobile (frontend)", "nothing")
_VERBS = ("Merge branch", "Fix", "Add", "Bump", "v2", "Refactor", "Document", "Test")


def add(name: str, run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit for each line of an order: the repository is the part's, the date the shipping date."""
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    verb = F.element_at(F.array(*map(F.lit, _VERBS)), (k % len(_VERBS)).cast("int") + 1)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return spread(lines, "l_orderkey", "l_linenumber").select(
        (F.col("l_partkey") % 50).alias("repo"), F.sha2(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), 256).alias("sha"),
        F.concat_ws(" ", verb, "l_orderkey").alias("subject"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_suppkey").alias("s"), "l_linenumber", "l_orderkey",
    )


COMMITS_SQL = """with c as (select l_partkey % 50 as repo, sha256(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) as sha,
 ['Merge branch', 'Fix', 'Add', 'Bump', 'v2', 'Refactor', 'Document', 'Test'][((l_orderkey * 8 + l_linenumber) % 8)::int + 1] || ' ' || l_orderkey as subject, strftime(l_shipdate, '%Y-%m-%d') as "date",
 l_suppkey as s, l_linenumber, l_orderkey from lineitem),
p as (select o_custkey % 50 as repo, o_orderkey as number, o_orderstatus = 'F' as merged, o_orderstatus as state, strftime(o_orderdate, '%Y-%m-%d') as created from orders)"""


def pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("repo"), F.col("o_orderkey").alias("number"), (F.col("o_orderstatus") == "F").alias("merged"), F.col("o_orderstatus").alias("state"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"),
    )


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = commits(spark, sf_dir).dropDuplicates(["repo", "sha"])
    prior = rows.where("`date` < '1999-01-01'").select("repo", "sha", "subject", "date")
    fetched = rows.where("`date` >= '1998-06-01'").select("repo", "sha", F.when(F.col("l_orderkey") % 10 == 0, F.concat("subject", F.lit("!"))).otherwise(F.col("subject")).alias("subject"), "date")
    return V.upsert(prior, fetched, ["repo", "sha"], ["subject", "date"])


def _pulls_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pulls(spark, sf_dir)
    prior = rows.where("created < '1999-01-01'").select("repo", "number", F.lit("O").alias("state"), "created")
    return V.upsert(prior, rows.where("created >= '1998-06-01'").select("repo", "number", "state", "created"), ["repo", "number"], ["state", "created"])


add("e08_commit_upsert", lambda s, d: _upserted(s, d).groupBy("repo", "op").agg(F.count("*").alias("n"), F.min("subject").alias("least")), f"""{COMMITS_SQL},
u as (select repo, sha, any_value(subject) as subject, any_value("date") as "date", any_value(l_orderkey) as k from c group by all),
a as (select * from u where "date" < '1999-01-01'), b as (select repo, sha, case when k % 10 = 0 then subject || '!' else subject end as subject, "date" from u where "date" >= '1998-06-01'),
j as (select coalesce(a.repo, b.repo) as repo, coalesce(b.subject, a.subject) as subject, case when a.sha is null then 'added' when b.sha is null then 'kept' when a.subject = b.subject then 'unchanged' else 'updated' end as op
 from a full join b on a.repo = b.repo and a.sha = b.sha) select repo, op, count(*) as n, min(subject) as least from j group by all""")
add("e09_pull_upsert", lambda s, d: _pulls_upserted(s, d).groupBy("op").agg(F.count("*").alias("n")), f"""{COMMITS_SQL}
select case when created >= '1999-01-01' then 'added' when created < '1998-06-01' then 'kept' when state = 'O' then 'unchanged' else 'updated' end as op, count(*) as n from p group by 1""")
add("f16_refresh_delta", lambda s, d: V.delta_totals(_upserted(s, d), _pulls_upserted(s, d)), f"""{COMMITS_SQL},
u as (select repo, sha, any_value(subject) as subject, any_value("date") as "date", any_value(l_orderkey) as k from c group by all),
a as (select * from u where "date" < '1999-01-01'), b as (select repo, sha, case when k % 10 = 0 then subject || '!' else subject end as subject, "date" from u where "date" >= '1998-06-01'),
j as (select coalesce(a.repo, b.repo) as repo, coalesce(b.subject, a.subject) as subject, case when a.sha is null then 'added' when b.sha is null then 'kept' when a.subject = b.subject then 'unchanged' else 'updated' end as op
 from a full join b on a.repo = b.repo and a.sha = b.sha),
q as (select repo, case when created >= '1999-01-01' then 'added' when created < '1998-06-01' then 'kept' when state = 'O' then 'unchanged' else 'updated' end as op from p),
every as (select repo, op, 'c' as kind from j union all select repo, op, 'p' from q)
select repo, count(*) filter (where kind = 'c' and op = 'added') as commits_added, count(*) filter (where kind = 'c' and op = 'updated') as commits_updated,
 count(*) filter (where kind = 'p' and op = 'added') as pulls_added, count(*) filter (where kind = 'p' and op = 'updated') as pulls_updated from every group by rollup (repo)""")
_month = lambda c: F.substring(c, 1, 7).alias("month")
add("f13_activity_timeline", lambda s, d: V.timeline(commits(s, d).select("repo", _month("date")), pulls(s, d).select("repo", _month("created"))), f"""{COMMITS_SQL},
a as (select repo, "date"[:7] as month, 1 as c from c union all select repo, created[:7], 0 from p) select month, sum(c)::bigint as commits, sum(1 - c)::bigint as pulls, count(distinct repo) as repos from a group by 1""")
add("f14_repo_evidence", lambda s, d: V.repo_evidence(commits(s, d), pulls(s, d)), f"""{COMMITS_SQL}
select repo, coalesce(commits, 0) as commits, coalesce(pulls, 0) as pulls, coalesce(merged, 0) as merged, coalesce("open", 0) as "open" from (select repo, count(*) as commits from c group by 1)
 full join (select repo, count(*) as pulls, count(*) filter (where merged) as merged, count(*) filter (where not merged) as "open" from p group by 1) using (repo)""")
add("f12_snapshot_totals", lambda s, d: V.repo_evidence(commits(s, d), pulls(s, d)).agg(F.count("*").alias("repos"), F.sum("commits").alias("commits"), F.sum("pulls").alias("pulls")),
    f"{COMMITS_SQL} select (select count(*) from (select repo from c union select repo from p)) as repos, (select count(*) from c) as commits, (select count(*) from p) as pulls")
add("f11_language_bytes", lambda s, d: table(s, d, "part").groupBy(F.col("p_type").alias("language")).agg(F.sum("p_size").alias("bytes")), "select p_type as language, sum(p_size)::bigint as bytes from part group by 1")
add("g09_notable_commits", lambda s, d: V.notable(commits(s, d).dropDuplicates(["repo", "sha"])).select("repo", "nth", "subject", "date"), f"""{COMMITS_SQL},
u as (select repo, sha, any_value(subject) as subject, any_value("date") as "date" from c group by all),
r as (select *, row_number() over (partition by repo order by regexp_matches(subject, '^(merge|v\\d|version bump|bump)', 'i'), "date" desc, sha) as nth from u) select repo, nth, subject, "date" from r where nth <= 8""")
add("g12_fetch_cap", lambda s, d: V.capped(pulls(s, d), "repo", [F.desc("created"), F.desc("number")], 20).select("repo", "number", "truncated"), f"""{COMMITS_SQL},
r as (select *, row_number() over (partition by repo order by created desc, number desc) as nth, count(*) over (partition by repo) >= 20 as truncated from p) select repo, number, truncated from r where nth <= 20""")
add("g08_latest_commit", lambda s, d: commits(s, d).groupBy("repo").agg(F.max(F.struct("date", "sha")).alias("m")).select("repo", "m.date", "m.sha"),
    f"""{COMMITS_SQL} select repo, max("date") as "date", max(case when "date" = m then sha end) as sha from (select *, max("date") over (partition by repo) as m from c) group by repo""")


def _identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = commits(spark, sf_dir)
    return c.select("repo", "sha", F.when(F.col("s") % 7 == 0, F.lit("Ada-L")).alias("login"), F.when(F.col("s") % 5 == 0, F.lit("Ada Lovelace")).when(F.col("s") % 5 == 1, F.lit("Adam")).alias("author_name"), F.when(F.col("s") % 11 == 0, F.lit("ada")).alias("committer_name")).where("repo % 3 <> 0 or login is null")


add("c13_own_commits", lambda s, d: V.own_commits(_identities(s, d), ["ada-l"], ["Ada"]).groupBy("repo").agg(F.count("*").alias("n")), f"""{COMMITS_SQL},
i as (select repo, s % 7 = 0 as l, s % 5 = 0 or s % 11 = 0 as n from c where repo % 3 <> 0 or s % 7 <> 0), m as (select repo, max(l) as any_login from i group by 1)
select repo, count(*) as n from i join m using (repo) where l or (n and not any_login) group by 1""")
add("c17_repo_has_evidence", lambda s, d: table(s, d, "nation").select(F.col("n_nationkey").alias("repo")).join(commits(s, d).where("`date` > '2000-06-01'").select(F.col("repo").cast("int").alias("repo")), "repo", "left_semi"),
    f"""{COMMITS_SQL} select n_nationkey as repo from nation where n_nationkey in (select repo from c where "date" > '2000-06-01')""")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("repo"), (F.col("o_custkey") % 200).cast("string")).alias("name"), F.to_date("o_orderdate").alias("pushed_at"), F.col("o_orderpriority").alias("language"), F.col("o_orderkey").alias("k"))
    return V.merge_candidates([o.where(f"k % 3 = {i}").select("name", "pushed_at", "language", F.lit(n).alias("source")) for i, n in enumerate(("owned", "member", "public"))])


add("e10_candidate_merge", lambda s, d: _candidates(s, d).withColumns({"sources": F.array_join("sources", ","), "pushed_at": F.col("pushed_at").cast("string")}), """with o as (select 'repo' || (o_custkey % 200) as name, o_orderdate::date as pushed_at, o_orderpriority as language, o_orderkey % 3 as r from orders)
select name, max(pushed_at)::varchar as pushed_at, arg_min(language, (r, language)) as language, array_to_string(list_transform(list_sort(list(distinct r)), lambda x: ['owned', 'member', 'public'][x::int + 1]), ',') as sources from o group by name""")
add("c16_activity_cutoff", lambda s, d: V.active_since(_candidates(s, d), F.lit("2003-05-01").cast("date"), 2).select("name"), "select 'repo' || (o_custkey % 200) as name from orders group by 1 having max(o_orderdate)::date >= date '2001-05-01'")

# corpus audits
_docs = lambda s, d: spread(table(s, d, "documents").select("doc_id", "text"), "doc_id")
#: What stands before each document's text, by doc_id: headings and roles, evidence tags and comments (fixed values).
_HEADS = ("# Name\n## Work\nintro line\n### Role A\n- did x\n", "## Skills\n**Stack:** a, b\n> a note\n## Work\n- y\n", "*2001 to 2003*\n", "### Alone\n- z\n## Last\n")
_TAGGED = ("Did this `verified-from-github` and that. ", "<!-- doc:meta a\nb -->Rest ", "Plain. ", "One `needs-your-confirmation` two `Verified-From-GitHub`<!--doc-meta: x-->")


def _planted(spark: SparkSession, sf_dir: str, heads) -> DataFrame:
    head = F.element_at(F.array(*map(F.lit, heads)), (F.col("doc_id") % len(heads)).cast("int") + 1)
    return _docs(spark, sf_dir).select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))


def _planted_sql(heads) -> str:
    listed = ", ".join("'" + h.replace("\n", "' || chr(10) || '") + "'" for h in heads)
    return f"select doc_id, [{listed}][(doc_id % {len(heads)})::int + 1] || coalesce(text, '') as text from documents"


add("k01_structure", lambda s, d: K.structure(_planted(s, d, _HEADS)).groupBy("doc_id", "kind", "section", "role").agg(F.count("*").alias("n"), F.min("line_no").alias("first")), f"""with d as ({_planted_sql(_HEADS)}),
l0 as (select doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) as a from d), l1 as (select doc_id, unnest(a) as line, generate_subscripts(a, 1) as line_no from l0), l as (select *, trim(line) as t from l1),
s as (select *, last_value(case when starts_with(t, '## ') then t[4:] end ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as section from l),
r as (select *, last_value(case when starts_with(t, '### ') then t[5:] end ignore nulls) over (partition by doc_id, section order by line_no rows between unbounded preceding and current row) as role from s),
k as (select *, case when starts_with(t, '- ') then 'bullet' when regexp_matches(t, '^\\*\\*stack:?\\*\\*', 'i') then 'stack' when starts_with(t, '> ') then 'note' when regexp_matches(t, '^\\*[^*]+\\*$') then 'meta' else 'paragraph' end as kind
 from r where t <> '' and not regexp_matches(t, '^#{{1,6}}\\s') and not regexp_matches(t, '^---+\\s*$')) select doc_id, kind, section, role, count(*) as n, min(line_no)::int as "first" from k group by all""")
add("k02_diagnostics", lambda s, d: K.diagnostics(_docs(s, d)).groupBy("code").agg(F.count("*").alias("n")), """with l as (select doc_id, unnest(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10))) as line from documents),
k as (select doc_id, case when trim(line) = '' or regexp_matches(trim(line), '^---+\\s*$') then null when starts_with(trim(line), '# ') then 'heading' when regexp_matches(trim(line), '^#{4,}\\s') then 'unsupported_heading'
 when regexp_matches(trim(line), '^#{1,3}\\s') then null when regexp_matches(trim(line), '^\\|.+\\|') or regexp_matches(trim(line), '^:?-{3,}:?\\s*(?:\\||$)') then 'unsupported_table'
 when regexp_matches(line, '!\\[[^\\]]*\\]\\([^)]+\\)') then 'unsupported_image' when regexp_matches(line, '^\\s+- ') then 'unsupported_nested_list' when regexp_matches(line, '<[a-zA-Z][^>]*>') then 'unsupported_raw_html' end as code from l)
select code, count(*) as n from k where code <> 'heading' group by 1 union all select 'missing_name_heading', count(*) from (select doc_id from k group by 1 having not bool_or(coalesce(code = 'heading', false)))""")
_HEADERS = ("# Name\nme@example.com\n---\nlost line\n", "\n# Name\n## Work\n---\nkept\n", "# Name\n---\n\n---\nlost\n## Work\nkept\n", "No name\n---\nnot judged\n", "# Name\nno rule\n")
add("k02_orphan_content", lambda s, d: K.orphans(_planted(s, d, _HEADERS)).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("line_no").alias("first")), f"""with d as ({_planted_sql(_HEADERS)}),
l0 as (select doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) as a from d), l as (select doc_id, unnest(a) as line, generate_subscripts(a, 1)::int as line_no from l0),
h as (select doc_id, min(line_no) filter (where regexp_matches(line, '^\\s*---+\\s*$')) as hr, min(line_no) filter (where starts_with(line, '## ')) as sec, arg_min(line, line_no) filter (where regexp_matches(line, '\\S')) as name from l group by 1)
select doc_id, count(*) as n, min(line_no) as "first" from l join h using (doc_id) where starts_with(name, '# ') and line_no > hr and line_no < coalesce(sec, line_no + 1) and regexp_matches(line, '\\S') and not regexp_matches(line, '^\\s*---+\\s*$') group by 1""")
_tag, _meta = "`(?:verified-from-github|needs-your-confirmation)`", "<!--\\s*(?:doc:meta|doc-meta:)(?:.|\\n)*?-->"
add("k03_evidence_tags", lambda s, d: K.remove_tags(_planted(s, d, _TAGGED)).select("doc_id", F.md5("clean").alias("clean"), "n_tags", "n_meta", "leaked"), f"""with d as ({_planted_sql(_TAGGED)}),
c as (select *, trim(regexp_replace(regexp_replace(text, '(?i){_meta}', '', 'g'), '(?i) ?{_tag} ?', ' ', 'g')) as clean from d)
select doc_id, md5(clean) as clean, len(regexp_extract_all(text, '(?i){_tag}')) as n_tags, len(regexp_extract_all(text, '(?i){_meta}')) as n_meta,
 regexp_matches(clean, '(?i)verified-from-github|needs-your-confirmation|doc:meta|doc-meta:') as leaked from c""")
_TOLD = (
    "I delve into robust systems -- it is not a bug; it is a feature.", "It's not the price. It's not the speed. In today's landscape, it's worth noting the game-changer.",
    "The headline isn't the speed. The real story is not only the tapestry, not a phase.", "Great question! Certainly, let me know if you need anything else.",
    "This serves as a testament to showcasing, leveraging and harnesses. We could potentially ship red, green, and blue.", "I ran it. He saw it. She had it. We got it. They won it.", "",
)


def _told_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, each with some prose of the kind behind it."""
    said = F.element_at(F.array(*map(F.lit, _TOLD)), (F.col("doc_id") % len(_TOLD)).cast("int") + 1)
    return _docs(spark, sf_dir).select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n"), said).alias("text"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# words stand between two spaces each, so phrases are counted by what taking them out leaves
_PHRASE_SQL = ", ".join(
    f"list_sum(list_transform([{', '.join(_quoted(' ' + '  '.join(p.split()) + ' ') for p in phrases)}], lambda p: (length(w) - length(replace(w, p, ''))) // length(p)))::int as {check}"
    for check, phrases in P.rules().items()
)
_STYLE_SQL = f"""with t as (select doc_id, coalesce(text, '') || chr(10) || chr(10) || [{', '.join(map(_quoted, _TOLD))}][(doc_id % {len(_TOLD)})::int + 1] as text from documents),
w as (select *, ' ' || replace(array_to_string(regexp_extract_all(lower(text), {_quoted(P.WORD)}), '  '), '’', chr(39)) || ' ' as w,
 list_transform(list_filter(regexp_split_to_array(text, '[.!?]+\\s+'), lambda x: trim(x) <> ''), lambda x: len(regexp_split_to_array(trim(x), '\\s+'))) as s,
 list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: trim(x) <> '') as p from t),
c as (select doc_id, len(regexp_extract_all(text, '—|--')) as dashes, {' + '.join(f"len(regexp_extract_all(text, {_quoted(f)}))" for f in P.FRAMES)} as contrasts, {_PHRASE_SQL},
 len(list_filter(p, lambda x: regexp_matches(x, {_quoted(P.TRIAD)}))) as triads, len(p) as n,
 len(list_filter(range(1, len(s) - 3), lambda i: list_max(s[i:i + 4]) - list_min(s[i:i + 4]) <= 2)) as uniform_runs from w)"""
add("k05_style_counts", lambda s, d: P.audit(_told_docs(s, d)).drop("no_dashes", "no_contrasts", "vocabulary_clean", "rhythm_varied", "pass", "polished"), f"{_STYLE_SQL} select * exclude (n) from c")
add("k05_style_audit", lambda s, d: P.audit(_told_docs(s, d)).select("doc_id", "no_dashes", "no_contrasts", "vocabulary_clean", "rhythm_varied", "pass", "polished"), f"""{_STYLE_SQL}
select doc_id, dashes = 0 as no_dashes, contrasts = 0 as no_contrasts, vocabulary = 0 as vocabulary_clean, uniform_runs = 0 as rhythm_varied, dashes = 0 and contrasts = 0 and vocabulary = 0 and uniform_runs = 0 and chat = 0 as pass,
 {' and '.join(f"{c} = 0" for c in P.rules())} and not (n > 1 and triads = n) as polished from c""")
add("k06_letter_limits", lambda s, d: K.letter_limits(_docs(s, d)).select("doc_id", "paragraphs", "words"),
    "select doc_id, len(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: trim(p) <> '')) as paragraphs, len(list_filter(regexp_split_to_array(text, '[ \\t\\n]+'), lambda w: w <> '')) as words from documents")
add("k07_secrets", lambda s, d: K.secrets(_docs(s, d)), """select doc_id, label from (select doc_id, unnest([case when regexp_matches(text, 'ghp_[A-Za-z0-9]{20,}') then 'code host token' end,
 case when regexp_matches(text, 'github_pat_[A-Za-z0-9_]{20,}') then 'code host fine-grained token' end, case when regexp_matches(text, '\\bsk-[A-Za-z0-9]{20,}\\b') then 'api key' end,
 case when regexp_matches(text, '-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----') then 'private key header' end]) as label from documents) where label is not null""")
_path = lambda: F.element_at(F.array(*map(F.lit, ("profile/me.md", "profile/ONBOARDING.md", ".env", "src/.env.example", "keys/a.pem", "jobs/x.md", "jobs/.gitkeep", "config/job-search.json", "src/a.ts"))), (F.col("doc_id") % 9).cast("int") + 1)
add("k08_path_policy", lambda s, d: _docs(s, d).select("doc_id", K.path_policy(_path()).alias("rule")),
    "select doc_id, ['personal profile file', null, 'secrets or env file', null, 'secrets or env file', 'application artefact', null, 'personal config', null][(doc_id % 9)::int + 1] as rule from documents")
add("k09_redaction", lambda s, d: K.redacted(_docs(s, d)).select("doc_id", "had", "left", F.length("redacted").alias("n")), None)
add("k10_inline_spans", lambda s, d: K.inline_spans(_docs(s, d)).select("doc_id", "strong", "code", "links", "hrefs"),
    "select doc_id, len(regexp_extract_all(text, '\\*\\*[^*\\n]+\\*\\*')) as strong, len(regexp_extract_all(text, '`[^`\\n]+`')) as code, len(regexp_extract_all(text, '\\[[^\\]\\n]+\\]\\(([^)\\n]+)\\)')) as links, array_to_string(regexp_extract_all(text, '\\[[^\\]\\n]+\\]\\(([^)\\n]+)\\)', 1), ' ') as hrefs from documents")


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms are part names' words; evidence is the commits."""
    e = commits(spark, sf_dir).select(F.col("sha").alias("id"), F.col("subject").alias("text"), (F.col("s") % 2 == 0).alias("merged"), F.col("date").alias("at"))
    terms = table(spark, sf_dir, "nation").select(F.col("n_name").alias("term"), F.element_at(F.array(*[F.lit(v.lower().split()[0]) for v in _VERBS]), (F.col("n_nationkey") % 8) + 1).alias("word"))
    return K.evidence_search(terms, e)[0].select("term", "id", "nth")


add("k04_evidence_search", _search, f"""{COMMITS_SQL},
t as (select n_name as term, ['merge', 'fix', 'add', 'bump', 'v2', 'refactor', 'document', 'test'][n_nationkey % 8 + 1] as word from nation),
f as (select t.term, c.sha as id, max(c.s % 2 = 0) as merged, max(c."date") as tm from c join t on lower(split_part(c.subject, ' ', 1)) = t.word group by all),
r as (select term, id, row_number() over (partition by term order by merged desc, tm desc, id) as nth from f) select * from r where nth <= 5""")


def _owned_pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("number")
    login = F.when(k % 7 == 0, "Ada-L").when(k % 7 == 1, "ada-l").when(k % 7 == 2, "ada-lovelace").when(k % 7 == 3, F.lit(None)).otherwise("bob")
    return V.own_pulls(pulls(spark, sf_dir).withColumn("login", login), ["ADA-l"])


add("c14_own_pulls", lambda s, d: _owned_pulls(s, d).groupBy("repo", "state").agg(F.count("*").alias("n")), f"{COMMITS_SQL} select repo, state, count(*) as n from p where number % 7 < 2 group by all")
add("f15_theme_set", lambda s, d: V.theme_set(table(s, d, "part").select(F.concat_ws(" ", "p_name", F.element_at(F.array(*map(F.lit, _TOPICS)), (F.col("p_partkey") % len(_TOPICS)).cast("int") + 1)).alias("text"))), f"""
with t as (select lower(p_name || ' ' || [{", ".join(f"'{x}'" for x in _TOPICS)}][(p_partkey % {len(_TOPICS)})::int + 1]) as text from part),
w as (select unnest([{", ".join(f"'{x}'" for x in THEMES)}]) as theme)
select theme, count(*) as n from t join w on regexp_matches(text, '\\b' || theme || '\\b') group by 1""")
