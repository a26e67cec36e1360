"""Engine inputs derived from the driver's tables: once as DataFrames, once as DuckDB common table expressions.

The tables hold no listings, so titles, places and texts are picked from lists by key, in both engines alike; keys,
firms, dates and the sharing of URLs come from the tables, so every input grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrook.session import materialize, spread

TITLES = (
    "Senior React Engineer", "Frontend Engineer", "Backend Engineer", "Software Engineer", "Node.js Developer", "Staff Platform Engineer",
    "Junior Web Developer", "Engineering Manager, Frontend", "Full-Stack Engineer", "Product Engineer", "Lead API Engineer",
    "Python Engineer", "React Native Engineer &amp; Mentor", "NestJS Backend Engineer", "Sales Director", "Mid-level UI Engineer",
    "Support Engineer", "Design Engineer", "Vue.js Web Developer", "UX Engineer, fullstack", "Golang Backend Engineer", "Data Analyst",
    "Next.js front end Engineer",
)
LOCATIONS = (
    "Worldwide", "Remote - EMEA", "Remote", "US only", "Hybrid - Berlin", "Lagos, Nigeria", "Home based - Worldwide",
    "Home based - EMEA", "Europe", "Remote (UK)", "", "San Francisco", "Anywhere in the world", "Poland only", "Remote Africa",
    "Remote, Europe, the Middle East and Africa", "Accra",
)
DESCRIPTIONS = (
    "<p>We use React and Next.js.</p>", "Node.js services with Express &amp; NestJS", "Must be based in the EU", "Open to all candidates",
    "Work from anywhere", "You lead a team; right to work in the UK", "Hybrid role", "Not Africa", "remote-first firm",
    "No location restriction", "A plain text about data", "Angular and Vue.js", "&lt;b&gt;Remote&lt;/b&gt; role for intermediate people",
)
BLOCKLIST = ("customer#000000007", "Customer#000000011", "CUSTOMER#000000100", "Unknown Firm")
REFERENCE_DATE = "2001-08-15 00:00:00"
PROFILE = "front"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values)).cast("int") + 1)


def pick_sql(values: tuple[str, ...], key: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][(({key}) % {len(values)})::int + 1]"


def raw_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw listing for each order, from seven sources and three adapters; URLs are shared by neighbouring keys."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    k = F.col("o_orderkey")
    company = F.when(k % 10 == 0, F.upper("c_name")).when(k % 10 == 1, F.concat(F.lit(" "), "c_name", F.lit("  &amp; Co "))).otherwise(F.col("c_name"))
    third, fourth = F.floor(k / 3).cast("string"), F.floor(k / 4).cast("string")
    url = (
        F.when(k % 6 == 0, F.concat(F.lit("https://jobs.example.com/Role/"), third, F.lit("?utm_source=feed&b=2&a=1")))
        .when(k % 6 == 1, F.concat(F.lit("http://Jobs.Example.com:80/Role/"), third, F.lit("/?a=1&b=2#apply")))
        .when(k % 6 == 2, F.concat(F.lit("https://board.example.org/view?id="), fourth, F.lit("&ref=x")))
        .when(k % 6 == 3, F.concat(F.lit("https://user:pw@board.example.org:443/view/?id="), fourth))
        .when(k % 6 == 4, F.concat(F.lit("Not a URL "), (k % 100).cast("string")))
        .otherwise(F.concat(F.lit("https://10.0.0.5/role/"), k.cast("string")))
    )
    # written once dealt: else filters on what is derived go below the exchange, into the few tasks of the files' row groups
    o, _ = materialize(spread(o.select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey", narrow=True), "orders")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("posting_id"),
        F.concat(F.lit("src"), (k % 7).cast("string")).alias("source_id"),
        F.concat(F.lit("board"), (k % 3).cast("string")).alias("adapter"),
        F.when(k % 5 != 0, F.concat(F.lit("Job "), F.floor(k / 2).cast("string"))).alias("source_job_id"),
        company.alias("company"), pick(TITLES, k).alias("title"), url.alias("url"), pick(LOCATIONS, F.floor(k / 2)).alias("location"),
        pick(DESCRIPTIONS, F.floor(k / 3)).alias("description"), F.when(k % 13 != 0, F.col("o_orderdate")).alias("posted_at"),
    )


RAW_SQL = f"""
raw as (
  select o_orderkey as posting_id, 'src' || (o_orderkey % 7) as source_id, 'board' || (o_orderkey % 3) as adapter,
    case when o_orderkey % 5 <> 0 then 'Job ' || (o_orderkey // 2) end as source_job_id,
    case when o_orderkey % 10 = 0 then upper(c_name) when o_orderkey % 10 = 1 then ' ' || c_name || '  &amp; Co ' else c_name end as company,
    {pick_sql(TITLES, "o_orderkey")} as title,
    case o_orderkey % 6 when 0 then 'https://jobs.example.com/Role/' || (o_orderkey // 3) || '?utm_source=feed&b=2&a=1'
      when 1 then 'http://Jobs.Example.com:80/Role/' || (o_orderkey // 3) || '/?a=1&b=2#apply'
      when 2 then 'https://board.example.org/view?id=' || (o_orderkey // 4) || '&ref=x'
      when 3 then 'https://user:pw@board.example.org:443/view/?id=' || (o_orderkey // 4)
      when 4 then 'Not a URL ' || (o_orderkey % 100) else 'https://10.0.0.5/role/' || o_orderkey end as url,
    {pick_sql(LOCATIONS, "o_orderkey // 2")} as location, {pick_sql(DESCRIPTIONS, "o_orderkey // 3")} as description,
    case when o_orderkey % 13 <> 0 then o_orderdate end as posted_at
  from orders join customer on o_custkey = c_custkey)"""
