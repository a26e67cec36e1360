"""Mixing sources to target weights by capped water-filling, with Spark expressions only.

All sources share `percent` per cent of all words by weight, none beyond `max_epochs` times its own words. What a
source can't take is dealt again by weight until none is above its cap: with sources in order of cap/weight, those up
to some place take their caps and the rest share what is left, so one running sum finds the level. Each source's
target over its size is a number of repetitions: whole ones for all documents, and the fractional one for the
documents whose seeded hash falls into the buckets that make it up; in the last bucket each document gives the
missing fraction of its words.

Only sums by source and by (source, bucket) are shuffled, pre-aggregated; a source is a group of 2**BUCKET_BITS rows
at most. They boil down to one row a source (whole repetitions, the bucket that is cut, its share), written as a table.
If that has BROADCAST_ROWS rows or fewer, it is broadcast and no document moves; beyond, documents meet it by a join on
the source, whose hot keys adaptive execution splits.

Cases: a null text has size 0; a null source is a source of its own, last; a null doc_id hashes as the empty string;
rows that share a doc_id are in one bucket; a source without words has target 0; an empty table gives no rows. Other
columns are ignored by mix_plan() and kept by mixed(), but for input columns named size, source_size, target or taken: the
mix's own stand in their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrook.session import materialize

BUCKET_BITS, BROADCAST_ROWS = 12, 20_000
WEIGHTS = (3, 1, 2)


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def bucket_of(doc_id: str, seed: int) -> Column:
    """A seeded hash of the doc_id, as a bucket number: the same in any run and engine."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, BUCKET_BITS // 4), 16, 10).cast("int")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, max_epochs: int = 2) -> DataFrame:
    """(source, source_size) -> source, source_size, target."""
    one = Window.partitionBy(F.lit(0))  # one row a source
    order = one.orderBy(F.col("source").isNull(), F.col("source"))
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights)).cast("int") + 1))
    rows = rows.withColumn("cap", F.col("source_size") * max_epochs)
    # by cap / weight, compared without dividing
    rows = rows.withColumn("fill", F.col("cap").cast("double") / F.col("weight"))
    upto = one.orderBy("fill", F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "caps_below": F.coalesce(F.sum("cap").over(upto), F.lit(0)),
        "weight_left": F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(upto), F.lit(0)),
        "total": F.sum("source_size").over(one),
    })
    # the level if this source is the first that isn't full
    level = (F.col("total") * percent / F.lit(100.0) - F.col("caps_below")) / F.col("weight_left")
    rows = rows.withColumn("level", F.when(level <= F.col("fill"), level))
    # from the first such source on, taking more as full only lowers the level
    rows = rows.withColumn("level", F.max("level").over(one))
    full = F.col("level").isNull() | (F.col("fill") <= F.col("level"))
    return rows.select("source", "source_size", F.when(full, F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def source_deal(rows: DataFrame, weights: tuple[int, ...], percent: int, max_epochs: int) -> DataFrame:
    """(source, bucket, size) -> source, source_size, target, whole, cut (the bucket that is cut), share (of its words); a
    table of one row a source, broadcast if it is small."""
    by_bucket = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    goal = targets(by_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), weights, percent, max_epochs)
    of = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    deal = by_bucket.withColumn("before", F.coalesce(F.sum("words").over(of), F.lit(0)))
    deal = deal.join(goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    deal = deal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    extra = F.col("target") - F.col("whole") * F.col("source_size") - F.col("before")
    share = F.when(F.col("words") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), extra / F.col("words")))).otherwise(F.lit(0.0))
    deal = deal.withColumn("share", share)
    # shares fall with the bucket: 1 below the one that is cut, 0 above it
    last = F.max(F.when(F.col("share") > 0, F.struct("bucket", "share")))
    deal = deal.groupBy("source").agg(*[F.first(x).alias(x) for x in ("source_size", "target", "whole")], last.alias("last"))
    deal, _ = materialize(deal.select(F.col("source").alias("of"), "source_size", "target", "whole", F.coalesce("last.bucket", F.lit(-1)).alias("cut"), F.coalesce("last.share", F.lit(0.0)).alias("share")), "op7-deal")
    return F.broadcast(deal) if deal.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else deal


def _taken(rows: DataFrame, deal: DataFrame) -> DataFrame:
    """rows with source, size and bucket, and source_size, target and taken."""
    share = F.when(F.col("bucket") < F.col("cut"), 1.0).when(F.col("bucket") == F.col("cut"), F.col("share")).otherwise(0.0)
    out = rows.join(deal, F.col("source").eqNullSafe(F.col("of")))
    return out.withColumn("taken", (F.col("size") * F.col("whole") + F.floor(F.col("size") * share + 0.5)).cast("long"))


def _sized(documents: DataFrame, seed: int, *more: Column) -> DataFrame:
    rows = documents.select(*more, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of("text").alias("size"))
    return rows.withColumn("bucket", bucket_of("doc_id", seed))


def mix_plan(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """documents (doc_id, text, source, ...) -> doc_id, size, source_size, target, taken; a row for each input row.

    The texts are read once: sizes are written before they are summed.
    """
    rows, _ = materialize(_sized(documents, seed), "op7-sizes")
    return _taken(rows, source_deal(rows, weights, percent, max_epochs)).select("doc_id", "size", "source_size", "target", "taken")


def mixed(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """All columns of the documents that the mix takes words of, and size, source_size, target and taken.

    A document whose taken is its size, or a multiple, is repeated whole so often; else the rest is that many of its words.
    """
    deal = source_deal(_sized(documents, seed), weights, percent, max_epochs)
    out = _taken(_sized(documents, seed, F.struct("*").alias("row")), deal).where("taken > 0")
    own = [F.col(f"row.`{x}`").alias(x) for x in documents.columns if x not in ("size", "source_size", "target", "taken")]
    return out.select(*own, "size", "source_size", "target", "taken")


ORACLE = """
with docs as (
  select doc_id, cast(source as varchar) as source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size,
         cast('0x' || substr(md5('7:' || coalesce(cast(doc_id as varchar), '')), 1, 3) as integer) as bucket
  from documents),
bb as (select source, bucket, cast(sum(size) as bigint) as words from docs group by all),
s as (select source, cast(sum(words) as bigint) as source_size from bb group by source),
w as (select *, [3, 1, 2][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int] as weight, source_size * 2 as cap from s),
f as (select *, cap::double / weight as fill from w),
p as (select *, coalesce(sum(cap) over up, 0)::bigint as caps_below,
             (sum(weight) over () - coalesce(sum(weight) over up, 0))::bigint as weight_left, (sum(source_size) over ())::bigint as total
      from f window up as (order by fill, source is null, source rows between unbounded preceding and 1 preceding)),
l as (select *, ((total * 150)::double / 100.0::double - caps_below) / weight_left as lev from p),
m as (select *, max(case when lev <= fill then lev end) over () as level from l),
goal as (select source, source_size, case when level is null or fill <= level then cap::double else weight * level end as target from m),
deal as (select bb.source, bb.bucket, g.source_size, g.target, bb.words,
                case when g.source_size > 0 then floor(g.target / g.source_size)::bigint else 0 end as whole,
                coalesce(sum(bb.words) over (partition by bb.source order by bb.bucket rows between unbounded preceding and 1 preceding), 0)::bigint as before
         from bb join goal g on bb.source is not distinct from g.source),
sh as (select *, case when words > 0 then greatest(0.0::double, least(1.0::double, (target - whole * source_size - before) / words)) else 0.0::double end as share from deal)
select d.doc_id, d.size, sh.source_size, sh.target, (d.size * sh.whole + floor(d.size * sh.share + 0.5::double))::bigint as taken
from docs d join sh on d.source is not distinct from sh.source and d.bucket = sh.bucket
"""
