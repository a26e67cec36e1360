"""Filter interaction audit over a sparse document-term matrix.

Five filters judge each document; in which order they run decides what each seems to remove. The audit counts, for every
order and step, what a filter removes, what it would have removed (removed before), what it alone removes, and its share
of all orders (Shapley).

The matrix is built in two levels. A task encodes its words by a dictionary of its shard (about SHARD bytes of text, or
one longer text) and writes the shard as a few rows, PIECE values of each array a row: documents, row pointers, columns,
counts and the shard's dictionary. So what a task holds is one shard, however many its input has.
Then the shards' dictionaries, a word a shard and no more, are dealt by a hash of the word into buckets; a word's global
code is its rank in its bucket, interleaved over the buckets: unique, the same in any run, without a word counted by one
task for all. The codes go back to their shards, whose columns are renamed by them. Row sums and nonzero counts of the
matrix decide A and B; the flags of C and D come from the same bytes, E from the least doc_id of each text (by SHA-256).

Filters (failure): A under 50 words; B 100 * distinct words < 65 * words; C 100 * [A-Z] > 5 * code points; D holds any of
`#$%&*|`; E identical to the text of a smaller doc_id. Words are maximal `[^\\x20\\x09-\\x0D]+`, case-sensitive.

Cases: a null text is empty (no words: fails A alone, and E behind another empty or null text); rows are judged one by
one, so repeated rows all count, and rows of one doc_id aren't smaller than each other; a null doc_id is smaller than
none and none is smaller than it, and it has no label; of repeated labels one with the value 1 is enough; a null source
and an empty one are the part ''; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyrook.llm import textarrays as ta
from tallyrook.session import materialize

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 50, 65, 5
#: Bytes of text of a shard, and words of shards' dictionaries in a bucket.
SHARD, BUCKET = 1 << 24, 250_000
#: Values of each array in a row of a shard, bytes of a row group of such rows, and what a document counts at least.
PIECE, ROW_GROUP, DOCUMENT = 1 << 16, 1 << 24, 64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(x) for x in "#$%&*|"]] = True

_DOC = "doc_id array<long>, part array<string>, text_sha array<binary>, fails array<int>"
_CSR = f"shard long, piece int, first int, n_vocabulary long, {_DOC}, indptr array<long>, indices array<int>, data array<int>"
_MATRIX = f"shard long, {_DOC}, indptr array<long>, indices array<long>, data array<int>"
_COUNTED = "doc_id long, part string, text_sha binary, fails int, n_words long, n_distinct long"


def _per_document(c: ta.Chunk, marked: np.ndarray) -> np.ndarray:
    """How many marked bytes each document of a chunk has."""
    total = np.zeros(len(c.data) + 1, np.int64)
    np.cumsum(marked, out=total[1:])
    return total[c.offsets[1:]] - total[c.offsets[:-1]]


class _Shard:
    """Documents gathered until they make a shard."""

    def __init__(self) -> None:
        self.rows, self.words, self.lengths, self.fails, self.bytes = [], [], [], [], 0

    def add(self, c: ta.Chunk, rows: pa.RecordBatch) -> None:
        w = ta.words(c)
        size = w.end - w.start
        offsets = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=offsets[1:])
        letters = c.data[~ta._SPACE[c.data]]
        self.words.append(pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]))
        self.lengths.append(w.counts())
        upper = _per_document(c, (c.data >= 65) & (c.data <= 90))
        points = _per_document(c, (c.data & 0xC0) != 0x80)
        self.fails.append((100 * upper > UPPER_PERCENT * points) * 4 + (_per_document(c, _SYMBOL[c.data]) > 0) * 8)
        self.rows.append(rows)
        self.bytes += max(len(c.data), DOCUMENT * len(c))

    def pieces(self, number: int, piece: int) -> Iterator[pa.RecordBatch]:
        """The shard, its columns coded by its own dictionary, which comes last: rows of at most `piece` values of each array."""
        words, self.words = pa.chunked_array(self.words, pa.large_binary()), []
        coded = words.dictionary_encode()
        del words
        vocabulary = coded.chunk(0).dictionary if coded.num_chunks else pa.array([], pa.large_binary())
        codes = np.concatenate([np.asarray(x.indices) for x in coded.chunks] or [np.zeros(0, np.int32)])
        del coded
        length = np.concatenate(self.lengths)
        # (document, code) in order; equal neighbours are one entry
        key = np.repeat(np.arange(len(length)) << 32, length)
        key |= codes
        del codes
        key.sort()
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(new, len(key))).astype(np.int32)
        entry = key[new]
        del key, new
        indptr = np.searchsorted(entry, np.arange(len(length) + 1) << 32)
        rows = pa.Table.from_batches(self.rows)
        values = [
            *(rows.column(x).combine_chunks() for x in ("doc_id", "part", "text_sha")), pa.array(np.concatenate(self.fails), pa.int32()),
            pa.array(indptr, pa.int64()), pa.array((entry & 0xFFFFFFFF).astype(np.int32)), pa.array(count), vocabulary,
        ]
        names = ["doc_id", "part", "text_sha", "fails", "indptr", "indices", "data", "vocabulary"]
        for k, first in enumerate(range(0, max(map(len, values)), piece)):
            some = [x.slice(first, piece) for x in values]
            some[-1] = some[-1].cast(pa.binary())
            head = [pa.array([number], pa.int64()), pa.array([k], pa.int32()), pa.array([first], pa.int32()), pa.array([len(some[-1])], pa.int64())]
            yield pa.RecordBatch.from_arrays([*head, *map(_one_list, some)], ["shard", "piece", "first", "n_vocabulary", *names])


def _one_list(values) -> pa.ListArray:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _shards(size: int, piece: int):
    def run(batches):
        shard, number = _Shard(), TaskContext.get().partitionId() << 32
        for batch in batches:
            rows = batch.select(["doc_id", "part", "text_sha"])
            for c in ta.chunks(batch.column("text"), min(size, 1 << 22)):
                shard.add(c, rows.slice(c.first, len(c)))
                if shard.bytes >= size:
                    yield from shard.pieces(number, piece)
                    shard, number = _Shard(), number + 1
                    ta.release()
        if shard.rows:
            yield from shard.pieces(number, piece)

    return run


def coded_shards(documents: DataFrame, size: int = SHARD, piece: int = PIECE) -> DataFrame:
    """documents (doc_id, text, source, ...) -> the matrix in shards, written: columns are coded by `vocabulary`, the shard's own.

    A shard is as many rows as its longest array has pieces; each of its arrays is what its rows have of it, by piece.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_sha"), text.alias("text"))
    return materialize(rows.mapInArrow(_shards(size, piece), f"{_CSR}, vocabulary array<binary>"), "op11-shards", ROW_GROUP)[0]


def dictionary(shards: DataFrame) -> DataFrame:
    """(shard, local, word, code): the global code of each word of each shard's dictionary."""
    total = shards.agg(F.sum("n_vocabulary")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET))
    words = shards.select("shard", "first", F.posexplode("vocabulary").alias("at", "word")).select("shard", (F.col("first") + F.col("at")).alias("local"), "word")
    words = words.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy("word"))
    return words.select("shard", "local", "word", ((rank - 1) * F.lit(buckets) + F.col("bucket")).cast("long").alias("code"))


def _whole(shard: pa.Table, column: str) -> pa.Array:
    """An array of a shard: what its rows have of it, by piece."""
    rows, lists = np.argsort(shard.column("piece").to_numpy()), shard.column(column).combine_chunks()
    return pa.concat_arrays([lists[int(k)].values for k in rows])


def _encoded(shard: pa.Table, codes: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pointers, columns by global code, and counts of a shard."""
    name = np.full(len(codes), -1)
    name[codes.column("local").to_numpy()] = codes.column("code").to_numpy()
    if (name < 0).any():
        raise ValueError("a word without a code")
    indptr, indices, data = (_whole(shard, x).to_numpy() for x in ("indptr", "indices", "data"))
    return indptr, name[indices], data


def _matrix(shard: pa.Table, codes: pa.Table) -> pa.Table:
    indptr, indices, data = _encoded(shard, codes)
    kept = ["doc_id", "part", "text_sha", "fails"]
    values = [*(_whole(shard, x) for x in kept), pa.array(indptr), pa.array(indices), pa.array(data)]
    return pa.table([shard.column("shard").slice(0, 1), *map(_one_list, values)], ["shard", *kept, "indptr", "indices", "data"])


def _counted(shard: pa.Table, codes: pa.Table) -> pa.Table:
    indptr, indices, data = _encoded(shard, codes)
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data, out=total[1:])
    sums, filled = total[indptr[1:]] - total[indptr[:-1]], np.diff(indptr)
    flat = [_whole(shard, x) for x in ("doc_id", "part", "text_sha")]
    fails = _whole(shard, "fails").to_numpy() + (sums < MIN_WORDS) + (100 * filled < DISTINCT_PERCENT * sums) * 2
    return pa.table([*flat, pa.array(fails.astype(np.int32)), pa.array(sums), pa.array(filled)], ["doc_id", "part", "text_sha", "fails", "n_words", "n_distinct"])


def _with_codes(shards: DataFrame, run, schema: str) -> DataFrame:
    codes = dictionary(shards).select("shard", "local", "code")
    return shards.drop("vocabulary", "n_vocabulary", "first").groupBy("shard").cogroup(codes.groupBy("shard")).applyInArrow(run, schema)


def document_term_matrix(documents: DataFrame, size: int = SHARD) -> DataFrame:
    """CSR shards (doc_id, part, text_sha, fails as arrays of the documents; indptr, indices by global code, data)."""
    return _with_codes(coded_shards(documents, size), _matrix, _MATRIX)


def failures(documents: DataFrame, size: int = SHARD) -> DataFrame:
    """doc_id, part, n_words, n_distinct, fails: bits 1, 2, 4, 8, 16 for A to E; a row for each input row."""
    rows, _ = materialize(_with_codes(coded_shards(documents, size), _counted, _COUNTED), "op11-counts")
    first = rows.groupBy(F.col("text_sha").alias("sha")).agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    out = rows.join(first, F.col("text_sha") == F.col("sha"), "left")
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return out.select("doc_id", "part", "n_words", "n_distinct", (F.col("fails") + F.when(later, 16).otherwise(0)).cast("int").alias("fails"))


def _orders() -> tuple[list[tuple[str, int]], np.ndarray]:
    """(order, step) of the report's rows and, for each, what every cell (fails, good, toxic) adds to its seven counts."""
    cell = np.arange(128)
    fails, good, toxic = cell & 31, cell >> 5 & 1, cell >> 6 & 1
    names, counts, of = [], [], []
    for order in permutations(range(5)):
        before = 0
        for step, f in enumerate(order):
            hit, gone = fails >> f & 1 == 1, fails & before > 0
            removed = hit & ~gone
            before |= 1 << f
            names.append(("".join(FILTERS[x] for x in order), step + 1))
            counts.append([fails & before == 0, removed, hit & gone, fails == 1 << f, removed & (good == 1), removed & (toxic == 1)])
            of.append(f)
    table = np.array(counts, np.int64)
    shapley = np.stack([table[np.array(of) == f, 1].sum(0) for f in range(5)])
    return names, np.concatenate([table, shapley[of][:, None]], 1)


_MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _report():
    names, table = _orders()

    def run(batches):
        for batch in batches:
            for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                count = np.zeros(128, np.int64)
                for x in cells:
                    count[x["cell"]] = x["n"]
                got = table @ count
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(names)), pa.array([x[0] for x in names]), pa.array([x[1] for x in names], pa.int32()), *(pa.array(got[:, k]) for k in range(7))],
                    ["part", "filter_order", "step", *_MEASURES],
                )

    return run


def filter_audit(documents: DataFrame, labels: DataFrame, size: int = SHARD) -> DataFrame:
    """documents (doc_id, text, source), labels (doc_id, quality, toxic) -> part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley; 600 rows a part.

    What meets by part is pre-aggregated: 128 rows (failures by good by toxic) a part at most.
    """
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("of"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    rows = failures(documents, size)
    rows = rows.join(marks.hint("merge"), F.col("doc_id") == F.col("of"), "left")  # small compressed files of many labels would be broadcast
    cell = F.col("fails") + 32 * F.coalesce("good", F.lit(0)) + 64 * F.coalesce("bad", F.lit(0))
    cells = rows.groupBy("part", cell.alias("cell")).agg(F.count("*").alias("n"))
    cells = cells.groupBy("part").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))
    return cells.mapInArrow(_report(), "part string, filter_order string, step int, " + ", ".join(f"{x} long" for x in _MEASURES))


ORACLE = r"""
with w as (select doc_id, coalesce(cast(source as varchar), '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
f as (select doc_id, part, len(words) < 50 as a, 100 * len(list_distinct(words)) < 65 * len(words) as b,
             100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) as c, regexp_matches(text, '[#$%&*|]') as d,
             coalesce(doc_id > min(doc_id) over (partition by text), false) as e from w),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as bad from labels group by doc_id),
g as (select part, [case when a then 1 else 0 end, case when b then 1 else 0 end, case when c then 1 else 0 end, case when d then 1 else 0 end, case when e then 1 else 0 end] as fails,
             coalesce(good, 0) as good, coalesce(bad, 0) as bad, count(*) as n from f left join l using (doc_id) group by all),
five as (select unnest([1, 2, 3, 4, 5]) as x),
orders as (select [p.x, q.x, r.x, s.x, t.x] as o from five p, five q, five r, five s, five t where len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps as (select o, list_aggregate(list_transform(o, lambda y: 'ABCDE'[y]), 'string_agg', '') as filter_order, x as step, o[x] as f, o[1:x - 1] as before from orders, five),
m as (select part, filter_order, step, f,
             sum(case when fails[f] = 0 and list_sum(list_transform(before, lambda y: fails[y])) is not distinct from case when step > 1 then 0 end then n else 0 end)::bigint as kept,
             sum(case when fails[f] = 1 and coalesce(list_sum(list_transform(before, lambda y: fails[y])), 0) = 0 then n else 0 end)::bigint as removed,
             sum(case when fails[f] = 1 and coalesce(list_sum(list_transform(before, lambda y: fails[y])), 0) > 0 then n else 0 end)::bigint as redundant,
             sum(case when fails[f] = 1 and list_sum(fails) = 1 then n else 0 end)::bigint as unique_fails,
             sum(case when fails[f] = 1 and coalesce(list_sum(list_transform(before, lambda y: fails[y])), 0) = 0 and good = 1 then n else 0 end)::bigint as good_lost,
             sum(case when fails[f] = 1 and coalesce(list_sum(list_transform(before, lambda y: fails[y])), 0) = 0 and bad = 1 then n else 0 end)::bigint as toxic_lost
      from g, steps group by all)
select part, filter_order, step::integer as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, f))::bigint as shapley from m
"""
