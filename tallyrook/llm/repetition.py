"""Quality rules with suffix-array repetition.

Each document's words are one string over the alphabet of its words. Its suffix array comes from prefix doubling, many
documents at a time; common prefixes of neighbours give, for each position, the longest string that starts there and
occurs again (the deepest LCP interval that holds the suffix). The union of those of min_words words or more is the
covered part. A document is kept if it passes the base rules and neither the covered part nor the longest repeat
passes its limit.

Cases: a null or empty text has no words and fails the base rule of ten words; rows are judged one by one, so repeated
rows and doc_ids have a row each; other columns are ignored; an empty table gives no rows. A task holds one chunk of
texts, or its longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrook.llm import textarrays as ta

BASE_WINDOW = 5
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long"


def suffix_array(word_hash: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of all documents' word strings, sorted, by prefix doubling on those that still tie."""
    n = len(word_hash)
    # a document's number is mixed into its words, so that no prefix is shared across documents
    key = ta.mix(word_hash + ta.mix(doc.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    head = np.ones(n, bool)
    head[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    k, slots = 1, np.flatnonzero(~(head & np.append(head[1:], True)))
    last = np.searchsorted(doc, doc, "right")  # where each position's document ends
    while len(slots):
        at = order[slots]
        beyond = at + k < last[at]
        second = np.where(beyond, rank[np.where(beyond, at + k, 0)], -1)
        first = rank[at]
        sort = np.lexsort((second, first))
        at, first, second = at[sort], first[sort], second[sort]
        order[slots] = at
        head = np.ones(len(at), bool)
        head[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank[at] = slots[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        slots = slots[~(head & np.append(head[1:], True))]
        k *= 2
    return order


def longest_repeats(word_hash: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position, the words of the longest string that starts there and starts elsewhere in the document too."""
    n = len(word_hash)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    order = suffix_array(word_hash, doc)
    a, b = order[:-1], order[1:]
    last = np.searchsorted(doc, doc, "right")
    live = np.flatnonzero((doc[a] == doc[b]) & (word_hash[a] == word_hash[b]))
    a, b = a[live], b[live]
    up, down = ta.modular_powers(n + 1)
    total = ta.modular_sums(ta.modular_product(ta.modular_rest(word_hash), up[:n]))
    prime = np.uint64(ta.PRIME)

    def polynomial(x, size):
        return ta.modular_product(ta.modular_rest(total[x + size] + prime - total[x]), down[x])

    def equal(x, y, size):
        return polynomial(x, size) == polynomial(y, size)

    # gallop: double the common prefix while it holds, then halve the steps
    common, room = np.ones(len(a), np.int64), np.minimum(last[a] - a, last[b] - b)
    step, ahead, top = 1, np.arange(len(a)), 1
    while len(ahead):
        step *= 2
        ahead = ahead[room[ahead] >= step]
        ahead = ahead[equal(a[ahead], b[ahead], step)]
        common[ahead] = step
        top = step
    while top > 1:
        top //= 2
        more = np.flatnonzero(room >= common + top)
        more = more[equal(a[more] + common[more], b[more] + common[more], top)]
        common[more] += top
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


def _covered(repeat: np.ndarray, least: int) -> np.ndarray:
    """Whether each word lies in a repeated string of `least` words or more."""
    at = np.flatnonzero(repeat >= least)
    edge = np.zeros(len(repeat) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + repeat[at], -1)
    return np.cumsum(edge[:-1]) > 0


def _per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _dup_lines(c: ta.Chunk, ink: np.ndarray) -> np.ndarray:
    edge = np.zeros(len(c.data) + 1, bool)
    edge[c.offsets[:-1]] = True
    edge[1:] |= np.append(c.data, 0)[:-1] == 10
    start = np.flatnonzero(edge[:-1])
    end = np.append(start[1:], len(c.data))
    end = end - ((end > start) & (c.data[np.maximum(end - 1, 0)] == 10)) if len(start) else end
    worded = np.concatenate([[0], np.cumsum(ink)])
    some = worded[end] > worded[start]
    start, end = start[some], end[some]
    doc = np.searchsorted(c.offsets, start, "right") - 1
    key = ta.mix(ta.span_hashes(c.data, start, end, False) + ta.mix(doc.astype(np.uint64)))
    _, one = np.unique(key, return_index=True)
    return np.bincount(doc, minlength=len(c)) - np.bincount(doc[one], minlength=len(c))


def _measures(min_words: int):
    def run(batches):
        for batch in batches:
            for c in ta.chunks(batch.column("text")):
                w = ta.words(c)
                ink = np.zeros(len(c.data) + 1, np.int8)
                np.add.at(ink, w.start, 1)
                np.add.at(ink, w.end, -1)
                ink = np.cumsum(ink[:-1], dtype=np.int8) > 0
                repeat = longest_repeats(ta.span_hashes(c.data, w.start, w.end, False), w.doc)
                longest = np.zeros(len(c), np.int64)
                np.maximum.at(longest, w.doc, repeat)
                columns = (
                    w.counts(),
                    _per_doc(ink & (c.data & 0xC0 != 0x80), c.offsets),
                    _per_doc(_SYMBOL[c.data], c.offsets),
                    _dup_lines(c, ink),
                    _per_doc(_covered(repeat, BASE_WINDOW), w.first),
                    _per_doc(_covered(repeat, min_words), w.first),
                    longest,
                )
                names = [x.split()[0] for x in _COLUMNS.split(", ")]
                keep = [x for x in batch.schema.names if x != "text"]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(x).slice(c.first, len(c)) for x in keep] + [pa.array(x, pa.int64()) for x in columns], keep + names
                )

    return run


def quality_rules(documents: DataFrame, min_words: int = 10, max_covered_percent: int = 15, max_longest_words: int = 100) -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, the measures, base_failed and kept; a row for each input row.

    min_words: words of the shortest repeat that counts as covered; max_covered_percent: of the words; max_longest_words:
    of the longest repeat.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_measures(min_words), "doc_id long, " + _COLUMNS)
    return with_verdict(rows, max_covered_percent, max_longest_words)


def with_verdict(rows: DataFrame, max_covered_percent: int, max_longest_words: int) -> DataFrame:
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    fits = (100 * F.col("covered_words") <= max_covered_percent * F.col("n_words")) & (F.col("longest_repeat") <= max_longest_words)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & fits)


def keep_good(documents: DataFrame, min_words: int = 10, max_covered_percent: int = 15, max_longest_words: int = 100) -> DataFrame:
    """The rows of documents that quality_rules() keeps, with all their columns, whatever their names."""
    rest = F.struct(*[F.col(f"`{x}`") for x in documents.columns if x != "text"])
    rows = documents.select(rest.alias("rest"), "text")
    measure = _measures(min_words)

    def run(batches):
        for batch in batches:
            for out, at in _aligned(measure, batch):
                part = batch.slice(at, out.num_rows)
                yield pa.RecordBatch.from_arrays(part.columns + out.columns, part.schema.names + out.schema.names)

    measured = rows.mapInArrow(run, T.StructType([*rows.schema, *T.StructType.fromDDL(_COLUMNS)]))
    kept = with_verdict(measured, max_covered_percent, max_longest_words).where("kept")
    return kept.select(*[F.col("text" if x == "text" else f"rest.`{x}`").alias(x) for x in documents.columns])


def _aligned(inner, batch):
    """The measures of a batch, piece by piece, each with its first row."""
    at = 0
    for out in inner([batch.select(["text"])]):
        yield out, at
        at += out.num_rows


ORACLE = r"""
with w as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
lines as (select *, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as l from w),
base as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
                len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines
         from lines),
runs as (select doc_id, k, unnest(range(1, len(w) - k + 2)) as i, w from w, (values (5), (10), (101)) as ks(k)),
hashed as (select doc_id, k, i, md5(array_to_string(w[i : i + k - 1], ' ')) as run from runs),
many as (select doc_id, k, i from (select *, count(*) over (partition by doc_id, k, run) as c from hashed) where c > 1),
covered as (select doc_id, k, count(distinct pos)::bigint as n from (select doc_id, k, unnest(range(i, i + k)) as pos from many) group by all),
n as (select b.*, coalesce(c5.n, 0) as n_repeat_words, coalesce(c10.n, 0) as covered_words, c101.n is not null as long_repeat
      from base b left join covered c5 on b.doc_id = c5.doc_id and c5.k = 5 left join covered c10 on b.doc_id = c10.doc_id and c10.k = 10
      left join covered c101 on b.doc_id = c101.doc_id and c101.k = 101)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words,
       n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 100 * covered_words <= 15 * n_words and not long_repeat as kept
from n
"""
