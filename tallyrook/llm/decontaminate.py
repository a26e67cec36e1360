"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A short item inside a long document has almost no Jaccard similarity with it, so documents are indexed by windows:
items are partitioned by their number of shingles, and for the class of at most m shingles a document is cut into
windows of 2m at steps of m, one of which holds any passage of m. Then containment num/den of an item of more than m/2
shingles means a similarity of 0.19 at least, and HASHES minima with one row a band miss it less than twice in a
million. Window minima come from minima of blocks of STEP shingles, so all classes share one pass of hashing. Items of
fewer than four shingles are looked up by their shingles. Each candidate pair of document and item is then counted
exactly, on all shingles of the document.

Items are a stated query set: they go to every task in blocks of about BLOCK_BYTES of text, one pass over the
documents a block, and nothing is shuffled. The driver holds GROUP blocks at a time: what a group has found, or left over,
is written before the next group's items are read.

Cases: an item or text without words has no shingles and no matches; with fewer words than a shingle, its sequence is
its only one; null ids are kept as null; each input row is judged by itself; an empty table of items matches nothing;
other columns are ignored by containment_search() and kept by drop_contaminated(). A task holds one chunk of texts, or
its longest text.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrook.llm import textarrays as ta
from tallyrook.session import materialize

HASHES, STEP, TINY, BLOCK_BYTES, GROUP = 64, 8, 3, 4 << 20, 8
_FACTORS = np.random.default_rng(77).integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Items:
    """A block of items: distinct shingles of each, the size class of each, and signatures by class."""

    def __init__(self, ids: list, sets: list[np.ndarray]):
        some = [i for i, s in enumerate(sets) if len(s)]
        self.ids, self.sets = [ids[i] for i in some], [sets[i] for i in some]
        size = np.array([len(s) for s in self.sets], np.int64)
        self.level = np.maximum(0, np.ceil(np.log2(np.maximum(size, 1) / STEP))).astype(np.int64)
        self.level[size <= TINY] = -1
        tiny = np.flatnonzero(self.level < 0)
        self.tiny_items = np.repeat(tiny, size[tiny])
        self.tiny = np.concatenate([self.sets[i] for i in tiny]) if len(tiny) else np.zeros(0, np.uint64)
        order = np.argsort(self.tiny, kind="stable")
        self.tiny, self.tiny_items = self.tiny[order], self.tiny_items[order]
        self.classes = {}
        for level in sorted({*self.level.tolist()} - {-1}):
            own = np.flatnonzero(self.level == level)
            sign = np.stack([_minima(self.sets[i], np.zeros(1, np.int64))[:, 0] for i in own], 1)
            order = np.argsort(sign, axis=1, kind="stable")
            self.classes[level] = (np.take_along_axis(sign, order, 1), own[order])


def _minima(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """HASHES rows of minima of the runs of value that begin at first."""
    out = np.empty((HASHES, len(first)), np.uint32)
    for h in range(HASHES):
        out[h] = np.minimum.reduceat((value * _FACTORS[h] >> np.uint64(32)).astype(np.uint32), first)
    return out


def _lookup(names: np.ndarray, owners: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in value, owner) of all equal entries of the sorted names."""
    a, b = np.searchsorted(names, value, "left"), np.searchsorted(names, value, "right")
    hit = np.flatnonzero(b > a)
    return np.repeat(hit, (b - a)[hit]), owners[ta.segments(a[hit], (b - a)[hit])]


def matches(c: ta.Chunk, items: Items, shingle: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, shared shingles) of the pairs that reach the containment."""
    none = np.zeros(0, np.int64)
    w = ta.words(c)
    doc, value = ta.shingle_rows(w, ta.span_hashes(c.data, w.start, w.end, True), shingle)
    if not len(doc) or not items.ids:
        return none, none, none
    order = np.argsort(doc, kind="stable")  # short texts' shingles come last
    doc, value = doc[order], value[order]
    first = np.searchsorted(doc, np.arange(len(c) + 1))
    pairs = []
    at, item = _lookup(items.tiny, items.tiny_items, value) if len(items.tiny) else (none, none)
    pairs.append(doc[at] * len(items.ids) + item)
    if items.classes:
        blocks = -(-np.diff(first) // STEP)
        start = ta.segments(np.zeros(len(c), np.int64), blocks) * STEP + np.repeat(first[:-1], blocks)
        least = _minima(value, start)
        for level in range(max(items.classes) + 1):
            if level in items.classes:
                sign, owners = items.classes[level]
                base = np.concatenate([[0], np.cumsum(blocks)])
                whose = np.repeat(np.arange(len(c)), blocks)
                inner = np.flatnonzero(whose[1:] == whose[:-1])
                for h in range(HASHES):
                    window = least[h].copy()
                    window[inner] = np.minimum(window[inner], least[h][inner + 1])
                    at, item = _lookup(sign[h], owners[h], window)
                    pairs.append(whose[at] * len(items.ids) + item)
                del base
            # blocks of the next class: two of this one's
            begin = np.concatenate([[0], np.cumsum(blocks)])
            half = -(-blocks // 2)
            heads = ta.segments(np.zeros(len(c), np.int64), half) * 2 + np.repeat(begin[:-1], half)
            if len(heads):
                least = np.minimum.reduceat(least, heads, axis=1)
            blocks = half
    pair = np.unique(np.concatenate(pairs))
    docs, found = pair // len(items.ids), pair % len(items.ids)
    shared = np.zeros(len(pair), np.int64)
    keep = np.zeros(len(pair), bool)
    for d in np.unique(docs):
        own = np.unique(value[first[d] : first[d + 1]])
        for k in np.flatnonzero(docs == d):
            s = items.sets[found[k]]
            place = np.minimum(np.searchsorted(own, s), len(own) - 1)
            shared[k] = np.count_nonzero(own[place] == s)
            keep[k] = den * shared[k] >= num * len(s)
    return docs[keep], found[keep], shared[keep]


def item_blocks(benchmark: DataFrame, shingle: int):
    """The items, block by block, on the driver: each block has about BLOCK_BYTES of text, or one longer item."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    blocks = max(1, -(-ta.total_bytes(rows) // BLOCK_BYTES))
    for b in range(blocks):
        got = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        got.sort(key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))
        sets = []
        for c in ta.chunks(pa.array([r["text"] for r in got], pa.string())):
            _, value, first = ta.shingle_sets(c, shingle)
            sets += [value[x:y] for x, y in zip(first[:-1], first[1:], strict=True)]
        yield Items([r["item_id"] for r in got], sets)


def _groups(benchmark: DataFrame, shingle: int):
    """The blocks of items, GROUP at a time."""
    blocks = item_blocks(benchmark, shingle)
    while group := list(itertools.islice(blocks, GROUP)):
        yield group


def containment_search(documents: DataFrame, benchmark: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """documents (doc_id, text, ...), benchmark (item_id, text, ...) -> doc_id, item_id, n_shingles (of the item), n_shared."""

    def run(items):
        def inner(batches):
            for batch in batches:
                for c in ta.chunks(batch.column("text")):
                    doc, item, shared = matches(c, items, shingle, num, den)
                    size = [len(items.sets[i]) for i in item]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(c.first, len(c)).take(pa.array(doc)), pa.array([items.ids[i] for i in item], pa.int64()), pa.array(size, pa.int64()), pa.array(shared)],
                        ["doc_id", "item_id", "n_shingles", "n_shared"],
                    )

        return inner

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for group in _groups(benchmark, shingle):
        part = functools.reduce(DataFrame.union, [rows.mapInArrow(run(items), "doc_id long, item_id long, n_shingles long, n_shared long") for items in group])
        if len(group) == GROUP:
            part, _ = materialize(part, "op9-found")
        found = part if found is None else found.union(part)
    return found


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of documents, with all columns, whatever their names, that hold no item to num/den of its shingles."""
    rows = documents.select(F.struct(*[F.col(f"`{x}`") for x in documents.columns if x != "text"]).alias("rest"), "text")
    schema = T.StructType(list(rows.schema))

    def run(items):
        def inner(batches):
            for batch in batches:
                for c in ta.chunks(batch.column("text")):
                    doc, _, _ = matches(c, items, shingle, num, den)
                    clean = np.ones(len(c), bool)
                    clean[doc] = False
                    yield batch.slice(c.first, len(c)).filter(pa.array(clean))

        return inner

    for group in _groups(benchmark, shingle):
        for items in group:
            rows = rows.mapInArrow(run(items), schema)
        if len(group) == GROUP:
            rows, _ = materialize(rows, "op9-left")
    return rows.select(*[F.col("text" if x == "text" else f"rest.`{x}`").alias(x) for x in documents.columns])


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from benchmark),
ds as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, case when len(w) > 0 then 1 else 0 end) + 1)) as i from d)),
bs as (select distinct item_id, array_to_string(w[i : i + 4], ' ') as s from (select item_id, w, unnest(range(1, greatest(len(w) - 4, case when len(w) > 0 then 1 else 0 end) + 1)) as i from b)),
n as (select item_id, count(*) as n_shingles from bs group by item_id),
m as (select doc_id, item_id, count(*) as n_shared from ds join bs using (s) group by all)
select doc_id, item_id, n_shingles, n_shared from m join n using (item_id) where 100 * n_shared >= 80 * n_shingles
"""
