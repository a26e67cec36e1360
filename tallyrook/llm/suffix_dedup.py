"""Suffix-array deduplication of byte strings that start in more than one document.

Each byte covered by a string of LENGTH bytes that also starts in a document with a smaller doc_id is removed; strings
are judged on the input and never cross documents.

1. Anchors. Of the ANCHOR-byte strings in each window of LENGTH bytes, the one with the least hash is the window's
   anchor, so equal windows have equal anchors. One pass over the texts deals anchors into buckets by hash; those in two
   or more documents are marked. Windows without a marked anchor can't repeat and go no further.
2. Segments. Runs of windows with one marked anchor, at most LENGTH + ANCHOR bytes long, go to the anchor's bucket.
3. Each bucket's segments are a collection of strings whose Burrows-Wheeler transform is built column by column from the
   right (Bauer, Cox, Rosone 2013): each round inserts one symbol of every string and the row that it opens, and brings
   the common prefixes of neighbouring rows up to date from those of the round before. Neighbours whose common prefix
   reaches LENGTH are one string, whose least doc_id keeps its bytes. Columns are taken in turn from a file of the task's,
   and each round's transform is written to files that the next round reads from front to back.
4. Spans meet their documents again, by doc_id and text.

A whole collection can't be built in one such run: rounds would follow the longest text, and every round would rewrite
the files of the transform. Anchors make it many collections of bounded rounds.

Hot groups: exact copies of a document with a smaller doc_id are removed whole and give no anchors; within a chunk of
texts an anchor is sent once, and equal segments are settled by the chunk, so only their least document's is sent. An
anchor that comes from more than HOT chunks is hot: its windows are dealt by their own hash instead of the anchor's, so
a bucket gets a window once a chunk at most, however many documents share the anchor. Tasks know the hot anchors by a bitmap
of SIEVE bits.

Cases: a null text is empty; a null doc_id counts as larger than any; rows with equal doc_id don't count against each
other, each is judged by its own text; a text under LENGTH bytes keeps all; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrook.llm import textarrays as ta
from tallyrook.session import materialize

LENGTH, ANCHOR, HOT, SIEVE = 50, 25, 4096, 1 << 23
_STRINGS = 4096  # of a collection, or those of one anchor
_NEVER = np.uint64(2**64 - 1)
_END = 255  # no byte of UTF-8
_BLOBS = "bucket int, a binary, b binary, c binary, d binary, e binary, f binary"


def window_anchors(c: ta.Chunk, length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """For each position where a window of a document starts: whether, and its anchor (the least hash of its k-byte strings)."""
    n = len(c.data)
    if n < length:
        return np.zeros(n, bool), np.zeros(n, np.uint64)
    width, least, reach = length - k + 1, ta.window_hashes(c.data, k), 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    rest = width - reach
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    left = np.repeat(c.offsets[1:], np.diff(c.offsets)) - np.arange(n)
    return left >= length, np.concatenate([least, np.zeros(n - len(least), np.uint64)])


def _keys(least: np.ndarray, bits: int) -> np.ndarray:
    """Anchors as they are dealt: least hashes are small numbers, mixed again, they fall evenly into buckets."""
    return ta.mix(least) >> np.uint64(32 - bits) << np.uint64(32 - bits)


def _same_text(c: ta.Chunk, order: np.ndarray, th: np.ndarray) -> np.ndarray:
    """For documents in an order by text hash: whether the text is that of the document before, byte for byte."""
    same = np.append(False, th[order][1:] == th[order][:-1])
    for i in np.flatnonzero(same):
        a, b = (c.data[c.offsets[d] : c.offsets[d + 1]] for d in (order[i - 1], order[i]))
        same[i] = np.array_equal(a, b)
    return same


def _runs(c: ta.Chunk, whole: np.ndarray, least: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(first window, windows) of runs of windows of one document with one anchor, cut at `longest` windows."""
    at = np.flatnonzero(whole)
    if not len(at):
        return at, at
    head = np.ones(len(at), bool)
    head[1:] = (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]])
    edge = np.zeros(len(c.data) + 1, bool)
    edge[c.offsets] = True
    head |= edge[at]
    first = np.flatnonzero(head)
    size = np.diff(np.append(first, len(at)))
    parts = -(-size // longest)
    start = ta.segments(np.zeros(len(first), np.int64), parts) * longest
    each = np.repeat(np.arange(len(first)), parts)
    return at[first[each]] + start, np.minimum(size[each] - start, longest)


def _batch(found: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("bucket", pa.int32()), *[(x, pa.binary()) for x in "abcdef"]])
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)


def _row(bucket: int, *arrays) -> tuple:
    return (bucket, *(x if isinstance(x, bytes) else x.tobytes() for x in arrays), *[b""] * (6 - len(arrays)))


def _anchors(bits: int):
    """Texts -> rows for each bucket: (32-bit anchors, whose, documents); or, negative bucket, what the chunk has marked itself.

    Documents are (doc_id, text hash), twice as many numbers, and `whose` their places among them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, _ = ta.ids_of(batch.column("__id"))
            names, _ = ta.ids_of(batch.column("__th"))
            for c in ta.chunks(batch.column("text")):
                own, th = ids[c.first : c.first + len(c)], names[c.first : c.first + len(c)]
                both = np.stack([own, th], 1)
                whole, least = window_anchors(c)
                at, _ = _runs(c, whole, least, 2**40)
                doc = np.searchsorted(c.offsets, at, "right") - 1
                # of equal texts in the chunk, only the least doc_id's counts
                order = np.lexsort((own, th))
                lead = np.zeros(len(c), np.int64)
                lead[order] = own[order][np.maximum.accumulate(np.where(_same_text(c, order, th), 0, np.arange(len(c))))]
                keep = (lead == own)[doc]
                place = np.empty(len(c), np.int64)  # documents by doc_id
                place[np.lexsort((th, own))] = np.arange(len(c))
                back = np.argsort(place)
                who, key = place[doc[keep]], _keys(least[at[keep]], bits)
                order = np.lexsort((who, key))
                who, key = who[order], key[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (who[1:] != who[:-1])
                who, key = who[new], key[new]
                head = np.ones(len(key), bool)
                head[1:] = key[1:] != key[:-1]
                size = np.diff(np.append(np.flatnonzero(head), len(key)))
                many = np.repeat(size > 1, size)
                found = []
                if many.any():
                    found.append(_row(-1 - int(key[many][0] >> np.uint64(64 - bits)), key[many], who[many].astype(np.uint16), both[back]))
                who, key = who[head], key[head]
                bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
                cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
                for b in np.flatnonzero(np.diff(cuts)):
                    part = slice(cuts[b], cuts[b + 1])
                    order = np.argsort(who[part], kind="stable")
                    some, index = np.unique(who[part][order], return_inverse=True)
                    found.append(_row(int(b), (key[part] >> np.uint64(32 - bits)).astype(np.uint32)[order], index.astype(np.uint16), both[back[some]]))
                if found:
                    yield _batch(found)

    return run


def _by_document(who: np.ndarray, key: np.ndarray) -> pa.Table:
    """(doc_id, text hash) and marks -> a row for each document."""
    order = np.lexsort((who[:, 1], who[:, 0]))
    who, key = who[order], key[order]
    first = np.flatnonzero(np.append(True, (who[1:] != who[:-1]).any(1))) if len(who) else np.zeros(0, np.int64)
    cuts = np.append(first, len(who))
    return pa.table({
        "__id": who[first, 0].copy(), "__th": who[first, 1].copy(), "__marks": pa.array([key[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
        "__hot": np.zeros(len(first), bool),
    })


def _sieve_place(key: np.ndarray) -> np.ndarray:
    return (ta.mix(key) & np.uint64(SIEVE - 1)).astype(np.int64)


def _hot_sieve(marks: DataFrame) -> np.ndarray:
    """A bitmap of SIEVE bits of the hot anchors' hashes, the same for all tasks: who falls on one by chance is treated alike."""
    words = marks.where("__hot").groupBy(F.expr("shiftright(__id, 6)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(__id & 63 as int))")).alias("bits"))
    out = np.zeros(SIEVE // 64, np.int64)
    for part in words.toArrow().to_batches():
        out[part.column("w").to_numpy()] = part.column("bits").to_numpy()
    return out.view(np.uint8)


def _mark(bits: int):
    """One bucket of anchors -> the anchors of each document that another has too; and a row (__hot) for each hot one."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        kind = np.uint64 if bucket < 0 else np.uint32
        rows = [(np.frombuffer(a, kind), np.frombuffer(b, np.uint16), np.frombuffer(c, np.int64).reshape(-1, 2)) for a, b, c in zip(*(table[x].to_pylist() for x in "abc"), strict=True)]
        key, who = np.concatenate([x[0] for x in rows]), np.concatenate([x[2][x[1]] for x in rows])
        if bucket < 0:
            return _by_document(who, key)
        order = np.lexsort((who[:, 0], key))
        key, who = key[order], who[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        # an anchor comes once a chunk; two chunks may both name the least row of one document
        lowest, highest = np.minimum.reduceat(who[:, 0], first), np.maximum.reduceat(who[:, 0], first)
        many = np.repeat((lowest != highest), size)
        full = np.uint64(bucket) << np.uint64(64 - bits) | key[many].astype(np.uint64) << np.uint64(32 - bits)
        hot = _sieve_place(np.uint64(bucket) << np.uint64(64 - bits) | key[first[size > HOT]].astype(np.uint64) << np.uint64(32 - bits))
        return pa.concat_tables([_by_document(who[many], full), pa.table({"__id": hot, "__th": hot, "__marks": pa.nulls(len(hot), pa.binary()), "__hot": np.ones(len(hot), bool)})])

    return run


def _segments(bits: int, hot: np.ndarray):
    """Texts with marks -> rows for each bucket: (documents, text hashes, starts, lengths, bytes, anchors); negative bucket: spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids, _ = ta.ids_of(batch.column("__id"))
            names = batch.column("__th").to_numpy(zero_copy_only=False)
            marks = batch.column("__marks")
            for c in ta.chunks(batch.column("text"), 3 * ta.CHUNK):
                span = slice(c.first, c.first + len(c))
                own, th = ids[span], names[span]
                marked = [np.frombuffer(b"".join(x), np.uint64) for x in marks.slice(c.first, len(c)).to_pylist()]
                whole, least = window_anchors(c)
                at, windows = _runs(c, whole, least, LENGTH - ANCHOR + 1)
                doc = np.searchsorted(c.offsets, at, "right") - 1
                key = _keys(least[at], bits)
                cuts = np.searchsorted(doc, np.arange(len(c) + 1))
                keep = np.zeros(len(at), bool)
                for i, m in enumerate(marked):
                    if len(m):
                        keep[cuts[i] : cuts[i + 1]] = np.isin(key[cuts[i] : cuts[i + 1]], m)
                at, windows, doc, key = at[keep], windows[keep], doc[keep], key[keep]
                if not len(at):
                    continue
                place = _sieve_place(key)
                split = hot[place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0
                if split.any():
                    # the windows of a hot anchor part, and each is dealt by its own bytes
                    one, each = at[split], windows[split]
                    apart = ta.segments(one, each)
                    at, doc = np.concatenate([at[~split], apart]), np.concatenate([doc[~split], np.repeat(doc[split], each)])
                    key = np.concatenate([key[~split], ta.mix(ta.rolling_hashes(c.data, apart, apart + LENGTH)) >> np.uint64(32 - bits) << np.uint64(32 - bits)])
                    windows = np.concatenate([windows[~split], np.ones(len(apart), np.int64)])
                size = windows + LENGTH - 1
                name = ta.rolling_hashes(c.data, at, at + size)
                order = np.lexsort((own[doc], name))
                new = np.ones(len(order), bool)
                new[1:] = name[order[1:]] != name[order[:-1]]
                lead = np.empty(len(order), np.int64)
                lead[order] = order[new][np.cumsum(new) - 1]
                later = own[doc] > own[doc[lead]]
                check = np.flatnonzero(later)
                same = size[check] == size[lead[check]]
                check = check[same]
                bytes_a, bytes_b = (c.data[ta.segments(x[check], size[check])] for x in (at, at[lead]))
                if len(check):
                    equal = np.add.reduceat(bytes_a != bytes_b, np.concatenate([[0], np.cumsum(size[check])[:-1]])) == 0
                    check = check[equal]
                start = at - c.offsets[doc]
                found = []
                if len(check):
                    found.append(_row(-1 - int(key[check[0]] >> np.uint64(64 - bits)), own[doc[check]], th[doc[check]], start[check], start[check] + size[check]))
                send = np.ones(len(at), bool)
                send[check] = False
                at, size, doc, key, start = at[send], size[send], doc[send], key[send], start[send]
                bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
                for b in np.flatnonzero(np.diff(cuts)):
                    x = order[cuts[b] : cuts[b + 1]]
                    text = c.data[ta.segments(at[x], size[x])].tobytes()
                    found.append(_row(int(b), pack.compress(own[doc[x]].tobytes()), pack.compress(th[doc[x]].tobytes()), pack.compress(start[x].astype(np.int64).tobytes()), size[x].astype(np.uint8), pack.compress(text), (key[x] >> np.uint64(32 - bits)).astype(np.uint32)))
                if found:
                    yield _batch(found)

    return run


def _between(prefix: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The least common prefix among rows before + 1 .. at."""
    ends = np.cumsum(at - before)
    # the rows' numbers as a running sum: by one within a stretch, a leap to the next
    step = np.ones(ends[-1], np.int64)
    step[0] = before[0] + 1
    step[ends[:-1]] = before[1:] + 1 - at[:-1]
    return np.minimum.reduceat(prefix.take(np.cumsum(step, out=step), mode="clip"), np.concatenate([[0], ends[:-1]]))


class _Files:
    """Sequential files of a task: the columns of a collection, and the transform's rows, rewritten each round.

    Small arrays stay with the operating system's cache; they go when they are closed, and with a task that dies.
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.columns, self.rounds = tempfile.TemporaryFile(), tempfile.TemporaryFile()
        for j in range(1, int(size.max(initial=0)) + 1):
            live = np.flatnonzero(size >= j)
            self.columns.write(data[start[live] + size[live] - j].tobytes())
        self.columns.seek(0)

    def column(self, n: int) -> np.ndarray:
        return np.frombuffer(self.columns.read(n), np.uint8)

    def put(self, rows: np.ndarray) -> None:
        self.rounds.seek(0)
        self.rounds.write(memoryview(rows).cast("B"))
        self.shape = len(rows), rows.dtype

    def take(self) -> np.ndarray:
        n, kind = self.shape
        self.rounds.seek(0)
        return np.frombuffer(self.rounds.read(n * kind.itemsize), kind)

    def close(self) -> None:
        self.columns.close()
        self.rounds.close()


def column_wise_rows(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, suffix length, common prefix with the row before) of all non-empty suffixes of the strings
    data[start : start + size], sorted.

    Row r of the transform holds the symbol before suffix r, or _END where that isn't known yet or there is none. Round
    j gives the rows of the suffixes of j - 1 symbols their symbol; sorted by symbol, stably, the rows of the transform
    are the suffixes of the next column, so the rows that this round opens fall between those that are there. Two
    neighbours of the next column that begin with one symbol have one symbol more in common than any two rows between the
    rows that they come from; only neighbours of opened rows change.
    """
    m = len(start)
    files = _Files(data, start, size)
    # a row of the transform is its symbol and, in the upper byte, its common prefix; those of the empty suffixes stay in front
    # and have nothing in common
    files.put(np.full(m, _END, np.uint16))
    row = np.arange(m)  # of each string's newest suffix
    opened: list[tuple[np.ndarray, np.ndarray]] = []  # by each round: rows, of which strings
    for j in range(1, int(size.max(initial=0)) + 1):
        rows = files.take()
        symbol, prefix = rows.astype(np.uint8), (rows >> np.uint16(8)).astype(np.uint8)
        live = np.flatnonzero(size >= j)
        new = row[live]
        symbol[new] = files.column(len(live))
        opens, whose = np.zeros(len(symbol), bool), np.empty(len(symbol), np.int32)
        opens[new], whose[new] = True, live
        order = np.argsort(symbol, kind="stable")[: len(symbol) - np.count_nonzero(symbol == _END)]
        fresh = opens.take(order, mode="clip")
        at = np.flatnonzero(fresh)
        who = whose[order[at]]
        fresh[1:] |= fresh[:-1].copy()
        change = np.flatnonzero(fresh)
        inner = change[change > 0]
        inner = inner[symbol[order[inner]] == symbol[order[inner - 1]]]
        at += m
        old = np.ones(len(symbol) + len(at), bool)
        old[at] = False
        grown = np.full(len(old), _END, np.uint16)
        grown[old] = symbol | (rows & np.uint16(0xFF00))
        grown[m + change] &= np.uint16(0xFF)
        if len(inner):
            grown[m + inner] |= (_between(prefix, order[inner - 1], order[inner]) + np.uint8(1)).astype(np.uint16) << np.uint16(8)
        files.put(grown)
        row[who] = at
        opened.append((at, who))
    prefix = (files.take() >> np.uint16(8)).astype(np.uint8)
    files.close()
    # where the rows that a round opened have come to lie: rounds are taken back, the last one first
    string, length, place = np.empty(len(prefix), np.int32), np.zeros(len(prefix), np.uint8), np.arange(len(prefix), dtype=np.int32)
    for j in range(len(opened), 0, -1):
        at, who = opened[j - 1]
        final = place[at]
        string[final], length[final] = who, j
        stay = np.ones(len(place), bool)
        stay[at] = False
        place = place[stay]
    return string[m:], length[m:], prefix[m:]


def repeated_windows(data: np.ndarray, start: np.ndarray, size: np.ndarray, who: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each string: the string, and the least `who` of the strings that have an equal window."""
    string, suffix, prefix = column_wise_rows(data, start, size)
    # shorter suffixes have no window; those between two windows can't share `length` symbols with both and part none
    new = prefix < length
    group = np.cumsum(new)
    full = suffix >= length
    string, suffix, group = string[full], suffix[full].astype(np.int64), group[full]
    at = start[string] + size[string] - suffix
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(at) else at
    least = np.minimum.reduceat(who[string], head) if len(at) else who[:0]
    least = np.repeat(least, np.diff(np.append(head, len(at))))
    order = np.lexsort((at, string))
    return string[order], least[order]


def _least_of_windows(data, start, size, who, anchor) -> tuple[np.ndarray, np.ndarray]:
    """The least `who` for each window of each distinct string, string by string, and where each string's begin.

    Equal windows have equal anchors, so an anchor with one string needs no sorting, and the others' strings are sorted
    a few thousand at a time.
    """
    count = size - LENGTH + 1
    cut = np.concatenate([[0], np.cumsum(count)])
    least = np.repeat(who, count)
    order = np.argsort(anchor, kind="stable")
    head = np.append(True, anchor[order][1:] != anchor[order][:-1])
    group = np.cumsum(head) - 1
    many = np.bincount(group)[group] > 1
    order, group = order[many], group[many]
    a = 0
    while a < len(order):
        b = min(len(order), a + _STRINGS)
        b = int(np.searchsorted(group, group[b - 1], "right"))
        part = np.sort(order[a:b])
        _, found = repeated_windows(data, start[part], size[part], who[part])
        least[ta.segments(cut[part], count[part])] = found
        a = b
    return least, cut


def _spans_of(table: pa.Table) -> pa.Table:
    """One bucket of segments -> the spans (from, to) to be removed of each document and text."""
    if table["bucket"][0].as_py() < 0:
        who, th, a, b = (np.frombuffer(b"".join(table[x].to_pylist()), np.int64) for x in "abcd")
    else:
        unpack = zstandard.ZstdDecompressor()
        ids, names, starts = (np.frombuffer(b"".join(map(unpack.decompress, table[x].to_pylist())), np.int64) for x in "abc")
        size = np.frombuffer(b"".join(table["d"].to_pylist()), np.uint8).astype(np.int64)
        data = np.frombuffer(b"".join(map(unpack.decompress, table["e"].to_pylist())), np.uint8)
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        # equal segments are one string of the collection, of the least document
        text = data.tobytes()
        number: dict[bytes, int] = {}
        string = np.array([number.setdefault(text[x : x + y], len(number)) for x, y in zip(first.tolist(), size.tolist(), strict=True)])
        _, one = np.unique(string, return_index=True)
        least_id = np.full(len(one), 2**63 - 1)
        np.minimum.at(least_id, string, ids)
        least, cut = _least_of_windows(data, first[one], size[one], least_id, np.frombuffer(b"".join(table["f"].to_pylist()), np.uint32)[one])
        count = size - LENGTH + 1
        each = np.repeat(np.arange(len(ids)), count)
        window = ta.segments(np.zeros(len(ids), np.int64), count)
        gone = least[cut[string[each]] + window] < ids[each]
        each, window = each[gone], window[gone]
        head = np.ones(len(each), bool)
        head[1:] = (each[1:] != each[:-1]) | (window[1:] != window[:-1] + 1)
        tail = np.append(head[1:], True)[: len(head)]
        who, th = ids[each[head]], names[each[head]]
        a, b = starts[each[head]] + window[head], starts[each[tail]] + window[tail] + LENGTH
    order = np.lexsort((a, th, who))
    who, th, spans = who[order], th[order], np.stack([a, b], 1)[order]
    first = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (th[1:] != th[:-1]))) if len(who) else np.zeros(0, np.int64)
    cuts = np.append(first, len(who))
    return pa.table({"__id": who[first], "__th": th[first], "__spans": pa.array([spans[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})


def mark_repeats(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text, ...; no other name may begin with `__`) with __id, __th, __found (array of spans) and __copy (whether the text is gone whole).

    One row for each row of documents; settled() makes its spans of the last columns.
    """
    base = documents.withColumns({
        "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)),
        "__th": F.coalesce(F.xxhash64("text"), F.lit(0)),
    })
    key = ["__id", "__th"]
    texts = base.select(*key, "text")
    bits = ta.bucket_bits(ta.total_bytes(documents), 8 << 20)
    marks = texts.mapInArrow(_anchors(bits), _BLOBS).groupBy("bucket").applyInArrow(ta.released(_mark(bits)), "__id long, __th long, __marks binary, __hot boolean")
    marks, _ = materialize(marks, "op8-marks")
    names = texts.where(F.octet_length("text") >= LENGTH).select(*key, F.unhex(F.sha2(F.encode("text", "utf-8"), 256)).alias("name"))
    first = names.groupBy("name").agg(F.min("__id").alias("low"), F.max("__id").alias("high")).where("low < high")
    copies = names.join(first, "name").where("__id > low").select(*key, F.lit(True).alias("__copy")).distinct()
    notes = marks.where("not __hot").groupBy(*key).agg(F.collect_list("__marks").alias("__marks")).join(copies, key, "left_anti")
    # all columns go along, so that this join and the last share one exchange of the texts
    spans = base.join(notes, key).mapInArrow(_segments(bits, _hot_sieve(marks)), _BLOBS)
    spans = spans.groupBy("bucket").applyInArrow(ta.released(_spans_of), "__id long, __th long, __spans binary")
    spans = spans.groupBy(*key).agg(F.collect_list("__spans").alias("__found"))
    return base.join(spans, key, "left").join(copies, key, "left")


def settled(found, gone, n: int) -> np.ndarray:
    """The maximal removed runs, as rows (from, to), of a text of n bytes."""
    if gone:
        return np.array([[0, n]])
    parts = [np.frombuffer(x, np.int64) for x in found or ()]
    if not parts:
        return np.zeros((0, 2), np.int64)
    spans = np.concatenate(parts).reshape(-1, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    head = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.stack([spans[head, 0], reach[np.append(head[1:], len(spans)) - 1]], 1)


def kept_bytes(text: bytes, runs: np.ndarray) -> bytes:
    at, parts = 0, []
    for a, b in runs.tolist():
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def _digests(batches):
    for batch in batches:
        out = []
        for doc, text, found, gone in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "text", "__found", "__copy")), strict=True):
            text = (text or "").encode()
            runs = settled(found, gone, len(text))
            kept = kept_bytes(text, runs)
            out.append((doc, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(),) * 4 + (pa.string(),), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removal_digests(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256; a row for each input row."""
    rows = mark_repeats(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.select("doc_id", "text", "__found", "__copy").mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def whole_characters(text: bytes, runs: np.ndarray) -> np.ndarray:
    """Runs cut back to whole code points, so that what is kept is valid UTF-8."""
    out = []
    for a, b in runs.tolist():
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def cut_texts(documents: DataFrame) -> DataFrame:
    """documents with the repeated spans cut out of text; the same columns, whatever their names, and rows.

    A code point goes only if all its bytes do. n_chars, where there is one, follows. A null text stays null.
    """
    rest = F.struct(*[F.col(f"`{x}`") for x in documents.columns if x != "text"])
    rows = documents.select(rest.alias("rest"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches):
        for batch in batches:
            texts = []
            for text, found, gone in zip(*(batch.column(x).to_pylist() for x in ("text", "__found", "__copy")), strict=True):
                if text is not None:
                    raw = text.encode()
                    runs = whole_characters(raw, settled(found, gone, len(raw)))
                    text = kept_bytes(raw, runs).decode() if len(runs) else text
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(texts, pa.string())], ["rest", "text"])

    out = mark_repeats(rows).select("rest", "text", "__found", "__copy").mapInArrow(run, T.StructType([rows.schema["rest"], rows.schema["text"]]))
    chars = lambda x: F.length("text").cast(documents.schema[x].dataType) if x == "n_chars" else F.col("text" if x == "text" else f"rest.`{x}`")
    return out.select(*[chars(x).alias(x) for x in documents.columns])
