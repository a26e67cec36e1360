"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Two documents link when the Jaccard similarity of their sets of word shingles reaches num/den. Every step is exact:

1. Keys (one pass over the texts). Sets that link have sizes within num/den and differ in at most d shingles, where d
   follows from their size level. A level deals the shingles into K > d classes by hash, so linked sets agree on a
   whole class. Each set gives the hash of each class as a key, for its own size level and the next. A document with
   so many empty classes that they could be all that agrees gives those as keys too.
2. Families. Documents that share a key of a size level hang together; connected components of that, level by level, are
   families. Equal sets are one member, the least doc_id; copies are counted, not compared.
3. Search. Members of a family meet in a task, in blocks if the family is large, and each is looked up in an inverted
   index of the others: the longest lists are set apart, as many as DivideSkip's rule says, the short ones merged and
   counted, and what they leave is probed for, by binary search, in the long ones (or these are counted too, if they have
   fewer entries than there would be probes). What reaches the overlap is a link.
4. Links and copies give components.

Hot groups: within a chunk of texts a key is sent once, with the links that the chunk shows by itself, so a key has no
more rows than there are chunks. A large family is dealt into blocks of BLOCK members, and each task compares two
blocks. Tasks give a spanning forest of the links they find and a count for each member, never all pairs.

Cases: a null doc_id takes no part (its row has a null component); a null text or one without words has an empty set,
no links, n_shingles 0; rows that share a doc_id are one document (its texts' links are joined); an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrook.llm import textarrays as ta
from tallyrook.operators.components import connected_components
from tallyrook.session import materialize

BLOCK = 2048
#: Bits of the sieve: SIEVE_SHARE for each member, between these bounds (16 MiB at most; beyond, more other rows pass).
SIEVE_SHARE, SIEVE_LEAST, SIEVE_MOST = 8, 1 << 20, 1 << 27
#: The published tuning constant of DivideSkip's number of long lists.
MU = 0.0085
_SIGNALS = "kind int, a binary, b binary, c binary"


class Levels:
    """Size levels of a threshold num/den: linked sets are in the same level or in neighbours."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.first = num, den, [1]

    def of(self, sizes: np.ndarray) -> np.ndarray:
        while len(sizes) and self.first[-1] <= sizes.max():
            self.first.append(self.first[-1] * self.den // self.num + 1)
        return np.searchsorted(np.array(self.first), sizes, "right") - 1

    def up_to(self, size: int) -> list[tuple[int, int]]:
        """classes() of all levels up to that of a size."""
        return [self.classes(x) for x in range(int(self.of(np.array([size]))[0]) + 2)]

    def classes(self, level: int) -> tuple[int, int]:
        """d, the most shingles by which linked sets of this level and the one before differ, and K."""
        while len(self.first) <= level + 1:
            self.first.append(self.first[-1] * self.den // self.num + 1)
        d = 2 * (self.first[level + 1] - 1) * (self.den - self.num) // (self.den + self.num)
        return d, d + 1 + d // 6


def class_keys(value: np.ndarray, first: np.ndarray, levels: Levels) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, key, level) of all class keys of the sets in (value, first); rows (document, level, empty classes) where
    linked sets agree on two classes or more and some are empty."""
    sizes = np.diff(first)
    docs, keys, where, void = [], [], [], []
    some = np.flatnonzero(sizes)
    if not len(some):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros((0, 3), np.int64)
    own = levels.of(sizes[some])
    pick, mixed = ta.mix(value ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32), ta.mix(value)
    for up in (0, 1):
        dk = np.array([levels.classes(int(x) + up) for x in range(own.max() + 1)])
        d, k = dk[own, 0], dk[own, 1]
        base = np.concatenate([[0], np.cumsum(k)])
        each = np.repeat(np.arange(len(some)), sizes[some])
        at = base[each] + (pick % k[each].astype(np.uint64)).astype(np.int64)
        total, count = np.zeros(base[-1], np.uint64), np.bincount(at, minlength=base[-1])
        np.add.at(total, at, mixed)
        who = np.repeat(np.arange(len(some)), k)
        cls = np.arange(base[-1]) - base[who]
        empties = np.bincount(who, count == 0, len(some)).astype(np.int64)
        less = np.flatnonzero((empties > 0) & (k - d > 1))
        void.append(np.stack([some[less], own[less] + up, empties[less]], 1))
        send = (count > 0) | (empties >= k - d)[who]
        salt = ta.mix((own[who] + up).astype(np.uint64) << np.uint64(32) | cls.astype(np.uint64))
        docs.append(some[who[send]])
        keys.append(ta.mix(total * np.uint64(0x9E3779B97F4A7C15) + salt)[send])
        where.append((own[who[send]] + up).astype(np.uint8))
    return np.concatenate(docs), np.concatenate(keys), np.concatenate(where), np.concatenate(void)


def _row(kind: int, *arrays: np.ndarray) -> tuple:
    return (kind, *(x.tobytes() for x in arrays), *[b""] * (3 - len(arrays)))


def _rows(found: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)


def _star(who: np.ndarray, key: np.ndarray, lev: np.ndarray) -> np.ndarray:
    """Sorted keys -> rows (level, document, least document of the key, keys), for the keys that two documents share.

    The least document has rows with itself, so a document's keys add up to how many of its keys another has too.
    """
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(key)))
    shared = np.repeat(who[first] != who[np.append(first[1:], len(key)) - 1], size)
    rows = np.stack([lev.astype(np.int64), who, np.repeat(who[first], size)], 1)[shared]
    rows, count = np.unique(rows, axis=0, return_counts=True)
    return np.column_stack([rows, count])


def _edges(who, key, lev, salt: int) -> list[tuple]:
    star = _star(who, key, lev)
    return [_row(-1 - salt, star[:, 1], star[:, 2], np.ascontiguousarray(star[:, [0, 3]]))] if len(star) else []


def _signals(n: int, num: int, den: int, bits: int):
    """Texts -> rows of arrays by kind. 0 and up: a bucket of (32-bit keys, documents). Below, -1 - (4 * salt + what), with
    0: edges, 1: (documents, sizes, digests), 2: sizes of rows without a doc_id, 3: empty classes; the salt spreads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels(num, den)
        for batch in batches:
            ids, void = ta.ids_of(batch.column("doc_id"))
            for c in ta.chunks(batch.column("text")):
                own, gone = ids[c.first : c.first + len(c)], void[c.first : c.first + len(c)]
                doc, value, first = ta.shingle_sets(c, n)
                sizes = np.diff(first)
                mixed = ta.mix(value)
                digest = np.stack([np.add.reduceat(np.append(x, np.uint64(0)), first[:-1]) * (sizes > 0) for x in (mixed, ta.mix(mixed ^ value))], 1)
                salt = 4 * int(value[0] % np.uint64(1 << bits)) if len(value) else 0
                found = [_row(-2 - salt, own[~gone], sizes[~gone].astype(np.int64), digest[~gone])]
                if gone.any():
                    found.append(_row(-3 - salt, sizes[gone].astype(np.int64)))
                # A set that the chunk has already had gives no keys.
                live = np.flatnonzero(~gone & (sizes > 0))
                live = live[np.lexsort((own[live], digest[live, 1], digest[live, 0]))]
                new = np.ones(len(live), bool)
                new[1:] = (digest[live[1:]] != digest[live[:-1]]).any(1)
                only = np.zeros(len(c), bool)
                only[live[new]] = True
                keep = only[doc]
                at, key, lev, empty = class_keys(value[keep], np.concatenate([[0], np.cumsum(np.where(only, sizes, 0))]), levels)
                if len(empty):
                    found.append(_row(-4 - salt, own[empty[:, 0]], own[empty[:, 0]], np.ascontiguousarray(empty[:, 1:])))
                who = own[at]
                order = np.lexsort((who, key))
                who, key, lev = who[order], key[order], lev[order]
                found += _edges(who, key, lev, salt)
                new = np.ones(len(key), bool)
                new[1:] = key[1:] != key[:-1]
                who, key, lev = who[new], key[new], lev[new]
                bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
                cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
                for b in np.flatnonzero(np.diff(cuts)):
                    part = slice(cuts[b], cuts[b + 1])
                    back = np.argsort(who[part], kind="stable")
                    found.append(_row(int(b), (key[part] >> np.uint64(32 - bits)).astype(np.uint32)[back], who[part][back], lev[part][back]))
                yield _rows(found)

    return run


def _longs(data, type_=np.int64) -> np.ndarray:
    return np.frombuffer(b"".join(data.to_pylist()), type_)


_MET = "what int, src long, dst long, d1 long, d2 long"


def _meet(table: pa.Table) -> pa.Table:
    """A bucket of keys -> edges from each document of a key to the least, with level and number of keys as d1 and d2 (32 bits
    of a key only add edges); the rest: rows, of empty classes with level and their number as d1 and d2."""
    kind = table["kind"][0].as_py()
    what = (-1 - kind) % 4 if kind < 0 else 0
    a, d, e = None, None, None
    if kind >= 0:
        key, who, lev = _longs(table["a"], np.uint32), _longs(table["b"]), _longs(table["c"], np.uint8)
        order = np.lexsort((who, lev, key))
        star = _star(who[order], key[order].astype(np.uint64) << np.uint64(8) | lev[order], lev[order])
        d, a, b, e = star.T
    elif what == 2:
        b = _longs(table["a"])
    else:
        a, b, both = _longs(table["a"]), _longs(table["b"]), _longs(table["c"])
        d, e = both[0::2], both[1::2]
    void = pa.nulls(len(b), pa.int64())
    return pa.table({
        "what": pa.array(np.full(len(b), what, np.int32)), "src": void if a is None else pa.array(a.copy()), "dst": pa.array(b.copy()),
        "d1": void if d is None else pa.array(d.copy()), "d2": void if e is None else pa.array(e.copy()),
    })


def _sieve(members: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of so many bits: the members' hashed ids. Made as sums of 64 bits each."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    words = members.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    for part in words.toArrow().to_batches():
        out[part.column("w").to_numpy()] = part.column("bits").to_numpy()
    return out.view(np.uint8)


def _member_sets(n: int, sieve: np.ndarray):
    """Texts that the sieve lets through -> their sets, sorted; 8 bytes a shingle."""

    def run(batches):
        for batch in batches:
            at = batch.column("at").to_numpy()
            batch = batch.filter(pa.array((sieve[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            for c in ta.chunks(batch.column("text")):
                _, value, first = ta.shingle_sets(c, n)
                sets = pa.array([value[first[i] : first[i + 1]].tobytes() for i in range(len(c))], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(c.first, len(c)), sets], ["doc_id", "items"])

    return run


def _merge_short(lists: list[np.ndarray], least: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Members low .. high - 1 that stand in at least `least` of the sorted lists, and in how many: a heap merge of few
    entries; many are counted in an array of the members."""
    if sum(map(len, lists)) > 256:
        count = np.bincount(np.concatenate(lists) - low, minlength=high - low)
        some = np.flatnonzero(count >= least)
        return some + low, count[some]
    every = np.fromiter(heapq.merge(*(y.tolist() for y in lists)), np.int64)
    head = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else every
    count = np.diff(np.append(head, len(every)))
    some = count >= least
    return every[head[some]], count[some]


def long_lists(need: int, longest: int) -> int:
    """How many of the longest lists DivideSkip sets apart when `need` occurrences are asked for: need / (MU log2 longest + 1)."""
    return min(need - 1, int(need / (MU * np.log2(max(2, longest)) + 1)))


def t_occurrence(sets: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of distinct-valued sets with den * |a & b| >= num * |a | b|; with sides, only pairs across them,
    with parts, only pairs within one.

    DivideSkip (Li, Lu, Lu 2008): a set of n shingles needs T = ceil(num * n / den) shared ones with any partner that isn't
    larger. L of its longest lists, by the published rule, are set apart; a partner then stands in T - L of the short
    ones at least, which are merged and counted, and what reaches T - L there is looked up in the long lists by binary search,
    or counted there where that takes fewer steps.
    """
    sizes = np.array([len(x) for x in sets])
    token = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    who = np.repeat(np.arange(len(sets)), sizes)
    # members by size, so that every list is sorted by rank, and a query only sees ranks below its own
    rank_of = np.empty(len(sets), np.int64)
    by_size = np.lexsort((np.arange(len(sets)), sizes))
    rank_of[by_size] = np.arange(len(sets))
    rank = rank_of[who]
    order = np.lexsort((rank, token))
    token, rank = token[order], rank[order]
    head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    ends = np.append(head[1:], len(token))
    names = token[head]
    size_by_rank = sizes[by_size]
    place = np.repeat(np.arange(len(head)), ends - head) * len(sets) + rank  # sorted: (list, rank) as one number
    left, right = [], []
    for r in range(len(sets)):
        x = sets[by_size[r]]
        n = len(x)
        if not n:
            continue
        need = -(-num * n // den)
        low = int(np.searchsorted(size_by_rank, need))  # smaller partners can't reach it
        if low >= r:
            continue
        lists = np.searchsorted(names, x)
        a = np.searchsorted(place, lists * len(sets) + low)
        b = np.searchsorted(place, lists * len(sets) + r)
        length = b - a
        if np.count_nonzero(length) < need:
            continue
        by_length = np.argsort(length, kind="stable")
        apart = long_lists(need, int(length.max()))
        short, long = by_length[: n - apart], by_length[n - apart :]
        found, shared = _merge_short([rank[a[i] : b[i]] for i in short if length[i]], need - apart, low, r)
        if side is not None and len(found):
            fit = side[by_size[found]] != side[by_size[r]]
            found, shared = found[fit], shared[fit]
        if part is not None and len(found):
            fit = part[by_size[found]] == part[by_size[r]]
            found, shared = found[fit], shared[fit]
        if not len(found):
            continue
        if len(found) * apart > int(length[long].sum()):
            # more probes than entries: a family of near copies, whose long lists are counted like the short ones
            shared = shared + np.bincount(np.concatenate([rank[a[i] : b[i]] for i in long]) - low, minlength=r - low)[found - low]
            apart = 0
        long = long[::-1]  # the longest first, where a partner is likeliest
        step = max(1, (1 << 20) // len(found))
        for k in range(0, apart, step):
            probe = (lists[long[k : k + step], None] * len(sets) + found[None, :]).ravel()
            at = np.minimum(np.searchsorted(place, probe), len(place) - 1)
            shared = shared + (place[at] == probe).reshape(-1, len(found)).sum(0)
            rest = apart - min(apart, k + step)
            fit = (den + num) * (shared + rest) >= num * (n + size_by_rank[found])
            if not fit.all():
                found, shared = found[fit], shared[fit]
                if not len(found):
                    break
        fit = (den + num) * shared >= num * (n + size_by_rank[found])
        found = found[fit]
        left += [by_size[r]] * len(found)
        right += by_size[found].tolist()
    return np.array(left, np.int64), np.array(right, np.int64)


def _forest(m: int, left: np.ndarray, right: np.ndarray) -> list[int]:
    """Indices of links that join what earlier ones don't."""
    top = list(range(m))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        a, b = find(x), find(y)
        if a != b:
            top[a] = b
            keep.append(i)
    return keep


def _search(num: int, den: int):
    """Members of a group of families, or of two blocks of one -> links: (src, dst) spanning them, and counts (dst null)."""

    def run(table: pa.Table) -> pa.Table:
        ids = table["doc_id"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table["items"].to_pylist()]
        copies, block, level = (table[x].to_numpy() for x in ("copies", "block", "level"))
        seen, keep = set(), []
        for i, x in enumerate(zip(ids.tolist(), level.tolist(), map(bytes, sets), strict=True)):  # repeated rows count once
            if x not in seen:
                seen.add(x)
                keep.append(i)
        ids, copies, block, level, sets = ids[keep], copies[keep], block[keep], level[keep], [sets[i] for i in keep]
        left, right = t_occurrence(sets, num, den, block if table["cross"][0].as_py() else None, level)
        # a pair of the level below has been found there
        own = Levels(num, den).of(np.array([len(x) for x in sets]))
        other = (ids[left] != ids[right]) & (np.maximum(own[left], own[right]) == level[left])
        left, right = left[other], right[other]
        kept = _forest(len(sets), left, right)
        links = np.bincount(left, copies[right], len(sets)) + np.bincount(right, copies[left], len(sets))
        some = np.flatnonzero(links)
        src = np.concatenate([ids[left[kept]], ids[some]])
        dst = pa.array(ids[right[kept]].tolist() + [None] * len(some), pa.int64())
        return pa.table({"src": src, "dst": dst, "links": pa.array([0] * len(kept) + links[some].astype(np.int64).tolist(), pa.int64())})

    return run


def jaccard_join(documents: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """documents (doc_id long, text string, ...) -> doc_id, n_shingles, component_id, n_links; a row for each input row.

    component_id is the least doc_id that links reach, the document's own without links. n_links counts the documents
    that the document links with, equal sets included.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bits = ta.bucket_bits(ta.total_bytes(texts), 8 << 20)
    met, _ = materialize(texts.mapInArrow(_signals(shingle, num, den, bits), _SIGNALS).groupBy("kind").applyInArrow(ta.released(_meet), _MET), "op2-signals")
    docs = met.where("what = 1").select(F.col("src").alias("doc_id"), F.col("dst").alias("n"), "d1", "d2")
    some = docs.where("n > 0")
    reps = some.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.countDistinct("doc_id").alias("copies"), F.max("doc_id").alias("last"))
    equal, _ = materialize(
        some.join(reps.where("rep < last"), ["d1", "d2"]).where("doc_id <> rep").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst")).distinct(),
        "op2-equal",
    )
    node = lambda x: F.struct(F.col("d1").alias("level"), F.col(x).alias("doc_id"))
    family = connected_components(met.where("what = 0").select(node("src").alias("src"), node("dst").alias("dst")))
    # Who shares fewer keys of a level than linked sets must can't link there: it only holds its family together. The classes
    # that linked sets agree on may be empty in both, and an empty one gives no key if either has few: each that a document
    # has takes one off what it must share, down to one key.
    need = F.element_at(F.array(*[F.lit(k - d) for d, k in Levels(num, den).up_to(1 << 40)]), F.col("d1").cast("int") + 1)
    met_keys = met.where("what in (0, 3)").groupBy("src", "d1").agg(
        F.sum(F.when(F.col("what") == 0, F.col("d2"))).alias("keys"), F.max(F.when(F.col("what") == 3, F.col("d2"))).alias("empty")
    ).where(F.col("keys") >= F.greatest(F.lit(1), need - F.coalesce("empty", F.lit(0))))
    family = family.join(met_keys.select(F.struct(F.col("d1").alias("level"), F.col("src").alias("doc_id")).alias("node")), "node", "left_semi")
    family = family.select(F.col("node.doc_id").alias("doc_id"), F.col("node.level").alias("level"), F.xxhash64("component").alias("component"))
    members = reps.select(F.col("rep").alias("doc_id"), "copies").join(family, "doc_id")
    large = members.groupBy("component").agg(F.count("*").alias("m")).where("m > 1")
    members = (
        members.join(large, "component")
        .withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    )
    members, _ = materialize(members, "op2-members")
    shared = members.agg(F.count("*")).first()[0]
    groups = max(1, shared // 1024)
    # small families share a group; a large one has groups of its own
    group = F.when(F.col("blocks") == 1, F.pmod(F.col("component"), F.lit(groups))).otherwise(F.col("component"))
    members = members.withColumn("group", group).select("doc_id", "copies", "level", "group", "block", "blocks")
    # only members' sets are shuffled; a member that the sieve lets through by chance goes in the join
    bits = min(SIEVE_MOST, max(SIEVE_LEAST, 1 << (SIEVE_SHARE * shared - 1).bit_length()))
    sets = texts.where("doc_id is not null").withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(bits)))
    sets = sets.mapInArrow(_member_sets(shingle, _sieve(members, bits)), "doc_id long, items binary").join(members, "doc_id")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("low"), F.greatest("block", j).alias("high")))
    dealt = sets.withColumn("pair", F.explode(meets)).select(
        "doc_id", "copies", "level", "group", "block", "blocks", F.col("pair.low").alias("low"), F.col("pair.high").alias("high"), "items"
    ).withColumn("cross", F.col("low") < F.col("high"))
    found, _ = materialize(dealt.groupBy("blocks", "group", "low", "high").applyInArrow(ta.released(_search(num, den)), "src long, dst long, links long"), "op2-links")
    component = connected_components(found.where("dst is not null").select("src", "dst").union(equal))
    counts = found.where("dst is null").groupBy("src").agg(F.sum("links").alias("links"))
    own = some.select("doc_id", "d1", "d2").distinct().join(reps, ["d1", "d2"]).join(counts.withColumnRenamed("src", "rep"), "rep", "left")
    own = own.groupBy("doc_id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows = docs.select("doc_id", F.col("n").alias("n_shingles"))
    out = (
        rows.join(component.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .join(own, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    void = met.where("what = 2").select(F.col("dst").alias("n"))
    return out.union(void.select(F.lit(None).cast("long"), "n", F.lit(None).cast("long"), F.lit(0).cast("long")))


def keep_one(documents: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of documents, with all columns, whatever their names, but for those whose doc_id isn't the least of its component."""
    rows = jaccard_join(documents, shingle, num, den)
    gone = rows.where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    whole = documents.select(F.struct("*").alias("row"))
    kept = whole.join(gone.hint("shuffle_hash"), F.col("row.doc_id").cast("long") == F.col("gone"), "left_anti")
    return kept.select(*[F.col(f"row.`{x}`").alias(x) for x in documents.columns])
