"""Prefix trie of conversations: union-find over the common prefixes of sorted neighbours, deepest first.

A turn is named by 16 bytes of the SHA-256 of (role, text), a conversation by the string of its turns' names. Ranges of
the conversations sorted by (string, conv_id) are partitions. In a partition, edges between neighbours are taken in
descending length of their common prefix; a component merge at depth d creates the branching node of depth d, so the
components are a compressed trie, whose edges are spelled out into the nodes of each depth.

A node that holds neither the first nor the last conversation of its partition is complete. Only the paths of these two
can go on in other partitions: the partition's forest is contracted to them, each path node keeping the sums of what
hung on it. Contracted forests of FAN partitions on end are again sorted neighbours and are merged by the same
union-find, level by level, until one group is left; then parents' members are passed down the levels again. So a task
holds one partition, or 2 * FAN paths. Identical conversations, however many, spread over partitions by conv_id.

The digest of a node's ended conversations is sequential by its nature: of nodes on the contracted paths, the conv_ids
alone are dealt by node, sorted, and hashed as a stream in constant memory.

Cases: turns are ordered by turn (null first), then role, then text, and repeated rows all stay; a null role or text is
empty; rows without a conv_id are left out; a conversation whose rebuilt turns are none ends at the root; an empty table
gives no rows; other columns are ignored. A conversation is one row of 20 bytes a turn.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyrook.llm import textarrays as ta
from tallyrook.session import materialize

NAME = 16
#: Bytes of conversations in a partition, conversations in one (as long as there are fewer partitions than cores twice
#: over), and partitions whose contracted forests are merged in one task.
PART_BYTES, PART_ROWS, FAN = 1 << 25, 512, 64
_NONE = np.iinfo(np.int64).max
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_LEVEL = (
    "kind string, part long, side int, depth long, conv_id long, parent_conv_id long, up_part long, up_side int, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, name binary, key binary, words array<long>, convs array<long>, least array<long>, "
    "hung_saved array<long>, hung_leaves array<long>, hung_children array<long>"
)
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
_FIELDS = [(x.split()[0], _TYPES[x.split()[1]]) for x in _LEVEL.split(", ")]
_ADDED = ("convs", "hung_saved", "hung_leaves", "hung_children")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, t: the turns in order, as array of struct(name, words). Texts aren't shuffled, but those of turns that tie."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    name = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    words = F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).cast("int")
    named = rows.withColumns({"name": F.substring(name, 1, 2 * NAME), "words": words})
    tied = rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"))
    if tied.isEmpty():
        named = named.withColumn("place", F.lit(0))
    else:
        same = (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
        place = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
        named = named.join(tied, same, "left_anti").withColumn("place", F.lit(0)).unionByName(named.join(tied, same, "left_semi").withColumn("place", place))
    turns = F.array_sort(F.collect_list(F.struct("turn", "place", "name", "words")))
    return named.groupBy("conv_id").agg(F.transform(turns, lambda x: F.struct(x["name"].alias("name"), x["words"].alias("words"))).alias("t"))


def rebuilt(turns: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """(conv_id, t) -> the same, with the first h turns replaced by those of conversation conv_id - conv_id % every; h: crc32 of conv_id modulo heads."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    base = turns.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("t", 1, heads - 1).alias("head"))
    rows = turns.withColumns({"h": h, "of": F.col("conv_id") - F.col("conv_id") % every})
    rows = rows.join(base, F.col("of") == F.col("base"), "left")
    head = F.when(F.col("head").isNull(), F.slice("t", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    return rows.select("conv_id", F.concat(head, F.slice("t", F.col("h") + 1, F.size("t"))).alias("t"))


class _Items:
    """Paths in order: names of turns, and for each depth from 0 to a path's length, words of the turn and sums to be added up."""

    def __init__(self, keys: pa.Array, words: np.ndarray, convs: np.ndarray, least: np.ndarray, saved: np.ndarray, leaves: np.ndarray, children: np.ndarray) -> None:
        data, at = ta.byte_column(keys)
        self.bytes, self.at = data, at
        self.length = np.diff(at) // NAME
        self.names = np.ascontiguousarray(data).view(np.uint64).reshape(-1, 2)
        self.first = at[:-1] // NAME  # of its names
        self.start = self.first + np.arange(len(self.length))  # of its depths
        self.words, self.convs, self.least, self.saved, self.leaves, self.children = words, convs, least, saved, leaves, children

    def __len__(self) -> int:
        return len(self.length)

    def key(self, i: int, depth: int) -> bytes:
        return self.bytes[self.at[i] : self.at[i] + NAME * depth].tobytes()

    def common(self) -> np.ndarray:
        """Turns that each path, but the first, shares with the one before."""
        size = np.minimum(self.length[1:], self.length[:-1])
        out = size.copy()
        differ = (self.names[ta.segments(self.first[:-1], size)] != self.names[ta.segments(self.first[1:], size)]).any(1)
        pair = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        np.minimum.at(out, pair[differ], place[differ])
        return out


def _components(length: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(depth, parent) of the components that union-find makes of the edges in descending depth; the first ones are the paths.

    A component of the same depth as its parent has no nodes of its own.
    """
    depth, parent, top = length.tolist(), [-1] * len(length), list(range(len(length)))
    node = list(range(len(length)))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    edges = np.argsort(-common, kind="stable")
    for e, d in zip(edges.tolist(), common[edges].tolist(), strict=True):
        x, y = find(e), find(e + 1)
        a, b = node[x], node[y]
        if depth[a] != d:  # this merge branches
            depth.append(d)
            parent.append(-1)
            parent[a] = a = len(depth) - 1
        parent[b] = a
        top[y] = x
        node[x] = a
    return np.array(depth), np.array(parent)


class _Forest:
    """The trie of some paths: its nodes, their sums, and the node of each path at each depth."""

    def __init__(self, items: _Items) -> None:
        self.items = items
        depth, parent = _components(items.length, items.common())
        above = np.where(parent < 0, -1, depth[parent])
        size = depth - above
        base = np.cumsum(size) - size
        self.depth = ta.segments(above + 1, size)
        self.parent = np.arange(len(self.depth)) - 1
        own = size > 0
        up = parent[own]
        self.parent[base[own]] = np.where(up < 0, -1, (base + size - 1)[up])
        self.node = np.empty(len(items.words), np.int64)
        item = at = np.arange(len(items))
        while len(item):
            self.node[ta.segments(items.start[item] + above[at] + 1, size[at])] = ta.segments(base[at], size[at])
            at = parent[at]
            item, at = item[at >= 0], at[at >= 0]
        n = len(self.depth)
        total = lambda x: _sums(self.node, x, n)
        self.convs, self.saved, self.leaves, self.children = (total(x) for x in (items.convs, items.saved, items.leaves, items.children))
        self.least = np.full(n, _NONE)
        np.minimum.at(self.least, self.node, items.least)
        self.words = np.zeros(n, np.int64)
        self.words[self.node] = items.words

    def path(self, i: int) -> np.ndarray:
        return self.node[self.items.start[i] : self.items.start[i] + self.items.length[i] + 1]

    def close(self, open_: np.ndarray) -> None:
        """Add up complete nodes, and onto open ones what hangs on them."""
        order = np.argsort(-self.depth, kind="stable")
        cut = np.searchsorted(-self.depth[order], np.arange(-int(self.depth.max()), 1), "right")
        for a, b in zip([0, *cut[:-1]], cut, strict=True):
            x = order[a:b]
            x = x[~open_[x]]
            self.leaves[x] += self.children[x] == 0
            self.saved[x] += (self.convs[x] - 1) * self.words[x]
            x = x[self.parent[x] >= 0]
            for sums, more in ((self.leaves, self.leaves[x]), (self.saved, self.saved[x]), (self.children, 1)):
                np.add.at(sums, self.parent[x], more)


def _sums(where: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, where, value)
    return out


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in _FIELDS], [k for k, _ in _FIELDS])


def _level(items: _Items, part: int, last: bool, slots: list[tuple[int, int]] | None, ids: np.ndarray | None):
    """Rows of one partition or group: complete nodes; of partitions (ids), conversations that end on open ones; of groups,
    the nodes of their parts' paths (slots: part and side of each item); and, unless last, the two paths."""
    forest = _Forest(items)
    n = len(forest.depth)
    side = np.full(n, -1)
    if not last:
        side[forest.path(len(items) - 1)] = 1
        side[forest.path(0)] = 0
    open_ = side >= 0
    forest.close(open_)
    done = np.flatnonzero(~open_)
    parent = forest.parent[done]
    known = (parent >= 0) & ~open_[parent]
    some = np.zeros(n, np.int64)
    some[forest.node] = np.arange(len(forest.node))  # a path and depth of each node
    item = np.searchsorted(items.start, some, "right") - 1
    sha, name = [None] * len(done), [None] * len(done)
    if ids is not None:
        ends = forest.node[items.start + items.length]
        order = np.argsort(ends, kind="stable")
        cut = np.searchsorted(ends[order], np.arange(n + 1))
        text = ids.astype(str)
        for k, x in enumerate(done.tolist()):
            sha[k] = hashlib.sha256(",".join(text[order[cut[x] : cut[x + 1]]]).encode()).hexdigest() if cut[x] < cut[x + 1] else EMPTY_SHA
        late = np.flatnonzero(open_[ends])
        of = {x: hashlib.sha256(items.key(int(item[x]), int(forest.depth[x]))).digest() for x in np.unique(ends[late]).tolist()}
        yield _rows(len(late), kind=["end"] * len(late), name=[of[x] for x in ends[late].tolist()], conv_id=ids[late])
    else:
        name = [hashlib.sha256(items.key(int(item[x]), int(forest.depth[x]))).digest() for x in done.tolist()]
    upper = [None if k or p < 0 else int(side[p]) for k, p in zip(known.tolist(), parent.tolist(), strict=True)]
    yield _rows(
        len(done), kind=["node"] * len(done), part=[part] * len(done), depth=forest.depth[done], conv_id=forest.least[done], parent_conv_id=pa.array(np.where(known, forest.least[parent], 0), mask=~known),
        up_side=upper, n_convs=forest.convs[done], n_children=forest.children[done], n_leaves=forest.leaves[done], saved_tokens=forest.saved[done], ends_sha256=sha, name=name,
    )
    if slots is not None:
        of = np.repeat(np.arange(len(items)), items.length + 1)
        at = np.arange(len(of)) - items.start[of]
        x, shut = forest.node, ~open_[forest.node]
        yield _rows(
            len(of), kind=["slot"] * len(of), part=np.array([s[0] for s in slots])[of], side=np.array([s[1] for s in slots])[of], depth=at,
            conv_id=pa.array(forest.least[x], mask=~shut), up_part=[part] * len(of), up_side=pa.array(side[x], mask=shut),
        )
    if not last:
        shared = set(forest.path(0).tolist())
        for s, i in ((0, 0), (1, len(items) - 1)):
            path = forest.path(i)
            own = np.array([s == 0 or x not in shared for x in path.tolist()])
            values = {"convs": forest.convs, "hung_saved": forest.saved, "hung_leaves": forest.leaves, "hung_children": forest.children}
            yield _rows(
                1, kind=["item"], part=[part], side=[s], key=[items.key(i, int(items.length[i]))], words=[forest.words[path]], least=[np.where(own, forest.least[path], _NONE)],
                **{k: [np.where(own, v[path], 0)] for k, v in values.items()},
            )


def _partition(batches):
    """A range of conversations in order, in whole."""
    got = list(batches)
    if not sum(map(len, got)):
        return
    table = pa.Table.from_batches(got).combine_chunks()
    ids, keys = table.column("conv_id").to_numpy(), table.column("key").combine_chunks()
    length = np.diff(ta.byte_column(keys)[1]) // NAME
    start = np.cumsum(length + 1) - length - 1
    words = np.zeros(int((length + 1).sum()), np.int64)
    words[ta.segments(start + 1, length)] = table.column("words").combine_chunks().flatten().to_numpy()
    one, none = np.ones(len(words), np.int64), np.zeros(len(words), np.int64)
    yield from _level(_Items(keys, words, one, np.repeat(ids, length + 1), none, none, none), TaskContext.get().partitionId(), False, None, ids)


def _group(last: bool, fan: int):
    """Contracted forests of some parts on end."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("side", "ascending")]).combine_chunks()
        flat = lambda x: table.column(x).combine_chunks().flatten().to_numpy()
        items = _Items(table.column("key").combine_chunks(), flat("words"), flat("convs"), flat("least"), flat("hung_saved"), flat("hung_leaves"), flat("hung_children"))
        slots = list(zip(table.column("part").to_pylist(), table.column("side").to_pylist(), strict=True))
        return pa.Table.from_batches(list(_level(items, slots[0][0] // fan, last, slots, None)))

    return run


def _digests(batches):
    """(name, conv_id) in order -> name, SHA-256 of its ids, as a stream."""
    name, state = None, None
    for batch in batches:
        out = []
        for x, c in zip(batch.column("name").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if x != name:
                if state:
                    out.append((name, state.hexdigest()))
                name, state = x, hashlib.sha256(str(c).encode())
            else:
                state.update(b",%d" % c)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out])], ["of", "ends"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()])], ["of", "ends"])


def trie(paths: DataFrame, parts: int | None = None) -> DataFrame:
    """(conv_id, t array of struct(name, words)) -> conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256; a row a node."""
    key = F.unhex(F.array_join(F.transform("t", lambda x: x["name"]), ""))
    rows, _ = materialize(paths.select("conv_id", key.alias("key"), F.transform("t", lambda x: x["words"]).alias("words")), "op13-paths")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key") + 64), F.lit(0))).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = parts or max(1, -(-size // PART_BYTES), min(2 * cores, -(-n // PART_ROWS)))
    ranged = rows.repartitionByRange(parts, "key", "conv_id")
    level, _ = materialize(ranged.sortWithinPartitions("key", "conv_id").mapInArrow(_partition, _LEVEL), "op13-parts")
    levels, last = [level], level.where("kind = 'item'").agg(F.max("part")).first()[0]
    parts = 0 if last is None else last + 1
    while parts and (parts > 1 or len(levels) == 1):
        parts = -(-parts // FAN)
        items = levels[-1].where("kind = 'item'").withColumn("kind", F.floor(F.col("part") / FAN).cast("string"))
        level, _ = materialize(items.groupBy("kind").applyInArrow(_group(parts == 1, FAN), _LEVEL), "op13-groups")
        levels.append(level)
    ended = levels[0].where("kind = 'end'").select("name", "conv_id").repartition("name").sortWithinPartitions("name", "conv_id")
    ended = ended.mapInArrow(_digests, "of binary, ends string")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    result, found = None, None  # found: members of the nodes of this level's open paths
    for k in range(len(levels) - 1, -1, -1):
        nodes = levels[k].where("kind = 'node'")
        if found is not None:
            hung = nodes.where("up_side is not null").drop("parent_conv_id").join(found, (F.col("part") == F.col("in_part")) & (F.col("up_side") == F.col("in_side")) & (F.col("depth") - 1 == F.col("in_depth")))
            nodes = nodes.where("up_side is null").unionByName(hung.withColumn("parent_conv_id", F.col("is")).select(nodes.columns))
        if k:
            nodes = nodes.join(ended, F.col("name") == F.col("of"), "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(EMPTY_SHA)))
            slots = levels[k].where("kind = 'slot'")
            place = [F.col("part").alias("in_part"), F.col("side").alias("in_side"), F.col("depth").alias("in_depth")]
            shut = slots.where("conv_id is not null").select(*place, F.col("conv_id").alias("is"))
            if found is not None:
                up = found.toDF("a", "b", "c", "is")
                shut = shut.union(slots.where("conv_id is null").join(up, (F.col("up_part") == F.col("a")) & (F.col("up_side") == F.col("b")) & (F.col("depth") == F.col("c"))).select(*place, "is"))
            found = shut
        result = nodes.select(out) if result is None else result.unionByName(nodes.select(out))
    return result


def prefix_trie(conversations: DataFrame, parts: int | None = None) -> DataFrame:
    """conversations (conv_id, turn, role, text, ...), rebuilt, -> the nodes of their trie, see trie()."""
    return trie(rebuilt(ordered_turns(conversations)), parts)


ORACLE = r"""
with t as (select conv_id as c, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as name,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words,
                  row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as k
           from conversations where conv_id is not null),
tokens as (select c, flatten(list_transform(string_split(c::varchar, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])) as v from (select distinct c from t)),
-- the unsigned CRC-32 of the decimal number, modulo 4
ids as (select c, (xor(list_reduce(list_prepend(4294967295::bigint, v), lambda x, y: case when y >= 0 then xor(x, y) else xor(x >> 1, (x & 1) * 3988292384::bigint) end), 4294967295::bigint) % 4) as h from tokens),
r as (select i.c, t.name, t.words, row_number() over (partition by i.c order by k) as d
      from ids i join t on case when k <= h then t.c = i.c - i.c % 20 else t.c = i.c end),
p as (select c, d, words, string_agg(name, '') over (partition by c order by d) as pre from r union all select c, 0, 0, '' from ids),
len as (select c, max(d) as n from p group by c),
nodes as (select pre, d, min(c) as conv_id, count(*) as n_convs, any_value(words) as words, sha256(coalesce(string_agg(case when n = d then c::varchar end, ',' order by c), '')) as ends_sha256
          from p join len using (c) group by pre, d),
kids as (select left(pre, 64 * (d - 1)) as pre, d - 1 as d, count(*) as n from nodes where d > 0 group by all),
full_nodes as (select nodes.*, coalesce(kids.n, 0) as n_children from nodes left join kids using (pre, d)),
up as (select left(pre, 64 * a) as pre, a as d, sum(case when n_children = 0 then 1 else 0 end)::bigint as n_leaves, sum((n_convs - 1) * words)::bigint as saved_tokens
       from (select *, unnest(range(d + 1)) as a from full_nodes) group by all)
select f.conv_id, f.d as depth, q.conv_id as parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
from full_nodes f join up using (pre, d) left join nodes q on q.d = f.d - 1 and q.pre = left(f.pre, 64 * (f.d - 1))
"""
