"""Filter audit, quality ranking and the prefix trie: each against a plain version on small tables of odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tallyrook.llm import filter_audit, prefix_trie, quality_rank, textarrays

_DOCS = "doc_id long, text string, lang string, source string, part string, fails int, code long, shard long, word string, of long, score double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["Alpha", "beta", "gamma", "é", "x#y", "z", "Ärger", "one", "two"]) + rng.choice(["", "", str(rng.randint(0, 99))]) for _ in range(n))
    texts = [None, "", " \t\n", "one", "A B C", "#", "x" * 200_000, "ß" * 50_000, *(text(rng.randint(1, 90)) for _ in range(40)), text(4000), "w " * 300]
    texts += [texts[9], texts[9], texts[20], "a|b " * 60, "THE AND " * 30]
    more = ["p", 7, 8, 9, "w", 3, 0.1]
    docs = [(i, t, "en", [None, "", "b", "Z"][i % 4], *more) for i, t in enumerate(texts)]
    return [*docs, docs[9], (None, texts[9], None, None, *more), (None, None, None, "b", *more)]


@pytest.fixture(scope="module")
def labels():
    return [(i, i % 3 % 2, int(i % 5 == 0)) for i in range(0, 50, 2)] + [(4, 1, None), (9, 1, 1), (9, 0, 0), (None, 1, 1), (12, None, None), (999, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, _DOCS).repartition(3)


def failing(rows):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, _, source, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        yield i, source or "", [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > least[t]]


@pytest.mark.parametrize("size", [1 << 24, 3000])
def test_filter_audit(spark, docs, rows, labels, size):
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    want = Counter()
    parts = {s or "" for _, _, _, s, *_ in rows}
    for i, part, fails in failing(rows):
        for order in permutations(range(5)):
            before = False
            for step, f in enumerate(order):
                key = (part, "".join("ABCDE"[x] for x in order), step + 1)
                hit = fails[f]
                removed = hit and not before
                for k, x in enumerate((not before and not hit, removed, hit and before, hit and sum(fails) == 1, removed and i in good, removed and i in toxic)):
                    want[(*key, k)] += x
                want[(part, "ABCDE"[f])] += removed
                before |= hit
    got = filter_audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), size).collect()
    assert len(got) == len({(r.part, r.filter_order, r.step) for r in got}) == 600 * len(parts)
    for r in got:
        assert tuple(r)[3:9] == tuple(want[(r.part, r.filter_order, r.step, k)] for k in range(6))
        assert r.shapley == want[(r.part, r.filter_order[r.step - 1])]


def test_matrix_has_each_word_of_each_document_once(docs, rows):
    columns, got = defaultdict(set), Counter()
    for r in filter_audit.document_term_matrix(docs, 3000).collect():
        for k, i in enumerate(r.doc_id):
            entries = range(r.indptr[k], r.indptr[k + 1])
            assert len({r.indices[e] for e in entries}) == len(entries)
            got[(i, tuple(sorted(Counter({r.indices[e]: r.data[e] for e in entries}).items())))] += 1
    words = filter_audit.dictionary(filter_audit.coded_shards(docs, 3000)).collect()
    for r in words:
        columns[bytes(r.word).decode()].add(r.code)
    assert all(len(x) == 1 for x in columns.values())
    code = {k: next(iter(x)) for k, x in columns.items()}
    assert len(set(code.values())) == len(code)
    assert got == Counter((i, tuple(sorted((code[w], n) for w, n in Counter(WORD.findall(t or "")).items()))) for i, t, *_ in rows)


def test_what_a_task_holds_is_a_shard(spark, docs):
    """Arrays are cut into pieces, and the row groups of one task's many shards stay small; the dictionary joins the pieces again."""
    shards = filter_audit.coded_shards(docs, 3000, 40)
    arrays = [x for x, kind in shards.dtypes if kind.startswith("array")]
    for r in shards.collect():
        assert max(len(r[x]) for x in arrays) <= 40
    whole = lambda x: sorted((r.n_words, r.n_distinct, *r.doc) for r in x)
    counted = filter_audit._with_codes(shards, filter_audit._counted, filter_audit._COUNTED).selectExpr("n_words", "n_distinct", "array(coalesce(doc_id, -1), fails) as doc")
    assert whole(counted.collect()) == whole(filter_audit._with_codes(filter_audit.coded_shards(docs), filter_audit._counted, filter_audit._COUNTED).selectExpr("n_words", "n_distinct", "array(coalesce(doc_id, -1), fails) as doc").collect())

    text = "concat_ws(' ', transform(sequence(1, 900), x -> hex(xxhash64(id, x)))) as text"
    many = filter_audit.coded_shards(spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", text, "'s' as source"))
    files = [pq.ParquetFile(x.removeprefix("file://")).metadata for x in many.inputFiles()]
    groups = [m.row_group(k).total_byte_size for m in files for k in range(m.num_row_groups)]
    assert sum(groups) > 2 * filter_audit.ROW_GROUP and max(groups) < 2 * filter_audit.ROW_GROUP


def test_empty_texts_end_a_shard_too():
    shard = filter_audit._Shard()
    shard.add(next(textarrays.chunks(pa.array([""] * 1000))), pa.RecordBatch.from_pydict({"doc_id": [1] * 1000}))
    assert shard.bytes >= 32 * 1000  # what is kept of a document beside its text


def test_empty_tables(spark):
    none = spark.createDataFrame([], _DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(none, labels).count() == 0
    assert filter_audit.document_term_matrix(none).count() == 0
    assert quality_rank.rank_quality(none, labels).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_features_equal_plain_ones(rows):
    texts = [r[1] for r in rows]
    got = np.concatenate([quality_rank.features(c) for c in textarrays.chunks(pa.array(texts, pa.string()), 5000)])
    share = lambda a, b: a / b if b else 0.0
    for x, t in zip(got, texts, strict=True):
        t = t or ""
        w, raw = WORD.findall(t), t.encode()
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), y) for y in w]
        runs = list(zip(*(low[k:] for k in range(4))))
        lines = [y for y in t.split("\n") if WORD.search(y)]
        count = lambda chars: sum(t.count(y) for y in chars)
        want = [
            np.log1p(len(w)), np.log1p(len(t)), share(len("".join(w).encode()), len(w)), np.log1p(len(w) / max(1, len(lines))), share(len(re.findall("[A-Z]", t)), len(t)), share(len(re.findall("[0-9]", t)), len(t)),
            share(count("#$%&*+=<>@^_~{}[]\\/"), len(t)), share(count("!?"), len(t)), share(count("|"), len(t)), share(count(".,;:"), len(t)), share(sum(y >= 0xC2 for y in raw), len(t)),
            share(sum(bool(re.search(r"[#$%&*+=<>@^_~{}\[\]\\/]", y)) for y in w), len(w)), share(sum(a == b for a, b in zip(low, low[1:])), len(w)), share(len(set(low)), len(w)), share(len(runs) - len(set(runs)), len(runs)),
            share(len(lines) - len(set(lines)), len(lines)), share(sum(len(y.encode()) > 24 for y in w), len(w)), share(sum(len(y.encode()) == 1 for y in w), len(w)), share(sum(bool(re.match("[A-Z]", y)) for y in w), len(w)), share(sum(y[-1] in ".,;:" for y in lines), len(lines)),
        ]
        assert np.allclose(x, np.array(want, np.float32), atol=1e-5), (t[:40], dict(zip(quality_rank.FEATURES, zip(x, want), strict=True)))


def test_quality_ranking_of_odd_rows(spark, docs, rows, labels):
    got = quality_rank.rank_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in quality_rank.rank_quality(docs, one).collect()} == {(0.7, 1)}


def test_quality_ranking_parts_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in quality_rank.rank_quality(docs, labels).collect()}
    assert got == {r.doc_id: r for r in quality_rank.rank_quality(docs.drop("lang", "source").repartition(5), labels).collect()}
    held = [(got[r.doc_id].score, r.quality, got[r.doc_id].predicted) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out]
    pairs = [(a > b) + (a == b) / 2 for a, q, _ in held if q == 1 for b, p, _ in held if p == 0]
    assert len(held) > 50 and np.mean(pairs) > 0.97
    assert np.mean([p == q for _, q, p in held]) > 0.93


def test_pairs_alone_order_the_scores():
    """Labels that follow one feature come out in its order, whatever share of the rows is good."""
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(quality_rank.FEATURES))).astype(np.float32)
    for share in (0.1, 0.5, 0.9):
        good = x[:, 3] > np.quantile(x[:, 3], 1 - share)
        model = quality_rank.fit(x, good, 1 - share)
        score = model.scores(x)
        assert np.mean((score >= 0.7) == good) > 0.9
        assert abs(np.mean(score >= 0.7) - share) < 0.05


def test_every_labelled_row_is_learned_from(spark, monkeypatch):
    """More rows of each label than any sample of 5000: all meet in pairs or judge the threshold, and any order gives the same scores."""
    n = 30_000
    docs = spark.range(n).selectExpr("id as doc_id", "concat(repeat('word', cast(id % 7 as int)), ' and ', id, repeat(' go', cast(id % 11 as int))) as text")
    labels = spark.range(n).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    rows = quality_rank.featured(docs).cache()
    learnable = rows.where("not held_out").count()
    seen = []
    real_pairs, real_order = quality_rank.pair_groups, quality_rank.order_statistics

    def pairs(*args):
        out = real_pairs(*args)
        # labels are of one size: a group has one part of the commoner label, so no row stands twice
        seen.append(out.selectExpr("sum(size(good)) + sum(size(bad))").first()[0])
        return out

    def order(table, *args):
        seen.append(table.count())
        return real_order(table, *args)

    monkeypatch.setattr(quality_rank, "pair_groups", pairs)
    monkeypatch.setattr(quality_rank, "order_statistics", order)
    one = quality_rank.train(rows, labels)
    edges, learned, judged = seen
    assert edges == learnable > 20_000 and learned + judged == learnable
    two = quality_rank.train(rows.repartition(7), labels.repartition(3))
    assert (one.cut, one.slope, one.weight.tolist()) == (two.cut, two.slope, two.weight.tolist())
    x = np.array([r.x for r in rows.where("not held_out").collect()], np.float32)
    want = np.sort(x, axis=0)[[-(-k * len(x) // 16) - 1 for k in range(1, 16)]].T
    assert np.array_equal(one.edges, want)


@pytest.mark.parametrize("good, bad", [(3, 2000), (2000, 3), (700, 900)])
def test_pairs_of_a_group_all_meet(spark, good, bad):
    """However rare a label is, each row meets a row of the other label, and a pair once."""
    rng = np.random.default_rng(3)
    cells = [rng.integers(0, 16, len(quality_rank.FEATURES)).astype(np.uint8).tobytes() for _ in range(good + bad)]
    rows = spark.createDataFrame([(i, i < good, c) for i, c in enumerate(cells)], "doc_id long, good boolean, cells binary")
    met = Counter((bytes(a), bytes(b)) for r in quality_rank.pair_groups(rows, {True: good, False: bad}, 5).collect() for a in r.good for b in r.bad)
    assert {a for a, _ in met} == set(cells[:good]) and {b for _, b in met} == set(cells[good:])
    assert set(met.values()) == {1} and len(met) >= min(good, bad, quality_rank.GROUP // 2) * max(good, bad)


def test_order_statistics_are_exact(spark):
    values = [-3.5, -0.0, 0.0, 1e-30, 1.0000001, 1.0, 1.0, 7e30, -1e-3, 5.0]
    rows = spark.createDataFrame([([v, -v],) for v in values], "x array<float>").repartition(3)
    got = quality_rank.order_statistics(rows, lambda b: quality_rank._matrix(b.column("x")), 2, list(range(1, 11)))
    assert np.array_equal(got, np.sort(np.array([[v, -v] for v in values], np.float32), axis=0).T)


def brute_trie(turns):
    own, out = defaultdict(list), defaultdict(list)
    for c, turn, role, text, *_ in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    for c in own:
        own[c] = [x[2:] for x in sorted(own[c])]
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    for p in members:
        out[p] = [0, 0]
    children = Counter(p[:-1] for p in members if p)
    for p in members:
        for d in range(len(p) + 1):
            out[p[:d]][0] += children[p] == 0
            out[p[:d]][1] += (len(members[p]) - 1) * (len(WORD.findall(p[-1][1])) if p else 0)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], *out[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()
    )


def odd_turns(seed, n):
    rng = random.Random(seed)
    out = []
    for c in [*range(n), *range(-45, -5, 3), 10**12, 10**12 + 7]:
        size = rng.choice([1, 1, 2, 3, 3, 5, 9])
        for k in range(size):
            out.append((c, rng.choice([k, k, k, 0, None]), rng.choice(["user", "user", None, ""]), rng.choice(["a", "a", "a b", "b", None, "", "x" * 300]), 1, "k", 0, b"n"))
    out += [out[0], out[5], out[5], (None, 0, "user", "lost", 1, "k", 0, b"n")]
    out += [(500 + c, k, "user", f"deep {k}", 1, "k", 0, b"n") for c in range(3) for k in range(150 + c)]
    hot = [(2000 + c, k, "user", "same", 1, "k", 0, b"n") for c in range(60) for k in range(4)]
    rng.shuffle(out)
    return out + hot


@pytest.mark.parametrize(("parts", "fan"), [(None, 64), (1, 2), (5, 2), (16, 3), (60, 4)])
def test_prefix_trie(spark, monkeypatch, parts, fan):
    monkeypatch.setattr(prefix_trie, "FAN", fan)
    turns = odd_turns(parts or 9, 90)
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, part long, key string, depth long, name binary").repartition(3)
    got = prefix_trie.prefix_trie(df, parts).collect()
    assert sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *tuple(r)[3:]) for r in got) == brute_trie(turns)


def test_trie_of_one_and_of_turnless_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 1)  # its head comes from conversation 0, which is absent
    for turns in ([(lone, 0, "user", "hello")], [(20, 0, "user", "one two")], [(c, 0, "u", "t") for c in range(1, 19)]):
        got = prefix_trie.prefix_trie(spark.createDataFrame(turns, schema)).collect()
        assert sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *tuple(r)[3:]) for r in got) == brute_trie(turns)


def test_components_of_descending_edges_are_a_tree():
    depth, parent = prefix_trie._components(np.array([2, 3, 3, 1, 4]), np.array([2, 3, 1, 0]))
    # equal paths 1 and 2 hang together below path 0, which is a prefix of them; the others branch at depths 1 and 0
    assert depth.tolist() == [2, 3, 3, 1, 4, 1, 0]
    assert parent.tolist() == [5, 0, 1, 5, 6, 6, -1]
