"""Each operator on small tables with nulls, empty, long and repeated texts, ties and clashing columns."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyrook.llm import chat, decontaminate, jaccard_join, langid, licenses, mixing, repetition, suffix_dedup, textarrays, token_files, url_filter

_DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, n string, bucket int, items string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text, lower=True):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "") if lower else text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    names = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(2, 7))).replace(" ", "") or "x" for _ in range(400)]
    text = lambda n: " ".join(rng.choice(names) for _ in range(n))
    base, shared = text(120), text(60)
    out = [base, base, base.upper(), base.replace(" ", "\n", 3), base + " tail", " ".join(base.split()[:-1] + ["other"])]
    for _ in range(12):
        w = base.split()
        w[rng.randrange(len(w))] = rng.choice(names)
        out.append(" ".join(w))
    out += [text(80) + " " + shared + " " + text(50) for _ in range(6)] + [shared]
    out += [None, "", " \n\t ", "one", "one", "two words", "aaa " * 400, "x" * 3000, "é" * 2000, "ab" * 40]
    out += [" ".join([text(12)] * 4), "line of some words here\n" * 9, text(5000), "tie tie tie tie tie tie tie tie tie tie tie tie"]
    docs = [(i, t, ["en", "fr", None][i % 3], [None, "b", "a", "Z"][i % 4], 0, "s", "n", 1, "i") for i, t in enumerate(out)]
    return [*docs, docs[3], docs[20], (None, base, None, None, 0, "s", "n", 1, "i")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, _DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], _DOCS)


def shingles(text, n):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (2, 60)])
def test_jaccard_join(docs, rows, n, num):
    sets = {r[0]: shingles(r[1], n) for r in rows if r[0] is not None}
    top, links = {i: i for i in sets}, Counter()

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                top[b] = a
    got = jaccard_join.jaccard_join(docs, n, num, 100).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.n_links) == (len(sets[r.doc_id]), find(r.doc_id), links[r.doc_id])
    kept = {r.doc_id for r in jaccard_join.keep_one(docs, n, num, 100).collect()}
    assert kept == {i for i in sets if find(i) == i} | {None}


def test_blocks_of_a_family_lose_nothing(docs, monkeypatch):
    whole = sorted(map(tuple, jaccard_join.jaccard_join(docs, 3, 90, 100).na.fill(-1).collect()))
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    assert sorted(map(tuple, jaccard_join.jaccard_join(docs, 3, 90, 100).na.fill(-1).collect())) == whole


def test_t_occurrence_equals_all_pairs():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64)) for _ in range(80)]
    left, right = jaccard_join.t_occurrence(sets, 40, 100)
    want = {(i, j) for i in range(80) for j in range(i) if len(sets[i]) and len(sets[j]) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 40 * len(np.union1d(sets[i], sets[j]))}
    assert {tuple(sorted(p, reverse=True)) for p in zip(left.tolist(), right.tolist(), strict=True)} == want


@pytest.mark.parametrize(("x", "y", "both"), [(27, 27, 24), (26, 28, 24), (28, 28, 25)])
def test_short_sets_at_the_threshold_link(spark, x, y, both):
    """Pairs whose classes are partly empty, many of them: 24 of 30 is 0.8 exactly."""
    texts = []
    for seed in range(1500):
        w = [f"w{seed}x{i}" for i in range(x + y - both)]
        texts += [" ".join(w[:x]), " ".join(w[x - both :])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.jaccard_join(df, 1, 80, 100).collect()}
    assert got == {i: ((x, y)[i % 2], i - i % 2, 1) for i in range(len(texts))}


def _few_keys(pairs, n, levels):
    """Indices of pairs of texts whose class keys agree in fewer than K - d."""
    few, at_pair = [], 0
    for c in textarrays.chunks(pa.array([t for p in pairs for t in p], pa.string()), 1 << 40):
        _, value, first = textarrays.shingle_sets(c, n)
        at, key, lev, _ = jaccard_join.class_keys(value, first, levels)
        name = np.stack([lev.astype(np.uint64), key], 1)
        cuts = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[cuts], np.arange(len(c) + 1))
        for d in range(0, len(c), 2):
            level = int(levels.of(np.array([first[d + 1] - first[d]]))[0])
            x, y = ({tuple(k) for k in name[cuts[ends[e] : ends[e + 1]]].tolist() if k[0] == level} for e in (d, d + 1))
            fewest = levels.classes(level)
            few += [at_pair + d // 2] * (len(x & y) < fewest[1] - fewest[0])
        at_pair += len(c) // 2
    return few


@pytest.mark.parametrize(("n", "num", "words", "change", "seeds"), [(3, 90, 59, 29, range(32000, 41000)), (5, 80, 32, 2, range(4000))])
def test_pairs_that_share_few_class_keys_link(spark, n, num, words, change, seeds):
    """One changed word, Jaccard exactly 54/60 or 25/31: pairs that share fewer than K - d keys among them."""
    pairs = []
    for seed in seeds:
        w = [f"w{seed}x{i}" for i in range(words)]
        pairs.append((" ".join(w), " ".join([*w[:change], f"other{seed}", *w[change + 1 :]])))
    few = _few_keys(pairs, n, jaccard_join.Levels(num, 100))
    assert few
    pairs = [pairs[i] for i in few] + pairs[:300]
    a, b = (shingles(t, n) for t in pairs[0])
    assert 100 * len(a & b) >= num * len(a | b)
    df = spark.createDataFrame(list(enumerate(t for p in pairs for t in p)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.n_links for r in jaccard_join.jaccard_join(df, n, num, 100).collect()}
    assert all(v >= 1 for v in got.values()) and len(got) == 2 * len(pairs)


@pytest.mark.parametrize("num", [80, 90])
def test_borderline_pairs_of_all_sizes_link(spark, num):
    """10000 pairs of sets of 2 to 200 one-word shingles that differ as much as linked sets may."""
    rng, texts, sizes = random.Random(num), [], []
    while len(sizes) < 10000:
        x = rng.randint(2, 200)
        y = rng.randint(x, x * 100 // num)
        both = -(-num * (x + y) // (100 + num))
        if both <= x:
            w = [f"p{len(sizes)}w{i}" for i in range(x + y - both)]
            texts += [" ".join(w[:x]), " ".join(w[x - both :])]
            sizes.append((x, y))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.jaccard_join(df, 1, num, 100).collect()}
    assert got == {i: (sizes[i // 2][i % 2], i - i % 2, 1) for i in range(len(texts))}


def thue_morse(n):
    x = np.array([bin(i).count("1") & 1 for i in range(n)], np.uint8)
    return bytes(97 + x).decode(), bytes(98 - x).decode()


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_lines_and_texts_that_trick_polynomial_hashes(spark, n):
    """Thue-Morse strings: a polynomial modulo a power of two can't tell them from their complements."""
    a, b = thue_morse(n)
    spaced = " ".join(f"w{x}" for x in a), " ".join(f"w{x}" for x in b)
    texts = [a, b, f"{a} x y", f"{b} x y", f"{a}\n{b}\n{a}", *spaced, f"{spaced[0]} q {spaced[1]} r"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(df, 3, 90, 100).collect()}
    assert [got[i].component_id for i in range(5)] == [0, 1, 2, 3, 4]
    rules = {r.doc_id: r for r in repetition.quality_rules(df).collect()}
    assert (rules[4].n_dup_lines, rules[4].n_words) == (1, 3)
    for i in (5, 6, 7):
        w = "".join(x[-1] for x in words_of(texts[i]))
        tails = sorted(w[x:] for x in range(len(w)))
        assert rules[i].longest_repeat == max(len(os.path.commonprefix(p)) for p in zip(tails, tails[1:], strict=False))
    assert Counter(map(tuple, suffix_dedup.removal_digests(df).collect())) == removed([(i, t) for i, t in enumerate(texts)])
    items = spark.createDataFrame([(1, a), (2, f"{b} x y")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.containment_search(df, items).collect()} == {(0, 1), (3, 2)}


def test_number_of_long_lists():
    assert [jaccard_join.long_lists(54, m) for m in (2, 1024, 1 << 20)] == [53, 49, 46]
    assert jaccard_join.long_lists(1, 100) == 0


def test_empty_tables(spark, none):
    assert jaccard_join.jaccard_join(none, 3, 90, 100).count() == 0
    assert suffix_dedup.removal_digests(none).count() == 0
    assert repetition.quality_rules(none).count() == 0 and repetition.keep_good(none).count() == 0
    assert mixing.mix_plan(none).count() == 0 and token_files.token_counts(none).count() == 0
    assert langid.identify(none).count() == 0 and licenses.scan(none).count() == 0
    assert chat.format_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert decontaminate.containment_search(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontaminate.drop_contaminated(none, spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0
    assert suffix_dedup.cut_texts(none).count() == 0 and mixing.mixed(none).count() == 0


def removed(rows):
    texts = sorted(((2**63 if i is None else i, (t or "").encode()) for i, t, *_ in rows))
    first = {}
    for i, x in texts:
        for k in range(len(x) - 49):
            first.setdefault(x[k : k + 50], i)
    out = Counter()
    for i, x in texts:
        gone = bytearray(len(x))
        for k in range(len(x) - 49):
            if first[x[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out[(None if i == 2**63 else i, len(x), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest())] += 1
    return out


def test_suffix_dedup(docs, rows):
    assert Counter(map(tuple, suffix_dedup.removal_digests(docs).collect())) == removed(rows)
    cut = suffix_dedup.cut_texts(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert all(r.text is None or r.n_chars == len(r.text) for r in cut.collect())


def test_suffix_dedup_of_hot_anchors_and_null_ids(spark, monkeypatch):
    """Passages that most documents share, with different neighbours; many rows without a doc_id that copy others."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(25), text(40)]
    rows = [(rng.choice([i, None]), " ".join([text(rng.randint(0, 12)), rng.choice(shared), text(rng.randint(0, 12)), rng.choice(shared)])) for i in range(150)]
    rows += [(None, rows[i][1]) for i in range(40)] + [(7, rows[3][1]), (8, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    assert Counter(map(tuple, suffix_dedup.removal_digests(df).collect())) == removed(rows)
    for name, value in (("HOT", 2), ("_STRINGS", 5)):
        monkeypatch.setattr(suffix_dedup, name, value)
    assert Counter(map(tuple, suffix_dedup.removal_digests(df).collect())) == removed(rows)


def test_column_wise_rows_are_a_suffix_array():
    rng = np.random.default_rng(2)
    strings = [bytes(rng.integers(97, 100, rng.integers(1, 30)).astype(np.uint8)) for _ in range(60)]
    size = np.array([len(s) for s in strings])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    string, length, prefix = suffix_dedup.column_wise_rows(np.frombuffer(b"".join(strings), np.uint8), start, size)
    got = [strings[s][len(strings[s]) - n :] for s, n in zip(string.tolist(), length.tolist(), strict=True)]
    assert got == sorted(s[k:] for s in strings for k in range(len(s)))
    assert prefix.tolist() == [0, *(len(os.path.commonprefix(p)) for p in zip(got, got[1:], strict=False))]


def rules_of(t):
    """All that quality_rules() says of a text, in plain Python."""
    w = words_of(t, False)

    def covered(k):
        c = Counter(tuple(w[a : a + k]) for a in range(len(w) - k + 1))
        return len({x for a in range(len(w) - k + 1) if c[tuple(w[a : a + k])] > 1 for x in range(a, a + k)})

    most = next((k for k in range(1, len(w) + 1) if not covered(k)), len(w) + 1) - 1 if w else 0
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * covered(5) > 20 * len(w)
    kept = not failed and 100 * covered(10) <= 15 * len(w) and most <= 100
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), covered(5), covered(10), most, failed, kept


def test_repetition(docs, rows):
    want = Counter((i, *rules_of(t)) for i, t, *_ in rows)
    got = repetition.quality_rules(docs)
    assert Counter(map(tuple, got.collect())) == want
    assert repetition.keep_good(docs).count() == got.where("kept").count() and repetition.keep_good(docs).columns == docs.columns


def test_token_counts(docs, rows):
    encode = token_files.encoder().encode_ordinary
    want = Counter((r[0], len(encode(r[1] or ""))) for r in rows)
    for size in (7, 1000, 1 << 20):
        assert Counter(map(tuple, token_files.token_counts(docs, block_tokens=size).collect())) == want


def test_token_files_without_a_last_separator(spark, tmp_path):
    end = token_files.END_OF_DOCUMENT
    np.array([1, 2, end, end, 3, 4, 5], np.uint16).tofile(tmp_path / "a.bin")
    np.array([9] * 25, np.uint16).tofile(tmp_path / "b.bin")
    for size in (2, 3, 100):
        got = token_files.separator_counts(token_files.token_blocks(spark, f"file://{tmp_path}", size))
        assert sorted((r.file[-5], r.ordinal, r.n_tokens, r.ended) for r in got.collect()) == [("a", 0, 2, True), ("a", 1, 0, True), ("a", 2, 3, False), ("b", 0, 25, False)]


def test_decontamination(spark, docs, rows):
    items = [(1, rows[0][1][:200]), (2, " ".join(words_of(rows[20][1])[80:110])), (3, "nothing of this stands anywhere at all"), (4, "one"), (5, None), (6, ""), (7, "tie tie tie tie tie tie tie")]
    items = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for i, t in map(tuple, items.collect()):
        q = shingles(t, 5)
        for r in rows:
            n = len(q & shingles(r[1], 5))
            if q and 100 * n >= 80 * len(q):
                want[(r[0], i, len(q), n)] += 1
    assert Counter(map(tuple, decontaminate.containment_search(docs, items).collect())) == want
    dirty = {k[0] for k in want}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()} == {r[0] for r in rows} - dirty


def test_blocks_and_groups_of_items(spark, docs, monkeypatch):
    items = spark.createDataFrame([(i, r.text[k : k + 300]) for i, (k, r) in enumerate((k, r) for r in docs.where("length(text) > 500").collect() for k in (0, 150))], "item_id long, text string")
    whole = Counter(map(tuple, decontaminate.containment_search(docs, items).collect()))
    kept = Counter(r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(decontaminate, "GROUP", 2)
    assert Counter(map(tuple, decontaminate.containment_search(docs, items).collect())) == whole
    assert Counter(r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()) == kept
    assert decontaminate.containment_search(docs, items.limit(0)).count() == 0 and decontaminate.drop_contaminated(docs, items.limit(0)).count() == docs.count()


def test_mix_of_many_sources_is_the_same_without_a_broadcast(docs, monkeypatch):
    rows = sorted(map(tuple, mixing.mix_plan(docs).na.fill(-1).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 1)
    assert sorted(map(tuple, mixing.mix_plan(docs).na.fill(-1).collect())) == rows
    assert mixing.mixed(docs).columns == [*[x for x in docs.columns if x != "size"], "size", "source_size", "target", "taken"]


def test_mixing(docs, rows):
    got = mixing.mix_plan(docs).collect()
    assert len(got) == len(rows) and got and sorted(map(tuple, mixing.mix_plan(docs.repartition(5)).na.fill(-1).collect())) == sorted(map(tuple, mixing.mix_plan(docs).na.fill(-1).collect()))
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    size, total = defaultdict(int), sum(len(words_of(r[1])) for r in rows)
    for r in rows:
        size[r[3]] += len(words_of(r[1]))
    goal = {r.source_size: r.target for r in got}
    assert abs(sum(goal[s] for s in size.values()) - 1.5 * total) < 1 and all(goal[s] <= 2 * s for s in size.values())
    taken = defaultdict(int)
    for r in got:
        taken[r.target] += r.taken
    assert all(abs(t - v) <= 10 for t, v in taken.items())
    assert mixing.mixed(docs).where("taken = 0").count() == 0


@pytest.mark.parametrize("total", [10, 150, 199, 500])
def test_water_filling(spark, total):
    sizes = [("a", 100), ("b", 1), ("c", 50), (None, 7), ("d", 0)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long"), (3, 1, 2), total, 2).collect()}
    weights = {"a": 3, "b": 1, "c": 2, "d": 3, None: 1}
    caps = {s: 2 * n for s, n in sizes}
    want, left, full = 158 * total / 100, dict(weights), {}
    while left:
        level = (want - sum(full.values())) / sum(left.values())
        over = [s for s in left if caps[s] <= left[s] * level]
        if not over:
            break
        for s in over:
            full[s] = caps[s]
            del left[s]
    full |= {s: w * level for s, w in left.items()}
    assert all(abs(got[s] - full[s]) < 1e-6 for s in full)


def test_urls(spark):
    cases = {
        "http://A.Example.COM/en/x?q#f": ("a.example.com", "/en/x", "example.com/en/", "block"), "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "x://net/fr/": ("net", "/fr/", "net/fr/", "block"), "http://b.com": ("b.com", "", None, None), "http://b.com/": ("b.com", "/", "com/", "allow"), "b.net/es/": ("", "", None, None),
        None: ("", "", None, None), "http://É.net/es/1": ("É.net", "/es/1", "net/es/", "block"), "http://xcom/a": ("xcom", "/a", None, None),
    }
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(3, 0, 0), (3, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, labels).collect()}
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in (("allow", "block") if verdict is None else (verdict,))


def test_reputation_blocks_bad_hosts(spark):
    hosts = [(f"h{i}.site{i % 5}.org", 40, 1) for i in range(30)] + [("bad.site0.org", 40, 38), ("new.site9.org", 0, 0)]
    low = {r.site: r.low for r in url_filter.host_reputation(spark.createDataFrame(hosts, "site string, n long, bad long")).collect()}
    assert low["bad.site0.org"] > 0.25 and all(v < 0.25 for h, v in low.items() if h != "bad.site0.org")


def test_sites_domains_and_suffixes(spark):
    cases = {
        "u:p@www.example.com:8080": ("www.example.com", "example.com", "com"), "example.com.": ("example.com", "example.com", "com"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1", "ip"),
        "[::1]:80": ("[::1]", "[::1]", "ip"), "a.b.co.uk": ("a.b.co.uk", "b.co.uk", "co.uk"), "x.com.mx": ("x.com.mx", "x.com.mx", "com.mx"), "me.github.io": ("me.github.io", "me.github.io", "github.io"),
        "": ("", "", ""), "localhost": ("localhost", "localhost", "localhost"),
    }
    df = spark.createDataFrame([(h,) for h in cases], "host string").withColumn("site", url_filter.site_of(F.col("host")))
    got = df.select("host", "site", url_filter.registered_domain(F.col("site")).alias("d"), url_filter.suffix(F.col("site")).alias("s")).collect()
    assert {r.host: (r.site, r.d, r.s) for r in got} == cases


def test_urls_of_empty_tables_and_scans(spark, tmp_path):
    none, no_labels = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert url_filter.filter_urls(none, no_labels).count() == 0
    pages = spark.createDataFrame([(1, "http://a.org/" + "x" * 100_000), (None, "http://b.org"), (1, "http://a.org/")], "page_id long, url string")
    assert {r.verdict for r in url_filter.filter_urls(pages, no_labels).collect()} == {"allow"}
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    plan = url_filter.filter_urls(spark.read.parquet(f"{tmp_path}/pages.parquet"), no_labels)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "NestedLoop" not in plan and "Cartesian" not in plan


def test_chat_round_trip(spark):
    nasty = ["<|im_start|>", "a<|part|>b\\", "[INST] x [/INST]</s>", "\\<\\[", "", None, "é😀<|im_end|>\n", "<", "[\\"]
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "sys<|tem", None]), rng.choice(nasty)) for c in (1, 2, None) for t in (*range(12), 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_conversations(df).withColumn("t", chat.turns_of("formatted")).collect()}
    digests = {r.conv_id: r for r in chat.format_digests(df).collect()}
    for c, r in out.items():
        want = sorted((t, role or "", text or "") for k, t, role, text in rows if k == c)
        assert [(x.role, x.text) for x in r.t] == [(b, d) for _, b, d in want]
        assert "".join(s.text for s in r.segments) == r.formatted
        loss = "".join(d for _, b, d in want if b == "assistant")
        assert digests[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and digests[c].loss_chars == len(loss)


def test_language_identification(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(9001, None, None), (9002, "123 !!", "en"), (None, "the and of the", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs.select("doc_id", "text", "lang").union(extra)).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    tested = [i for i in truth if got[i].held_out]
    assert tested and np.mean([got[i].lang_pred == truth[i] for i in tested]) > 0.97
    assert (got[9001].lang_pred, got[9001].score, got[9002].lang_pred) == ("und", 0.0, "und") and got[None].held_out is False
    assert all(0 <= r.score <= 1 for r in got.values())


@pytest.mark.parametrize("languages", [3, 40])
def test_predictions_equal_plain_ones(spark, languages):
    """Each prediction against its own features, one byte string at a time, and the same model."""
    rng = random.Random(languages)
    words = {k: ["".join(rng.choice("abcdefgé漢"[k % 7 :] + "xyz") for _ in range(rng.randint(1, 6))) for _ in range(30)] for k in range(languages)}
    rows = [(i, " ".join(rng.choice(words[i % languages]) for _ in range(rng.randint(1, 40))), f"l{i % languages}") for i in range(languages * 30)] + [(9000, "", "l0"), (9001, "É", "l1"), (9002, "a1b--C", None)]
    df = spark.createDataFrame([(*r, "en", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    model = langid.train(df, epochs=2)
    assert len(model.languages) == languages and (model.weight is None) == (languages <= langid.DIM)
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    for i, text, _ in rows:
        data = " " + re.sub("[^a-z\x80-\uffff]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)) + " "
        data, found = data.encode(), []
        for n in (2, 3, 4):
            for k in range(len(data) - n + 1):
                x = data[k : k + n]
                if b" " not in x[1:-1] if n > 2 else x != b"  ":
                    found.append((((int.from_bytes(x, "big") ^ n * 0x45D9F3B) & 0xFFFFFFFF) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - langid.HASH_BITS))
        if not re.search(r"[^\W\d_]", text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        p = model.probabilities(model.table[found].astype(float).mean(0, keepdims=True))[0]
        assert got[i].lang_pred == model.languages[int(p.argmax())] and abs(got[i].score - p.max()) < 1e-5


def test_only_the_most_frequent_languages_are_learned(spark):
    df = spark.createDataFrame([(i, f"word{i % 5} and more", f"l{i % 5}" if i % 7 else "l0") for i in range(200)], "doc_id long, text string, lang string")
    assert langid.train(df, max_languages=2, epochs=1).languages[0] == "l0"


def test_licences(spark):
    texts = ["Some words.\nReleased under the MIT License.", "Licensed under CC BY-NC 4.0.", "nothing here", None, "", "He got a driving license in may.\nThe source was copied."]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, row string").union(spark.createDataFrame([(0, texts[0], "x")], "doc_id long, text string, row string"))
    got = sorted((r.doc_id, r.family) for r in licenses.scan(df).collect())
    assert got == [(0, "mit"), (0, "mit"), (1, "cc-by-nc-4.0"), (2, "unknown"), (3, "unknown"), (4, "unknown"), (5, "unknown")]


def test_licence_scores_equal_plain_ones(spark):
    """Each text against a plain-Python version of scoring with the same model: lines, runs of lines, confirmation."""
    rng = random.Random(12)
    sentences = [x for family in licenses.TEMPLATES.values() for x in family]
    broken = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files (the Software), to deal in the\nSoftware without restriction."
    texts = [broken, "Nothing.\n\n" + broken.replace("\n", "\n  ") + "\nmore", None, "", "\n\n", "Über die Brücke. MIT", "word " * 30_000 + "All rights reserved."]
    for _ in range(150):
        lines = []
        for _ in range(rng.randint(1, 5)):
            w = rng.choice([*sentences, *licenses.NEUTRAL, "", "plain words of no law", "the license of the copy"]).split()
            a = rng.randint(0, len(w) // 2)
            lines.append(" ".join(w[a : a + rng.randint(1, 30)]))
        texts.append("\n".join(lines))
    df = spark.createDataFrame([*((i, t, "x", 1) for i, t in enumerate(texts)), (None, broken, "x", 1)], "doc_id long, text string, family string, x int").repartition(3)
    model = licenses.train(df)
    sure, place = {*licenses.CUES, *licenses.PAIRS}, {g: k for k, g in enumerate(licenses.GRAMS)}
    shapes = {f: [licenses._grams(licenses._words(x)) for x in family] for f, family in licenses.TEMPLATES.items()}
    want = {}
    for i, text in [*enumerate(texts), (None, broken)]:
        lines, run, units, runs = (text or "").split("\n"), [], [], []
        for line in [*lines, None]:
            w = licenses._words(line or "")
            if line is not None and (licenses._grams(w) & sure or 0 < len(w) <= licenses.SHORT and {*w} <= licenses._WORDS):
                units.append(line)
                run.append(line)
            else:
                runs += ["\n".join(run)] if len(run) > 1 else []
                run = []
        sure_ones = []
        for j, u in enumerate([*units, *runs]):
            g = licenses._grams(licenses._words(u))
            z = (model.weights[[place[x] for x in sorted(g) if x in place]].sum(0) + model.bias) / model.temperature
            can = [f == "unknown" or any({*x} <= g for x in licenses.KEYS[f]) and not {*licenses.RIVALS.get(f, ())} & g for f in model.families]
            z = np.where(can, z, -1e9)
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            k = model.families[int(p.argmax())]
            if k != "unknown" and p.max() >= model.least:
                alike = max(len(t & g) / min(len(t), max(1, len(g))) for t in shapes[k]) >= 0.6
                sure_ones.append((k, p.max(), alike, j < len(units), bool(g & {*licenses.STRONG})))
        ok = [x for x in sure_ones if x[2]]
        if any(x[0] != licenses.WEAK for x in ok):
            ok = [x for x in ok if x[0] != licenses.WEAK or x[4]]
        best = max(((round(x[1], 6), -j, x[0]) for j, x in enumerate(ok)), default=(0.0, 0, "unknown"))
        want[i] = (len(lines), len(units), sorted({x[0] for x in ok}), best[2], sum(x[3] and not x[2] for x in sure_ones)), best[0]
    got = {r.doc_id: ((r.n_paragraphs, r.n_candidates, r.families, r.family, r.n_unconfirmed), r.score) for r in licenses.scan(df, model).collect()}
    assert {i: r[0] for i, r in got.items()} == {i: r[0] for i, r in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 1e-5 for i in want)
    assert [want[i][0][2:4] for i in (0, 1, None)] == [(["mit"], "mit")] * 3


def _wrapped(text, width, head=""):
    lines, line = [], head
    for w in text.split():
        if len(line) + len(w) >= width and line != head:
            lines.append(line.rstrip())
            line = head
        line += w + " "
    return "\n".join([*lines, line.rstrip()])


#: Licence texts as they stand in files, none a template of the model's as it is, and what they declare.
_GNU = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version. This {} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. You should have received a copy of the GNU {}General Public License along with this {}."
_MIT = 'MIT License Copyright (c) 2021 Someone Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
_BSD = "Copyright (c) 2019, Someone. All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.'
_FILES = {
    "wrapped mit": (_wrapped(_MIT, 70), ["mit"]),
    "mit behind slashes": (_wrapped(_MIT, 76, "// "), ["mit"]),
    "apache behind hashes": (_wrapped(_APACHE, 66, "# "), ["apache-2.0"]),
    "bsd-2": (_wrapped(_BSD.format(""), 72), ["bsd-2-clause"]),
    "bsd-3": (_wrapped(_BSD.format(_THIRD), 72), ["bsd-3-clause"]),
    "mpl": (_wrapped("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", 70, " * "), ["mpl-2.0"]),
    "lgpl-2.1": (_wrapped(_GNU.format("library", ";", "Lesser ", ";", "2.1", "library", "Lesser ", "library"), 68), ["lgpl-2.1"]),
    "lgpl-3": (_wrapped(_GNU.format("program", ":", "Lesser ", ",", "3", "program", "Lesser ", "program"), 68), ["lgpl-3.0"]),
    "agpl": (_wrapped(_GNU.format("program", ":", "Affero ", ",", "3", "program", "Affero ", "program"), 75, "# "), ["agpl-3.0"]),
    "gpl-2": (_wrapped(_GNU.format("program", ";", "", ";", "2", "program", "", "program"), 72), ["gpl-2.0"]),
    "gpl-3": (_wrapped(_GNU.format("program", ":", "", ",", "3", "program", "", "program"), 72), ["gpl-3.0"]),
    "isc": (_wrapped("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", 72), ["isc"]),
    "cc0": (_wrapped("To the extent possible under law, Someone has waived all copyright and related or neighboring rights to this work. It is published under CC0 1.0 Universal.", 80), ["cc0-1.0"]),
    "warranty alone": (_wrapped(_WARRANTY, 74), []),
    "gnu without version": ("You should have received a copy of the GNU General Public License along with this program.", []),
    "redistribution alone": ("Redistribution and use in source and binary forms, with or without modification, are permitted.", []),
    "a report": ("The general public may obtain a copy of the report, version 3 of which was published by the foundation.", []),
    "a permit": ("Permission to fish was granted to any person with a license, without a fee, in the public part of the river.", []),
}


def test_licence_texts_of_files(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(_FILES.values())], "doc_id long, text string")
    model = licenses.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    got = {r.doc_id: r.families for r in licenses.scan(df, model).collect()}
    assert {name: got[k] for k, name in enumerate(_FILES) if got[k] != _FILES[name][1]} == {}


def test_candidates_lose_no_licence_text(spark, monkeypatch):
    """Scoring every line instead of candidates finds nothing more, in texts that are no templates."""
    df = spark.createDataFrame([(k, _wrapped(t, width)) for k, (t, width) in enumerate((t.replace("\n", " "), w) for t, _ in _FILES.values() for w in (24, 40, 66, 100, 1000))], "doc_id long, text string")
    model = licenses.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    some = {r.doc_id: r.families for r in licenses.scan(df, model).collect()}
    monkeypatch.setattr(licenses, "may_declare", lambda words: F.size(words) >= 0)
    every = {r.doc_id: r.families for r in licenses.scan(df, model).collect()}
    assert sum(map(len, every.values())) > 40
    assert {k for k in every if set(every[k]) - set(some[k])} == set()


def test_licence_candidates_do_not_depend_on_other_lines(spark):
    plain = ["all of the boats came home before dark that night", "we saw all rivers and any hill from there", "it can be seen with or without a glass by the water"]
    texts = ["All rights reserved.", "first line\nsecond line\nthird line\nAll rights reserved.", "rights reserved", *plain]
    got = {r.doc_id: (r.n_candidates, r.family) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i][1] for i in range(6)] == ["proprietary"] * 3 + ["unknown"] * 3
    assert [got[i][0] for i in range(3)] == [1, 1, 1]


def test_sample_of_unknown_lines(spark):
    """Distinct lines of whole texts, without those that overlap a template."""
    texts = ["one line that is common to all texts\n" * 3 + f"line {i} stands deep in its text\nReleased under the terms of the MIT" for i in range(40)]
    got = licenses.unknown_lines(spark.createDataFrame([(t,) for t in texts], "text string"), 500, 5)
    assert sorted(got) == sorted(["one line that is common to all texts", *(f"line {i} stands deep in its text" for i in range(40))])
    assert licenses.unknown_lines(spark.createDataFrame([(t,) for t in texts], "text string"), 7, 5) == got[:7]


def test_words_at_chunk_edges():
    texts = ["a b", "", None, "c", "é f"]
    for size in (1, 3, 100):
        found = []
        for c in textarrays.chunks(pa.array(texts, pa.string()), size):
            w = textarrays.words(c)
            found += [bytes(c.data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)]
        assert found == ["a", "b", "c", "é", "f"]


def test_pipeline_stages(spark, tmp_path, docs, rows):
    """run() against a brute-force version of its stages."""
    import corpus_pipeline

    names_of = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(*names_of).write.parquet(f"{tmp_path}/documents.parquet")
    item = " ".join(words_of(rows[20][1])[:40])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [r for r in rows if rules_of(r[1])[-1]]
    sets = {r[0]: shingles(r[1], 5) for r in left if r[0] is not None}
    group = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    group[i] = group[j] = min(group[i], group[j])
    left = [r for r in left if r[0] is None or group[r[0]] == r[0]]
    order = sorted(left, key=lambda r: 2**63 if r[0] is None else r[0])
    first, texts = {}, []
    for r in order:
        x = r[1].encode()
        for k in range(len(x) - 49):
            first.setdefault(x[k : k + 50], r[0])
    for r in order:
        x, gone = r[1].encode(), set()
        for k in range(len(x) - 49):
            if first[x[k : k + 50]] != r[0]:
                gone |= set(range(k, k + 50))
        chars, at = [], 0
        for char in r[1]:
            n = len(char.encode())
            if not set(range(at, at + n)) <= gone:
                chars.append(char)
            at += n
        texts.append((r[0], "".join(chars), r[3]))
    q = shingles(item, 5)
    texts = [x for x in texts if 100 * len(q & shingles(x[1], 5)) < 80 * len(q)]
    # the mix: water-filling, then whole repetitions and the buckets that make up the rest
    size = Counter()
    for _, x, source in texts:
        size[source] += len(words_of(x))
    names = sorted(size, key=lambda x: (x is None, x or ""))
    weights = {x: (3, 1, 2)[k % 3] for k, x in enumerate(names)}
    full, open_ = {}, dict(weights)
    while open_:
        level = (1.5 * sum(size.values()) - sum(full.values())) / sum(open_.values())
        over = [x for x in open_ if 2 * size[x] <= open_[x] * level]
        if not over:
            break
        for x in over:
            full[x] = 2 * size[x]
            del open_[x]
    target = full | {x: w * level for x, w in open_.items()}
    bucket = lambda i: int(hashlib.md5(f"7:{'' if i is None else i}".encode()).hexdigest()[:3], 16)
    inside = Counter()
    for i, x, source in texts:
        inside[source, bucket(i)] += len(words_of(x))
    want = Counter()
    for i, x, source in texts:
        n, whole = len(words_of(x)), int(target[source] // size[source]) if size[source] else 0
        before = sum(v for (z, k), v in inside.items() if z == source and k < bucket(i))
        share = min(1.0, max(0.0, (target[source] - whole * size[source] - before) / inside[source, bucket(i)])) if inside[source, bucket(i)] else 0
        taken = n * whole + int(n * share + 0.5)
        want[(i, x, taken)] += taken > 0
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert set(names_of) <= set(got.columns)
    assert Counter((r.doc_id, r.text, r.taken) for r in got.collect()) == +want
    assert len(+want) > 5


def test_clashing_names_and_long_texts(spark):
    extra = "lang_pred string, score double, held_out boolean, family string, segments string, formatted string, t string"
    long = "Released under the MIT License. " * 2 + "x" * 300_000
    rows = [(1, long, "en", *["c", 0.5, True, "f", "s", "o", "t"]), (None, "All rights reserved.", "fr", *["c", 0.5, True, "f", "s", "o", "t"]), (None, "All rights reserved.", None, *["c", 0.5, True, "f", "s", "o", "t"])]
    df = spark.createDataFrame(rows, f"doc_id long, text string, lang string, {extra}")
    assert sorted((r.family, r.n_candidates) for r in licenses.scan(df).collect()) == [("mit", 1), ("proprietary", 1), ("proprietary", 1)]
    assert langid.identify(df).count() == 3
    turns = spark.createDataFrame([(1, 0, "user", "a", "z", "y", "x"), (1, 1, "user", "b", "z", "y", "x")], "conv_id long, turn long, role string, text string, t string, segments string, formatted string")
    assert [(r.conv_id, r.n_turns) for r in chat.format_digests(turns).collect()] == [(1, 2)]


def test_equal_texts_of_a_chunk_are_compared_by_bytes():
    """Texts whose hashes agree are one text only if their bytes are the same; windows' hashes are those of single ranges."""
    texts = ["one text", "two text", "two text", "", None, "one text"]
    c = next(iter(textarrays.chunks(pa.array(texts, pa.string()))))
    same = suffix_dedup._same_text(c, np.array([0, 1, 2, 3, 4, 5]), np.array([7, 7, 7, 9, 9, 7]))
    assert same.tolist() == [False, False, True, False, True, False]
    data = np.frombuffer("Zwölf Boxkämpfer jagen Viktor".encode() * 9, np.uint8)
    at = np.arange(len(data) - 24)
    assert np.array_equal(textarrays.window_hashes(data, 25), textarrays.rolling_hashes(data, at, at + 25))
