"""Quality scores by Bradley-Terry pairwise ranking.

A document has a strength w.x of its features x; that a document labelled good is preferred to one labelled bad has the
probability sigmoid(w.(x_good - x_bad)), and w minimises the logistic loss on the feature differences of pairs, by gradient
descent with curvature from the steps before (L-BFGS). A feature is a property of the whole text (lengths, shares of kinds of
characters, repetition of words and lines), cut into bins at its quantiles. The share of bad rows among the labelled names the
quantile of the strengths that is the threshold, and a document's score is 0.7 there, falls and rises with its strength, and
is calibrated by one slope on rows that the fit leaves out.

Every labelled row that isn't held out is learned from, none is sampled. Texts are read once, for their features, which are written
beside doc_id. Quantiles are exact: counts of a value's upper 16 bits, then of the lower ones where a quantile falls. A quarter of the
rows, by a hash, is for the threshold and slope; of the others, those of the rarer label are dealt into groups of about GROUP, and each is
paired with all rows of the other label in its group. A round of the fit is one pass over the groups, of which each task sends one
vector; sums are integers, so neither the order of rows nor the number of tasks changes a score.
Rows whose crc32(doc_id as text) mod 4 is 2 are held out and never learned from.

Cases: a null text is empty, an empty text has a strength and score like any; a null doc_id has held_out false, and no
label; of repeated labels of one doc_id the least counts, for each of its rows; without good or without bad labelled rows every score is 0.7; rows
are scored one by one; an empty table gives no rows; other columns are ignored. A task holds one chunk of texts, or its longest text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyrook.llm import textarrays as ta
from tallyrook.session import materialize

THRESHOLD, BINS, GROUP = 0.7, 16, 128
_UNIT = float(1 << 50)  # sums of shares are added as integers of this unit
_SLOPES = np.geomspace(0.05, 20, 40)
_LINE_END = 10


def _class(*ranges) -> np.ndarray:
    out = np.zeros(256, bool)
    for r in ranges:
        out[[ord(x) for x in r] if isinstance(r, str) else list(r)] = True
    return out


_UPPER, _LOWER_CASE, _DIGIT = _class(range(65, 91)), _class(range(97, 123)), _class(range(48, 58))
_SYMBOL, _LOUD, _BAR, _STOP = _class("#$%&*+=<>@^_~{}[]\\/"), _class("!?"), _class("|"), _class(".,;:")
FEATURES = (
    "log_words", "log_chars", "word_length", "line_words", "upper", "digit", "symbol", "loud", "bar", "stop", "wide", "symbol_words", "same_as_last",
    "distinct_words", "repeated_runs", "repeated_lines", "long_words", "single_words", "capital_words", "stop_lines",
)


def features(c: ta.Chunk) -> np.ndarray:
    """FEATURES of each document of a chunk."""
    docs, data = len(c), c.data
    w = ta.words(c)
    n = w.counts().astype(np.float64)
    length = w.end - w.start
    ahead = np.zeros(len(data) + 1, np.int64)

    def of_bytes(mask: np.ndarray) -> np.ndarray:
        np.cumsum(mask, out=ahead[1:])
        return (ahead[c.offsets[1:]] - ahead[c.offsets[:-1]]).astype(np.float64)

    def of_words(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return (total[w.first[1:]] - total[w.first[:-1]]).astype(np.float64)

    def in_words(mask: np.ndarray) -> np.ndarray:
        np.cumsum(mask, out=ahead[1:])
        return ahead[w.end] > ahead[w.start]

    points = of_bytes((data & 0xC0) != 0x80)
    some, any_ = np.maximum(points, 1), np.maximum(n, 1)
    name = ta.span_hashes(data, w.start, w.end, True)
    _, _, first = ta.distinct_rows(w.doc, name, docs)
    again = np.zeros(len(name), bool)
    again[1:] = (name[1:] == name[:-1]) & (w.doc[1:] == w.doc[:-1])
    runs = ta.run_hashes(name, 4)
    whole = w.doc[: len(runs)] == w.doc[3 : 3 + len(runs)]
    run_doc = w.doc[: len(runs)][whole]
    _, _, run_first = ta.distinct_rows(run_doc, runs[whole], docs)
    n_runs = np.bincount(run_doc, minlength=docs).astype(np.float64)
    cut = np.unique(np.concatenate([c.offsets, np.flatnonzero(data == _LINE_END) + 1]))
    start, end = cut[:-1], cut[1:].copy()
    end[data[end - 1] == _LINE_END] -= 1
    np.cumsum(~ta._SPACE[data], out=ahead[1:])
    filled = ahead[end] > ahead[start]
    start, end = start[filled], end[filled]
    line_doc = np.searchsorted(c.offsets, start, "right") - 1
    _, _, line_first = ta.distinct_rows(line_doc, ta.span_hashes(data, start, end, False), docs)
    lines = np.bincount(line_doc, minlength=docs).astype(np.float64)
    stopped = np.bincount(line_doc, _STOP[data[end - 1]], docs) if len(end) else np.zeros(docs)
    columns = {
        "log_words": np.log1p(n), "log_chars": np.log1p(points), "word_length": of_bytes(~ta._SPACE[data]) / any_, "line_words": np.log1p(n / np.maximum(lines, 1)),
        "upper": of_bytes(_UPPER[data]) / some, "digit": of_bytes(_DIGIT[data]) / some, "symbol": of_bytes(_SYMBOL[data]) / some, "loud": of_bytes(_LOUD[data]) / some,
        "bar": of_bytes(_BAR[data]) / some, "stop": of_bytes(_STOP[data]) / some, "wide": of_bytes(data >= 0xC2) / some, "symbol_words": of_words(in_words(_SYMBOL[data])) / any_,
        "same_as_last": of_words(again) / any_, "distinct_words": np.diff(first) / any_, "repeated_runs": 1 - np.diff(run_first) / np.maximum(n_runs, 1) * (n_runs > 0) - (n_runs == 0),
        "repeated_lines": 1 - np.diff(line_first) / np.maximum(lines, 1) - (lines == 0), "long_words": of_words(length > 24) / any_, "single_words": of_words(length == 1) / any_,
        "capital_words": of_words(_UPPER[data[w.start]]) / any_ if len(w.start) else np.zeros(docs), "stop_lines": stopped / np.maximum(lines, 1),
    }
    return np.stack([columns[k] for k in FEATURES], 1).astype(np.float32)


@dataclass
class Model:
    edges: np.ndarray  # of each feature, where its bins end
    weight: np.ndarray  # of each feature and bin
    slope: float
    cut: float  # the strength whose score is THRESHOLD

    def strengths(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for j in range(len(self.edges)):
            out += self.weight[j, np.searchsorted(self.edges[j], x[:, j], "left")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.slope * (self.strengths(x) - self.cut), -500, 500)
        return 1 / (1 + (1 / THRESHOLD - 1) * np.exp(-z))


def held_out() -> F.col:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _bins(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A row's bins."""
    return np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(len(edges))], 1).astype(np.uint8)


def pair_sums(weight: np.ndarray, good: np.ndarray, bad: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Over all pairs of a good and a bad row (of bins): the sum of the loss, and of its slope in each weight."""
    place = np.arange(len(FEATURES)) * bins
    good, bad = good + place, bad + place
    strong, weak = weight[good].sum(1), weight[bad].sum(1)
    loss, missed, miss_of = 0.0, np.zeros(len(bad)), np.empty(len(good))
    for k in range(0, len(good), 512):
        gap = weak[None, :] - strong[k : k + 512, None]
        loss += np.logaddexp(0, gap).sum()
        miss = 1 / (1 + np.exp(-np.clip(gap, -500, 500)))
        missed += miss.sum(0)
        miss_of[k : k + 512] = miss.sum(1)
    each = len(FEATURES)
    slope = np.bincount(bad.ravel(), np.repeat(missed, each), len(weight)) - np.bincount(good.ravel(), np.repeat(miss_of, each), len(weight))
    return np.append(loss, slope)


def descend(measure: Callable[[np.ndarray], np.ndarray], size: int, rounds: int = 40, decay: float = 1e-4, memory: int = 10) -> np.ndarray:
    """The weights that minimise the mean loss of the pairs, and decay on their squares; measure(w) gives pair_sums() as means."""

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        m = measure(w)
        return float(m[0] + decay / 2 * (w @ w)), m[1:] + decay * w

    w = np.zeros(size)
    loss, slope = at(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, shares = -slope, []
        for s, y in reversed(past):
            shares.append((s @ way) / (s @ y))
            way = way - shares[-1] * y
        way = way * (past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1e-12, np.abs(slope).sum()))
        for (s, y), share in zip(past, reversed(shares), strict=True):
            way = way + (share - (y @ way) / (s @ y)) * s
        step, down = 1.0, slope @ way
        for _ in range(12):
            new_loss, new_slope = at(w + step * way)
            if new_loss <= loss + 1e-4 * step * down:
                break
            step /= 2
        else:
            break
        s, y = step * way, new_slope - slope
        if s @ y > 1e-14:
            past = [*past, (s, y)][-memory:]
        done = loss - new_loss < 1e-6
        w, loss, slope = w + s, new_loss, new_slope
        if done:
            break
    return w


def slope_losses(model: Model, x: np.ndarray, good: np.ndarray, unit: float = float(1 << 32)) -> np.ndarray:
    """For each of _SLOPES the sum of the rows' logistic losses, each an integer of so small a unit: no order of rows changes it."""
    strength, out = model.strengths(x), []
    for slope in _SLOPES:
        z = np.clip(slope * (strength - model.cut), -500, 500)
        p = np.clip(1 / (1 + (1 / THRESHOLD - 1) * np.exp(-z)), 1e-9, 1 - 1e-9)
        out.append(np.rint(-np.log(np.where(good, p, 1 - p)) * unit).astype(np.int64).sum())
    return np.array(out)


def fit(x: np.ndarray, good: np.ndarray, bad_share: float, bins: int = BINS, seed: int = 5) -> Model:
    """What train() does, for rows in memory."""
    rng = np.random.default_rng(seed)
    edges = np.sort(x, axis=0)[np.minimum(np.ceil(np.arange(1, bins) / bins * len(x)).astype(int), len(x)) - 1].T.astype(np.float32)
    cells = _bins(edges, x)
    aside = rng.random(len(x)) < 0.25
    if len(set(good[aside].tolist())) < 2 or len(set(good[~aside].tolist())) < 2:
        aside[:] = False
    a, b = cells[good & ~aside], cells[~good & ~aside]
    weight = descend(lambda w: pair_sums(w, a, b, bins) / (len(a) * len(b)), len(FEATURES) * bins)
    model = Model(edges, weight.reshape(len(FEATURES), bins), 1.0, 0.0)
    rows = aside if aside.any() else ~aside
    strength = model.strengths(x[rows])
    # each label stands for its share of all labelled rows
    mass = np.where(good[rows], (1 - bad_share) / max(1, good[rows].sum()), bad_share / max(1, (~good[rows]).sum()))
    order = np.argsort(strength, kind="stable")
    k = min(int(np.searchsorted(np.cumsum(mass[order]) / mass.sum(), bad_share)), len(order) - 1)
    model.cut = float((strength[order][k] + strength[order][min(k + 1, len(order) - 1)]) / 2)
    model.slope = float(_SLOPES[np.argmin(slope_losses(model, x[rows], good[rows]))])
    return model


def _rank(share: float, n: int) -> int:
    """The place, from 1, of the value that a share of n rows isn't above."""
    return min(max(int(np.ceil(share * n - 1e-9)), 1), n)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(rows: DataFrame, f: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over all batches of vectors of integers; a task sends one."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                one = f(batch)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    return sum(np.frombuffer(r["v"], np.int64) for r in rows.mapInArrow(run, "v binary").collect())


def _ordered(x: np.ndarray) -> np.ndarray:
    """32 bits in the order of the numbers."""
    bits = (x + np.float32(0)).astype(np.float32).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.int64)


def _numbers(bits: np.ndarray) -> np.ndarray:
    bits = bits.astype(np.uint32)
    return np.where(bits >> 31, bits & np.uint32(0x7FFFFFFF), ~bits).astype(np.uint32).view(np.float32)


def order_statistics(rows: DataFrame, columns: Callable[[pa.RecordBatch], np.ndarray], width: int, ranks: list[int]) -> np.ndarray:
    """The exact values at some ranks, from 1, of each of `width` columns of 32-bit floats.

    The upper 16 bits are counted first, then the lower ones below each upper half that a rank falls on: a window sees 65,536 counts
    at most, and the driver one row a rank.
    """

    def cells(wanted: list[tuple[int, int, int]], upper: bool) -> dict:
        asked = {(j, p) for j, p, _ in wanted}

        def run(batches):
            for batch in batches:
                key = _ordered(columns(batch)) if batch.num_rows else np.zeros((0, width), np.int64)
                out = []
                for j in range(width):
                    k = key[:, j]
                    if not upper:
                        k = k[np.isin(k >> 16, [p for i, p in asked if i == j])]
                    cell, n = np.unique(k >> 16 if upper else k, return_counts=True)
                    out.append((np.full(len(cell), j), np.zeros(len(cell), np.int64) if upper else cell >> 16, cell & 0xFFFF, n))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["j", "p", "cell", "n"])

        counts = rows.mapInArrow(run, "j int, p int, cell int, n long").groupBy("j", "p", "cell").agg(F.sum("n").alias("n"))
        counts = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("j", "p").orderBy("cell")))
        ask = rows.sparkSession.createDataFrame(wanted, "j int, p int, rank long")
        found = counts.join(F.broadcast(ask), ["j", "p"]).where("rank <= upto and rank > upto - n").select("j", "p", "rank", "cell", (F.col("upto") - F.col("n")).alias("before"))
        return {(r["j"], r["p"], r["rank"]): (r["cell"], r["before"]) for r in found.collect()}

    top = cells([(j, 0, r) for j in range(width) for r in sorted(set(ranks))], True)
    inner = {(j, r): (cell, r - before) for (j, _, r), (cell, before) in top.items()}
    low = cells(sorted({(j, p, r) for (j, _), (p, r) in inner.items()}), False)
    bits = np.array([[inner[j, r][0] << 16 | low[(j, *inner[j, r])][0] for r in ranks] for j in range(width)], np.int64)
    return _numbers(bits)


def featured(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, held_out and x, its FEATURES; written, since texts are read for it once."""

    def run(batches):
        for batch in batches:
            for c in ta.chunks(batch.column("text")):
                part = batch.slice(c.first, len(c))
                x = features(c)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], ["doc_id", "held_out", "x"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out())
    return materialize(rows.mapInArrow(run, "doc_id long, held_out boolean, x array<float>"), "op12-features")[0]


def pair_groups(rows: DataFrame, counts: dict[bool, int], seed: int) -> DataFrame:
    """rows (doc_id, good, cells) -> good, bad: arrays of cells. Each row is in a group with GROUP or more of the rarer label, as expected;
    the rarer label's rows stand in each part of their group, so every pair of a group is in one part."""
    rare = counts[True] <= counts[False]
    groups = max(1, counts[rare] // GROUP)
    parts = max(1, -(-counts[not rare] // (2 * GROUP * groups)))
    deal = lambda k, n: F.pmod(F.xxhash64("doc_id", "cells", F.lit(seed + k)), F.lit(n))
    name = {True: "good", False: "bad"}
    few = rows.where(F.col("good") == rare).groupBy(deal(1, groups).alias("g")).agg(F.sort_array(F.collect_list("cells")).alias(name[rare]))
    many = rows.where(F.col("good") != rare).groupBy(deal(1, groups).alias("g"), deal(2, parts).alias("part")).agg(F.sort_array(F.collect_list("cells")).alias(name[not rare]))
    return materialize(many.join(few.hint("merge"), "g").select("good", "bad"), "op12-pairs")[0]


def _group_arrays(batch: pa.RecordBatch):
    for good, bad in zip(batch.column("good"), batch.column("bad"), strict=True):
        yield tuple(np.frombuffer(b"".join(x.values.to_pylist()), np.uint8).reshape(-1, len(FEATURES)) for x in (good, bad))


def train(rows: DataFrame, labels: DataFrame, seed: int = 5) -> Model | None:
    """Learn from labels (doc_id, quality) of all rows of featured() that held_out() leaves; None without rows of both labels."""
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 1).alias("good"))
    known = rows.where("not held_out").select("doc_id", "x").join(marks.hint("merge"), "doc_id")
    known, _ = materialize(known.withColumn("aside", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(4)) == 0), "op12-labelled")
    counts = {(r["good"], r["aside"]): r["n"] for r in known.groupBy("good", "aside").agg(F.count("*").alias("n")).collect()}
    total = {g: sum(n for (h, _), n in counts.items() if h == g) for g in (False, True)}
    if not total[False] or not total[True]:
        return None
    n = sum(total.values())
    edges = order_statistics(known, lambda b: _matrix(b.column("x")), len(FEATURES), [_rank(k / BINS, n) for k in range(1, BINS)])

    def binned(batches):
        for batch in batches:
            if batch.num_rows:
                cells = _bins(edges, _matrix(batch.column("x")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("good"), pa.array([c.tobytes() for c in cells], pa.binary())], ["doc_id", "good", "cells"])

    if len(counts) == 4:
        learned, rest = known.where("not aside"), known.where("aside")
        counts, judged = ({g: counts[g, side] for g in (False, True)} for side in (False, True))
    else:
        learned = rest = known
        counts = judged = total
    groups = pair_groups(learned.select("doc_id", "good", "x").mapInArrow(binned, "doc_id long, good boolean, cells binary"), counts, seed)
    pairs = groups.agg(F.sum(F.size("good").cast("long") * F.size("bad"))).first()[0]

    def measure(weight: np.ndarray) -> np.ndarray:
        one = lambda batch: sum(np.rint(pair_sums(weight, a, b) * (_UNIT / pairs)).astype(np.int64) for a, b in _group_arrays(batch))
        return _summed(groups, one) / _UNIT

    weight = descend(measure, len(FEATURES) * BINS)
    model = Model(edges, weight.reshape(len(FEATURES), BINS), 1.0, 0.0)
    size, k = sum(judged.values()), judged[False]  # as many rows are below the threshold as are bad
    low, high = order_statistics(rest, lambda b: model.strengths(_matrix(b.column("x")))[:, None].astype(np.float32), 1, [k, min(k + 1, size)])[0].astype(np.float64)
    model.cut = float(low + high) / 2
    each = lambda b: slope_losses(model, _matrix(b.column("x")), b.column("good").to_numpy(zero_copy_only=False).astype(bool))
    model.slope = float(_SLOPES[np.argmin(_summed(rest, each))])
    return model


def _scored(model: Model | None):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                score = model.scores(_matrix(batch.column("x"))) if model else np.full(batch.num_rows, THRESHOLD)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def rank_quality(documents: DataFrame, labels: DataFrame, seed: int = 5) -> DataFrame:
    """documents (doc_id, text, ...), labels (doc_id, quality, ...) -> doc_id, held_out, score, predicted; a row for each input row."""
    rows = featured(documents)
    return rows.mapInArrow(_scored(train(rows, labels, seed)), "doc_id long, held_out boolean, score double, predicted int")
