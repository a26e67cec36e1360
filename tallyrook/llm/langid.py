"""Language identification with averaged hashed subword embeddings and a linear softmax.

Features of a text are its 2- to 4-byte strings that stand inside a word or touch its end (A-Z lower-cased, other ASCII
than letters taken as a gap), hashed to 2**HASH_BITS rows of an embedding. The mean of a text's rows goes through a
linear softmax; both are trained by stochastic gradient descent in NumPy on a bounded sample. Since mean and linear map
commute, prediction takes the mean of class scores where these are narrower than embeddings. A temperature fitted on sampled rows that training leaves
out calibrates the score; the least score whose accepted share of those rows is right often enough is the rejection
threshold.

Sample: of each language about `per_language` rows, chosen by a hash of doc_id; of each at most a whole text and a few
short pieces, each as counts of its features. Of more than MAX_LANGUAGES distinct values of lang, the most frequent are
learned. So what reaches the driver has a bound of its own.

Cases: a null text, or one without a letter, is `und` with score 0, not accepted; a null doc_id has held_out false and
isn't learned from; rows are predicted one by one; other columns are ignored; without a learnable row all are `und`; an
empty table gives no rows. A task holds one chunk of texts, or its longest text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrook.llm import textarrays as ta

HASH_BITS, DIM, MAX_LANGUAGES = 16, 16, 4096
_PIECES = (64, 16, 6, 3)

_LETTER = np.full(256, 32, np.uint8)
_LETTER[128:] = np.arange(128, 256)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # of each hashed feature: its class scores if languages are few, else its embedding
    weight: np.ndarray | None  # from embeddings to class scores
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, mean: np.ndarray) -> np.ndarray:
        z = ((mean if self.weight is None else mean @ self.weight) + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def features(c: ta.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(feature, document) of each subword of a chunk, not in order."""
    size = np.diff(c.offsets)
    at = np.arange(len(c.data)) + np.repeat(np.arange(1, len(c) + 1), size)  # one gap before each text and after the last
    text = np.full(len(c.data) + len(c) + 1, 32, np.uint8)
    text[at] = _LETTER[c.data]
    doc = np.repeat(np.arange(len(c) + 1), np.append(size + 1, 1))
    gap = text == 32
    out, whose = [], []
    value = text.astype(np.uint32)
    for n in (2, 3, 4):
        value = value[:-1] << np.uint32(8) | text[n - 1 :]
        inside = gap[1 : len(value) + 1].copy() if n > 2 else gap[: len(value)] & gap[1 : len(value) + 1]
        for j in range(2, n - 1):
            inside |= gap[j : len(value) + j]
        keep = np.flatnonzero(~inside)
        out.append(((value[keep] ^ np.uint32(n * 0x45D9F3B)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - HASH_BITS))
        whose.append(doc[keep])
    return np.concatenate(out), np.minimum(np.concatenate(whose), len(c) - 1)


def _units(seed: int):
    """Sampled rows -> their training units: features and counts of the whole text and of short pieces of it."""

    def run(batches):
        for batch in batches:
            names, rows, parts, pick = [], [], [], batch.column("pick").to_pylist()
            for k, text in enumerate(batch.column("text").to_pylist()):
                w = text.split()
                rng = np.random.default_rng([seed, pick[k] % 2**32])
                for piece in (len(w), *(x for x in _PIECES if x < len(w))):
                    a = int(rng.integers(0, len(w) - piece + 1))
                    rows.append(" ".join(w[a : a + piece]))
                    names.append(k)
            for c in ta.chunks(pa.array(rows, pa.string())):
                f, doc = features(c)
                key, count = np.unique(doc.astype(np.int64) << HASH_BITS | f, return_counts=True)
                cut = np.searchsorted(key >> HASH_BITS, np.arange(len(c) + 1))
                parts += [((key[a:b] & (2**HASH_BITS - 1)).astype(np.uint32).tobytes(), count[a:b].astype(np.uint32).tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            if parts:
                at = pa.array(names)
                yield pa.RecordBatch.from_arrays([batch.column("lang").take(at), batch.column("pick").take(at), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())], ["lang", "pick", "f", "n"])

    return run


def held_out() -> F.col:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, per_language: int = 300, max_languages: int = MAX_LANGUAGES, epochs: int = 8, rate: float = 2.0, precision: float = 0.99, seed: int = 11) -> Model:
    """Learn from text and lang of rows that held_out() leaves; documents as for identify()."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out() & F.col("text").rlike("\\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    if not counts:
        return Model([], np.zeros((2**HASH_BITS, 0), np.float32), None, np.zeros(0), 1.0, 1.0)
    known = rows.sparkSession.createDataFrame([(k, min(1.0, per_language / n)) for k, n in counts.items()], "lang string, share double")
    rows = rows.join(F.broadcast(known), "lang")  # max_languages rows at most
    pick = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40))
    sample = rows.withColumn("pick", pick).where(F.col("pick") < F.col("share") * float(1 << 40))
    got = sample.mapInArrow(_units(seed), "lang string, pick long, f binary, n binary").collect()
    got.sort(key=lambda r: (r["lang"], r["pick"], len(r["f"]), bytes(r["f"])))
    languages = sorted(counts)
    number = {x: k for k, x in enumerate(languages)}
    label = np.array([number[r["lang"]] for r in got])
    f = [np.frombuffer(r["f"], np.uint32) for r in got]
    n = [np.frombuffer(r["n"], np.uint32).astype(np.float32) for r in got]
    rng = np.random.default_rng(seed)
    aside = np.array([r["pick"] % 5 == 0 for r in got])
    if aside.all() or not aside.any():
        aside[:] = False
    table = (rng.standard_normal((2**HASH_BITS, DIM)) * 0.1).astype(np.float32)
    weight, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    fit = np.flatnonzero(~aside)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(fit)
        for a in range(0, len(order), 16):
            part = order[a : a + 16]
            ids = np.concatenate([f[i] for i in part])
            size = np.array([len(f[i]) for i in part])
            row = np.repeat(np.arange(len(part)), size)
            share = np.concatenate([n[i] / max(1, n[i].sum()) for i in part])
            mean = np.zeros((len(part), DIM), np.float32)
            np.add.at(mean, row, table[ids] * share[:, None])
            z = mean @ weight + bias
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(part)), label[part]] -= 1
            z /= len(part)
            back = z @ weight.T
            weight -= step * mean.T @ z
            bias -= step * z.sum(0)
            np.add.at(table, ids, -step * 16 * back[row] * share[:, None])
    few = len(languages) <= DIM
    model = Model(languages, (table @ weight).astype(np.float32) if few else table, None if few else weight, bias, 1.0, 0.0)
    test = np.flatnonzero(aside) if aside.any() else fit
    mean = np.stack([(model.table[f[i]] * n[i][:, None]).sum(0) / max(1, n[i].sum()) for i in test])
    best = None
    for t in np.geomspace(0.1, 10, 41):
        model.temperature = float(t)
        p = model.probabilities(mean)
        loss = -np.log(np.maximum(p[np.arange(len(test)), label[test]], 1e-12)).mean()
        if best is None or loss < best[0]:
            best = (loss, float(t), p)
    model.temperature, p = best[1], best[2]
    top, right = p.max(1), p.argmax(1) == label[test]
    order = np.argsort(-top, kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) >= precision * np.arange(1, len(order) + 1))
    model.threshold = float(top[order][good[-1]]) if len(good) else 1.0
    return model


def _predict(model: Model):
    def run(batches):
        for batch in batches:
            lettered = np.asarray(batch.column("lettered").fill_null(False))
            for c in ta.chunks(batch.column("text")):
                some = lettered[c.first : c.first + len(c)]
                names, scores = np.full(len(c), "und", object), np.zeros(len(c))
                if model.languages and some.any():
                    f, doc = features(c)
                    count = np.bincount(doc, minlength=len(c))
                    mean = np.stack([np.bincount(doc, model.table[f, j], len(c)) for j in range(model.table.shape[1])], 1) / np.maximum(count, 1)[:, None]
                    p = model.probabilities(mean)
                    names[some] = np.array(model.languages, object)[p.argmax(1)][some]
                    scores[some] = p.max(1)[some]
                part = batch.slice(c.first, len(c))
                accepted = (scores >= model.threshold) & (names != "und")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores), pa.array(accepted)], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return run


def identify(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """documents (doc_id, text, lang, ...) -> doc_id, held_out, lang_pred, score, accepted; a row for each input row.

    accepted is false where the calibrated score is below the model's rejection threshold.
    """
    model = model or train(documents)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("text").rlike("\\p{L}").alias("lettered"))
    rows = rows.withColumn("held_out", held_out())
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
