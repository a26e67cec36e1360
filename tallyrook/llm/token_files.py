"""Token counts from flat, unindexed token files by a separator scan.

A token file is a run of unsigned 16-bit token ids in which each document ends with the end-of-document id, and
nothing says where. Here a file is a series of blocks, rows (file, block, ids); token_blocks() cuts files that lie in a
folder, tokenize() makes them of a table (one file a partition) together with a manifest of the documents in order.

The scan has no order within itself: each block's separators are found by one vectorised comparison, giving the tokens
before the first, between them, and after the last. A prefix scan over the few numbers of each block (a window by file)
then stitches what crosses block boundaries: the document that a block's first separator ends began behind the last
separator before, however many blocks ago.

Cases: a null or empty text is a document of no tokens; a file may end without a separator (its last document has
`ended` false) or hold none; an empty block or table gives no documents; repeated rows and null doc_ids are documents of
their own; other columns are ignored. Files are bounded by their writer's partitions, blocks by block_tokens.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyrook.session import materialize

VOCABULARY, END_OF_DOCUMENT, BLOCK_TOKENS = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256, 1 << 20
#: How the vocabulary's maker splits text before merging (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_encoders: dict = {}


def encoder(vocabulary: str = VOCABULARY):
    """The tokenizer of a file of base64 tokens and ranks; one a process."""
    if vocabulary not in _encoders:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[vocabulary] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def tokenize(documents: DataFrame, vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """documents (doc_id, text, ...) -> blocks (file, block, ids) and manifest (file, ordinal, doc_id), written once."""

    def run(batches):
        encode, file = encoder(vocabulary).encode_ordinary, TaskContext.get().partitionId()
        held, size, block, listed = [], 0, 0, 0

        def rows(blocks, ids=None, at=0):
            extra = [(file, -1, at, np.array([x is None for x in ids], np.bool_).tobytes(), np.array([x or 0 for x in ids], np.int64).tobytes())] if ids else []
            got = [(file, b, 0, x, b"") for b, x in blocks] + extra
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["file", "block", "first", "ids", "docs"])

        for batch in batches:
            full = []
            for text in batch.column("text"):
                ids = np.append(np.array(encode(text.as_py() or ""), np.uint16), np.uint16(END_OF_DOCUMENT))
                held.append(ids)
                size += len(ids)
                if size >= block_tokens:
                    whole = np.concatenate(held)
                    cut = size // block_tokens * block_tokens
                    full += [(block + k, whole[k * block_tokens : (k + 1) * block_tokens].tobytes()) for k in range(cut // block_tokens)]
                    block, held, size = block + cut // block_tokens, [whole[cut:]], size - cut
            ids = batch.column("doc_id").to_pylist()
            if ids or full:
                yield rows(full, ids, listed)
            listed += len(ids)
        if size:
            yield rows([(block, np.concatenate(held).tobytes())])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made, _ = materialize(rows.mapInArrow(run, "file int, block long, first long, ids binary, docs binary"), "op3-files")

    def unlist(batches):
        for batch in batches:
            for file, first, void, docs in zip(*(batch.column(x).to_pylist() for x in ("file", "first", "ids", "docs")), strict=True):
                own = pa.array(np.frombuffer(docs, np.int64), mask=np.frombuffer(void, np.bool_))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), file, np.int32)), pa.array(first + np.arange(len(own))), own], ["file", "ordinal", "doc_id"])

    manifest = made.where("block < 0").mapInArrow(unlist, "file int, ordinal long, doc_id long")
    return made.where("block >= 0").select("file", "block", "ids"), manifest


def token_blocks(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Flat files of little-endian 16-bit ids in a folder that Spark can read -> (file, block, ids); file is the path."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = data.as_py()
                for k in range(0, len(data), 2 * block_tokens):
                    yield pa.RecordBatch.from_pydict({"file": [name], "block": [k // (2 * block_tokens)], "ids": [data[k : k + 2 * block_tokens]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, block long, ids binary")


def _scan(end: int):
    def run(batches):
        for batch in batches:
            got = []
            for data in batch.column("ids"):
                ids = np.frombuffer(data.as_buffer() if data.is_valid else b"", np.uint16)
                at = np.flatnonzero(ids == end)
                got.append((len(ids), len(at), int(at[0]) if len(at) else len(ids), np.diff(at) - 1, len(ids) - 1 - int(at[-1]) if len(at) else len(ids)))
            inner = pa.array([x[3].tolist() for x in got], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), *[pa.array([x[k] for x in got], pa.int64()) for k in (0, 1, 2)], inner, pa.array([x[4] for x in got], pa.int64())], ["file", "block", "n", "ends", "lead", "inner", "tail"])

    return run


def separator_counts(blocks: DataFrame, end: int = END_OF_DOCUMENT) -> DataFrame:
    """(file, block, ids) -> file, ordinal, n_tokens, ended: a row for each document of each file, in order from 0."""
    kind = blocks.schema["file"].dataType.simpleString()
    found, _ = materialize(blocks.select("file", "block", "ids").mapInArrow(_scan(end), f"file {kind}, block long, n long, ends long, lead long, inner array<long>, tail long"), "op3-blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # only the few numbers of a block go through the scan; the counts between separators stay in the table
    rows = found.drop("inner").withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("ordinal", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    # where the document that is open at a block's start began: behind the last separator of the blocks before
    opened = F.coalesce(F.max(F.when(F.col("ends") > 0, F.col("start") + F.col("n") - F.col("tail"))).over(before), F.lit(0))
    rows = rows.withColumn("carry", F.col("start") - opened)
    crossed = rows.where("ends > 0").select("file", "ordinal", (F.col("carry") + F.col("lead")).alias("n_tokens"), F.lit(True).alias("ended"))
    inner = found.where("ends > 1").select("file", "block", F.posexplode("inner").alias("k", "n_tokens"))
    inner = inner.join(rows.select("file", "block", "ordinal"), ["file", "block"]).select("file", (F.col("ordinal") + F.col("k") + 1).alias("ordinal"), "n_tokens", F.lit(True))
    last = rows.groupBy("file").agg(
        F.sum("ends").alias("ordinal"), (F.sum("n") - F.coalesce(F.max(F.when(F.col("ends") > 0, F.col("start") + F.col("n") - F.col("tail"))), F.lit(0))).alias("n_tokens")
    )
    return crossed.union(inner).union(last.where("n_tokens > 0").select("file", "ordinal", "n_tokens", F.lit(False)))


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, n_tokens: tokenized into files, whose documents are counted by the scan."""
    blocks, manifest = tokenize(documents, vocabulary, block_tokens)
    return manifest.join(separator_counts(blocks), ["file", "ordinal"]).select("doc_id", "n_tokens")
