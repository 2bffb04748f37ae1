"""Token counts of documents in flat token files without an index.

The files hold nothing but ids of a fixed width; documents end with an
end-of-document id and may straddle files of the same stream.  Every file is
a block: a vectorised search gives its number of ids and the places of the
separators.  A prefix scan over the blocks of a stream gives each block the
ids and documents before it and the last separator before it, which stitches
the documents that cross blocks.

Defined cases: an empty document has 0 tokens; ids after a stream's last
separator are a document with ``terminated`` false; an empty folder of files
gives no rows; null texts are written as empty documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import textvec as V
from quarry.llm.base import pick
from quarry.llm.shared_files import new_file
from quarry.llm.tokenizers_io import json_encoder
from quarry.session import materialize, scratch_path, ship_package

BLOCK_IDS = 1 << 21
NAME = r"stream-(\d+)-(\d+)\.ids$"


def _write_batches(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int,
                   kind: str, block_ids: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    enc = json_encoder(tokenizer)
    if max(len(enc.id_bytes) - 1, end_id) > np.iinfo(kind).max:
        raise ValueError(f"ids up to {max(len(enc.id_bytes) - 1, end_id)} don't fit files of {kind}; take a larger width")
    stream = TaskContext.get().partitionId()
    held, n_held, seq, ordinal = [], 0, 0, 0

    def flush(last: bool):
        nonlocal held, n_held, seq
        ids = np.concatenate([np.zeros(0, np.uint32), *held]).astype(kind)
        cut = len(ids) if last else len(ids) // block_ids * block_ids
        for lo in range(0, cut, block_ids):
            with new_file(f"{folder}/stream-{stream:06d}-{seq:06d}.ids") as out:
                out.write(ids[lo:min(cut, lo + block_ids)].tobytes())
            seq += 1
        held, n_held = [ids[cut:].astype(np.uint32)], len(ids) - cut

    for batch in batches:
        for lo, hi, data, offs in V.text_runs(batch.column("text")):
            ids, bounds = enc.encode(data, offs)
            held.append(np.insert(ids, bounds[1:], end_id).astype(np.uint32))
            n_held += len(held[-1])
            if n_held >= block_ids:
                flush(False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(hi - lo, stream, np.int32)), pa.array(np.arange(ordinal, ordinal + hi - lo)),
                 batch.column("doc_id").slice(lo, hi - lo)], names=["stream", "ordinal", "doc_id"])
            ordinal += hi - lo
    flush(True)


def write_flat(docs: DataFrame, folder: str, tokenizer: str, end_id: int, width: int = 2,
               block_ids: int = BLOCK_IDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all texts as flat token files, one stream per input partition, and return the manifest
    (stream, ordinal, doc_id), which the files themselves don't hold."""
    src = pick(docs, doc_id=doc_id, text=text)
    kind = src.schema["doc_id"].dataType.simpleString()
    made = src.mapInArrow(partial(_write_batches, folder=folder, tokenizer=tokenizer, end_id=end_id,
                                  kind=f"<u{width}", block_ids=block_ids),
                          f"stream int, ordinal bigint, doc_id {kind}")
    return materialize(made, "token-manifest")


def _search(batches: Iterator[pa.RecordBatch], end_id: int, kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, raw in zip(batch.column("path"), batch.column("content"), strict=True):
            ids = np.frombuffer(raw.as_buffer(), kind)
            at = np.flatnonzero(ids == end_id)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path.as_py()]), pa.array([len(ids)], pa.int64()),
                 pa.array([at], pa.list_(pa.int64()))], names=["path", "n_ids", "ends"])


def separator_scan(spark: SparkSession, folder: str, end_id: int, width: int = 2) -> DataFrame:
    """Documents of all streams below ``folder``: stream, ordinal, start (id offset in the stream),
    n_tokens (without the separator), terminated."""
    ship_package(spark)
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    blocks = files.mapInArrow(partial(_search, end_id=end_id, kind=f"<u{width}"),
                              "path string, n_ids bigint, ends array<bigint>")
    blocks = materialize(blocks.select(
        F.regexp_extract("path", NAME, 1).cast("int").alias("stream"),
        F.regexp_extract("path", NAME, 2).cast("bigint").alias("seq"), "n_ids", "ends",
        F.size("ends").cast("bigint").alias("n_ends")), "token-blocks")
    before = Window.partitionBy("stream").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    scan = blocks.select("stream", "seq", "n_ids", "n_ends", F.expr("try_element_at(ends, -1)").alias("last_end"))
    scan = scan.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    scan = scan.withColumn("end_at", F.col("base") + F.col("last_end"))
    scan = scan.select("stream", "seq", "base", F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("first"),
                       F.coalesce(F.max("end_at").over(before) + 1, F.lit(0)).alias("open_at"))
    joined = blocks.join(scan, ["stream", "seq"])
    docs = joined.select("stream", "base", "first", "open_at", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("open_at")).otherwise(
        F.col("base") + F.expr("try_element_at(ends, i)") + 1)
    closed = docs.select("stream", (F.col("first") + F.col("i")).alias("ordinal"), start.alias("start"),
                         (F.col("base") + F.col("end") - start).alias("n_tokens"), F.lit(True).alias("terminated"))
    tails = joined.groupBy("stream").agg(F.sum("n_ids").alias("n"), F.sum("n_ends").alias("ordinal"),
                                         F.max(F.col("base") + F.expr("try_element_at(ends, -1)")).alias("last"))
    start = F.coalesce(F.col("last") + 1, F.lit(0))
    tails = tails.select("stream", "ordinal", start.alias("start"), (F.col("n") - start).alias("n_tokens"),
                         F.lit(False).alias("terminated")).where("n_tokens > 0")
    return closed.unionByName(tails)


def token_counts(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id",
                 text: str = "text", folder: str | None = None) -> DataFrame:
    """Flat files of all texts, counted by the separator scan and named by the manifest: doc_id, stream,
    start, n_tokens, terminated."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "flat-tokens")
    manifest = write_flat(docs, folder, tokenizer, end_id, doc_id=doc_id, text=text)
    if manifest.limit(1).isEmpty():
        return manifest.select("doc_id", "stream", F.lit(0).cast("bigint").alias("start"),
                               F.lit(0).cast("bigint").alias("n_tokens"), F.lit(True).alias("terminated"))
    counts = separator_scan(spark, folder, end_id)
    return manifest.join(counts, ["stream", "ordinal"]).select("doc_id", "stream", "start", "n_tokens", "terminated")
