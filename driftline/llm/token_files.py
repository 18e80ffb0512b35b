"""Token ids as flat binary files with 64-bit document offsets, read back memory-mapped.

Layout of one part (little endian, all parts in ascending doc_id order):
``part-NNNNN-<attempt>.bin``  the ids, 16 bits each if the vocabulary allows, else 32
``part-NNNNN-<attempt>.idx``  n_docs + 1 unsigned 64-bit offsets, in ids, from the part's start
``part-NNNNN-<attempt>.doc``  n_docs signed 64-bit document ids

Tasks of a range partitioning by doc_id write one part each, under a name of their own, and
return one manifest row; the manifest is a table in the same shared folder, so a repeated or
speculative task leaves unread files but never a half-written part. A part's base (the ids of
all parts before it) is a prefix sum over the manifest: one row per part, never per document.

A null text is an empty document (only the end id); null doc_ids sort first and are stored as
the smallest 64-bit integer; equal doc_ids keep all their rows. An empty table writes no part
and reads back no row. Other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.common import file_system, scratch_dir, shuffle_partitions, text_of
from driftline.llm.tokens import encoder, text_chunks

NO_ID = -2**63
MANIFEST = "part int, path string, width int, n_docs long, n_tokens long"
READ_DOCS = 4096


def write_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None,
                 end_id: int = 1, vocab_size: int = 49408, folder: str | None = None,
                 partitions: int | None = None) -> str:
    """Write the ids of every document (then ``end_id``) and return the folder."""
    spark = docs.sparkSession
    folder = folder or scratch_dir(spark, "tokens")
    width = 2 if max(vocab_size - 1, end_id) < 1 << 16 else 4

    def part(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId()
        store, root = file_system(folder)
        path = f"{root}/part-{number:05d}-{uuid.uuid4().hex[:12]}"
        first = next(batches, None)
        if first is None:
            return
        store.create_dir(root, recursive=True)
        coder, n_docs, n_tokens = encoder(tokenizer), 0, 0
        with (store.open_output_stream(path + ".bin") as ids, store.open_output_stream(path + ".idx") as idx,
              store.open_output_stream(path + ".doc") as names):
            idx.write(np.zeros(1, "<u8").tobytes())
            for batch in _with(first, batches):
                text = batch.column(1)
                for a, b in text_chunks(text):
                    flat, at = coder.encode(text.slice(a, b - a))
                    at = at + np.arange(b - a + 1)                      # an end id after each document
                    whole = np.full(int(at[-1]), end_id, f"<u{width}")
                    mine = np.ones(len(whole), bool)
                    mine[at[1:] - 1] = False
                    whole[mine] = flat
                    ids.write(whole.tobytes())
                    idx.write((n_tokens + at[1:]).astype("<u8").tobytes())
                    n_tokens += len(whole)
                names.write(batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                n_docs += batch.num_rows
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([number], pa.int32()), "path": [path], "width": pa.array([width], pa.int32()),
            "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64())})

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    (rows.repartitionByRange(partitions or shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id")
     .mapInArrow(part, MANIFEST).write.parquet(folder.rstrip("/") + "/manifest"))
    return folder


def _with(first, rest):
    yield first
    yield from rest


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The parts in order with ``base``, the number of ids before each (one row per part)."""
    parts = spark.read.schema(MANIFEST).parquet(folder.rstrip("/") + "/manifest")
    return parts.withColumn("base", F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens"))


class Part:
    """One part, memory-mapped where its store is a mounted file system."""

    def __init__(self, path: str, width: int):
        store, self.path = file_system(path)
        self.ids = np.frombuffer(_buffer(store, self.path + ".bin"), f"<u{width}")
        self.offsets = np.frombuffer(_buffer(store, self.path + ".idx"), "<u8").astype(np.int64)
        self.doc_ids = np.frombuffer(_buffer(store, self.path + ".doc"), "<i8")

    def __len__(self) -> int:
        return len(self.doc_ids)

    def __getitem__(self, i: int) -> np.ndarray:
        """The ids of the part's document ``i``, its end id included."""
        return self.ids[self.offsets[i]:self.offsets[i + 1]]


def _buffer(store, path: str):
    from pyarrow import fs
    if isinstance(store, fs.LocalFileSystem):
        with pa.memory_map(path) as f:
            return f.read_buffer()
    with store.open_input_file(path) as f:
        return f.read_buffer()


def ids_crc32(ids: np.ndarray) -> int:
    """CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, part."""
    def documents(batches):
        for batch in batches:
            for row in batch.to_pylist():
                part = Part(row["path"], row["width"])
                for a in range(0, len(part), READ_DOCS):
                    rows = range(a, min(a + READ_DOCS, len(part)))
                    names = part.doc_ids[rows.start:rows.stop]
                    at = part.offsets[rows.start:rows.stop + 1]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(names, mask=names == NO_ID), pa.array(row["base"] + at[:-1]), pa.array(np.diff(at)),
                        pa.array([ids_crc32(part[i]) for i in rows], pa.int64()),
                        pa.array(np.full(len(rows), row["part"], np.int32))],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "part"])

    parts = manifest(spark, folder)
    return parts.repartition(shuffle_partitions(spark), "part").mapInArrow(
        documents, "doc_id long, start long, n_tokens long, ids_crc32 long, part int")
