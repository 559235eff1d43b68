"""Token-id files: one concatenated id array and Elias-Fano document boundaries.

A file is ``LTOK1``, a byte for the width of an id (2 or 4), the ids of its
documents one after another, the Elias-Fano sequences of the n + 1 document
boundaries and of the document ids above the least, the count of documents
without an id (they come first), the least id, and a footer with the places of
these.  No table of 64-bit offsets is stored.

``write`` sorts documents by doc_id over all tasks, so file k's documents come
before file k + 1's; each task writes files of bounded size under names of its
own attempt, and the table of files that it returns is what counts: files of a
lost attempt are in no table.  ``read`` gives every document back, with a task
for many small files.

Defined results: a null text is empty and has only its end id; null doc_ids
come first; repeated doc_ids are ordered by the first 32 characters of their texts,
then by a hash, and each has its own boundary;
an empty table gives no file and no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe
from lattica.llm.elias_fano import EliasFano, encode
from lattica.llm.scratch import lean, new_path, open_fs

_MAGIC = b"LTOK1"
_FOOT = struct.Struct("<QQIQqQ5s")
FILES = "path string, part int, seq int, n_docs long, n_tokens long"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Tokens that a task of ``read`` gets, about, where there are more files than cores.
READ_TOKENS = 1 << 26


class Writer:
    """One file, written as a stream; close() adds the boundaries."""

    def __init__(self, folder: str, name: str, width: int):
        self.fs, inner = open_fs(folder)
        self.fs.create_dir(inner, recursive=True)
        self.path = f"{folder}/{name}"
        self.out = self.fs.open_output_stream(f"{inner}/{name}", compression=None)
        self.width, self.dtype = width, f"<u{width}"
        self.out.write(_MAGIC + bytes([width]))
        self.lengths: list[int] = []
        self.doc_ids: list[int] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit."""
        found = np.frombuffer(ids, "<u4")
        if self.width == 2 and found.max(initial=0) > 0xFFFF:
            raise ValueError(f"id {found.max()} of document {doc_id} takes more than two bytes")
        self.out.write(found.astype(self.dtype).tobytes() if self.width == 2 else ids)
        self.lengths.append(len(ids) // 4)
        self.tokens += len(ids) // 4
        if doc_id is not None:
            self.doc_ids.append(doc_id)

    def close(self) -> tuple[str, int, int]:
        n = len(self.lengths)
        bounds = encode(np.cumsum([0, *self.lengths], dtype=np.uint64))
        least = self.doc_ids[0] if self.doc_ids else 0
        keys = encode(np.array([d - least for d in self.doc_ids], np.uint64))
        self.out.write(bounds + keys + _FOOT.pack(len(bounds), len(keys), n - len(self.doc_ids), n, least, self.tokens, _MAGIC))
        self.out.close()
        return self.path, n, self.tokens


class Reader:
    """Random and sequential access to one file."""

    def __init__(self, path: str):
        fs, inner = open_fs(path)
        self.file = fs.open_input_file(inner)
        end = self.file.size() - _FOOT.size
        n_bounds, n_keys, nulls, self.n, least, self.tokens, magic = _FOOT.unpack(self.file.read_at(_FOOT.size, end))
        self.width = self.file.read_at(6, 0)[5]
        if magic != _MAGIC:
            raise ValueError(f"{path} is no token file")
        self.bounds = EliasFano(self.file.read_at(n_bounds, end - n_keys - n_bounds))
        self.keys, self.nulls, self.least = EliasFano(self.file.read_at(n_keys, end - n_keys)), nulls, least

    def ids(self, first: int, count: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(count * self.width, 6 + first * self.width), f"<u{self.width}").astype("<u4")

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, found by two selects."""
        a = self.bounds.select(i)
        return self.ids(a, self.bounds.select(i + 1) - a)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + [self.least + int(v) for v in self.keys.values()]


def write(docs: DataFrame, folder: str, tokenizer_path: str | None = None, end_id: int = 2, file_tokens: int = 1 << 26, width: int | None = None) -> DataFrame:
    """Write the documents' ids in ascending doc_id order; the table of files, whose rows the driver holds.

    ``width`` 2 holds ids below 65536, and is taken if the tokenizer has no others; a
    larger id is refused.  ``file_tokens`` bounds a file, but for its last document.
    """
    path, end = tokenizer_path or bpe.default_path(), np.array([end_id], "<u4").tobytes()
    width = width or (2 if max(end_id, len(bpe.word_bpe(path).id_bytes) - 1) <= 0xFFFF else 4)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = max(1, rows.rdd.getNumPartitions())

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, seq, writer = bpe.word_bpe(path), TaskContext.get().partitionId(), 0, None
        made: list[tuple] = []
        for batch in batches:
            encoded = tokenizer.encode_all(text.as_py() for text in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                if writer is None:
                    writer = Writer(folder, f"{part:06d}-{seq:04d}-{uuid.uuid4().hex}.tok", width)
                writer.add(doc_id, ids + end)
                if writer.tokens >= file_tokens:
                    name, n, tokens = writer.close()
                    made.append((name, part, seq, n, tokens))
                    writer, seq = None, seq + 1
        if writer is not None:
            name, n, tokens = writer.close()
            made.append((name, part, seq, n, tokens))
        if made:
            names = ["path", "part", "seq", "n_docs", "n_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=names)

    key = ["doc_id", F.left("text", F.lit(32)), F.xxhash64("text"), "row"]  # rows equal in all but the last are split too
    ordered = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *key).sortWithinPartitions(*key)
    made = ordered.mapInArrow(lean(task), FILES).collect()  # a row for each task and 64 M tokens; no part file for each
    return docs.sparkSession.createDataFrame(made, FILES)


def read(spark: SparkSession, files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the files."""
    base, listed = 0, []
    for f in sorted(files.collect(), key=lambda f: (f.part, f.seq)):  # a row for each file of up to 64 M tokens
        listed.append((f.path, base))
        base += f.n_tokens

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = Reader(path)
                bounds, keys = reader.bounds.values().astype(np.int64), reader.doc_ids()
                for a in range(0, reader.n, 1024):
                    b = min(a + 1024, reader.n)
                    block, start = memoryview(reader.ids(bounds[a], bounds[b] - bounds[a])).cast("B"), bounds[a]
                    crcs = [zlib.crc32(block[4 * (bounds[i] - start) : 4 * (bounds[i + 1] - start)]) for i in range(a, b)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[a:b], pa.int64()), pa.array(bounds[a:b] + base), pa.array(np.diff(bounds[a : b + 1])), pa.array(crcs, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    tasks = min(len(listed), max(spark.sparkContext.defaultParallelism, -(-base // READ_TOKENS)), 10_000)
    table = spark.createDataFrame(listed, "path string, base long")
    return table.repartition(max(1, tasks)).mapInArrow(task, DOCS)


def round_trip(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 2) -> DataFrame:
    """write() to a new folder of the shared one, then read()."""
    spark = docs.sparkSession
    return read(spark, write(docs, new_path(spark, "tokens"), tokenizer_path, end_id))
