"""Best-fit packing of documents into training sequences.

``pieces`` turns documents into token pieces of at most ``capacity`` ids and
``pack`` places pieces into sequences by bounded-space online best fit: a fixed
number of open bins, a bitset with a bit for every free space that some open bin
has, and the fullest bin closing first when a new one must open.

Defined results: a null text is empty and has only its end id; a null doc_id is
a document like any other; repeated rows are packed once each; an empty table
gives no rows.  Other columns of the input are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lattica.llm import bpe
from lattica.llm.scratch import lean, save

#: Tokens that one group of ``pack`` gets, about; a group is packed by one task, as a stream.
GROUP_TOKENS = 1 << 24


class OpenBins:
    """At most ``most`` open bins of ``capacity``; put() gives (bin, offset)."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.count = self.made = 0

    def put(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            which = self._take(space)
        else:
            if self.count == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            which, space = self.made, self.capacity
            self.made += 1
        left = space - length
        if left:
            self.free[left].append(which)
            self.bits |= 1 << left
            self.count += 1
        return which, self.capacity - space

    def _take(self, space: int) -> int:
        bins = self.free[space]
        which = bins.pop()
        if not bins:
            self.bits ^= 1 << space
        self.count -= 1
        return which


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and with ``with_ids`` its ids.

    A document is its text's ids and then ``end_id``; only documents longer than
    ``capacity`` are cut.  ids_crc32 is over little-endian unsigned 32-bit ids.
    """
    path, end, width = tokenizer_path or bpe.default_path(), np.array([end_id], "<u4").tobytes(), 4 * capacity
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.word_bpe(path).encode_all
        for batch in batches:
            encoded = encode(text.as_py() for text in batch.column(1))
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows: list[tuple] = []
                blocks: list[bytes] = []
                for doc_id, ids in zip(part.column(0).to_pylist(), islice(encoded, part.num_rows), strict=True):
                    ids += end
                    for k, a in enumerate(range(0, len(ids), width)):
                        block = ids[a : a + width]
                        rows.append((doc_id, k, a // 4, len(block) // 4, zlib.crc32(block)))
                        if with_ids:
                            blocks.append(block)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    ends = np.cumsum([0, *(len(b) // 4 for b in blocks)]).astype(np.int32)
                    flat = pa.array(np.frombuffer(b"".join(blocks), "<i4"))
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), flat))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(cut), schema)


def pack(table: DataFrame, capacity: int = 2048, open_bins: int = 1024, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """The pieces with sequence_id and offset added; the other columns stay.

    Pieces are dealt at random, by a hash of them and their place, into groups of about
    ``group_tokens`` tokens, and within a group into rounds of about half of what
    the open bins can hold; within a round they come longest first, so that best
    fit leaves little unused.  Pieces of more than half a bin are then fewer in a
    round than the open bins, and those find their short pieces before they must
    close.  A group is a stream through one task, which holds the open bins and
    nothing else.
    """
    total = table.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, -(-total // group_tokens))
    rounds = max(1, -(-total // (groups * max(1, open_bins * capacity // 2))))
    schema = StructType([*table.schema.fields, *StructType.fromDDL("sequence_id long, offset long").fields])
    names = [f.name for f in schema]
    key = ["doc_id", "piece", "length", "ids_crc32"]
    row = F.monotonically_increasing_id()  # equal rows go to different groups
    dealt = table.withColumn("__group", F.pmod(F.xxhash64(*key, row), F.lit(groups))).withColumn("__round", F.pmod(F.xxhash64(*key, row, F.lit(1)), F.lit(rounds)))
    dealt = dealt.repartition(groups, "__group").sortWithinPartitions("__group", "__round", F.desc("length"), "doc_id", "piece", "ids_crc32")

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, bins = None, OpenBins(capacity, open_bins)
        for batch in batches:
            ids, offsets = [], []
            for g, length in zip(batch.column("__group").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if g != group:
                    group, bins = g, OpenBins(capacity, open_bins)
                which, offset = bins.put(length)
                ids.append((g << 36) + which)
                offsets.append(offset)
            columns = [batch.column(n) for n in names[:-2]] + [pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return dealt.mapInArrow(lean(place), schema)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 2048, end_id: int = 0, open_bins: int = 1024, with_ids: bool = False) -> DataFrame:
    """pieces() kept in the shared folder, so that texts are tokenized once, then pack()."""
    return pack(save(pieces(docs, tokenizer_path, capacity, end_id, with_ids), "pieces"), capacity, open_bins)
