"""Language-model scoring with a probabilistic suffix tree over tokens.

Tokens are a text's words [^\\x20\\x09-\\x0D]+ with A-Z in lower case, then one
end.  The tree's root is the unigram distribution (count + 1) / (N + V + 1), in
which all unseen words are one event.  Contexts are the last 1 to DEPTH tokens;
the end stands for a text's beginning and is the oldest token of a context only.
All words are counted, and all longer grams that occur ``LEAST`` times, whatever
the size of the corpus.  A next token x diverges in context s from s's suffix r
if its count c is far above what r leads one to expect, E = n(s) P(x|r), by the
Poisson likelihood ratio c ln(c / E) - (c - E) > ``DIVERGENCE``; a context is
retained if some token diverges.  Its distribution gives each diverging token
(c - ``DISCOUNT``) / n(s) and leaves what remains to P(.|r).  A text is scored
from the longest retained suffix at each token.

All contexts of a token end in the token before it, so what the model holds of them
depends on the windows (three tokens before, the token) with that last one only: each
window is sent once, to a block by its last context token, and one task learns all
lengths of a block.  Where that token is frequent, its pairs are counted first and its
windows are dealt to several blocks by the token before it.

Windows and what they give are tables that are joined by shuffle and grow with the
corpus.  What tasks hold is bounded and changes no result: words and counts of common
words and the model's ``HOT`` most frequent entries are broadcast, others are looked
up by shuffle, once for each chunk of the texts; a filter of at most 2 ** ``FILTER``
bits tells which cannot be there.  A task holds all windows with the same two tokens
before the last, in blocks.  Words have numbers in descending order of their counts,
so that a number tells its count; those that occur once share one.  Entries of the
model go by 64 bits of a hash.  Probabilities are kept as multiples of the root's.

``Tree`` is the same model in one process; tests hold the tables against it.

Defined results: a null text is empty and has one token, its end; a row with a
null doc_id is not held out; repeated rows are learned from and scored each;
without training texts N and V are 0 and all scores are 0.  Other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.langid import held_out
from lattica.llm.scratch import drop_unread, lean, new_path, open_fs, recorded, remove, save

DEPTH, LEAST, DIVERGENCE, DISCOUNT = 3, 2, 12.0, 0.5
#: Words, the most frequent ones, whose ids and counts are broadcast.
COMMON = 50_000
#: Entries of the model that are broadcast, and bits (log 2) of a filter at most.
HOT, FILTER = 2_000_000, 29
#: The end token; UTF-8 has no such byte.
END = b"\xff"
#: Which bytes words have; bytes of texts that are split into words at once.
_WORD = ~np.isin(np.arange(256), [*b" \t\n\v\f\r"])
TEXT = 1 << 22
#: Bits of a gram's key in a Tree that hold its last token.
_BITS = 20
#: Tokens that one step of numpy works on (arrays that stay in the processor's cache), that a task sums windows of, and
#: that share a file of the model's less frequent entries.
STEP, SUMMED, CHUNK = 1 << 16, 1 << 21, 1 << 21
#: Windows of a block, about; a common word that ends more contexts has several blocks.
BLOCK = 1 << 20
#: What words have instead of a number that occur once in training, and that do not occur.
ONCE, UNSEEN = -2, -1
#: Numbers from here on do not fit the two bytes that a token takes in column p_ids; p_more has them.
WIDE = (1 << 16) + ONCE - 1


def tokens(text: str | bytes | None) -> list[bytes]:
    """Words in lower case (A-Z only), then the end."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return [*data.lower().split(), END]


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of a binary column's rows, as in tokens() but without ends, one after another, and the rows' bounds."""
    raw, at = _values(column.fill_null(b""), "u1")
    raw = np.frombuffer(raw.tobytes().lower(), np.uint8)
    inside = _WORD[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begin, end = at[:-1][at[:-1] < len(raw)], at[1:][at[1:] > 0] - 1  # of texts
    first[begin], last[end] = inside[begin], inside[end]
    starts = np.flatnonzero(first)
    ends = np.cumsum(np.flatnonzero(last) + 1 - starts)
    return _column(raw[inside], np.concatenate([[0], ends])), np.searchsorted(starts, at)


def _parts(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of runs of a binary column's rows of about TEXT bytes."""
    at, a = _values(column.fill_null(b""), "u1")[1], 0
    while a < len(column):
        b = min(max(a + 1, int(np.searchsorted(at, at[a] + TEXT))), len(column))
        yield a, b
        a = b


def rare_codes(words: pa.Array) -> np.ndarray:
    """Negative numbers, from Spark's xxhash64 of the words; common words have their ids from 0 on, 0 being the end."""
    data, at = _values(words, "u1")
    data, at = data.tobytes(), at.tolist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(data[a:b], 42) for a, b in zip(at, at[1:], strict=False)), np.uint64, len(words))
    return -1 - (hashes >> np.uint64(2)).astype(np.int64)


def count_words(texts: DataFrame) -> DataFrame:
    """word, code (of a rare word), n of all tokens of column text, in the shared folder."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [pa.array([], pa.binary())], 0, 0

        def flush() -> pa.RecordBatch:
            words, n = pa.chunked_array(held).value_counts().flatten()
            more = [END] if ends else []  # an end for each text
            return pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array(more, pa.binary())]), pa.concat_arrays([n, pa.array([ends] * len(more), pa.int64())])], names=["word", "n"])

        for batch in batches:
            for a, b in _parts(batch.column(0)):
                held.append(words_of(batch.column(0).slice(a, b - a))[0])
                size, ends = size + len(held[-1]), ends + b - a
                if size > 2 * SUMMED:
                    yield flush()
                    held, size, ends = held[:1], 0, 0
        yield flush()

    rows = texts.select(F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(lean(count), "word binary, n long")
    code = -1 - F.shiftrightunsigned(F.xxhash64("word"), 2)
    return save(rows.groupBy("word").agg(F.sum("n").alias("n")).select("word", code.alias("code"), "n"), "words")


@dataclass
class Level:
    """Grams of one length: sorted keys (context's place << _BITS | last token), counts, place of the gram without its first token."""

    keys: np.ndarray
    n: np.ndarray
    suffix: np.ndarray
    gain: np.ndarray = field(default_factory=lambda: np.zeros(0))  # (c - discount) / n(s) where the last token diverges, else 0
    keep: np.ndarray = field(default_factory=lambda: np.zeros(0))  # what the gram, as a context, leaves to its suffix; 1 if not retained


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted among sorted keys, -1 where missing; negative ones are missing."""
    if not len(keys):
        return np.full(wanted.shape, -1, np.int64)
    place = np.searchsorted(keys, wanted)
    place[place == len(keys)] = 0
    return np.where((wanted >= 0) & (keys[place] == wanted), place, -1)


class Tree:
    """levels[0] are the common words themselves (place: word), levels[k] the grams of k + 1 tokens."""

    def __init__(self, words: dict[bytes, int], n_tokens: int, n_words: int):
        self.ids = {w: i for i, w in enumerate(sorted(words))}
        counts = np.array([words[w] for w in self.ids], np.int64)
        self.n_tokens, self.n_words = n_tokens, n_words
        self.floor = float(np.log10(n_tokens + n_words + 1.0))
        self.prob = (counts + 1.0) / (n_tokens + n_words + 1.0)
        self.end = self.ids.get(END, -1)
        self.levels = [Level(np.arange(len(counts)), counts, np.zeros(len(counts), np.int64))]

    def contexts(self, ids: np.ndarray) -> list[np.ndarray]:
        """For each token and k, the place of the gram of k + 1 tokens that ends there; -1 if there is none."""
        out = [ids.astype(np.int64)]
        for level in self.levels[1:]:
            before = np.concatenate([[-1], out[-1][:-1]])
            usable = (before >= 0) & (ids >= 0) & (ids != self.end)
            found = np.full(len(ids), -1, np.int64)
            at = np.flatnonzero(usable)
            found[at] = _find(level.keys, (before[at] << _BITS) | ids[at])
            out.append(found)
        return out

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """Keys of the grams one longer than the last level's, in a run of texts that begins with an end."""
        last = self.contexts(ids)[-1][:-1]
        following = ids[1:].astype(np.int64)
        at = np.flatnonzero((last >= 0) & (following >= 0))
        return (last[at] << _BITS) | following[at]

    def expected(self, depth: int, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        """P(token | context), the contexts being grams of ``depth`` tokens; depth 0 is the root."""
        if not depth:
            return self.prob[token]
        rest = self.expected(depth - 1, self.levels[depth - 1].suffix[context], token)
        own = self.levels[depth]
        place = _find(own.keys, (context << _BITS) | token)
        return np.where(place >= 0, own.gain[place] if len(own.gain) else 0.0, 0.0) + self.levels[depth - 1].keep[context] * rest

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        """The next level; decides which tokens diverge and which contexts are retained."""
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        depth = len(self.levels)
        above = self.levels[-1]
        context, token = keys >> _BITS, keys & ((1 << _BITS) - 1)
        suffix = token if depth == 1 else _find(above.keys, (above.suffix[context] << _BITS) | token)
        want = above.n[context] * self.expected(depth - 1, above.suffix[context], token)
        diverges = (n > want) & (n * np.log(n / want) - (n - want) > DIVERGENCE)
        gain = np.where(diverges, (n - DISCOUNT) / above.n[context], 0.0)
        above.keep = 1.0 - np.bincount(context, gain, len(above.n))
        self.levels.append(Level(keys, n, np.maximum(suffix, 0), gain))

    def score(self, ids: np.ndarray) -> np.ndarray:
        """log10 of P(token | text before it) for all but the first, which is an end; for a rare word, without its own probability."""
        p = np.where(ids[1:] >= 0, self.prob[np.maximum(ids[1:], 0)] if len(self.prob) else 1.0, 1.0)
        if len(self.levels) == 1:
            return np.log10(p)
        places = self.contexts(ids)
        for depth in range(1, len(self.levels)):
            context, own = places[depth - 1][:-1], self.levels[depth]
            at = np.flatnonzero(context >= 0)
            s, x = context[at], ids[1:][at].astype(np.int64)
            retained = self.levels[depth - 1].keep[s] < 1.0
            at, s, x = at[retained], s[retained], x[retained]
            place = _find(own.keys, np.where(x >= 0, (s << _BITS) | x, -1))
            gain = np.where(place >= 0, own.gain[place] if len(own.gain) else 0.0, 0.0)
            p[at] = gain + self.levels[depth - 1].keep[s] * p[at]
        return np.log10(p)

    @property
    def retained(self) -> list[int]:
        """Contexts retained, by length."""
        return [int((level.keep < 1.0).sum()) for level in self.levels[:-1]]


def _column(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of numbers as a binary column, which costs Spark a step a row; a list costs one a number."""
    at = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def _values(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column's rows, one after another, and the rows' bounds."""
    if not len(column):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind) if at[-1] > at[0] else np.zeros(0, kind)
    return flat, (at - at[0]) // np.dtype(kind).itemsize


def _narrow(codes: np.ndarray) -> np.ndarray:
    """Numbers of words in two bytes each; from WIDE on as WIDE."""
    return np.minimum(codes, WIDE).astype("<u2")


def _codes(ids: pa.Array, more: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of words in columns p_ids and p_more, and the rows' bounds."""
    flat, bounds = _values(ids, "<u2")
    codes = flat.astype(np.int32)
    codes[flat > WIDE] -= 1 << 16
    codes[flat == WIDE] = _values(more, "<i4")[0]
    return codes, bounds


def encode(docs: DataFrame, order: list[bytes], logs: np.ndarray, seen: bool, keep: list[str]) -> DataFrame:
    """The keep columns, p_chunk and each text as places of words in order (fewer than WIDE; -1: rare), in the shared folder; codes of the rare ones in their order."""
    shared = docs.sparkSession.sparkContext.broadcast((pa.array(order, pa.binary()), logs))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, logs = shared.value
        size = 0
        chunk = TaskContext.get().partitionId() << 24
        for whole in batches:
            for a, b in _parts(whole.column(whole.num_columns - 1)):
                batch = whole.slice(a, b - a)
                words, ends = words_of(batch.column(batch.num_columns - 1))
                ends = ends + np.arange(len(ends))  # each text has an end
                code = np.zeros(ends[-1], np.int32)
                inside = np.ones(len(code), bool)
                inside[ends[1:] - 1] = False
                code[inside] = pc.index_in(words, value_set=order).fill_null(-1)
                common = code >= 0
                others = np.flatnonzero(~common)
                rare = rare_codes(words.filter(pa.array(~common[inside])))
                known = np.add.reduceat(common, ends[:-1], dtype=np.int64) - (not seen)
                base = np.add.reduceat(np.where(common, logs[code], 0.0), ends[:-1])
                chunks = chunk + (size + ends[1:]) // CHUNK
                size += len(code)
                columns = [pa.array(chunks), _column(_narrow(code), ends), pa.array(known), pa.array(base), _column(rare, np.searchsorted(others, ends))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*keep, "p_chunk", "p_ids", "p_known", "p_base", "p_rare"])

    rows = docs.select(*keep, F.col("text").cast("string").cast("binary").alias("text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[:-1])
    return save(rows.mapInArrow(lean(run), f"{schema}p_chunk long, p_ids binary, p_known long, p_base double, p_rare binary"), "encoded", compression="zstd")


def _runs(ids: pa.Array, more: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, codes after an end, bounds) for runs of rows of about STEP tokens."""
    flat, bounds = _codes(ids, more)
    a = 0
    while a < len(ids):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + STEP)))
        b = min(b, len(ids))
        yield a, np.concatenate([[0], flat[bounds[a] : bounds[b]]]).astype(np.int64), bounds[a : b + 1] - bounds[a]
        a = b


@dataclass
class Counts:
    """Counts of words by their numbers: those of common words, then runs of numbers with equal counts."""

    common: np.ndarray
    starts: np.ndarray
    n: np.ndarray

    def of(self, ids: np.ndarray) -> np.ndarray:
        out = self.common[np.minimum(ids, len(self.common) - 1)]
        rare = np.flatnonzero(ids >= len(self.common))
        out[rare] = self.n[np.searchsorted(self.starts, ids[rare], "right") - 1]
        return out


def number(rare: DataFrame, common: np.ndarray) -> tuple[DataFrame, Counts]:
    """code, id of the rare words in descending order of n, ONCE for all that occur once; counts of numbers."""
    parts = rare.where("n > 1").withColumn("part", F.pmod("code", F.lit(64)))
    # counts of rare words are few: their sum is below that of all tokens, and each is below the COMMON-th largest
    sizes = sorted(((r.n, r.part, r["count"]) for r in parts.groupBy("n", "part").count().collect()), key=lambda r: (-r[0], r[1]))
    first = np.concatenate([[len(common)], len(common) + np.cumsum([r[2] for r in sizes])]).astype(np.int64)
    begins = [i for i, r in enumerate(sizes) if not i or sizes[i - 1][0] != r[0]]
    counts = Counts(common, first[begins], np.array([sizes[i][0] for i in begins], np.int64))
    start = rare.sparkSession.createDataFrame(pa.table({"n": pa.array([r[0] for r in sizes], pa.int64()), "part": pa.array([r[1] for r in sizes], pa.int64()), "first": pa.array(first[:-1])}), "n long, part long, first long")
    place = F.row_number().over(Window.partitionBy("n", "part").orderBy("code")) - 1
    ids = parts.withColumn("place", place).join(F.broadcast(start), ["n", "part"]).select("code", (F.col("first") + F.col("place")).cast("int").alias("id"))
    return ids.union(rare.where("n = 1").select("code", F.lit(ONCE).alias("id"))), counts


def read_chunk(folder: str, chunk: int, columns: list[str]) -> list[np.ndarray] | None:
    """Columns of what was written to folder for a chunk; None if nothing."""
    fs, inner = open_fs(folder)
    files = fs.get_file_info(pafs.FileSelector(f"{inner}/chunk={chunk}", allow_not_found=True))
    tables = [pq.ParquetFile(fs.open_input_file(f.path)).read(columns) for f in files if f.path.endswith(".parquet")]
    return [pa.concat_tables(tables)[c].to_numpy() for c in columns] if tables else None


def resolve(encoded: DataFrame, ids: DataFrame, counts: Counts, whole: float, n_words: int, keep: list[str], spent: list[str]) -> DataFrame:
    """The keep columns, p_chunk, p_ids and p_more with the numbers of rare words too, p_known, p_base, in the shared folder.

    The tables at the spent paths, which ids read, are removed as soon as they are read.
    """
    spark, bits = encoded.sparkSession, block_bits(n_words)

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def ready() -> Iterator[pa.RecordBatch]:
            codes = np.concatenate([*held, np.zeros(0, np.int64)])
            held.clear()
            yield from _pieces(np.unique(_code_keys(codes)), [], bits, now or 0)

        for batch in batches:
            chunks = np.asarray(batch.column(0))
            for a, b in _spans(chunks):
                if chunks[a] != now:
                    yield from ready()
                    now = chunks[a]
                held.append(np.unique(_values(batch.column(1).slice(a, b - a), "<i8")[0]))
        yield from ready()

    def tell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _told(([_code_keys(np.asarray(b.column(0))), np.asarray(b.column(1)).astype(np.int64)] for b in batches), bits)

    asked = encoded.select("p_chunk", "p_rare").mapInArrow(lean(ask), _BLOCKS)
    folder = look_up(asked, ids.select("code", "id").mapInArrow(lean(tell), _BLOCKS), 1, "numbers")
    for path in spent:
        remove(path)
    _free(encoded)
    shared = spark.sparkContext.broadcast(counts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table = None, None
        once, unseen = np.log10(2.0 / whole), np.log10(1.0 / whole)
        for whole_batch in batches:
            chunks = np.asarray(whole_batch.column("p_chunk"))
            for a, b in _spans(chunks):
                batch = whole_batch.slice(a, b - a)
                if chunks[a] != now:
                    now, table = chunks[a], read_found(folder, chunks[a], 1)
                    if table:
                        order = np.argsort(table[0])
                        table = [table[0][order], table[1].view(np.int64)[order]]
                flat, ends = _values(batch.column("p_ids"), "<u2")
                others, starts = _values(batch.column("p_rare"), "<i8")
                codes = flat.astype(np.int32)
                found = np.full(len(others), UNSEEN, np.int32)
                if table:
                    keys = _code_keys(others)
                    place = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
                    hit = table[0][place] == keys
                    found[hit] = table[1][place[hit]]
                logs = np.where(found == ONCE, once, unseen)
                more = np.flatnonzero(found >= 0)
                logs[more] = np.log10((shared.value.of(found[more]) + 1.0) / whole)
                codes[flat > WIDE] = found
                wide = np.flatnonzero(codes >= WIDE)
                lengths = np.diff(starts)
                row = np.repeat(np.arange(len(lengths)), lengths)
                known = batch.column("p_known").to_numpy() + np.bincount(row, found != UNSEEN, len(lengths)).astype(np.int64)
                base = batch.column("p_base").to_numpy() + np.bincount(row, logs, len(lengths))
                columns = [_column(_narrow(codes), ends), _column(codes[wide].astype("<i4"), np.searchsorted(wide, ends))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*keep, "p_chunk"]), *columns, pa.array(known), pa.array(base)], names=[*keep, "p_chunk", "p_ids", "p_more", "p_known", "p_base"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in encoded.select(*keep).schema)
    rows = encoded.select(*keep, "p_chunk", "p_ids", "p_known", "p_base", "p_rare").mapInArrow(lean(run), f"{schema}p_chunk long, p_ids binary, p_more binary, p_known long, p_base double")
    return save(rows, "texts", compression="zstd")


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _hashed(seed: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a long."""
    turn = lambda v, k: (v << np.uint64(k)) | (v >> np.uint64(64 - k))
    h = (seed + _P5 + np.uint64(8)) ^ (turn(x.view(np.uint64) * _P2, 31) * _P1)
    h = turn(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def gram_keys(codes: np.ndarray, most: int) -> list[np.ndarray]:
    """For k = 1 to most, xxhash64 of the k codes that end at each place from k - 1 on."""
    out = [_hashed(np.full(len(codes), 42, np.uint64), codes)]
    for k in range(1, most):
        out.append(_hashed(out[-1][:-1], np.ascontiguousarray(codes[k:])))
    return out


class Filter:
    """Two bits for each key; has() is true for every key that was put in, and for few others while there is room."""

    def __init__(self, bits: int, slices: dict[int, bytes]):
        self.bits, empty = bits, bytes(1 << (bits - 9))
        self.data = np.frombuffer(b"".join(slices.get(i, empty) for i in range(64)), np.uint8)

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Both are in the slice that the key's first six bits name."""
        low = np.uint64((1 << (bits - 6)) - 1)
        return (keys >> np.uint64(64 - bits)).astype(np.int64), ((keys >> np.uint64(58) << np.uint64(bits - 6)) | (keys & low)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        a = keys >> np.uint64(64 - self.bits)
        found = ((self.data[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
        at = np.flatnonzero(found)
        b = self.places(keys[at], self.bits)[1]
        found[at] = (self.data[b >> 3] >> (b & 7)) & 1
        return found

    @classmethod
    def of(cls, keys: DataFrame) -> Filter:
        """From column key; each slice is made in one task."""
        bits = min(FILTER, max(16, (16 * keys.count()).bit_length()))

        def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size, made = 1 << (bits - 9), {}
            for batch in batches:
                mine = np.asarray(batch.column(0)).view(np.uint64)
                which = (mine >> np.uint64(58)).astype(np.int64)
                for i in np.unique(which).tolist():
                    data = made.setdefault(i, np.zeros(size, np.uint8))
                    for at in cls.places(mine[which == i], bits):
                        at = at - i * size * 8
                        np.bitwise_or.at(data, at >> 3, (1 << (at & 7)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array([d.tobytes() for d in made.values()], pa.binary())], names=["slice", "data"])

        rows = keys.repartition(64, F.shiftrightunsigned("key", 58)).mapInArrow(fill, "slice int, data binary").toArrow()  # 2 ** FILTER bits at most
        return cls(bits, dict(zip(rows["slice"].to_pylist(), rows["data"].to_pylist(), strict=True)))


class Entries:
    """Entries of the model in memory, found by the first bits of their keys."""

    def __init__(self, keys: np.ndarray, ratios: np.ndarray, keeps: np.ndarray):
        keys, at = np.unique(keys.view(np.uint64), return_index=True)
        self.keys, self.ratios, self.keeps = keys, ratios[at], keeps[at]
        self.bits = min(24, max(1, (2 * len(keys)).bit_length()))
        self.starts = np.searchsorted(keys >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)
        marks = np.zeros(1 << 24, bool)  # two megabytes of bits tell most keys that are not there
        marks[keys >> np.uint64(40)] = True
        self.marks = np.packbits(marks, bitorder="little")

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places among wanted, places among the entries) of those that are there."""
        first = wanted >> np.uint64(40)
        at = np.flatnonzero((self.marks[first >> np.uint64(3)] >> (first & np.uint64(7)).astype(np.uint8)) & 1)
        key, found = wanted[at], []
        top = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        place, last = self.starts[top], self.starts[top + 1]
        fits = place < last
        at, key, place, last = at[fits], key[fits], place[fits], last[fits]
        while len(at):
            here = self.keys[place]
            hit = here == key
            found.append((at[hit], place[hit]))
            place = place + 1
            more = (here < key) & (place < last)
            at, place, last, key = at[more], place[more], last[more], key[more]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (at, at)


def _chain(columns: list[np.ndarray]) -> np.ndarray:
    """Keys of the grams whose k-th tokens the columns hold."""
    key = np.full(len(columns[0]), 42, np.uint64)
    for c in columns:
        key = _hashed(key, c)
    return key


def windows(codes: np.ndarray) -> np.ndarray:
    """Rows w1, w2, w3, x: each token and those before it, the nearest first, as numbers from 1; 0 is none.

    A context ends at an end, and at a word that occurs once: no gram with it is
    learned.  Windows that tell nothing but their first context token are left out.
    """
    up = np.where(codes >= 0, codes + 1, 0).astype(np.uint32)
    x, w1 = up[1:], up[:-1]
    w2 = np.where(w1 > 1, np.concatenate([up[:1] * 0, up[:-2]]), 0)
    w3 = np.where(w2 > 1, np.concatenate([up[:2] * 0, up[:-3]])[: len(x)], 0)
    return np.stack([w1, w2, w3, x]).compress((w1 > 0) & ((x > 0) | (w2 > 0)), axis=1)


def _mixed(x: np.ndarray) -> np.ndarray:
    return _hashed(np.full(len(x), 7, np.uint64), x.astype(np.int64)) >> np.uint64(33)


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each key's place among the different ones, those in order)."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    ranks = np.empty(len(keys), np.uint64)
    ranks[order] = np.cumsum(new, dtype=np.uint64) - np.uint64(1)
    return ranks, keys[new]


def _summed(w: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Different windows in order, with the sums of n (None: of ones)."""
    # the places of both halves fit one number, which sorts faster than two
    half = np.uint64(32)
    high, highs = _ranks((w[0].astype(np.uint64) << half) | w[1])
    low, lows = _ranks((w[2].astype(np.uint64) << half) | w[3])
    keys = (high << half) | low
    if n is None:
        keys.sort()
    else:
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
    first = _numbered(keys)[1]
    sums = np.diff(np.append(first, len(keys))) if n is None else np.add.reduceat(n, first) if len(first) else n
    high, low = highs[keys[first] >> half], lows[keys[first] & np.uint64(0xFFFFFFFF)]
    return np.stack([high >> half, high, low >> half, low]).astype(np.uint32), sums


def _pack(w: np.ndarray, n: np.ndarray) -> bytes:
    """Windows in order, with counts: their bytes by weight, the first tokens as differences."""
    planes = np.concatenate([np.diff(w[:1], prepend=np.uint32(0)), w[1:], n[None].astype(np.uint32)]).astype("<u4", order="C")
    data = np.ascontiguousarray(planes.view(np.uint8).reshape(5, -1, 4).transpose(0, 2, 1)).tobytes()
    return len(n).to_bytes(4, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(data[:4], "little")
    raw = pa.Codec("zstd").decompress(data[4:], 20 * size, asbytes=True)
    planes = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(5, 4, size).transpose(0, 2, 1)).reshape(5, -1).view("<u4")
    w = planes[:4].copy()
    w[0] = np.cumsum(w[0], dtype=np.uint32)
    return w, planes[4].astype(np.int64)


def _diverging(n: np.ndarray, n_s: np.ndarray, want: np.ndarray) -> np.ndarray:
    """(n - DISCOUNT) / n_s where the token diverges, else 0."""
    diverges = (n >= LEAST) & (n > want) & (n * np.log(n / want) - (n - want) > DIVERGENCE)
    return np.where(diverges, (n - DISCOUNT) / n_s, 0.0)


def _numbered(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the runs of equal rows, the runs' first places)."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _tokens_of(context: np.ndarray, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (context, x), and their sums, of those that occur LEAST times."""
    keys = (context.astype(np.uint64) << np.uint64(32)) | x
    order = np.argsort(keys)
    keys = keys[order]
    first = _numbered(keys)[1]
    sums = np.add.reduceat(n[order], first) if len(first) else n[:0]
    keys, sums = keys[first][sums >= LEAST], sums[sums >= LEAST]
    return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), sums


class Ratios:
    """Ratios of diverging (context, x); 0 for others."""

    def __init__(self, context: np.ndarray, x: np.ndarray, ratio: np.ndarray):
        keys = (context.astype(np.uint64) << np.uint64(32)) | x
        order = np.argsort(keys)
        self.keys, self.ratio = keys[order], ratio[order]

    def of(self, context: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(x))
        keys = (context.astype(np.uint64) << np.uint64(32)) | x
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, self.ratio[place], 0.0)


def learn(w: np.ndarray, n: np.ndarray, counts: Counts, whole: float, heavy: dict[int, list[np.ndarray]]) -> Iterator[tuple[np.ndarray, ...]]:
    """key, ratio, keep, n of the grams that diverge and the contexts retained in all windows of some last context tokens.

    ``w`` and ``n`` are in order.  For a w1 in ``heavy``, its x, gain and ratio are
    those that diverge in context w1 (w and n hold some of its windows); they are
    not given out again.
    """
    code = lambda c: c.astype(np.int64) - 1
    i1, f1 = _numbered(w[0])
    i2, f2 = _numbered(w[0], w[1])
    i3, f3 = _numbered(w[0], w[1], w[2])
    if not len(f1):
        return
    n2, n3 = np.add.reduceat(n, f2), np.add.reduceat(n, f3)
    w1 = w[0][f1]
    n1 = counts.of(code(w1))

    def told(k: int, keys: list[np.ndarray], gain: np.ndarray, ratio: np.ndarray, c: np.ndarray, context: np.ndarray, keep: np.ndarray, n_s: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        at = np.flatnonzero(gain > 0)
        yield _chain([code(x[at]) for x in keys]), ratio[at], np.ones(len(at)), c[at]
        at = np.unique(context[at])
        yield _chain([code(w[j][firsts[at]]) for j in range(k - 2, -1, -1)]), np.zeros(len(at)), keep[at], n_s[at]

    # pairs
    at = np.flatnonzero((w[3] > 0) & ~np.isin(w1, list(heavy))[i1])
    s, x, c = _tokens_of(i1[at], w[3][at], n[at])
    p0 = (counts.of(code(x)) + 1.0) / whole
    gain = _diverging(c, n1[s], n1[s] * p0)
    keep1 = 1.0 - np.bincount(s, gain, len(f1))
    yield from told(2, [w1[s], x], gain, gain / p0, c, s, keep1, n1, f1)
    at = gain > 0
    parts = [(s[at], x[at], (gain / p0)[at])]
    for one, (more_x, more_gain, more_ratio) in heavy.items():
        place = int(np.searchsorted(w1, one))
        if place < len(w1) and w1[place] == one:
            parts.append((np.full(len(more_x), place), more_x.astype(np.uint32), more_ratio))
            keep1[place] = 1.0 - more_gain.sum()
    ratio1 = Ratios(*(np.concatenate(c) for c in zip(*parts, strict=True)))
    # three tokens
    up2 = i1[f2]
    at = np.flatnonzero((w[3] > 0) & (w[1] > 0))
    s, x, c = _tokens_of(i2[at], w[3][at], n[at])
    p0 = (counts.of(code(x)) + 1.0) / whole
    gain = _diverging(c, n2[s], n2[s] * p0 * (ratio1.of(up2[s], x) + keep1[up2[s]]))
    keep2 = 1.0 - np.bincount(s, gain, len(f2))
    yield from told(3, [w[1][f2[s]], w[0][f2[s]], x], gain, gain / p0, c, s, keep2, n2, f2)
    at = gain > 0
    ratio2 = Ratios(s[at], x[at], (gain / p0)[at])
    # four
    at = np.flatnonzero((w[3] > 0) & (w[2] > 0) & (n >= LEAST))
    s, x, c = i3[at], w[3][at], n[at]
    p0 = (counts.of(code(x)) + 1.0) / whole
    t, u = i2[f3[s]], i1[f3[s]]
    gain = _diverging(c, n3[s], n3[s] * p0 * (ratio2.of(t, x) + keep2[t] * (ratio1.of(u, x) + keep1[u])))
    keep3 = 1.0 - np.bincount(s, gain, len(f3))
    yield from told(4, [w[2][at], w[1][at], w[0][at], x], gain, gain / p0, c, s, keep3, n3, f3)


_MODEL = "key long, ratio double, keep double, n long"


def frequent_pairs(encoded: DataFrame, counts: Counts, whole: float) -> tuple[str, DataFrame]:
    """Tokens that diverge after words with more than BLOCK windows: a folder with a folder for each word, and their part of the model."""
    spark, path = encoded.sparkSession, new_path(encoded.sparkSession, "pairs")
    shared = spark.sparkContext.broadcast(counts)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, held, size = shared.value.common > BLOCK, [], 0

        def ready() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate([*held, np.zeros(0, np.int64)]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            for _, codes, _ in _runs(batch.column(0), batch.column(1)):
                s, x = codes[:-1], codes[1:]
                at = np.flatnonzero((s >= 0) & (s < len(heavy)) & (x >= 0))
                at = at[heavy[s[at]]]
                held.append((s[at] << 32) | x[at])
                size += len(at)
                if size > SUMMED:
                    yield ready()
                    held, size = [], 0
        yield ready()

    def tell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, n = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            s, x = pair >> 32, pair & 0xFFFFFFFF
            n_s, p0 = shared.value.of(s), (shared.value.of(x) + 1.0) / whole
            gain = _diverging(n, n_s, n_s * p0)
            at = gain > 0
            columns = [x[at], gain[at], (gain / p0)[at], _chain([s[at], x[at]]).view(np.int64), _chain([s[at]]).view(np.int64), n[at], n_s[at], s[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["x", "gain", "ratio", "key", "context", "n", "n_s", "chunk"])

    schema = "x long, gain double, ratio double, key long, context long, n long, n_s long, chunk long"
    pairs = encoded.select("p_ids", "p_more").mapInArrow(lean(count), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    pairs.mapInArrow(tell, schema).repartition("chunk").sortWithinPartitions("chunk").write.partitionBy("chunk").parquet(path)
    rows = spark.read.schema(schema).parquet(path)
    kept = rows.groupBy("context").agg((1.0 - F.sum("gain")).alias("keep"), F.max("n_s").alias("n"))
    return path, rows.select("key", "ratio", F.lit(1.0).alias("keep"), "n").union(kept.selectExpr("context", "0.0D", "keep", "n"))


def learn_windows(encoded: DataFrame, counts: Counts, whole: float, tokens: int, pairs: str | None) -> DataFrame:
    """key, ratio, keep, n of what all windows give, in the shared folder; pairs is the folder of frequent_pairs()."""
    shared = encoded.sparkSession.sparkContext.broadcast(counts)
    blocks = max(1, tokens // (BLOCK // 2))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value.common
        many = np.concatenate([[1], np.where(common > BLOCK, 2 * common // BLOCK, 1), [1]]).astype(np.uint64)  # blocks of a word, by numbers from 1
        held, size = np.empty((4, SUMMED), np.uint32), 0

        def ready() -> Iterator[pa.RecordBatch]:
            w, n = _summed(held[:, :size], None)
            split = many[np.minimum(w[0], len(many) - 1)]
            block = ((_mixed(w[0]) + _mixed(w[1]) % split) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            w, n, block = w.take(order, axis=1), n[order], block[order]
            spans = list(_spans(block))
            for some in (spans[i : i + 16] for i in range(0, len(spans), 16)):
                data = [_pack(w[:, a:b], n[a:b]) for a, b in some]
                yield pa.RecordBatch.from_arrays([pa.array(block[[a for a, _ in some]]), pa.array(data, pa.binary())], names=["block", "data"])

        for batch in batches:
            for _, codes, _ in _runs(batch.column(0), batch.column(1)):
                w = windows(codes)
                while w.shape[1]:
                    some, w = w[:, : SUMMED - size], w[:, SUMMED - size :]
                    held[:, size : size + some.shape[1]] = some
                    size += some.shape[1]
                    if size == SUMMED:
                        yield from ready()
                        size = 0
        if size:
            yield from ready()

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, least = None, [], 0, 2 * BLOCK
        common = shared.value.common

        def merged() -> tuple[np.ndarray, np.ndarray]:
            w, n = np.concatenate([h[0] for h in held], axis=1), np.concatenate([h[1] for h in held])
            held.clear()
            return _summed(w, n)

        def ready() -> Iterator[pa.RecordBatch]:
            w, n = merged()
            heavy = {}
            for one in np.unique(w[0]).tolist():
                if pairs and one <= len(common) and common[one - 1] > BLOCK:
                    heavy[one] = read_chunk(pairs, one - 1, ["x", "gain", "ratio"]) or [np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
                    heavy[one][0] = heavy[one][0] + 1
            for key, *columns in learn(w, n, shared.value, whole, heavy):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *map(pa.array, columns)], names=["key", "ratio", "keep", "n"])

        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if block != now and held:
                    yield from ready()
                    size, least = 0, 2 * BLOCK
                now = block
                held.append(_unpack(data.as_py()))
                size += len(held[-1][1])
                if size > least:  # equal windows of several tasks are summed before more are held
                    held.append(merged())
                    size = len(held[-1][1])
                    least = max(least, 2 * size)
        if held:
            yield from ready()

    rows = encoded.select("p_ids", "p_more").mapInArrow(lean(deal), "block long, data binary").repartition("block").sortWithinPartitions("block")
    return save(rows.mapInArrow(lean(total), _MODEL), "learned")


def _free(df: DataFrame) -> None:
    """Have the driver let go of shuffles whose tables are gone, so that their files are removed; it holds the last job's until the next."""
    df.sparkSession.range(1).collect()
    df.sparkSession.sparkContext.parallelize([0], 1).count()
    df.sparkSession.sparkContext._jvm.System.gc()


def grow(encoded: DataFrame, counts: Counts, whole: float, tokens: int) -> DataFrame:
    """key, ratio, keep, n of diverging grams and retained contexts, in the shared folder."""
    with recorded() as made:
        pairs, more = frequent_pairs(encoded, counts, whole) if (counts.common > BLOCK).any() else (None, None)
        rows = learn_windows(encoded, counts, whole, tokens, pairs)
        _free(encoded)
        model = save((rows.union(more) if pairs else rows).groupBy("key").agg(F.max("ratio").alias("ratio"), F.min("keep").alias("keep"), F.max("n").alias("n")), "model")
    drop_unread(made, model)
    _free(encoded)
    return model


def hottest(table: DataFrame, most: int) -> int:
    """An n that at most so many rows reach; 0 if all may be taken.  Counts are told apart by their first eight bits."""
    shift = "greatest(0, cast(floor(log2(n)) as int) - 7)"
    sizes = table.groupBy(F.expr(f"shiftleft(shiftright(n, {shift}), {shift})").alias("m")).count().collect()  # 64 * 128 rows at most
    left, least = most, (1 << 63) - 1
    for m, count in sorted(((r.m, r["count"]) for r in sizes), reverse=True):
        if count > left:
            return least
        left, least = left - count, m
    return 0


def _spans(chunks: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    edges = [0, *(np.flatnonzero(chunks[1:] != chunks[:-1]) + 1).tolist(), len(chunks)]
    yield from ((a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b)


def _pack_sorted(keys: np.ndarray, *others: np.ndarray) -> bytes:
    """Keys in ascending order, as differences, and doubles; their bytes by weight."""
    planes = np.stack([np.diff(keys, prepend=np.uint64(0)), *(c.view(np.uint64) for c in others)]).astype("<u8")
    data = np.ascontiguousarray(planes.view(np.uint8).reshape(len(planes), -1, 8).transpose(0, 2, 1)).tobytes()
    return len(keys).to_bytes(4, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def _unpack_sorted(data: bytes, columns: int) -> list[np.ndarray]:
    size = int.from_bytes(data[:4], "little")
    raw = pa.Codec("zstd").decompress(data[4:], 8 * columns * size, asbytes=True)
    planes = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(columns, 8, size).transpose(0, 2, 1)).reshape(columns, -1).view("<u8")
    return [np.cumsum(planes[0], dtype=np.uint64), *(c.view(np.float64) for c in planes[1:])]


def _pieces(keys: np.ndarray, others: list[np.ndarray], bits: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """Sorted keys and their values as rows block, chunk, data: a block for each value of the keys' first bits."""
    edges = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    full = np.flatnonzero(edges[1:] > edges[:-1])
    data = [_pack_sorted(*(c[edges[i] : edges[i + 1]] for c in (keys, *others))) for i in full]
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(np.full(len(full), chunk)), pa.array(data, pa.binary())], names=["block", "chunk", "data"])


_BLOCKS = "block long, chunk long, data binary"


def block_bits(entries: int) -> int:
    """Of keys, how many name a block of a table with so many entries."""
    return max(4, (entries >> 18).bit_length())


def _code_keys(codes: np.ndarray) -> np.ndarray:
    """Codes of rare words as keys whose first bits differ."""
    return (~codes).view(np.uint64) << np.uint64(2)


def _told(parts: Iterable[list[np.ndarray]], bits: int) -> Iterator[pa.RecordBatch]:
    """Blocks of keys and their values, as those of chunk -1."""
    held, size = [], 0

    def ready() -> Iterator[pa.RecordBatch]:
        keys, *others = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(keys)
        held.clear()
        yield from _pieces(keys[order], [c[order] for c in others], bits, -1)

    for part in parts:
        held.append(part)
        size += len(part[0])
        if size > SUMMED:
            yield from ready()
            size = 0
    if held:
        yield from ready()


def look_up(asked: DataFrame, told: DataFrame, values: int, name: str) -> str:
    """A folder with the keys and values told that each chunk asked for, a folder each; blocks of both meet in one task."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, entries = None, [], None
        for batch in batches:
            for block, chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if block != now:
                    now, held, entries = block, [], None
                if chunk < 0:  # these are a block's first
                    held.append(_unpack_sorted(data.as_py(), 1 + values))
                    continue
                if entries is None:
                    columns = [np.concatenate(c) for c in zip(*held, strict=True)] or [np.zeros(0, np.uint64), *[np.zeros(0)] * values]
                    order = np.argsort(columns[0])
                    entries = [c[order] for c in columns]
                    held = []
                if not len(entries[0]):
                    continue
                (keys,) = _unpack_sorted(data.as_py(), 1)
                place = np.minimum(np.searchsorted(entries[0], keys), len(entries[0]) - 1)
                place = place[entries[0][place] == keys]
                if len(place):
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([_pack_sorted(*(c[place] for c in entries))], pa.binary())], names=["chunk", "data"])

    path = new_path(asked.sparkSession, name)
    blocks = asked.union(told).repartition("block").sortWithinPartitions("block", "chunk")
    found = blocks.mapInArrow(lean(find), "chunk long, data binary").repartition("chunk").sortWithinPartitions("chunk")
    found.write.partitionBy("chunk").parquet(path)
    return path


def read_found(folder: str, chunk: int, values: int) -> list[np.ndarray] | None:
    """What look_up() wrote for a chunk; None if nothing."""
    found = read_chunk(folder, chunk, ["data"])
    return found and [np.concatenate(c) for c in zip(*(_unpack_sorted(d, 1 + values) for d in found[0]), strict=True)]


def chunk_entries(encoded: DataFrame, cold: DataFrame) -> str:
    """A folder with the entries of cold that occur in each chunk of the texts, a folder each.

    Chunks ask blocks of keys, and each block is one task's.
    """
    bits = block_bits(cold.count())
    shared = encoded.sparkSession.sparkContext.broadcast(Filter.of(cold.select("key")))

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def ready() -> Iterator[pa.RecordBatch]:
            keys = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]))
            held.clear()
            yield from _pieces(keys, [], bits, now or 0)

        for batch in batches:
            chunks = np.asarray(batch.column(0))
            for a, b in _spans(chunks):
                if chunks[a] != now:
                    yield from ready()
                    now = chunks[a]
                for _, codes, _ in _runs(*(batch.column(j).slice(a, b - a) for j in (1, 2))):
                    held += [g[shared.value.has(g)] for g in gram_keys(codes, min(DEPTH + 1, len(codes)))]
        yield from ready()

    def tell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _told(([np.asarray(b.column(0)).view(np.uint64), *(np.asarray(b.column(j)) for j in (1, 2))] for b in batches), bits)

    asked = encoded.select("p_chunk", "p_ids", "p_more").mapInArrow(lean(ask), _BLOCKS)
    path = look_up(asked, cold.select("key", "ratio", "keep").mapInArrow(lean(tell), _BLOCKS), 2, "entries")
    _free(encoded)
    return path


def read_entries(folder: str, chunk: int) -> Entries | None:
    """What chunk_entries() wrote for a chunk; None if nothing."""
    found = read_found(folder, chunk, 2)
    return found and Entries(*found)


def first_keeps(hot: Entries, counts: np.ndarray, least: int) -> np.ndarray:
    """What the first words leave to the root as contexts, up to the first that is not counted ``least`` times and so may not be among the hot entries."""
    below = np.flatnonzero(counts < least)
    codes = np.arange(below[0] if len(below) else len(counts))
    keeps = np.ones(len(codes))
    at, place = hot.find(_chain([codes]))
    keeps[at] = hot.keeps[place]
    return keeps


def _gains(codes: np.ndarray, hot: Entries, cold: Entries | None, first: np.ndarray) -> np.ndarray:
    """log10 of P(token | text before it) over the root's, for all codes but the first; ``first`` is from first_keeps()."""
    m = len(codes)
    p, keep_before = np.ones(m), np.zeros(0)
    for k, keys in enumerate(gram_keys(codes, min(DEPTH + 1, m)), 1):
        ratio, keep = np.zeros(len(keys)), np.ones(len(keys))
        ask = None
        if k == 1:
            known = (codes >= 0) & (codes < len(first))
            ask = np.flatnonzero(~known)
            keep[known] = first[codes[known]]
        elif k > DEPTH:
            ask = np.flatnonzero(keep_before[: len(keys)] < 1.0)
        wanted = keys if ask is None else keys[ask]
        for entries in (hot, cold):
            if entries is not None and len(entries.keys):
                at, place = entries.find(wanted)
                at = at if ask is None else ask[at]
                ratio[at], keep[at] = entries.ratios[place], entries.keeps[place]
        if k > 1:
            p[k - 1 :] = ratio + keep_before[: len(keys)] * p[k - 1 :]
        keep_before = keep
    return np.log10(p)[1:]


def score_held_out(docs: DataFrame, modulus: int = 7) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of all documents; those not held out are learned from."""
    rows = docs.select("doc_id", held_out(F.col("doc_id"), modulus).alias("held_out"), "text")
    spark = docs.sparkSession
    with recorded() as before:
        words = count_words(rows.where(~F.col("held_out")))
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    whole, common = n + v + 1.0, (F.col("n") >= hottest(words, COMMON)) | (F.col("word") == F.lit(END))
    table = words.where(common).select("word", "n").toArrow()  # COMMON rows and one at most
    times = {w: c for w, c in zip(table["word"].to_pylist(), table["n"].to_pylist(), strict=True) if w != END}
    ends = int(n > 0 and sum(c for w, c in zip(table["word"].to_pylist(), table["n"].to_pylist(), strict=True) if w == END))
    order = [END, *sorted(times, key=lambda w: (-times[w], w))]
    count = np.array([ends, *(times[w] for w in order[1:])], np.int64)
    with recorded() as more:
        encoded = encode(rows, order, np.log10((count + 1.0) / whole), ends > 0, ["doc_id", "held_out"])
    ids, counts = number(words.where(~common).select("code", "n"), count)
    with recorded() as made:
        texts = resolve(encoded, ids, counts, whole, v, ["doc_id", "held_out"], before)
    drop_unread([*more, *made], texts)
    _free(texts)
    model = grow(texts.where(~F.col("held_out")), counts, whole, n)
    least = hottest(model, HOT)
    hot = model.where(F.col("n") >= least).select("key", "ratio", "keep").toArrow()  # HOT rows at most
    hot = Entries(*(hot[c].to_numpy() for c in ("key", "ratio", "keep")))
    shared = spark.sparkContext.broadcast((hot, first_keeps(hot, count, least)))
    del hot
    folder = chunk_entries(texts, model.where(F.col("n") < least)) if least else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cold = None, None
        hot, first = shared.value
        for batch in batches:
            columns = batch.column("p_ids"), batch.column("p_more")
            chunks = np.asarray(batch.column("p_chunk"))
            scores = []
            for a, b in _spans(chunks):
                if folder and chunks[a] != now:
                    now, cold = chunks[a], read_entries(folder, chunks[a])
                for _, codes, bounds in _runs(*(c.slice(a, b - a) for c in columns)):
                    sums = np.concatenate([[0.0], np.cumsum(_gains(codes, hot, cold, first))])
                    scores.append(sums[bounds[1:]] - sums[bounds[:-1]])
            lengths = np.diff(_values(columns[0], "<u2")[1])
            names = ["doc_id", "held_out", "p_known", "p_base"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(lengths), pa.array(np.concatenate(scores))], names=[*names, "n_tokens", "p_score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, p_known long, p_base double, n_tokens long, p_score double"
    scored = texts.select("doc_id", "held_out", "p_chunk", "p_known", "p_base", "p_ids", "p_more").mapInArrow(lean(run), schema)
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        F.col("p_known").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        F.col("p_base").alias("base_score"),
        (F.col("p_base") + F.col("p_score")).alias("score"),
    )
