"""Similarity join of documents on word 5-grams (Jaccard), by chosen paths.

Documents with equal sets of 5-grams are one class from the start; classes are
joined.  In each of a number of runs every set samples one of its tokens
(5-grams), the one with the smallest hash of run and token, so that two sets
sample the same one with a probability equal to their similarity, and goes to
that token's bucket.  A bucket of more than ``BUCKET`` sets is split again by a
token sampled in the same way for the next level, up to ``LEVELS`` levels; a set
is in one bucket a run at every level, however large its buckets are.  The runs
are as many as ``recall`` needs.  Small buckets are compared by brute force on
the sets' bottom-k sketches; sets that stay together in a bucket that no level
could split are taken to be linked for now.  What comes of this are candidate
components, far apart sets being in different ones.  Within each component
every pair of sets is then compared exactly, so a link is missed only if no chain
of buckets joins its ends.  Components of more than ``BLOCK`` sets, or
``BLOCK_SHINGLES`` shingles, are compared block by block, each pair of blocks
being a task of its own.

Shingles: words of [^\\x20\\x09-\\x0D], five in a row, compared by 64-bit hashes
of all of the words; a text of one to four words has all of them as its only
shingle.

Defined results: a text without words (or null) links to nothing and is a class
of its own, even if repeated; repeated rows are copies of one another; a class
is named by its smallest doc_id (null if all its documents' ids are); an empty
table gives no rows; other columns are kept, whatever their names, and never
looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lattica.llm.bpe import WordIds
from lattica.llm.components import components
from lattica.llm.scratch import lean, save, set_aside, tidied

WORDS, LEVELS, BUCKET, BLOCK, SKETCH = 5, 3, 256, 1024, 64
#: Shingles (8 bytes each) that a block of a component holds on average, at most.
BLOCK_SHINGLES = 1 << 20
#: Pairs in a bucket whose sketches are less alike are not candidates: five standard errors below 0.8.
SKETCH_LEAST = 0.55
#: Row ids that a broadcast may hold (16 bytes each); above it the join shuffles.
BROADCAST_ROWS = 1_000_000
_U = np.uint64
_PIECE = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _odd(*key: int) -> np.uint64:
    return _U(int.from_bytes(blake2b(repr(key).encode(), digest_size=8).digest(), "little") | 1)


class Shingler:
    """Shingle sets of texts; keeps a bounded table of words' hashes."""

    def __init__(self, words: int = WORDS, cached_words: int = 200_000):
        self.words = words
        self.hashes = WordIds(lambda w: blake2b(w, digest_size=8).digest(), cached_words)
        self.factors = [_odd("word", k) for k in range(words)]

    def word_hashes(self, text: str) -> np.ndarray:
        """A text is worked on a piece at a time, so that a very long one takes 8 bytes a word."""
        data, parts, at = text.encode("utf-8", "surrogatepass"), [], 0
        while at < len(data):
            end = at + _PIECE
            while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
                end += 1
            parts.append(b"".join(map(self.hashes.__getitem__, data[at:end].split())))
            at = end
        return np.frombuffer(b"".join(parts), "<u8")

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the text's shingles."""
        w = self.word_hashes(text or "")
        if not len(w):
            return w
        n = max(1, len(w) - self.words + 1)
        total = np.full(n, _U(min(len(w), self.words)))
        for k, f in enumerate(self.factors[: len(w)]):
            total += w[k : k + n] * f
        return np.unique(_mix(total))


def runs_for(recall: float, threshold: float = 0.8) -> int:
    """Runs sample by hashes of their own: one of them misses a linked pair with 1 - threshold ** LEVELS at most."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**LEVELS))


def index(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """docs with j_row (an id of the row), j_n (size of its set), j_f1 and j_f2 (128 bits of it), j_sketch and j_paths, in the shared folder.

    j_paths are the sampled tokens, all runs' of the first level first.
    """
    runs = runs_for(recall, threshold)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    added = StructType.fromDDL("j_row long, j_n int, j_f1 long, j_f2 long, j_sketch binary, j_paths array<long>")
    schema = StructType([*docs.schema.fields, *added.fields])
    samples = [(_odd("pick", level, run), _odd("key", level, run)) for level in range(LEVELS) for run in range(runs)]
    at = docs.columns.index("text")

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, row = Shingler(), TaskContext.get().partitionId() << 36
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                sets = [shingles(t.as_py()) for t in batch.column(at)]
                n = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate([*sets, np.zeros(0, _U)])
                ids = row + np.arange(len(sets), dtype=np.int64)
                row += len(sets)
                bounds = np.cumsum(n) - n
                full, prints = n > 0, []
                for k in (1, 2):
                    total = np.zeros(len(sets), _U)
                    if full.any():
                        total[full] = np.add.reduceat(_mix(flat ^ _odd("print", k)), bounds[full])
                    prints.append(np.where(full, _mix(total + n.astype(_U)).view(np.int64), ids if k == 1 else -1))
                paths = np.zeros((int(full.sum()), len(samples)), np.int64)
                if len(flat):
                    for k, (odd, key) in enumerate(samples):
                        paths[:, k] = _mix(np.minimum.reduceat(flat * odd, bounds[full]) ^ key).view(np.int64)
                ends = np.concatenate([[0], np.cumsum(full) * len(samples)]).astype(np.int32)
                sketch = [(s[:SKETCH] >> _U(32)).astype("<u4").tobytes() for s in sets]
                columns = [pa.array(ids), pa.array(n.astype(np.int32)), pa.array(prints[0]), pa.array(prints[1]), pa.array(sketch, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(paths.ravel()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[f.name for f in schema])

    return save(docs.mapInArrow(lean(task), schema), "shingles")


def _alike(sketches: list[bytes], sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(i, the j > i that may be linked to it) by sketches and sizes."""
    width, pad = SKETCH, np.uint64(1) << np.uint64(40)
    table = np.full((len(sketches), width), pad)
    for i, s in enumerate(sketches):
        v = np.frombuffer(s, "<u4")
        table[i, : len(v)] = v
    for i in range(len(sketches) - 1):
        near = np.flatnonzero(10 * np.minimum(sizes[i], sizes[i + 1 :]) >= 8 * np.maximum(sizes[i], sizes[i + 1 :])) + i + 1
        if not len(near):
            continue
        both = np.sort(np.concatenate([np.broadcast_to(table[i], (len(near), width)), table[near]], axis=1), axis=1)
        again = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] < pad)
        fresh = np.concatenate([np.ones((len(near), 1), bool), ~again], axis=1) & (both < pad)
        rank = np.cumsum(fresh, axis=1)
        k = np.minimum(rank[:, -1], width)
        common = (again & (rank[:, 1:] <= k[:, None])).sum(axis=1)
        yield i, near[common >= SKETCH_LEAST * k]


def _roots(n: int, links: Iterable[tuple[int, np.ndarray]]) -> list[int]:
    """The least member of each one's component; a link's row that adds nothing costs one comparison of labels."""
    label = np.arange(n)
    for i, many in links:
        mine = label[many]
        if (mine != label[i]).any():
            joined = np.unique(np.append(mine, label[i]))
            label[np.isin(label, joined)] = joined[0]
    return label.tolist()


def _groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """Runs of rows with the same key; rows come sorted by it."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row[key] != now:
                yield now, rows
                rows = []
            now = row[key]
            rows.append(row)
    if rows:
        yield now, rows


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def candidates(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges a, b between rows of ``reps`` (j_row) that share buckets; their components hold all links."""
    mine = sets.where("j_n > 0").select("j_row", "j_paths").join(reps.select("j_row"), "j_row", "left_semi")
    runs = (F.size("j_paths") / LEVELS).cast("int")
    rows = mine.select("j_row", F.posexplode(F.slice("j_paths", 1, runs)).alias("run", "key"))
    done: list[DataFrame] = []
    for level in range(LEVELS):
        count = rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
        shared = save(rows.join(count, "key"), f"buckets-{level}")
        small = shared.where(F.col("m") <= BUCKET).groupBy("key").agg(F.sort_array(F.collect_list("j_row")).alias("rows"))  # of BUCKET rows at most
        done.append(small.select("rows").distinct())
        large = shared.where(F.col("m") > BUCKET)
        if level == LEVELS - 1 or large.limit(1).count() == 0:
            break
        deep = F.element_at("j_paths", (level + 1) * runs + F.col("run") + 1)
        rows = large.join(sets.select("j_row", "j_paths"), "j_row").select("j_row", "run", F.xxhash64("key", deep).alias("key"))
    buckets = done[0]
    for more in done[1:]:
        buckets = buckets.unionByName(more)
    placed = buckets.distinct().select(F.xxhash64("rows").alias("bucket"), F.explode("rows").alias("j_row"))

    def brute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[int, int]] = []
        for _, rows in _groups(batches, "bucket"):
            for k, r in enumerate(_roots(len(rows), _alike([x["j_sketch"] for x in rows], np.array([x["j_n"] for x in rows])))):
                if r != k:
                    pairs.append((rows[k]["j_row"], rows[r]["j_row"]))
            if len(pairs) > 10_000:
                yield _edges(pairs)
                pairs = []
        yield _edges(pairs)

    compared = placed.join(sets.select("j_row", "j_n", "j_sketch"), "j_row").repartition("bucket").sortWithinPartitions("bucket", "j_row").mapInArrow(lean(brute), "a long, b long")
    centre = large.groupBy("key").agg(F.min("j_row").alias("b"))
    unsplit = large.join(centre, "key").select(F.col("j_row").alias("a"), "b").where("a <> b")
    return compared.unionByName(unsplit).distinct()


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of a with every set of b."""
    flat = np.concatenate([*a, *b])
    owner = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in (*a, *b)])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    token = np.cumsum(new) - 1
    shared = np.bincount(token)[token] > 1
    token, owner = token[shared], owner[shared]
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(token):
        return out
    token = np.cumsum(np.concatenate([[0], token[1:] != token[:-1]]))
    width = max(64, min(8192, (1 << 23) // (len(a) + len(b))))
    edges = np.searchsorted(token, np.arange(0, token[-1] + width + 1, width))
    for k in range(len(edges) - 1):
        part = slice(edges[k], edges[k + 1])
        grid = np.zeros((len(a) + len(b), width), np.float32)
        grid[owner[part], token[part] - k * width] = 1
        out += grid[: len(a)] @ grid[len(a) :].T
    return out


def verify(sets: DataFrame, reps: DataFrame, comps: DataFrame, threshold: float = 0.8) -> DataFrame:
    """j_row, links (documents linked to it, by weight), root for all rows of comps (node, root), compared exactly.

    The threshold is taken as a fraction of whole thousandths.
    """
    up = round(threshold * 1000)
    placed = comps.select(F.col("node").alias("j_row"), F.col("root").alias("comp")).join(reps.select("j_row", "w", "n"), "j_row")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES))
    placed = save(placed.join(placed.groupBy("comp").agg(blocks.alias("blocks")), "comp").drop("n"), "placed")
    few = placed.count() <= BROADCAST_ROWS
    texts = sets.select("j_row", "text").join(F.broadcast(placed) if few else placed, "j_row")
    block = F.pmod(F.xxhash64("j_row"), F.col("blocks")).cast("int")
    texts = texts.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    texts = texts.withColumn("cell", F.struct("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
    texts = texts.withColumn("cell", F.concat_ws("/", "cell.comp", "cell.i", "cell.j"))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, out = Shingler(), []

        def ready() -> pa.RecordBatch:
            rows, links, roots = zip(*out, strict=True) if out else ((), (), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(links, pa.int64()), pa.array(roots, pa.int64())], names=["j_row", "links", "root"])

        for cell, rows in _groups(_slim(batches, shingles), "cell"):
            i, j = map(int, cell.split("/")[1:])
            left = [r for r in rows if r["block"] == i]
            right = left if i == j else [r for r in rows if r["block"] == j]
            total = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
            everyone = left if i == j else left + right
            ids = [r["j_row"] for r in everyone]
            links: list[tuple[int, np.ndarray]] = []
            n_right, w_right = np.array([len(r["set"]) for r in right]), np.array([r["w"] for r in right], np.int64)
            for a in range(0, len(left), 512):
                part = left[a : a + 512]
                common = _intersections([r["set"] for r in part], [r["set"] for r in right]).astype(np.int64)
                n = np.array([len(r["set"]) for r in part])[:, None]
                linked = (1000 + up) * common >= up * (n + n_right)
                if i == j:
                    linked[np.arange(len(part)), np.arange(a, a + len(part))] = False
                else:
                    total[1][:] += np.array([r["w"] for r in part], np.int64) @ linked
                total[0][a : a + len(part)] += linked @ w_right
                links += [(a + k, np.flatnonzero(x) + (0 if i == j else len(left))) for k, x in enumerate(linked)]
            roots = _roots(len(everyone), links)
            sums = total[0] if i == j else np.concatenate(total)
            out += zip(ids, sums.tolist(), [ids[r] for r in roots], strict=True)
            if len(out) > 10_000:
                yield ready()
        yield ready()

    wanted = texts.select("cell", "block", "j_row", "w", "text").repartition("cell").sortWithinPartitions("cell", "j_row")
    found = save(wanted.mapInArrow(lean(compare), "j_row long, links long, root long"), "compared")
    links = found.groupBy("j_row").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.count("*").alias("cells"))
    if placed.where("blocks > 1").limit(1).count():
        final = components(found.select(F.col("j_row").alias("a"), F.col("root").alias("b")))
        links = links.drop("root").join(final.withColumnRenamed("node", "j_row"), "j_row")
    return links.select("j_row", "links", "root")


def _slim(batches: Iterable[pa.RecordBatch], shingles: Shingler) -> Iterator[pa.RecordBatch]:
    """The batches with sets for texts, a few rows at a time."""

    class Rows:
        def __init__(self, rows: list[dict]):
            self.rows = rows

        def to_pylist(self) -> list[dict]:
            return self.rows

    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            rows = batch.slice(a, 64).to_pylist()
            for row in rows:
                row["set"] = shingles(row.pop("text"))
            yield Rows(rows)


def classes(sets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """j_row, doc_id, class_row (its class's first row), class_id (smallest doc_id), n_links (documents at or above the threshold)."""
    rows = sets.select("j_row", "doc_id", "j_f1", "j_f2")
    reps = sets.groupBy("j_f1", "j_f2").agg(F.min("j_row").alias("j_row"), F.count("*").alias("w"), F.min("doc_id").alias("first_doc"), F.min("j_n").cast("long").alias("n"))
    reps = save(reps, "classes")
    comps = save(components(save(candidates(sets, reps), "candidates")), "components")
    found = verify(sets, reps, comps, threshold)
    ours = reps.join(found, "j_row", "left").select("j_f1", "j_f2", "first_doc", F.coalesce("root", "j_row").alias("class_row"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    ours = save(ours, "linked")
    names = ours.groupBy("class_row").agg(F.min("first_doc").alias("class_id"))
    named = ours.drop("first_doc").join(names, "class_row")
    return rows.join(named, ["j_f1", "j_f2"]).select("j_row", "doc_id", "class_row", "class_id", "n_links")


@tidied
def join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """doc_id, class_id, n_links of every document."""
    sets = index(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), threshold, recall)
    return classes(sets, threshold).select("doc_id", "class_id", "n_links")


@tidied
def keep_one(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """docs without all but one document of each class: the row with the class's smallest doc_id stays."""
    aside = set_aside(docs, ("doc_id", "text"))
    sets = index(aside, threshold, recall)
    found = save(classes(sets, threshold).select("j_row", "doc_id", "class_row"), "members")
    first = found.groupBy("class_row").agg(F.min_by("j_row", F.struct(F.col("doc_id").isNull(), "doc_id", "j_row")).alias("j_row"))
    gone = save(found.select("j_row").join(first, "j_row", "left_anti"), "copies")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return sets.join(gone, "j_row", "left_anti").select(*aside.columns).toDF(*docs.columns)
