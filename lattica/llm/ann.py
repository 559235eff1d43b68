"""Approximate nearest neighbours by adaptive dimension scan within probed lists.

Vectors are scaled to length 1 and turned by a random rotation.  Lists come from
k-means on a sample of at most ``SAMPLE`` vectors; every vector is in one list.
A query probes the lists whose centres are nearest.  The rotated vectors of a list
lie in column blocks of ``BLOCK`` dimensions; after t of d dimensions a candidate
is abandoned if its partial distance rejects, at the significance that ``EPSILON``
stands for, the hypothesis that its distance is below the k-th best so far,

    partial > best * t / d * (1 + EPSILON / sqrt(t)) ** 2,

and further blocks are read for those that remain only.  The k-th best tightens
after every ``STEP`` candidates, and the nearest list's is what the query's other
lists begin with.  What survives all blocks is measured exactly, on the original
vectors.

Lists are scanned in cells of at most about ``CELL`` candidates and ``QUERIES``
queries, so a hot list is many tasks.  The centres, at most ``LISTS``, are what
is broadcast.

Defined results: a vector that is null or zero, has a null or non-finite
component, or has not the most frequent number of dimensions takes no part; rows
with the query's own vec_id are no candidates; rows repeated under one vec_id
are candidates each, and the same query several times is one query; a null
vec_id is a candidate after all others; equal scores go to the smaller vec_id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm.scratch import save

SAMPLE, LISTS, BLOCK, EPSILON, CELL, QUERIES, STEP = 20_000, 1024, 16, 2.1, 16_384, 2048, 1024
#: Share of the nearest vectors that probing is to reach, as measured on the sample.
TARGET = 0.97


def valid(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id and v (doubles) of the vectors that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    rows = rows.where(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0].d if sizes else -1))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = np.concatenate([np.asarray(c.flatten()) for c in getattr(column, "chunks", [column])] or [np.zeros(0)])
    return flat.reshape(len(column), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; very large or small ones first by their largest component."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class Index:
    """Rotation and list centres."""

    def __init__(self, sample: np.ndarray, n: int, seed: int = 7):
        rng, d = np.random.default_rng(seed), sample.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
        unit = _unit(sample)
        k = max(1, min(LISTS, len(unit), math.isqrt(n)))
        centres = unit[rng.choice(len(unit), k, replace=False)]
        for _ in range(10):
            near = (unit @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, unit)
            size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
        self.centres = centres
        self.probes = self._probes(unit, rng)

    def _probes(self, unit: np.ndarray, rng: np.random.Generator, k: int = 5) -> int:
        """Lists that sample queries need for ``TARGET`` of their nearest in the sample."""
        asks = rng.choice(len(unit), min(len(unit), 256), replace=False)
        owner, rank = (unit @ self.centres.T).argmax(axis=1), np.empty(len(self.centres), np.int64)
        needed = []
        for q in asks:
            near = unit @ unit[q]
            near[q] = -2
            rank[np.argsort(-(self.centres @ unit[q]), kind="stable")] = np.arange(len(rank))
            needed += rank[owner[np.argsort(-near)[:k]]].tolist()
        return int(np.quantile(needed, TARGET, method="higher")) + 1

    def nearest(self, v: np.ndarray) -> np.ndarray:
        return (_unit(v) @ self.centres.T).argmax(axis=1)

    def order(self, v: np.ndarray) -> np.ndarray:
        """All lists, nearest first."""
        return np.argsort(-(_unit(v) @ self.centres.T), axis=1, kind="stable")


class Columns:
    """Rotated unit vectors in column blocks, each contiguous, with their squares' sums."""

    def __init__(self, turned: np.ndarray):
        self.d = turned.shape[1]
        parts = [np.ascontiguousarray(turned[:, a : a + BLOCK]) for a in range(0, self.d, BLOCK)]
        self.blocks = [(p, (p * p).sum(axis=1)) for p in parts]


def scan(query: np.ndarray, table: Columns, rows: np.ndarray, k: int, best: float = math.inf) -> np.ndarray:
    """Those of the rows that may be among the query's k nearest, if these are nearer than ``best`` (a squared distance)."""
    found, near = [], np.zeros(0)
    for a in range(0, len(rows), STEP):
        alive, partial, t = rows[a : a + STEP], 0.0, 0
        for block, squares in table.blocks:
            part = query[t : t + block.shape[1]]
            partial = partial + squares[alive] - 2 * (block[alive] @ part) + part @ part
            t += len(part)
            limit = best if t == table.d else best * t / table.d * (1 + EPSILON / math.sqrt(t)) ** 2
            stay = partial <= limit + 1e-9
            if not stay.all():
                alive, partial = alive[stay], partial[stay]
        found.append((alive, partial))
        near = np.sort(np.concatenate([near, partial]))[:k]
        if len(near) == k:
            best = min(best, near[-1])
    return np.concatenate([alive[distance <= best + 1e-9] for alive, distance in found]) if found else rows


def cosine(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines in double precision; vectors whose squares leave its range are first scaled by their largest component."""

    def tame(v: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", under="ignore"):
            square = (v * v).sum(axis=1)
        wild = ~((square > 1e-280) & (square < 1e280))
        if wild.any():
            v = v.copy()
            v[wild] /= np.abs(v[wild]).max(axis=1, keepdims=True)
        return v

    rows, query = tame(rows), tame(query[None, :])[0]
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def search(vectors: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding", key: str = "vec_id", probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score (cosine, in doubles) of each query's k nearest found."""
    rows = save(valid(vectors, vector, key), "vectors")
    n, most_same = rows.groupBy("vec_id").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    spark, result = rows.sparkSession, "query_id long, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).select("v").toArrow()
    index = spark.sparkContext.broadcast(Index(_matrix(sample["v"]), n))
    lists = len(index.value.centres)
    probes = min(lists, probes or index.value.probes)

    @F.arrow_udf("int")
    def list_of(v: pa.Array) -> pa.Array:
        return pa.array(index.value.nearest(_matrix(v)).astype(np.int32))

    placed = save(rows.withColumn("list", list_of("v")), "lists")
    held = np.zeros(lists, np.int64)
    for r in placed.groupBy("list").count().collect():  # LISTS rows at most
        held[r["list"]] = r["count"]
    need = k + int(most_same)

    @F.arrow_udf("array<int>")
    def probed(v: pa.Array) -> pa.Array:
        order = index.value.order(_matrix(v))
        enough = (np.cumsum(held[order], axis=1) < need).sum(axis=1) + 1
        return pa.array([o[: max(probes, e)].tolist() for o, e in zip(order, enough, strict=True)], pa.list_(pa.int32()))

    asked = rows.where(is_query).withColumnRenamed("vec_id", "query_id").distinct()
    asked = save(asked.select("query_id", "v", F.posexplode(probed("v")).alias("nth", "list")), "probes")
    sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks"))

    def cell(there: pa.Table, asks: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if there.num_rows and asks.num_rows:
            v, q = _matrix(there["v"]), _matrix(asks["v"])
            ids = there["vec_id"].to_numpy(zero_copy_only=False) if not there["vec_id"].null_count else np.array([math.inf if x is None else x for x in there["vec_id"].to_pylist()], object)
            order = np.argsort(ids, kind="stable")
            v, ids = v[order], ids[order]
            table, turned = Columns(_unit(v) @ index.value.rotation), _unit(q) @ index.value.rotation
            for query, own, at, least in zip(q, asks["query_id"].to_pylist(), turned, asks["least"].to_pylist(), strict=True):
                found = scan(at, table, np.flatnonzero(ids != own), k, math.inf if least is None else 2 - 2 * least)
                score = cosine(v[found], query)
                top = np.lexsort((found, -score))[:k]
                out_q += [own] * len(top)
                out_v += [None if ids[i] == math.inf else int(ids[i]) for i in found[top]]
                out_s += score[top].tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    def scanned(asked: DataFrame) -> DataFrame:
        """query_id, vec_id, score from the lists of asked (query_id, v, list, least: the k-th best cosine so far)."""
        groups = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
        grid = F.broadcast(sizes.join(groups, "list"))  # LISTS rows at most
        every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
        left = placed.join(grid, "list").withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int")).withColumn("group", every("groups"))
        right = asked.join(grid, "list").withColumn("group", F.pmod(F.xxhash64("query_id", "v"), F.col("groups")).cast("int")).withColumn("block", every("blocks"))
        keys = ["list", "block", "group"]
        return left.select(*keys, "vec_id", "v").groupBy(*keys).cogroup(right.select(*keys, "query_id", "v", "least").groupBy(*keys)).applyInArrow(cell, result)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)  # noqa: E731  k rows for each probe
    nearest = save(scanned(asked.where("nth = 0").withColumn("least", F.lit(None).cast("double"))), "nearest")
    least = ranked(nearest).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    # a null or repeated query_id begins without a bound
    single = asked.where("nth = 0").groupBy("query_id").count().where("count = 1").select("query_id")
    others = asked.where("nth > 0").join(least.join(single, "query_id"), "query_id", "left")
    found = nearest.unionByName(scanned(others.select("query_id", "v", "list", "least")))
    return ranked(found).select("query_id", "rank", "vec_id", "score")
