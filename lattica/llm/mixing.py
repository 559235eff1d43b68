"""Mixing sources to target weights by the cube method of balanced sampling.

A source's target is its share of the wanted total, at most ``most`` times its
size.  Each of its documents is taken floor(r) times for certain, r being target
over size, and once more with probability r - floor(r); which ones, the cube
method decides: the vector of probabilities moves through the null space of the
two balancing constraints (tokens and documents taken) until at most two
documents of a group are undecided, and the moves are random with mean 0, so
every document keeps its probability.  The flight runs over groups of about
``GROUP`` documents, as a stream that holds three documents; what stays
undecided flies again in the next round, in ever fewer groups, and the landing
drops the constraint on documents for a source's last few (at most ``LANDING``),
which then fly on tokens alone, rounds the one that stays, and changes one or
two of these few decisions if that brings the source's tokens nearer its target.

Defined results: a null text has size 0; a null source is a source, after all
others; null doc_ids and repeated rows are documents like others; sources of
size 0 have target 0 and nothing is taken from them.  The result depends on the
rows only, not on how they lie in partitions: random moves come from hashes of
doc_id and size, and rows equal in both are interchangeable.  Other columns are
kept, whatever their names, and never looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from itertools import chain, combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm.scratch import save, set_aside, tidied

GROUP = 50_000
#: Groups of one round whose undecided documents share a group of the next.
FOLD = 10_000
#: Documents of a source that fly on the token constraint alone.
LANDING = 64
#: Documents whose count a broadcast may hold (12 bytes each); above it the join shuffles.
BROADCAST_ROWS = 1_000_000
_EPS = 1e-9


def words(text: Column) -> Column:
    """Words of [^\\x20\\x09-\\x0D] in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, n_docs, target for a table (source, size, n_docs) with a row a source.

    Weights go to sources in code point order, null last, over and over.  A
    source whose share exceeds ``most`` times its size stops there, and the
    excess is shared again by weight among the others until none exceeds.
    """
    spark = sizes.sparkSession
    table = save(sizes, "sources")
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    ranked = table.withColumn("k", (F.row_number().over(order) - 1) % len(weights))
    ranked = save(ranked.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("k").cast("int") + 1)), "weights")
    total = ranked.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    level, full = 0.0, -1.0  # a source's target is level * weight unless it stops at most * size
    stops = most * F.col("size")
    while True:
        stopped = stops < F.lit(level) * F.col("weight")
        row = ranked.agg(F.sum(F.when(stopped, stops)).alias("s"), F.sum(F.when(~stopped, F.col("weight"))).alias("w")).first()
        if not row.w:
            break
        raised = (share * total - (row.s or 0.0)) / row.w
        if raised <= level or (row.s or 0.0) == full:
            break
        level, full = raised, row.s or 0.0
    target = F.least(F.lit(level) * F.col("weight"), stops)
    return ranked.select("source", F.col("size").alias("source_size"), "n_docs", target.alias("target"))


def _draw(a: int, b: int) -> float:
    """A number in (0, 1) from two hashes."""
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 31)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 29)) + 0.5) / 2**64


class Flight:
    """Flight of one group under the token constraint and, with ``held`` 3, the document constraint.

    put() takes documents one by one and yields those decided; at most held - 1 stay undecided.
    """

    def __init__(self, held: int = 3) -> None:
        self.held = held
        self.open: list[list] = []  # [probability, size, hash, row]

    def _direction(self) -> tuple[float, ...]:
        """A null vector of the open documents' constraint rows (sizes and, if three are open, ones)."""
        size = [unit[1] for unit in self.open]
        if self.held == 2:
            return (size[1], -size[0]) if any(size) else (1.0, -1.0)
        u = (size[1] - size[2], size[2] - size[0], size[0] - size[1])
        return u if any(u) else (1.0, -1.0, 0.0)

    def put(self, p: float, size: float, key: int, row) -> Iterator[tuple[float, object]]:
        self.open.append([p, size, key, row])
        while len(self.open) == self.held:
            moves = [(unit[0], d) for unit, d in zip(self.open, self._direction(), strict=True)]
            up = min((1 - p) / d if d > 0 else p / -d for p, d in moves if d)
            down = min(p / d if d > 0 else (1 - p) / -d for p, d in moves if d)
            step = up if _draw(self.open[0][2], self.open[-1][2]) * (up + down) < down else -down
            left = []
            for unit, (_, d) in zip(self.open, moves, strict=True):
                unit[0] += step * d
                if unit[0] < _EPS or unit[0] > 1 - _EPS:
                    yield float(round(unit[0])), unit[3]
                else:
                    left.append(unit)
            self.open = left

    def rest(self) -> Iterator[tuple[float, object]]:
        """What is undecided."""
        for unit in self.open:
            yield unit[0], unit[3]
        self.open = []


class Landing:
    """A last flight: its final documents wait and fly on tokens alone; then one at most is rounded."""

    def __init__(self) -> None:
        self.flight, self.waiting = Flight(), deque()

    def put(self, *unit) -> Iterator[tuple[float, object]]:
        self.waiting.append(unit)
        if len(self.waiting) > LANDING:
            yield from self.flight.put(*self.waiting.popleft())

    def rest(self) -> Iterator[tuple[float, object]]:
        units = [tuple(u) for u in self.flight.open] + sorted(self.waiting, key=lambda u: -u[1])
        low, taken = Flight(2), [0.0] * len(units)
        for k, (p, size, key, _) in enumerate(units):
            for x, j in low.put(p, size, key, k):
                taken[j] = x
        for p, j in low.rest():
            taken[j] = float(round(p))
        for j in self._flips(units, taken):
            taken[j] = 1 - taken[j]
        for x, unit in zip(taken, units, strict=True):
            yield x, unit[3]

    @staticmethod
    def _flips(units: list[tuple], taken: list[float]) -> tuple[int, ...]:
        """The one or two decisions whose change brings the tokens nearest to what is expected, if any does."""
        over = sum((x - p) * size for x, (p, size, _, _) in zip(taken, units, strict=True))
        change = [(1 - 2 * x) * unit[1] for x, unit in zip(taken, units, strict=True)]
        n = range(len(units))
        tries = chain([()], ((i,) for i in n), combinations(n, 2))
        return min(tries, key=lambda t: (abs(over + sum(change[j] for j in t)) > 1 and abs(over + sum(change[j] for j in t)), len(t)))


def _fly(rows: DataFrame, last: bool) -> DataFrame:
    """rows (…, source, part, key, size, p): p moves to 0 or 1, but for two of each (source, part) at most; the last round lands."""
    names, sort = rows.columns, ["source", "part", "key", "doc_id", "size", "p"]
    at = {n: names.index(n) for n in ("source", "part", "key", "size", "p")}

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, flight, done = None, Flight(), []
        schema = None

        def out() -> pa.RecordBatch:
            data = [[*row[: at["p"]], float(p), *row[at["p"] + 1 :]] for p, row in done]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*data, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            schema = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (row[at["source"]], row[at["part"]]) != group:
                    done.extend(flight.rest())
                    group, flight = (row[at["source"]], row[at["part"]]), Landing() if last else Flight()
                done.extend(flight.put(row[at["p"]], float(row[at["size"]]), row[at["key"]], row))
            if done:
                yield out()
        done.extend(flight.rest())
        if done:
            yield out()

    return rows.repartition("source", "part").sortWithinPartitions(*sort).mapInArrow(task, rows.schema)


def mix(docs: DataFrame, size: Column | None = None, keep: list[str] = [], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:  # noqa: B006
    """doc_id, the ``keep`` columns, source, size, source_size, target and times (how often the mix takes it)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), (words(F.col("text").cast("string")) if size is None else size).alias("size"), *keep)
    rows = save(rows, "sizes")
    sources = save(targets(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n_docs")), weights, share, most), "targets")
    many = sources.count() > 10_000
    table = sources if many else F.broadcast(sources)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.join(table.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    sure = F.floor(rate + _EPS)
    chance = F.greatest(rate - sure, F.lit(0.0))
    rows = rows.withColumns({"sure": sure.cast("long"), "p": F.when(chance < _EPS, 0.0).otherwise(chance), "key": F.xxhash64("doc_id", "size")})
    rows = rows.withColumn("part", F.pmod("key", F.ceil(F.col("n_docs") / GROUP)).cast("long"))
    undecided = (F.col("p") > 0) & (F.col("p") < 1)
    largest = sources.agg(F.max("n_docs")).first()[0] or 0
    parts = -(-largest // GROUP)
    flown = [rows.where(~undecided)]
    rows = rows.where(undecided)
    while parts > 1:
        step = save(_fly(rows, last=False), "flight")
        flown.append(step.where(~undecided))
        rows, parts = step.where(undecided).withColumn("part", F.floor(F.col("part") / FOLD).cast("long")), -(-parts // FOLD)
    flown.append(_fly(rows, last=True))
    whole = flown[0]
    for part in flown[1:]:
        whole = whole.unionByName(part)
    return whole.select("doc_id", *keep, "source", "size", "source_size", "target", (F.col("sure") + F.col("p").cast("long")).alias("times"))


@tidied
def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it; the columns stay as they are."""
    aside = set_aside(docs, ("doc_id", "text", "source"))
    rows = save(aside.withColumn("m_row", F.monotonically_increasing_id()), "mixed")
    times = save(mix(rows, keep=["m_row"], **options).where("times > 0").select("m_row", F.col("times").cast("int").alias("m_times")), "times")
    if times.count() <= BROADCAST_ROWS:
        times = F.broadcast(times)
    taken = rows.join(times, "m_row").withColumn("m_copy", F.explode(F.array_repeat(F.lit(0), F.col("m_times"))))
    return taken.select(*aside.columns).toDF(*docs.columns)
