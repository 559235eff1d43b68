"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, what is no letter becomes a space, and its character
pairs and triples (but those of spaces only) are hashed into ``BUCKETS``
buckets.  Counting is one pass in which each task sums its own counts; the
model is a matrix of log probabilities, broadcast, of ``BUCKETS`` columns and a
row for each learned language, of which at most ``MAX_LANGS`` are allowed.
Texts are scored in batches: each n-gram's column is gathered and summed by
document.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
rows without a language teach nothing; with no labelled row at all every
prediction is ``und``; languages that tie go to the one first by code point.  A
U+0000 in a text counts as a space; very long texts are scored whole, ``STEP``
characters at a time; repeated rows teach once each and get the same prediction;
an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.scratch import lean

BUCKETS, MAX_LANGS, UND = 1 << 15, 512, "und"
#: Characters that one step of numpy works on; bounds a task's memory for texts of any length.
STEP = 1 << 20


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the text, bucket) of all n-grams of all texts, a step at a time."""
    flat = ("\0" + "\0".join(t.replace("\0", " ") for t in texts) + "\0").lower().encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(flat, np.uint32)
    letters, before = _letters(), 0
    for at in range(0, len(codes) - 2, STEP):
        part = codes[at : at + STEP + 2]
        ends = part == 0
        letter = letters[part]
        c = np.where(letter, part, 32).astype(np.uint32)
        doc = before + np.cumsum(ends[: len(part) - 2]) - 1
        before += int(np.count_nonzero(ends[:STEP]))
        pair = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1]
        whole = ~(ends[1:-2] if len(part) > STEP + 2 else ends[1:-1])  # no n-gram goes over a text's end
        keep = (letter[:-2] | letter[1:-1]) & whole & (doc < len(texts))
        yield doc[keep], ((pair[keep] * np.uint32(0x85EBCA6B)) >> np.uint32(17)).astype(np.int64)
        keep = (letter[:-2] | letter[1:-1] | letter[2:]) & whole & ~ends[2:] & (doc < len(texts))
        triple = (pair[keep] ^ np.uint32(0x5BD1E995)) * np.uint32(0x9E3779B1) + c[2:][keep]
        yield doc[keep], ((triple * np.uint32(0x85EBCA6B)) >> np.uint32(17)).astype(np.int64)


def _batches(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about STEP characters, each with the index of its first."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > STEP:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, texts[first:]


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    log_prob: np.ndarray  # of shape (BUCKETS, languages)
    log_prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior probability of each text."""
        score, known = np.zeros(len(texts)), [has_letter(t) for t in texts]
        names = np.full(len(texts), UND, object)
        rows = [i for i, k in enumerate(known) if k]
        if not self.langs or not rows:
            return list(names), score
        for first, run in _batches([texts[i] for i in rows]):
            total = np.tile(self.log_prior, (len(run), 1))
            for doc, bucket in features(run):
                for k in range(len(self.langs)):
                    total[:, k] += np.bincount(doc, self.log_prob[bucket, k], len(run))
            best = total.argmax(axis=1)
            at = rows[first : first + len(run)]
            score[at] = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            names[at] = np.array(self.langs, object)[best]
        return list(names), score


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> Model:
    """Fit on every row of ``labelled`` that has a language."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for t, name in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                docs[name] = docs.get(name, 0) + 1
                by_lang.setdefault(name, []).append(t.as_py() or "")
            for name, texts in by_lang.items():
                mine = sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                for _, run in _batches(texts):
                    for _, bucket in features(run):
                        mine += np.bincount(bucket, minlength=BUCKETS)
            if len(sums) > MAX_LANGS:
                raise ValueError(f"more than {MAX_LANGS} languages")
        for name, mine in sums.items():
            used = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(used) + 1), pa.string()), pa.array([*used, -1], pa.int32()), pa.array([*mine[used], docs[name]], pa.int64())], names=["lang", "bucket", "n"]
            )

    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = rows.mapInArrow(lean(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toPandas()  # at most MAX_LANGS * (BUCKETS + 1) rows
    langs = tuple(sorted(table["lang"].unique()))
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    grid = np.full((BUCKETS, len(langs)), smoothing)
    prior = np.zeros(len(langs))
    place = table["lang"].map({name: k for k, name in enumerate(langs)}).to_numpy(np.int64)
    bucket, n = table["bucket"].to_numpy(np.int64), table["n"].to_numpy(np.float64)
    grid[bucket[bucket >= 0], place[bucket >= 0]] += n[bucket >= 0]
    prior[place[bucket < 0]] = n[bucket < 0]
    return Model(langs, np.log(grid / grid.sum(axis=0)), np.log(prior / prior.sum()) if langs else prior)


def predictor(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A column struct<lang_pred, score> for docs; the model is broadcast once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        names, score = shared.value.predict([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"lang_pred": names, "score": score})

    return judge(F.col(text).cast("string"))


def held_out(doc_id: Column, modulus: int, remainder: int = 2) -> Column:
    """Whether crc32 of the id as text leaves the remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))
