import base64
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import ann, components, jaccard, mixing, warc
from lattica.llm import queries as Q

SF = "/root/testdata/sf0.001"


def _brute(rows):
    """class and links of (doc_id, text) rows, by comparing all pairs; rows are told by place."""
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links, up = Counter(), list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 9 * common >= 4 * (len(sets[i]) + len(sets[j])):
                links[i] += 1
                links[j] += 1
                up[max(top(i), top(j))] = min(top(i), top(j))
    members = defaultdict(list)
    for i in range(len(rows)):
        members[top(i)].append(rows[i][0])
    name = {r: min((m for m in ms if m is not None), default=None) for r, ms in members.items()}
    return sorted((rows[i][0] is None, rows[i][0] or 0, name[top(i)] if name[top(i)] is not None else -1, links[i]) for i in range(len(rows)))


def _got(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.class_id if r.class_id is not None else -1, r.n_links) for r in df.collect())


def test_join_against_all_pairs(spark, odd_docs, prose):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    base = prose(120, 9).split()
    for k in range(40):  # a group of near copies, some beyond the threshold
        w = list(base)
        w[(7 * k) % 120] = f"new{k}"
        if k % 5 == 0:
            w[60] = w[90] = w[30] = "other"
        rows.append((10_000 + k, " ".join(w)))
    rows += [(r.doc_id, r.text) for r in odd_docs.where("doc_id <> 5 or doc_id is null").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("j", "comp", "w", "root", "links", "cell")})
    assert _got(jaccard.join(docs)) == _brute(rows)


def test_join_splits_large_buckets_and_components(spark, prose, monkeypatch):
    shared = prose(60, 3)
    rows = [(i, shared + " " + prose(200, 100 + i)) for i in range(60)]
    base = prose(150, 77).split()
    for k in range(60):
        w = list(base)
        w[(11 * k) % 150] = f"n{k}"
        rows.append((1000 + k, " ".join(w)))
    monkeypatch.setattr(jaccard, "BUCKET", 8)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _got(jaccard.join(docs)) == _brute(rows)


def test_one_of_each_class_stays(spark, odd_docs):
    kept = jaccard.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6, 7, 8]
    assert jaccard.keep_one(odd_docs.limit(0)).count() == 0


@pytest.mark.parametrize("one_task", [500_000, -1])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task, raising=False)
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (103, 101), (200, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 103: 100, 200: 200}


def test_ann_recall_and_order(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = defaultdict(list)
    for r in Q.op1_adaptive_dimension_scan(spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ids, v = zip(*((r.vec_id, r.embedding) for r in table.collect()), strict=True)
    ids, v = np.array(ids), np.array(v, float)
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = (v * v[q]).sum(1) / np.sqrt((v * v).sum(1) * (v[q] * v[q]).sum())
        score[q] = -9
        best = np.lexsort((ids, -score))[:5]
        mine = got[ids[q]]
        hits += len(set(ids[best]) & {i for i, _ in mine})
        total += 5
        assert len(mine) == 5 and mine == sorted(mine, key=lambda x: (-x[1], x[0]))
        for i, s in mine:
            assert s == pytest.approx(score[np.flatnonzero(ids == i)[0]], abs=1e-12)
    assert hits >= 0.9 * total


def test_ann_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [float("inf"), 1.0]), (50, [0.0, 1e200]), (50, [0.0, 1e200])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"list": F.lit(1), "v": F.lit(2), "block": F.lit(3)})
    got = defaultdict(list)
    for r in ann.search(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == {0: [1, 2, None, 50, 50], 50: [None, 0, 1, 2]}
    assert ann.search(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_mix_meets_its_targets(spark, odd_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in Q.op5_cube_mixing(spark, SF).collect()]
    assert len(rows) == docs.count()
    names = sorted({r["source"] for r in rows})
    size = {n: sum(r["size"] for r in rows if r["source"] == n) for n in names}
    weight = {n: (3, 1, 2)[k % 3] for k, n in enumerate(names)}
    left, want, rest = 1.5 * sum(size.values()), {}, set(names)
    while rest:
        unit = left / sum(weight[n] for n in rest)
        full = {n for n in rest if unit * weight[n] > 2 * size[n]}
        for n in full or rest:
            want[n] = 2 * size[n] if full else unit * weight[n]
        left -= sum(want[n] for n in full)
        rest = rest - full if full else set()
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == size[r["source"]]
        assert r["size"] == 0 or r["taken"] in (0, r["size"], 2 * r["size"])
    for n in names:
        taken = sum(r["taken"] for r in rows if r["source"] == n)
        assert abs(taken - want[n]) <= 0.1 * want[n] + 50
    again = Q.op5_cube_mixing(spark, SF).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    mixed = mixing.apply_mix(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert mixing.mix(odd_docs).count() == odd_docs.count()
    assert mixing.mix(odd_docs.limit(0)).count() == 0


def test_mix_does_not_depend_on_partitions_and_flies_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 20)
    monkeypatch.setattr(mixing, "FOLD", 3)
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("source"), (F.col("id") % 37 + 1).alias("size"))
    take = lambda d: {r.doc_id: r.times for r in mixing.mix(d, size=F.col("size").cast("long")).collect()}
    one = take(docs.coalesce(1))
    assert one == take(docs.repartition(7))
    rows = mixing.mix(docs, size=F.col("size").cast("long")).groupBy("source").agg(F.sum(F.col("times") * F.col("size")).alias("t"), F.first("target").alias("w")).collect()
    assert all(abs(r.t - r.w) <= 37 for r in rows)  # the largest document


def test_warc_round_trip(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "é" * 50_000, "<p>a</p>", "x\r\n\r\ny"]
    ids = [3, 9, 4, 5, 6, None, 7]
    pages = spark.createDataFrame([(i, f"http://e.com/{i}\n", h) for i, h in zip(ids, html, strict=True)] + [(9, None, "<p>a</p>")], "page_id long, url string, html string").withColumn("sha", F.lit(1))
    got = sorted(((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    want = [(i or -1, len((h or "").encode()), sha(h)) for i, h in zip([*ids, 9], [*html, "<p>a</p>"], strict=True)]
    first = {sha("<p>a</p>"): 9, sha(""): 5}
    want = [(*w, "response", None) if first.get(w[2], w[0]) == w[0] else (*w, "revisit", first[w[2]]) for w in want]
    assert got == sorted(want, key=str)
    small = warc.round_trip(pages, least_bytes=9)
    assert {r.record_type for r in small.collect()} == {"response"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_bundles_are_read_one_record_at_a_time(tmp_path):
    writer = warc.Writer(f"file://{tmp_path}", "b.warc.zst", 100)
    names = []
    for i in range(20):
        name, data = warc.record(i, f"http://e.com/{i}", b"x" * i, "response", None)
        writer.add(name, data)
        names.append(name)
    path, n = writer.close()
    bundle = warc.Bundle(path)
    assert n == 20 and len(bundle.frames) > 5
    headers, block = bundle.record(names[13])
    assert headers["warc-target-uri"] == "http://e.com/13" and block.endswith(b"\r\n\r\n" + b"x" * 13)
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(open(path.removeprefix("file://"), "rb"), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 20


def test_runs_reach_the_recall_through_all_levels(spark):
    rng = np.random.default_rng(3)
    pairs, n = 400, 400
    rows = []
    for i in range(pairs):  # the shorter text's shingles are 0.8 of the longer one's
        words = [f"w{x}" for x in rng.integers(0, 10**9, n + 4)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: round(0.8 * n) + 4]))]
    found = jaccard.index(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.9).toPandas().sort_values("doc_id")
    paths = np.array(found["j_paths"].tolist()).reshape(pairs, 2, jaccard.LEVELS, -1)
    same = paths[:, 0] == paths[:, 1]
    assert paths.shape[3] == jaccard.runs_for(0.9) and abs(same.mean() - 0.8) < 0.03
    assert same.all(axis=1).any(axis=1).mean() >= 0.9 - 0.03
    assert len({*map(jaccard.runs_for, (0.9, 0.99, 0.999))}) == 3
