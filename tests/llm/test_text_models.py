import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import langid, quality, suffix_tree, urls
from lattica.llm import queries as Q

SF = "/root/testdata/sf0.001"


def test_language_id_on_held_out_documents(spark):
    rows = Q.op10_naive_bayes_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_language_id_of_odd_rows(spark, odd_docs):
    model = langid.train(odd_docs)
    assert model.langs == ("en", "fr")
    got = odd_docs.select("doc_id", langid.predictor(odd_docs, model).alias("p")).select("doc_id", "p.*").collect()
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {2, 3, 4, 7}
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    nothing = langid.train(odd_docs.limit(0))
    assert nothing.predict(["abc", None])[0] == ["und", "und"]


def test_long_texts_score_as_in_one_piece(prose, monkeypatch):
    texts = [prose(400, 5), "x", prose(50, 6)]
    whole = [(d.tolist(), b.tolist()) for d, b in langid.features(texts)]
    monkeypatch.setattr(langid, "STEP", 97)
    parts = [(d.tolist(), b.tolist()) for d, b in langid.features(texts)]
    flat = lambda x: Counter((d, b) for ds, bs in x for d, b in zip(ds, bs, strict=True))
    assert flat(whole) == flat(parts)


def test_language_of_texts_with_nul_and_their_neighbours(spark, prose):
    texts = [prose(30, 1), "la casa\0 de la\0\0 montaña \0", prose(30, 2), "\0", "el río"]
    spaced = [t.replace("\0", " ") for t in texts]
    for at, other in zip(langid.features(texts), langid.features(spaced), strict=True):
        assert at[0].tolist() == other[0].tolist() and at[1].tolist() == other[1].tolist()
    table = lambda ts: spark.createDataFrame([(t, "en" if i in (0, 2) else "es") for i, t in enumerate(ts)], "text string, lang string").coalesce(1)
    model = langid.train(table(texts))
    assert (model.log_prob == langid.train(table(spaced)).log_prob).all()
    names, score = model.predict(texts)
    alone = [model.predict([t]) for t in texts]
    assert names == [a[0][0] for a in alone] == ["en", "es", "en", "und", "es"] and score == pytest.approx([a[1][0] for a in alone])


def _measures(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_against_plain_python(spark, odd_docs):
    extra = spark.createDataFrame([(9, "a b c a b c a b\na b\n a b\na b\n\n|x|"), (10, "a a a a a a"), (11, "x\x0by\x0cz\r\nx")], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(extra).unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    for r in quality.measure(docs).collect():
        assert (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words) == _measures(r.text)


def _tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k < n * p else 1.0


def test_binomial_tail_is_exact(spark):
    cases = [(k, n) for n in (1, 2, 10, 700, 1500) for k in (0, 1, 2, 7, 12) if k <= n]
    rows = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.0125).alias("p")).collect()
    for r in rows:
        assert r.p == pytest.approx(_tail(r.k, r.n, 0.0125), rel=1e-9)


def test_cutoffs_keep_their_promise(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda j: F.concat(F.lit("w"), F.col("id"), F.lit("x"), j, F.when(F.col("id") % 3 == 0, "##").otherwise("")))).alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("quality"))
    out = quality.assess(docs, labels).select("doc_id", "q_kept").collect()
    assert all(r.q_kept == (r.doc_id % 3 != 0) for r in out)
    few = quality.assess(docs, labels.where("doc_id < 300")).where("q_kept").count()
    assert few == 3000  # too few labels prove nothing


def test_quality_of_odd_rows(spark, odd_docs, labels):
    out = quality.assess(odd_docs, labels)
    assert out.count() == odd_docs.count()
    assert {r.doc_id for r in out.where("q_kept").collect()} == {None, 5, 6, 8}
    assert quality.assess(odd_docs.limit(0), labels.limit(0)).count() == 0


def test_suffix_tree_base_and_gain(spark, odd_docs):
    for docs in (odd_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        got = suffix_tree.score_held_out(docs).collect()
        texts = docs.select("doc_id", "text").collect()
        tokens = [(r.doc_id, suffix_tree.tokens(r.text)) for r in texts]
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        count = Counter(t for i, ts in tokens if not held(i) for t in ts)
        n, v = sum(count.values()), len(count)
        want = sorted((i is None, i or 0, held(i), len(ts), sum(count[t] > 0 for t in ts), round(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in ts), 6)) for i, ts in tokens)
        assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
        assert all(r.train_tokens == n and r.score <= 0 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert suffix_tree.score_held_out(odd_docs.limit(0)).count() == 0


def test_suffix_tree_distributions_sum_to_one():
    words = {b"a": 40, b"b": 40, b"c": 40, suffix_tree.END: 20}
    tree = suffix_tree.Tree(words, 140, 4)
    assert tree.prob.sum() == pytest.approx(1 - 1 / 145)
    a, b, c, end = (tree.ids[w] for w in (b"a", b"b", b"c", suffix_tree.END))
    key = lambda s, x: (s << suffix_tree._BITS) | x
    import numpy as np

    tree.add(np.array([key(a, b), key(b, c), key(c, a)]), np.array([38, 12, 13]))
    assert tree.retained == [1]
    for context in range(4):
        total = tree.expected(1, np.full(4, context), np.arange(4)).sum() + tree.levels[0].keep[context] / 145
        assert total == pytest.approx(1)
    p = 10 ** tree.score(np.array([end, a, b, c, end]))
    assert p[1] == pytest.approx((38 - 0.5) / 40 + tree.levels[0].keep[a] * 41 / 145)
    assert p[2] == pytest.approx(41 / 145)


def _in_one_process(texts, held):
    """Scores by a Tree that has every word and every gram that occurs LEAST times, the grams counted in plain Python."""
    all_tokens = [suffix_tree.tokens(t) for t in texts]
    train = [ts for i, ts in enumerate(all_tokens) if not held[i]]
    words = Counter(t for ts in train for t in ts)
    tree = suffix_tree.Tree(words, sum(words.values()), len(words))
    code = lambda ts: np.array([tree.ids.get(t, -1) for t in [suffix_tree.END, *ts]], np.int64)
    for _ in range(suffix_tree.DEPTH):
        grams = Counter(k for ts in train for k in tree.grams(code(ts)).tolist())
        keys = [k for k, n in grams.items() if n >= suffix_tree.LEAST]
        if not keys:
            break
        tree.add(np.array(keys, np.int64), np.array([grams[k] for k in keys], np.int64))
    return [float(tree.score(code(ts)).sum()) - tree.floor * sum(t not in words for t in ts) for ts in all_tokens]


@pytest.mark.parametrize("hot", [suffix_tree.HOT, 50])
def test_suffix_tree_tables_against_one_process(spark, odd_docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_tree, "HOT", hot)
    docs = odd_docs.select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    rows = docs.collect()
    want = _in_one_process([r.text for r in rows], [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows])
    got = sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 5)) for r in suffix_tree.score_held_out(docs).collect())
    for g, w in zip(got, sorted((r.doc_id is None, r.doc_id or 0, round(s, 5)) for r, s in zip(rows, want, strict=True)), strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=1e-4)


def test_suffix_tree_learns_rare_words_of_a_large_corpus(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "COMMON", 4)
    ids = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = next(i for i in range(1, 40) if i not in ids)
    rows = [(i, "a b c d " * 20_000 + "qzx vwy " * (k < 3)) for k, i in enumerate(ids)] + [(held, "qzx vwy")]
    row = suffix_tree.score_held_out(spark.createDataFrame(rows, "doc_id long, text string")).where(f"doc_id = {held}").first()
    assert row.train_tokens > 1_000_000 and row.n_known == 3
    assert row.score > row.base_score + 4


def test_suffix_tree_of_many_blocks_and_rare_words(spark, odd_docs, monkeypatch):
    """Frequent words in several blocks, most words looked up by chunk, small chunks and buffers."""
    for name, value in (("BLOCK", 300), ("SUMMED", 5_000), ("CHUNK", 3_000), ("COMMON", 60), ("HOT", 50)):
        monkeypatch.setattr(suffix_tree, name, value)
    docs = odd_docs.select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60))
    rows = docs.collect()
    want = _in_one_process([r.text for r in rows], [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows])
    got = sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 5)) for r in suffix_tree.score_held_out(docs).collect())
    for g, w in zip(got, sorted((r.doc_id is None, r.doc_id or 0, round(s, 5)) for r, s in zip(rows, want, strict=True)), strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=1e-4)


def test_suffix_tree_windows_and_their_bytes():
    codes = np.array([0, 5, suffix_tree.ONCE, 7, 8, 9, 0, 4], np.int64)
    got = suffix_tree.windows(codes)
    assert got.T.tolist() == [[1, 0, 0, 6], [6, 1, 0, 0], [8, 0, 0, 9], [9, 8, 0, 10], [10, 9, 8, 1], [1, 0, 0, 5]]
    w, n = suffix_tree._summed(np.concatenate([got, got[:, :2]], axis=1), None)
    assert sorted(zip(*w.tolist(), n.tolist(), strict=True))[0] == (1, 0, 0, 5, 1) and n.sum() == 8
    again, m = suffix_tree._unpack(suffix_tree._pack(w, n))
    assert again.tolist() == w.tolist() and m.tolist() == n.tolist()


def test_suffix_tree_splits_rows_at_once():
    texts = [None, b"", b"  ", b" a B\x0bc ", b"x", b"\xc3\x84B q\x1cz\x85", b"", b"end", None, b" \n"]
    for column in (pa.array(texts, pa.binary()), pa.array(texts, pa.binary()).slice(2, 6), pa.array([], pa.binary())):
        words, bounds = suffix_tree.words_of(column)
        words = words.to_pylist()
        assert [[*words[a:b], suffix_tree.END] for a, b in zip(bounds, bounds[1:], strict=False)] == [suffix_tree.tokens(t) for t in column.to_pylist()]


def test_suffix_tree_numbers_in_two_bytes_and_more():
    codes, ends = np.array([0, 50_000, -1, suffix_tree.WIDE - 1, suffix_tree.WIDE, -2, 1 << 20, 70_000], np.int32), np.array([0, 3, 3, 7, 8])
    wide = np.flatnonzero(codes >= suffix_tree.WIDE)
    ids, more = suffix_tree._column(suffix_tree._narrow(codes), ends), suffix_tree._column(codes[wide], np.searchsorted(wide, ends))
    for a, b in ((0, 4), (2, 4), (3, 4), (1, 2)):
        got, bounds = suffix_tree._codes(ids.slice(a, b - a), more.slice(a, b - a))
        assert got.tolist() == codes[ends[a] : ends[b]].tolist() and bounds.tolist() == (ends[a : b + 1] - ends[a]).tolist()


def test_suffix_tree_keeps_no_lists_of_numbers(spark, prose, monkeypatch):
    """Spark goes through a list number by number, each time it is read or written; numbers of a row are one binary value."""
    kept, save = [], suffix_tree.save
    monkeypatch.setattr(suffix_tree, "save", lambda df, *a, **b: kept.append(df.dtypes) or save(df, *a, **b))
    docs = spark.createDataFrame([(i, prose(50, i)) for i in range(20)], "doc_id long, text string")
    assert suffix_tree.score_held_out(docs).count() == 20
    assert len(kept) >= 4 and not any(kind.startswith("array") for dtypes in kept for _, kind in dtypes)


def test_suffix_tree_sends_each_token_once(spark, prose):
    """Shuffled bytes stay below twice those of the texts: sent level by level, grams took more than three times as many."""
    texts = [prose(2_000, i) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).localCheckpoint()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = written()
    suffix_tree.score_held_out(docs).write.format("noop").mode("overwrite").save()
    assert written() - before < 2 * sum(map(len, texts))


def _split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def _rule(host, path):
    best = None
    for text, says in sorted(urls.RULES, key=lambda r: len(r[0])):
        h, _, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            best = (text, says)
    return best or (None, None)


def test_url_rules_and_model(spark):
    odd = [None, "", "nonsense", "http://", "http://EXAMPLE.com/en/7?x", "https://a.example.net/de/8#f", "ftp://x.net/de/", "http://net/de/1", "http://com?/en/", "a://b://c.org/es/", "http://évil.ÀB.org/es/1", "http://notcom/en/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(odd)] + [(None, "http://x.com/en/1", "y")] * 2, "page_id long, url string, host string")
    pages = pages.select("page_id", "url").unionByName(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url"))
    got = urls.judge(pages).collect()
    assert len(got) == pages.count()
    for r, u in zip(got, [p.url for p in pages.collect()], strict=True):
        host, path = _split(u)
        rule, says = _rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (says or ("block" if r.block_score > 0.5 else "allow"))
    clean = [r for r in got if r.rule is None and r.host and not set(re.split("[.-]", r.host)) & set(urls.JUNK)]
    assert sum(r.verdict == "allow" for r in clean) >= 0.85 * len(clean)
    ruled = [r for r in got if r.rule and _rule(r.host, r.path)[1] == "block"]
    assert sum(r.block_score > 0.5 for r in ruled) >= 0.6 * len(ruled)
    assert urls.judge(pages.limit(0)).count() == 0


def test_quality_base_agrees_with_sql(spark):
    sql = Q.oracle_sql().get("op3_risk_controlled_quality")
    if sql is None:
        pytest.skip("no SQL")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = sorted(con.execute(f"select doc_id, n_words, n_repeat_words, kept from ({sql})").fetchall())
    assert sorted(tuple(r) for r in Q.op3_risk_controlled_quality(spark, SF).select("doc_id", "n_words", "n_repeat_words", "kept").collect()) == want
