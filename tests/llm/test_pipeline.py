import math
import re
import zlib
from collections import Counter

import numpy as np
import corpus_pipeline as P
from lattica.llm import bpe

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.names == docs.schema.names, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0.5 * sizes[0]
    packed = P.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_stages_take_odd_rows(spark, odd_docs):
    docs = odd_docs
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd_docs.columns
        assert {r.q_kept + r.j_row + r.m_row + r.judged for r in docs.collect()} <= {"xxxx"}
    assert P.STAGES[-1][1](spark, docs, SF).count() >= 1
    empty = odd_docs.limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def _grams(text):
    """Pairs and triples of characters with a letter among them."""
    c = "".join(x if x.isalpha() else " " for x in f" {text} ".lower())
    return [c[i : i + k] for k in (2, 3) for i in range(len(c) - k + 1) if c[i : i + k].strip()]


def _has_language(docs):
    """Ids with a letter and a language that naive Bayes, here without hashing, gives half of the posterior."""
    learned = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 4 != 2 and d[2] is not None]
    langs = sorted({d[2] for d in learned})
    prior = Counter(d[2] for d in learned)
    counts = {k: Counter(g for d in learned if d[2] == k for g in _grams(d[1] or "")) for k in langs}
    kept = set()
    for i, text, *_ in docs:
        if not any(map(str.isalpha, text or "")):
            continue
        logs = [math.log(prior[k]) + sum(math.log((counts[k][g] + 0.5) / (counts[k].total() + 0.5 * (1 << 15))) for g in _grams(text)) for k in langs]
        if 1 / sum(math.exp(x - max(logs)) for x in logs) >= P.SURE:
            kept.add(i)
    return kept


def _passes_base_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 3)}
    return len(words) >= 50 and 100 * len(covered) <= 50 * len(words)


def _one_of_each(docs):
    """The smallest id of each component of documents whose sets of 5-grams are alike by 0.8."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, text, *_ in docs for w in [text.split()]}
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    return set(group.values())


def test_run_against_plain_python(spark, prose, tmp_path):
    french = lambda n, seed: re.sub("[aeio]", lambda m: m.group() + "ûq", prose(n, seed))
    docs = [(i, (french if i % 3 == 0 else prose)(60 + 7 * i, i), "fr" if i % 3 == 0 else "en", "ab"[i % 2], 0) for i in range(40)]
    docs += [(100, None, "en", "a", 0), (101, "12345 !!! " * 60, "en", "a", 0), (102, "", "fr", "b", 0)]  # no language
    docs += [(200, prose(49, 90), "en", "a", 0), (201, prose(50, 91), "en", "b", 0), (202, "the same words again and again " * 20, "en", "a", 0)]  # base rules
    docs += [(300 + i, docs[i][1] + (" one more word" if i % 2 else ""), docs[i][2], "a", 0) for i in (3, 4, 5, 39)]  # copies
    docs += [(400, " ".join(docs[38][1].split()[:170] + prose(200, 92).split()), "en", "b", 0)]  # half alike
    docs += [(500, prose(6000, 93), "en", "a", 0)]  # several pieces
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    want, rows = [], docs
    for keep in (_has_language, lambda rows: {d[0] for d in rows if _passes_base_rules(d[1])}, _one_of_each):
        ids = keep(rows)
        rows = [d for d in rows if d[0] in ids]
        want.append(sorted(ids))
    assert [set(a) - set(b) for a, b in zip([[d[0] for d in docs], *want], want, strict=False)] == [{100, 101, 102}, {200, 202}, {303, 304, 305, 339}]
    got = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for ids, (name, stage) in zip(want, P.STAGES, strict=False):
        got = stage(spark, got, str(tmp_path))
        assert sorted(r.doc_id for r in got.collect()) == ids, name

    packed = P.run(spark, str(tmp_path)).collect()
    times = Counter(r.doc_id for r in packed if r.piece == 0)
    assert set(times) <= set(want[-1])
    for source in "ab":  # a source's documents are taken equally often, but for rounding
        taken = [times[d[0]] for d in rows if d[3] == source]
        assert max(taken) - min(taken) <= 1
    encode, pieces = bpe.word_bpe(bpe.default_path()).tokenizer.encode, Counter()
    for d in rows:
        ids = encode(d[1], add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            pieces[d[0], k, at, len(part), zlib.crc32(part.tobytes())] += times[d[0]]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == +pieces
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        parts.sort()
        assert [a for a, _ in parts] == np.cumsum([0, *(n for _, n in parts)]).tolist()[:-1] and sum(n for _, n in parts) <= 2048
