import random
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import bpe, elias_fano, packing, token_files
from lattica.llm.scratch import new_path, recorded


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.word_bpe(bpe.default_path())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("aZ '’éÉßÿ×\x1c\x85\xa0\u2003<|>x09²½\n\t")), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_ids_are_the_tokenizers_own(text):
    t = bpe.word_bpe(bpe.default_path())
    assert np.frombuffer(t.encode(text), "<u4").tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids


def test_many_texts_at_once(monkeypatch):
    """Ids are the tokenizer's; pieces without ' and of usual length are merged as arrays, not one by one."""
    monkeypatch.setattr(bpe, "TEXT", 2_000)
    t = bpe.WordBpe(bpe.default_path())
    rng, marks = random.Random(5), "aB'.,1é×ÀÞß½²µªº \xa0\x85\x1c-sStTrRevVemMlLdD<|>\t\xad\x00\x7f\x9fĀ"
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += [None, "", " ", "a" * 31, "a" * 32, "é" * 15, "é" * 16, "x" * 500, "th" * 15 + "'ll", "<|startoftext|> Hi <|ENDOFTEXT|>", "DON'T 'Tis \"A\""]
    want = [np.array(t.tokenizer.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert list(t.encode_all(texts)) == want and list(t.encode_all([])) == []
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 14))) for _ in range(3_000)]
    want = [t.encode(w) for w in words]
    monkeypatch.setattr(t, "words", None)
    assert list(t.encode_all(words)) == want and list(t.encode_all([" ".join(words)])) == [b"".join(want)]


def test_long_texts_in_parts(monkeypatch):
    """No part is much longer than TEXT, but for words that are; ids are the tokenizer's."""
    monkeypatch.setattr(bpe, "TEXT", 100)
    t, sizes = bpe.WordBpe(bpe.default_path()), []
    at_once = t._at_once
    monkeypatch.setattr(t, "_at_once", lambda texts: sizes.append(sum(map(len, texts))) or at_once(texts))
    rng = random.Random(8)
    texts = ["".join(rng.choice("aBé'.1 \n\xa0\x85\x1c") for _ in range(rng.randint(90, 2_000))) for _ in range(60)] + [" " * 500, "a" + " " * 101 + "b", "b" * 99 + "\n" + "c" * 100]
    want = [np.array(t.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert list(t.encode_all(texts)) == want and max(sizes) < 300
    long = "no " * 40 + "x7" * 300 + " yes" * 60
    assert list(t.encode_all([long, "short"])) == [t.encode(long), t.encode("short")]


def test_special_tokens_and_cache_limit(tokenizer):
    small = bpe.WordBpe(bpe.default_path(), cached_words=8)
    text = "A<|startoftext|>b don't <|ENDOFTEXT|> We'll see 'S " * 5
    assert small.encode(text) == tokenizer.encode(text)
    assert np.frombuffer(small.encode(text), "<u4").tolist() == tokenizer.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**62), max_size=300))
def test_elias_fano_gives_back_what_it_took(values):
    values = sorted(values)
    coded = elias_fano.EliasFano(elias_fano.encode(np.array(values, np.uint64)))
    assert coded.values().tolist() == values
    for i in range(0, len(values), 7):
        assert coded.select(i) == values[i]


def test_bins_never_overflow_and_best_fit_is_taken():
    bins = packing.OpenBins(10, 2)
    assert [bins.put(x) for x in (6, 3, 4, 8, 1, 9)] == [(0, 0), (0, 6), (1, 0), (2, 0), (2, 8), (3, 0)]


def _ids(t, text, end):
    return t.tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def test_packing_places_every_token_once(spark, odd_docs, tokenizer):
    rows = packing.pack_documents(odd_docs, capacity=256, with_ids=True).collect()
    docs = odd_docs.select("doc_id", "text").collect()
    want = sorted((d.doc_id is None, d.doc_id or 0, k, ids[a : a + 256]) for d in docs for ids in [_ids(tokenizer, d.text, 0)] for k, a in enumerate(range(0, len(ids), 256)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.ids) for r in rows) == want
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.start == r.piece * 256 for r in rows)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(odd_docs.limit(0)).count() == 0


def test_packing_of_more_long_pieces_than_open_bins(spark):
    rng = np.random.default_rng(4)
    lengths = [*rng.integers(1025, 2047, 2500).tolist(), *rng.integers(20, 900, 9000).tolist()]
    table = spark.createDataFrame([(i, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, length long, ids_crc32 long")
    rows = packing.pack(table).select("doc_id", "sequence_id", "offset", "length").collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths))
    assert len({r.sequence_id for r in rows}) <= 1.01 * sum(lengths) / 2048


def test_token_files_round_trip(spark, odd_docs, tokenizer):
    folder = new_path(spark, "t")
    files = token_files.write(odd_docs, folder, file_tokens=500)
    got = token_files.read(spark, files).collect()
    docs = sorted(((d.doc_id is not None, d.doc_id or 0, d.text is not None, d.text or "") for d in odd_docs.collect()))
    at, want = 0, []
    for has, doc_id, _, text in docs:
        ids = _ids(tokenizer, text, 2)
        want.append((doc_id if has else None, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    key = lambda r: r[1]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    reader = token_files.Reader(files.orderBy("part", "seq").first().path)
    assert reader.document(0).tolist() == _ids(tokenizer, docs[0][3], 2)
    assert token_files.round_trip(odd_docs.limit(0)).count() == 0


def test_token_files_encode_many_texts_at_once(spark, tokenizer, monkeypatch):
    """A tokenizer without its table of words, which encode() needs, writes the same ids."""

    def without_words(path):
        t = bpe.WordBpe(path)
        t.words = None
        return t

    monkeypatch.setattr(token_files, "bpe", SimpleNamespace(default_path=bpe.default_path, word_bpe=without_words))
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choice("aéEinrST,.7") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 300)))) for i in range(600)]
    rows += [(None, "No id"), (600, None), (601, ""), (602, "日本 Wide \u2003words"), (603, " \t\n")]
    got = token_files.round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    at, want = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = _ids(tokenizer, text, 2)
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_small_token_files_share_tasks(spark, tokenizer, monkeypatch):
    """Files of few tokens are read by as many tasks as there are cores, and no table of a part for each file is written."""
    docs = spark.createDataFrame([(i, f"Text {i}") for i in range(400)], "doc_id long, text string").repartition(40)
    with recorded() as made:
        read = token_files.round_trip(docs)
    assert len(made) == 1 and read.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism < 40
    at, want = 0, []
    for i in range(400):
        ids = _ids(tokenizer, f"Text {i}", 2)
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, read.collect())) == want
    files = token_files.write(docs, new_path(spark, "tokens"))
    monkeypatch.setattr(token_files, "READ_TOKENS", 1)
    read = token_files.read(spark, files)
    assert read.rdd.getNumPartitions() == files.count() > 20 and sorted(map(tuple, read.collect())) == want


def test_token_files_refuse_ids_beyond_their_width(tmp_path):
    import numpy as np
    import pytest

    writer = token_files.Writer(f"file://{tmp_path}", "a.tok", 2)
    with pytest.raises(ValueError, match="70000"):
        writer.add(1, np.array([5, 70_000], "<u4").tobytes())
    wide = token_files.Writer(f"file://{tmp_path}", "b.tok", 4)
    wide.add(1, np.array([5, 70_000], "<u4").tobytes())
    assert token_files.Reader(wide.close()[0]).document(0).tolist() == [5, 70_000]
