"""Token ids of a public tokenizer, as little-endian unsigned 32-bit bytes.

``encode`` gives exactly the ids of ``Tokenizer.encode(text,
add_special_tokens=False)``.  The supported tokenizers drop white space between
words, so a text's ids are those of its words one after another, and words
repeat: each worker keeps a bounded table from words to ids.  Words of a text in
Latin-1 are split into the tokenizer's pieces here and each piece goes to the
tokenizer's BPE model; other texts go through the whole tokenizer, word by word.
``encode_all`` gives the same for many texts: it finds their different words and
pieces and merges all of them at once, as arrays.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

#: The tokenizer's own white space, beyond what bytes.split() takes.
_SPACES = bytes(0x20 if b in (0x85, 0xA0) else b for b in range(256))
_LOWER = bytes(b + 32 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" or (0xC0 <= b <= 0xDE and b != 0xD7) else b for b in range(256))
_WIDE_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_ALPHA = "".join(chr(b) for b in range(256) if chr(b).isalpha()).encode("latin-1")
_DIGIT = "".join(chr(b) for b in range(256) if chr(b).isnumeric()).encode("latin-1")
_LOWER_SPACES = _SPACES.translate(_LOWER)
_LETTER, _NUMBER, _OTHER, _SPACE = range(4)
_KIND = np.array([_SPACE if bytes([b]).isspace() else _LETTER if b in _ALPHA else _NUMBER if b in _DIGIT else _OTHER for b in range(256)], np.uint8)
_GAP = re.compile(rb"[\t-\r ]")
#: Bytes of texts that encode_all() works on at once.
TEXT = 1 << 21
_PIECE = re.compile(
    rb"'s|'t|'re|'ve|'m|'ll|'d|[" + re.escape(_ALPHA) + rb"]+|[" + re.escape(_DIGIT) + rb"]|[^\s\x85\xa0" + re.escape(_ALPHA + _DIGIT) + rb"]+"
)


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: itself if it prints, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(0x100 + rest.index(b)) for b in rest}


class WordIds(dict):
    """word -> its ids; forgets all when it holds ``limit`` words."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        ids = self.make(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = ids
        return ids


class Merges:
    """A BPE model's merges over many pieces at once; as the model, always the first of the pairs that rank lowest."""

    MOST, NONE = 32, 1 << 30  # bytes of a piece, and the key of a pair that doesn't merge; keys are rank * MOST + place

    def __init__(self, model: dict, letters: dict[int, str]):
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        if len(vocab) > 1 << 16 or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or not suffix:
            raise ValueError("not a model of words with an end")
        self.first = np.array([vocab[letters[b] + end] for end in ("", suffix) for b in range(256)], np.uint32)
        left, right, self.made = (np.array(c, np.uint32) for c in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]), strict=True))
        keys = (left << np.uint32(16)) | right
        self.keys, self.ranks = np.full(1 << 18, 0xFFFFFFFF, np.uint32), np.full(1 << 18, self.NONE, np.int32)
        at, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):  # each goes to the first free slot from its own on
            free = rest[self.keys[at[rest]] == 0xFFFFFFFF]
            self.keys[at[free]] = keys[free]
            placed = free[self.keys[at[free]] == keys[free]]
            self.ranks[at[placed]] = placed * self.MOST
            rest = np.setdiff1d(rest, placed, assume_unique=True)
            at[rest] = (at[rest] + 1) & 0x3FFFF

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(14)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank * MOST of pairs of ids, NONE where there is no merge."""
        keys = (left << np.uint32(16)) | right
        at = self._slot(keys)
        there, out = self.keys[at], self.ranks[at]
        rest = np.flatnonzero((there != keys) & (there != 0xFFFFFFFF))
        out[there != keys] = self.NONE
        while len(rest):
            at[rest] = (at[rest] + 1) & 0x3FFFF
            there = self.keys[at[rest]]
            hit = there == keys[rest]
            out[rest[hit]] = self.ranks[at[rest[hit]]]
            rest = rest[~hit & (there != 0xFFFFFFFF)]
        return out

    def ids(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces at ``starts`` of the UTF-8 bytes, a row each; how many), all of at most MOST - 1 bytes."""
        out, counts = np.zeros((len(starts), self.MOST), np.uint32), sizes.astype(np.int64)
        order = np.argsort(sizes, kind="stable")
        for rows in (order[i : i + 8192] for i in range(0, len(order), 8192)):
            self._merge(text, starts[rows], sizes[rows], rows, out, counts)
        return out, counts

    def _merge(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray, out: np.ndarray, counts: np.ndarray) -> None:
        most = int(sizes[-1])
        place = np.arange(most)[:, None]
        byte = text[np.minimum(starts + place, len(text) - 1)].astype(np.int64)
        ids = self.first[byte + 256 * (place == sizes - 1)]  # a row for each place in the pieces
        keys = np.full((most + 1, len(rows)), self.NONE, np.int32)
        for j in range(most - 1):
            keys[j] = np.where(j + 1 < sizes, self.find(ids[j], ids[j + 1]) + j, self.NONE)
        ids = np.concatenate([ids, np.zeros((1, len(rows)), np.uint32)])
        left = sizes.astype(np.int64)
        while len(rows):
            best = keys.min(axis=0)
            merges = best < self.NONE
            if not merges.all():
                done = ~merges
                out[rows[done], :most] = ids[:most, done].T
                counts[rows[done]] = left[done]
                rows, ids, keys, left, best = rows[merges], ids[:, merges], keys[:, merges], left[merges], best[merges]
                if not len(rows):
                    break
            at, column = best % self.MOST, np.arange(len(rows))
            new = self.made[best // self.MOST]
            for j in range(int(at.min()), most):  # what follows the pair moves up
                after = at < j
                ids[j] = np.where(after, ids[j + 1], ids[j])
                keys[j] = np.where(after, np.where(keys[j + 1] < self.NONE, keys[j + 1] - 1, self.NONE), keys[j])
            ids[at, column] = new
            left -= 1
            more = at + 1 < left
            keys[at, column] = np.where(more, self.find(new, ids[at + 1, column]) + at, self.NONE)
            more = np.flatnonzero(at > 0)
            before = at[more] - 1
            keys[before, more] = self.find(ids[before, more], new[more]) + before
            np.minimum(keys, self.NONE, out=keys)


def _gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat with these numbers, one after another, and their bounds."""
    n = counts[which]
    bounds = np.append(0, np.cumsum(n))
    return flat[np.repeat(starts[which] - bounds[:-1], n) + np.arange(bounds[-1])], bounds


def _different(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the strings that begin at starts and together are raw: the bytes of the different ones, their bounds, and which one each is."""
    at = np.append(starts, len(raw)).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(raw)]).dictionary_encode()
    _, at, data = coded.dictionary.buffers()
    at = np.frombuffer(at, np.int32)[: len(coded.dictionary) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at, coded.indices.to_numpy()


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text in parts of about TEXT bytes, cut at white space."""
    at = 0
    while at < len(text):
        space = _GAP.search(text, at + TEXT)
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end


class WordBpe:
    """A tokenizer of words with lower case and dropped white space, such as word_bpe_49k.json."""

    def __init__(self, path: str, cached_words: int = 300_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.special = re.compile(b"|".join(re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()) or b"(?!)")
        self.letters = _byte_letters()
        self.id_bytes = [np.uint32(i).tobytes() for i in range(self.tokenizer.get_vocab_size())]
        self.words = WordIds(self._word, cached_words)
        self.wide = WordIds(self._whole, cached_words // 8)
        try:
            letters = {b: self.letters.get(b, chr(b)) for b in range(256)}
            self.merges = Merges(json.loads(self.tokenizer.to_str())["model"], letters)
        except (KeyError, ValueError):  # another kind of model
            self.merges = None

    def _word(self, word: bytes) -> bytes:
        if b"<|" in word and self.special.search(word):  # matched before anything else
            return self._whole(word.decode("latin-1"))
        pieces = _PIECE.findall(word.translate(_LOWER))
        if len(pieces) == 1 and pieces[0] == word:
            spelled = word.decode() if word.isalnum() else word.decode("latin-1").encode().decode("latin-1").translate(self.letters)
            known = self.id_bytes
            return b"".join([known[t.id] for t in self.tokenize(spelled)])
        return b"".join([self.words[p] for p in pieces])

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _at_once(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts in Latin-1, in lower case and without special tokens; different words and pieces are cut and merged once."""
        raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)  # a space after each
        ends = np.cumsum([len(t) + 1 for t in texts])
        inside = _KIND[raw] != _SPACE
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first = np.flatnonzero(first)
        if not len(first):
            return [b""] * len(texts)
        gone = np.cumsum(np.append(0, np.diff(first) - np.add.reduceat(inside, first, dtype=np.int64)[:-1]))
        words, at, word = _different(raw[inside], first - first[0] - gone)
        kind = _KIND[words]
        new = np.ones(len(words), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        marked = np.unique(np.searchsorted(at, np.flatnonzero(words == 0x27), "right") - 1)  # as 's and 'll are pieces, words with ' are left to _word()
        new[_gather(np.arange(len(words)), at[:-1], np.diff(at), marked)[0]] = False
        new[at[:-1]] = True
        new = np.flatnonzero(new)
        pieces, bounds, piece = _different(words, new)
        sizes = np.diff(bounds) + np.add.reduceat(pieces > 0x7F, bounds[:-1], dtype=np.int64)  # in UTF-8
        odd = sizes >= Merges.MOST
        odd[np.searchsorted(bounds, np.flatnonzero(pieces == 0x27), "right") - 1] = True
        usual, others = np.flatnonzero(~odd), np.flatnonzero(odd)
        ids, n = self.merges.ids(np.frombuffer(pieces.tobytes().decode("latin-1").encode(), np.uint8), (np.cumsum(sizes) - sizes)[usual], sizes[usual])
        more = [np.frombuffer(self.words[pieces[bounds[i] : bounds[i + 1]].tobytes()], "<u4") for i in others.tolist()]
        flat = np.concatenate([ids[np.arange(Merges.MOST) < n[:, None]], *more]).astype("<u4")
        counts, starts = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        n = np.concatenate([n, np.array([len(m) for m in more], np.int64)])
        order = np.concatenate([usual, others])
        counts[order], starts[order] = n, np.cumsum(n) - n
        flat, run = _gather(flat, starts, counts, piece)  # of the different words
        run = run[np.append(np.searchsorted(new, at[:-1]), len(new))]
        flat, run = _gather(flat, run[:-1], np.diff(run), word)
        data, edges = flat.tobytes(), (4 * run[np.append(0, np.searchsorted(first, ends))]).tolist()
        return [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """encode() of each text, worked on in parts of about TEXT bytes; longer texts are cut at white space."""
        held: list[bytes] = []  # texts in Latin-1, or the ids of others
        plain: list[int] = []
        size = 0

        def ready() -> Iterator[bytes]:
            for k, ids in zip(plain, self._at_once([held[k] for k in plain]) if plain else [], strict=True):
                held[k] = ids
            yield from held
            held.clear()
            plain.clear()

        for text in texts:
            try:
                data = (text or "").encode("latin-1")
            except UnicodeEncodeError:
                data = None
            if data and self.merges and b"<|" not in data:
                data = data.translate(_LOWER_SPACES)
                if len(data) > TEXT:
                    data = b"".join([self._at_once([part])[0] for part in _parts(data)])
                else:
                    plain.append(len(held))
            else:
                data = self.encode(text)
            held.append(data)
            size += len(data)
            if size > TEXT:
                yield from ready()
                size = 0
        yield from ready()

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text; b"" for None."""
        if not text:
            return b""
        try:
            words = text.encode("latin-1").translate(_SPACES).split()
        except UnicodeEncodeError:
            return b"".join([self.wide[w] for w in _WIDE_SPACE.split(text) if w])
        return b"".join(map(self.words.__getitem__, words))


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One per worker process and file."""
    return WordBpe(path)


def default_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")
