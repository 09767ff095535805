"""Byte-level BPE from a table of ranks: encoding by backtracking over longest matches, and decoding.

A text is split by the pre-tokenizer's pattern; each piece is encoded alone. Bytes are mapped to Latin-1 characters, so an
Aho-Corasick automaton over the vocabulary finds the longest token at each place. A sequence of tokens is what merging by
rank would give if each two neighbours are compatible (merging their bytes gives those two back); the compatibility of two
tokens is memoised. Encoding takes the longest token at each place, shortens it while it isn't compatible with its left
neighbour, and steps back where nothing fits; a place from which nothing fits is never tried twice, so the time is linear.

Defined cases: null is the empty text with no tokens; any text, however long, decodes to exactly its UTF-8 bytes. Repeated
rows give repeated results; an empty table gives an empty result. Other columns pass through, but for those named like a
result (``ids``, ``decoded``, ``__bpe``), which the result replaces.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from itertools import islice
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, pieces

#: Words whose ids a worker keeps, twice (a generation and the one before it): about 30 MB. They go when its task ends.
CACHE = 100_000
#: Pairs of neighbours whose compatibility a worker keeps, about 25 MB. They go too.
PAIRS = 300_000
#: White space as the pattern's engine knows it (fixed values: the property White_Space).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def load_ranks(path: str) -> dict[bytes, int]:
    """A table of lines: base64 of the token, space, its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Texts to ids, a batch at a time, as little-endian 32-bit numbers.

    Texts are cut at single spaces between other characters, where the pattern always cuts. What stands between is mostly a
    word; the ids of the words lately met are kept. ``encode_words`` gives the ids of words, each after a space;
    ``encode_text`` those of any text.
    """

    def __init__(self, encode_words, encode_text, most: int = CACHE):
        import regex

        self.encode_words, self.encode_text, self.most = encode_words, encode_text, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks = {m: encode_text(m) for m in ".,"}
        self.cuts = regex.compile(f"(?<=[^{WHITE}]) (?=[^{WHITE}])").split
        white = regex.compile(f"[{WHITE}]")
        self.blank = frozenset(c for c in map(chr, range(0x3001)) if white.match(c))

    def forget(self) -> None:
        self.young, self.old = {}, {}
        give_back()

    def _mark(self, w: str) -> tuple[str, bytes] | None:
        """A word before a comma or a full stop is a piece, so is the mark."""
        return (w[:-1], self.marks[w[-1]]) if w[-1] in self.marks and w[:-1].isalpha() else None

    def _learn(self, words: list[str]) -> None:
        """Sees to it that ``young`` knows the words, of which it knows none."""
        young, old = self.young, self.old
        marked, bodies, rests, new = [], [], [], []
        for w in words:
            if w in old:
                young[w] = old.pop(w)
            elif not w.isalpha() and (cut := self._mark(w)):
                marked.append(w)
                bodies.append(cut[0])
                rests.append(cut[1])
            else:
                new.append(w)
        for w in {b for b in bodies if b not in young}.difference(new):
            if w in old:
                young[w] = old.pop(w)
            else:
                new.append(w)
        young.update(zip(new, self.encode_words(new)))
        young.update(zip(marked, map(add, map(young.__getitem__, bodies), rests)))

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        blank, young = self.blank, self.young
        lists = [t.split(" ") if t else [] for t in texts]
        words: set[str] = set()
        for x in lists:
            words.update(islice(x, 1, None))
        # White space beside a space is encoded with it: no cut there. Words that are known have been looked at.
        new = [w for w in words if w not in young]
        bad = {w for w in new if not w or w[0] in blank or w[-1] in blank}
        again = False
        for i, x in enumerate(lists):
            if len(x) > 1 and (not x[0] or x[0][-1] in blank or bad and not bad.isdisjoint(x)):
                lists[i] = self.cuts(texts[i])
                words.update(islice(lists[i], 1, None))
                again = True
        if again:
            new = [w for w in words if w and w not in young and w[0] not in blank and w[-1] not in blank]
        self._learn(new)
        out, known = [], self.young.__getitem__
        for x in lists:
            if not x:
                out.append(np.zeros(0, np.uint32))
                continue
            last = x.pop() if len(x) > 1 and x[-1][-1] in blank else ""
            ids = [self.encode_text(x[0]), *map(known, islice(x, 1, None))]
            if last:
                ids.append(self.encode_text(" " + last))
            out.append(np.frombuffer(b"".join(ids), "<u4"))
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        return out

    def __call__(self, text: str | None) -> np.ndarray:
        return self.batch([text])[0]


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick

        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}  # of a token: the two of its last merge
        self.merged: dict[tuple[int, int], int] = {}
        trie = ahocorasick.Automaton()
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                split = self._merge(token, i)
                if len(split) != 2:
                    continue  # no merges lead to it: only a whole piece can be it
                self.parts[i] = (split[0], split[1])
                self.merged[split[0], split[1]] = i
            trie.add_word(token.decode("latin-1"), i)
        trie.make_automaton()
        self.trie = trie
        self.length = {i: len(t) for i, t in self.bytes_of.items()}
        self.shorter: dict[int, int] = {}
        self.fits: dict[int, bool] = {}  # by both ids in one number
        self.pattern = pattern

    def _merge(self, token: bytes, below: int) -> list[int]:
        """Merging by rank, with ranks under ``below`` only."""
        ranks, parts = self.ranks, [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives back left, right: no merge across their border comes first.

        The border is undone step by step: always the younger of the two inner tokens is split, and a merge of what then
        stands at the border counts if it is older than what was split.
        """
        known = self.fits.get(left << 20 | right)
        if known is not None:
            return known
        a, b, limit, fits = left, right, 1 << 60, True
        parts, merged = self.parts, self.merged
        while True:
            across = merged.get((a, b))
            if across is not None and across < limit:
                fits = False
                break
            split_a, split_b = a in parts, b in parts
            if split_a and (a > b or not split_b):
                limit, a = a, parts[a][1]
            elif split_b:
                limit, b = b + 1, parts[b][0]
            else:
                break
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        self.fits[left << 20 | right] = fits
        return fits

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1 if none."""
        if (found := self.shorter.get(token)) is None:
            b, found = self.bytes_of[token], -1
            for n in range(len(b) - 1, 0, -1):
                i = self.ranks.get(b[:n], -1)
                if i >= 0 and (n == 1 or i in self.parts):
                    found = i
                    break
            self.shorter[token] = found
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text = piece.decode("latin-1")
        tokens = [t for _, t in self.trie.iter_long(text)]
        fits, last = self.fits, tokens[0]
        for i in range(1, len(tokens)):
            token = tokens[i]
            ok = fits.get(last << 20 | token)
            if not (self.compatible(last, token) if ok is None else ok):
                return self._backtrack(text, tokens[:i], token)
            last = token
        return tokens

    def _backtrack(self, text: str, out: list[int], token: int) -> list[int]:
        """From the tokens ``out`` on, after which ``token`` is the longest match and doesn't fit."""
        iter_long, fits, length, shorter, end = self.trie.iter_long, self.fits, self.length, self.shorter, len(text)
        at = sum(map(length.__getitem__, out))
        shut = set()
        while at < end:
            last = out[-1] if out else -1
            while token >= 0:
                if at + length[token] not in shut:
                    if last < 0:
                        break
                    ok = fits.get(last << 20 | token)
                    if self.compatible(last, token) if ok is None else ok:
                        break
                short = shorter.get(token)
                token = self._shorter(token) if short is None else short
            if token >= 0:
                out.append(token)
                at += length[token]
                if at < end:
                    token = next(iter_long(text, at))[1]
            else:
                shut.add(at)
                token = out.pop()
                at -= length[token]
        return out

    def encoder(self) -> Encoder:
        import regex

        cut = regex.compile(self.pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")).findall
        piece, four = self.encode_piece, [packed([i]) for i in range(max(self.bytes_of) + 1)]

        def text(t: str) -> bytes:
            return b"".join([four[i] for p in cut(t) for i in piece(p.encode())])

        def words(new: list[str]) -> list[bytes]:
            return [b"".join([four[i] for i in piece((" " + w).encode())]) if w.isalpha() else text(" " + w) for w in new]

        return Encoder(words, text)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_LOADED: dict = {}


def loaded(path: str, pattern: str) -> tuple[ByteBPE, Encoder, list[str]]:
    """The encoder of this worker process, made once."""
    if (path, pattern) not in _LOADED:
        bpe = ByteBPE(load_ranks(path), pattern)
        _LOADED[path, pattern] = bpe, bpe.encoder(), [str(i) for i in range(max(bpe.bytes_of) + 1)]
    return _LOADED[path, pattern]


def _udf(make, schema: str, path: str, pattern: str):
    from collections.abc import Iterator

    def run(parts):
        encode = loaded(path, pattern)[1]
        try:
            for x in parts:
                yield make(x)
        finally:
            loaded(path, pattern)[0].fits.clear()
            encode.forget()

    out = pd.DataFrame if " " in schema else pd.Series
    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[out]}
    return F.pandas_udf(run, schema)


def _pieces(x: pd.Series):
    texts = x.tolist()
    return (texts[a:b] for a, b in pieces(texts))


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with a column ``ids`` (array of int), which replaces one of that name: the encoding of the column text."""
    encode = lambda x: pd.Series([i for part in _pieces(x) for i in loaded(path, pattern)[1].batch(part)], dtype=object)
    return docs.withColumn("ids", _udf(encode, "array<int>", path, pattern)(F.col("text")))


def decode_ids(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """rows with a column ``decoded`` (binary), which replaces one of that name: the decoding of the column ids; null has none."""
    decode = lambda x: pd.Series([None if i is None else loaded(path, pattern)[0].decode(i.tolist()) for i in x], dtype=object)
    return rows.withColumn("decoded", _udf(decode, "binary", path, pattern)(F.col("ids")))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with ``__bpe``: n_tokens, ids_sha256 and decoded_sha256 of each text, encoded and decoded in one pass over the batch."""

    def digest(texts: pd.Series) -> pd.DataFrame:
        bpe, encode, names = loaded(path, pattern)
        rows = []
        for part in _pieces(texts):
            for ids in encode.batch(part):
                ids = ids.tolist()
                rows.append((len(ids), hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.withColumn("__bpe", _udf(digest, "n_tokens long, ids_sha256 string, decoded_sha256 string", path, pattern)(F.col("text")))
