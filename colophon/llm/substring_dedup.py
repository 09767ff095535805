"""Substring dedup by seed and extend: words of passages that occur earlier in the corpus are removed.

Seeds are winnowed anchors of eight words; documents join on seeds that occur twice or more (see ``repeats``). From a seed a
match is extended both ways, word by word, as far as a window of ``window`` words that holds the seed can reach: two windows
agree if their seeds stand at the same place and the extensions to the left and to the right agree. Runs of repeated windows
are the maximal repeats over the length threshold; every word that one covers is removed.

Defined cases: a null text has no words and stays null-free (it becomes the empty text); texts shorter than a window lose
nothing but their spacing (words are joined by one space); of equal texts the one with the smallest doc_id (null last) is
first, and repeated rows are copies of each other; an empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .repeats import BASES, Kind, Rolling, Tokens, mix, repeated_tokens, word_tokens

OUT = StructType([StructField("text", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())])


def extended(spans: np.ndarray, texts: list[bytes], kind: Kind) -> np.ndarray:
    """The class of each window: the seed, how far it is extended to the left, and what stands on both sides of it."""
    t = kind.tokens(texts)
    base = np.cumsum(t.counts) - t.counts
    n = spans["n"].astype(np.int64)
    of = np.repeat(np.arange(len(spans)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = base[of] + place
    left = spans["off"][of].astype(np.int64) - place  # words before the seed
    seed = at + left
    right = kind.window - left - kind.gram
    keys = []
    for b in BASES[1:]:
        r = Rolling(t.values, b)
        before, after = r.of(at, left), r.of(seed + kind.gram, right)
        keys.append(mix(mix(before + left.astype(np.uint64)) + mix(r.of(seed, kind.gram)) * np.uint64(3) + mix(after) * np.uint64(5)))
    order = np.lexsort(keys)
    new = np.zeros(len(order), np.int64)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _finish(t: Tokens, covered: np.ndarray) -> tuple:
    kept = b" ".join(t.data[a:b] for a, b in zip(t.start[~covered].tolist(), t.end[~covered].tolist()))
    return kept.decode("utf-8", "surrogatepass"), len(covered), int(covered.sum()), hashlib.sha256(kept).hexdigest()


def dedup_substrings(docs: DataFrame, window: int = 20, gram: int = 8) -> DataFrame:
    """docs with text changed to the kept words joined by one space, and n_words, n_removed, kept_sha256."""
    return repeated_tokens(docs, Kind(window, gram, word_tokens, extended), _finish, OUT)
