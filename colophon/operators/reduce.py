"""Semi-join reduction by a Bloom filter: rows whose key surely has no partner go before anything costly is made of them.

The filter is a table of 64-bit words. A key's hash picks one word and a few bits in it; the words are made by one combining
aggregate (``bit_or``), and a row stays if its word has all its bits - a semi-join on the word, with the words broadcast. The number of words
follows from the number of keys and the error rate; a filter of more than ``MOST_WORDS`` words isn't made, and all rows
stay. Rows that stay by error find no partner in the exact join that has to follow.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BITS = 64
#: About 100 MB where it is broadcast.
MOST_WORDS = 1 << 21


def error_rate(load: float, bits: int) -> float:
    """How often a key that isn't there passes, with ``load`` keys a word on average and so many bits a key."""
    total, chance = 0.0, math.exp(-load)
    for keys in range(int(load + 12 * math.sqrt(load) + 12)):
        total += chance * (1 - (1 - 1 / WORD_BITS) ** (bits * keys)) ** bits
        chance *= load / (keys + 1)
    return total


def shape(keys: int, error: float) -> tuple[int, int]:
    """(words, bits a key): the least number of words that keeps the error rate."""
    best = None
    for bits in range(1, 9):
        low, high = 1e-6, float(WORD_BITS)
        for _ in range(40):  # the largest load within the error rate
            mid = (low + high) / 2
            low, high = (mid, high) if error_rate(mid, bits) <= error else (low, mid)
        if best is None or low > best[0]:
            best = low, bits
    return max(1, math.ceil(keys / best[0])), best[1]


def _place(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words)).alias("word")


def _mask(key: Column, bits: int) -> Column:
    h = F.xxhash64(key, F.lit(1))
    mask = None
    for i in range(bits):
        place = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(WORD_BITS - 1)).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), place)
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return mask


def filter_words(keys: DataFrame, words: int, bits: int, key: str = "key") -> DataFrame:
    """(word, set): the filter of the keys. Filters of one shape are put together by ``bit_or`` per word."""
    made = keys.select(_place(F.col(key), words), _mask(F.col(key), bits).alias("mask"))
    return made.groupBy("word").agg(F.bit_or("mask").alias("set"))


def semi_reduce(rows: DataFrame, keys: DataFrame, error: float = 0.01, key: str = "key", most_words: int | None = None) -> DataFrame:
    """rows without those whose key surely isn't among keys; all of them, if the filter would be too large."""
    n = keys.agg(F.approx_count_distinct(key, 0.02)).first()[0]
    words, bits = shape(max(n, 1), error)
    if words > (MOST_WORDS if most_words is None else most_words):
        return rows
    found = filter_words(keys, words, bits, key).withColumnRenamed("word", "__word").withColumnRenamed("set", "__set")
    placed = rows.withColumns({"__at": _place(F.col(key), words), "__mask": _mask(F.col(key), bits)})
    passes = (F.col("__at") == F.col("__word")) & (F.col("__set").bitwiseAND(F.col("__mask")) == F.col("__mask"))
    return placed.join(F.broadcast(found), passes, "left_semi").select(*rows.columns)
