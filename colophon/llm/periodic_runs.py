"""Periodic runs: stretches of words that repeat with a period, in each text.

A run of period q is a stretch of words in which words q apart are identical, q being its smallest period, that is at least
``max(least, times * q)`` long and that neither neighbour extends. Found by the names of Karp, Miller and Rosenberg: level 0
names the words of a text, level k + 1 names the pairs of level-k names that stand 2^k apart, so equal names of level k are
equal stretches of 2^k words; a name that occurs once in its text is dropped from the levels above. How far two places
agree, forwards or backwards, is read off by descending levels. A run of period p has ``max(least, times * p) - p`` places
or more from which the word p further on is the same, so every grid of that step meets it: for each p the places of the grid
are candidates, and those with equal words are extended to both sides. Nothing is hashed and no suffixes are sorted; names
are exact. All is done in numpy, over the texts of a batch at once, candidates in blocks of bounded number.

Work per text of n words: n log n for the names and (n / (times - 1)) log n candidates, each extended in log n steps.
Memory: 4 bytes for each word and level. A piece of a batch has a million characters at most, but for one text that is
longer, which is held whole; 2^31 words in a piece are an error.

Defined cases. A null or empty text has no words and no runs. Repeated rows give repeated results, texts are judged one by
one. Empty tables give empty results. All columns of docs stay; the results are the fields of the struct ``into``, which
replaces a column of that name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, words_of

#: Candidates that are looked at together.
BLOCK = 1 << 20
RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string"


def name_levels(words: np.ndarray) -> list[np.ndarray]:
    """Level k: for each place a name of the 2^k values from there on, equal for equal stretches; unique ones have names of their own (negative)."""
    n = len(words)
    if n >= 1 << 31:
        raise ValueError("a piece of 2^31 words or more")
    own = -1 - np.arange(n, dtype=np.int32)
    order = np.argsort(words, kind="stable")
    level, live = _named(own, order, words[order])
    levels = [level]
    step = 1
    while len(live):
        live = live[live + step < n]
        first, second = level[live], level[live + step]
        both = second >= 0
        live, key = live[both], first[both].astype(np.int64) << 32 | second[both]
        order = np.argsort(key, kind="stable")
        level, live = _named(own, live[order], key[order])
        if len(live):
            levels.append(level)
        step *= 2
    return levels


def _named(own: np.ndarray, places: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, places whose name occurs again): places by sorted keys; those with a key of their own keep their own name."""
    level = own.copy()
    if not len(places):
        return level, places
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    again = ~(new & np.concatenate((new[1:], [True])))
    level[places[again]] = (np.cumsum(new) - 1)[again]
    return level, np.sort(places[again])


def agree(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values from a and from b on are the same, for each pair of places a < b."""
    out = np.zeros(len(a), np.int64)
    last = len(levels[0]) - 1
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + out, np.minimum(b + out, last)
        out += (levels[k][x] == levels[k][y]).astype(np.int64) << k
    return out


def agree_before(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values just before a and just before b are the same."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a - out - (1 << k), b - out - (1 << k)
        ok = x >= 0
        out += (ok & (levels[k][np.where(ok, x, 0)] == levels[k][np.where(ok, y, 0)])).astype(np.int64) << k
    return out


def candidates(base: np.ndarray, counts: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period) in blocks: for each text and each period that fits, the places of the period's grid."""
    periods = np.where(counts >= least, counts // times, 0)
    for lo in range(0, len(counts), 1 << 16):
        hi = lo + (1 << 16)
        yield from _grids(np.arange(lo, min(hi, len(counts))), periods[lo:hi], base, counts, least, times)


def _grids(texts, periods, base, counts, least, times):
    ends = np.cumsum(periods)
    total = int(ends[-1]) if len(ends) else 0
    at = 0
    while at < total:
        # as many (text, period) as have BLOCK places together; a period of a text alone may have more
        k = np.arange(at, min(at + BLOCK, total))
        t = np.searchsorted(ends, k, side="right")
        p = k - (ends[t] - periods[t]) + 1
        t = texts[t]
        step = np.maximum(least, times * p) - p
        n = np.maximum(0, -(-(counts[t] - p) // step))
        upto = max(1, int(np.searchsorted(np.cumsum(n), BLOCK, side="right")))
        t, p, step, n = t[:upto], p[:upto], step[:upto], n[:upto]
        of = np.repeat(np.arange(upto), n)
        yield t[of], base[t][of] + (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * step[of], p[of]
        at += upto


def find_runs(words: np.ndarray, counts: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """Rows (text, start, length, period), in that order, of all runs; words: the texts' values one after another, from 0 on."""
    base = np.cumsum(counts) - counts
    # a value of its own after each text: no stretch goes past it
    apart = np.repeat(np.arange(len(counts)), counts)
    spread = np.full(len(words) + len(counts), -1, np.int64)
    spread[np.arange(len(words)) + apart] = words
    ends = np.flatnonzero(spread < 0)
    spread[ends] = int(words.max(initial=-1)) + 1 + np.arange(len(ends))
    base = base + np.arange(len(counts))
    levels = name_levels(spread)
    word = levels[0]
    found = [np.zeros((0, 4), np.int64)]
    for text, i, p in candidates(base, counts, least, times):
        hit = np.flatnonzero(word[i] == word[i + p])
        text, i, p = text[hit], i[hit], p[hit]
        back = agree_before(levels, i, i + p)
        length = back + p + agree(levels, i, i + p)
        long = np.flatnonzero(length >= np.maximum(least, times * p))
        if len(long):
            found.append(_least_periods(np.stack([text[long], (i - back)[long] - base[text[long]], length[long], p[long]], axis=1)))
    return _least_periods(np.concatenate(found))


def _least_periods(rows: np.ndarray) -> np.ndarray:
    """One row for each text and stretch: with its smallest period, as multiples of a period are periods of the same stretch."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    if len(rows):
        rows = rows[np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)))]
    # by text, start, period
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def strongest(runs: np.ndarray) -> tuple[int, int, int]:
    """(start, length, period) of the run with the greatest length / period, exactly; ties: smallest start, then period."""
    ratio = runs[:, 1] / runs[:, 2]
    near = runs[ratio >= ratio.max() * (1 - 1e-9)].tolist()  # by start, then period
    best = near[0]
    for r in near[1:]:
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    return tuple(best)


def _describe(words: list[str], runs: np.ndarray) -> tuple:
    """The fields of RESULT for one text."""
    if not len(runs):
        text = " ".join(words)
        return 0, None, None, None, None, hashlib.sha256(b"").hexdigest(), hashlib.sha256(text.encode()).hexdigest(), text
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    text = " ".join([words[i] for i in kept.tolist()])
    start, length, period = strongest(runs)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
    return len(runs), start, length, period, 1000 * length // period, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), text


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def describe_texts(texts: list, least: int = 6, times: int = 4) -> list[tuple]:
    split = [WORD.findall(t) if t else [] for t in texts]
    values, used = [], 0
    for words in split:
        # texts share no number, so that what they have in common isn't followed
        own: dict[str, int] = {}
        values += [used + own.setdefault(w, len(own)) for w in words]
        used += len(own)
    counts = np.array([len(x) for x in split], np.int64)
    runs = find_runs(np.array(values, np.int64), counts, least, times)
    bounds = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
    return [_describe(x, runs[a:b, 1:]) for x, a, b in zip(split, bounds[:-1].tolist(), bounds[1:].tolist())]


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4, into: str = "__runs") -> DataFrame:
    """docs with the struct ``into``: the number of runs, the strongest one, digests of all and of the collapsed text, and that text.

    Collapsed: without the words that any run contains after its first period words. ``start`` is a number of a word, from 0.
    """

    def run(parts):
        for x in parts:
            texts = x.tolist()
            rows = [r for a, b in pieces(texts) for r in describe_texts(texts[a:b], least, times)]
            out = pd.DataFrame(rows, columns=[f.split()[0] for f in RESULT.split(", ")])
            yield out.astype({c: "Int64" for c in ("n_runs", "start", "length", "period", "exponent_milli")})

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return docs.withColumn(into, F.pandas_udf(run, RESULT)(F.col("text")))


def planted(docs: DataFrame) -> DataFrame:
    """docs in which a tenth of the texts, by the crc32 of doc_id, end in a periodic stretch: each word i >= a becomes word a + (i - a) % p. Native; other texts, and those of null ids, stay."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.withColumns({"__words": F.when(h % 10 == 0, words_of(F.col("text"))), "__g": F.floor(h / 10).cast("long")})
    n = F.size("__words").cast("long")
    rows = rows.withColumns({"__n": n, "__a": F.when(n > 0, F.col("__g") % n)})
    rows = rows.withColumn("__p", 1 + F.floor((F.col("__n") - F.col("__a")) / (3 + F.col("__g") % 8)).cast("long"))
    i = lambda c: F.col(c).cast("int")
    block = F.slice("__words", i("__a") + 1, i("__p"))
    copies = F.ceil((F.col("__n") - F.col("__a")) / F.col("__p")).cast("int")
    turned = F.slice(F.concat(F.slice("__words", F.lit(1), i("__a")), F.flatten(F.array_repeat(block, copies))), F.lit(1), i("__n"))
    text = F.when((F.col("__n") > 0), F.array_join(turned, " ")).otherwise(F.col("text"))
    return rows.withColumn("text", text).drop("__words", "__g", "__n", "__a", "__p")
