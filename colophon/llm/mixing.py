"""Mixing sources to target weights by fitting a subset of exact lengths to each source's budget.

Weights 5, 2, 1 repeat over the sources in code point order (null last). They share ``share`` times all words; a target
stops at twice its source's size and the excess is shared again by weight until none is above. Each source then takes all
its documents as often as fits wholly into its target (0, 1 or 2 times), and for the rest of the budget a subset once more:
documents are counted by exact length, a proportional part of each length is taken, and a bounded-knapsack program over
the remaining budget sets how many more of each length. Which documents of a length go is decided by a seeded hash.

Only counts by length reach one task: their number is bounded by the longest document, not by the corpus.

Defined cases: null text has 0 words, takes none; a null source is a source; a null doc_id is one like any other, and rows
that share a doc_id are told apart by their text; rows that are equal in both are interchangeable, each is one document; a
long text is one document of its length; an empty table gives an empty result. Columns of docs pass through; names that
start with ``__`` are reserved.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, cut, shuffle_partitions

CELLS = 256
#: The budget left to the knapsack program: large enough that its sums are dense.
DP_BUDGET = 1 << 15


def source_targets(sizes: DataFrame, share: float = 1.5, weights: tuple = (5, 2, 1), most: float = 2.0) -> DataFrame:
    """(__source, __size) with one row per source -> with __target. Sources are ranked within ranges, so no task sorts them all."""
    spark = sizes.sparkSession
    key = [F.col("__source").isNull(), F.col("__source")]
    dealt = cut(sizes.repartitionByRange(shuffle_partitions(spark), *key).withColumn("__part", F.spark_partition_id()))
    offsets, n = {}, 0
    for part, rows in sorted(dealt.groupBy("__part").count().collect()):  # a row per partition
        offsets[part], n = n, n + rows
    if not n:
        return dealt.select("__source", "__size", F.lit(0.0).alias("__target"))
    start = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])[F.col("__part")]
    rank = start + F.row_number().over(Window.partitionBy("__part").orderBy(*key)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = dealt.select("__source", "__size", weight.alias("__w")).withColumn("__cap", most * F.col("__size"))
    rate = 0.0
    total = float(ranked.agg(F.sum("__size")).first()[0] or 0) * share
    while total:
        above = F.col("__cap") < rate * F.col("__w")
        capped, free = ranked.agg(F.coalesce(F.sum(F.when(above, F.col("__cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("__w"))), F.lit(0.0))).first()
        new = (total - capped) / free if free else rate
        if new <= rate:
            break
        rate = new
    return ranked.select("__source", "__size", F.least("__cap", rate * F.col("__w")).alias("__target"))


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many documents of each length (all over 0) to take so that the words come as near to the budget as possible.

    A proportional part first, then single documents until DP_BUDGET or so is left, then a bounded knapsack over that.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    take = np.minimum(counts, np.floor(counts * max(0.0, budget - DP_BUDGET) / total).astype(np.int64))
    rest = int(round(budget)) - int((take * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if rest <= DP_BUDGET:
            break
        more = int(min(counts[i] - take[i], max(0, (rest - DP_BUDGET // 2) // lengths[i])))
        more = min(more, 1 + int(counts[i]) // 8)
        take[i] += more
        rest -= more * int(lengths[i])
    while rest > 2 * DP_BUDGET:  # few documents of each length, all lengths tried once
        left = np.flatnonzero((counts > take) & (lengths <= rest))
        if not len(left):
            break
        i = left[-1]
        more = int(min(counts[i] - take[i], rest // lengths[i]))
        take[i] += more
        rest -= more * int(lengths[i])
    if rest <= 0:
        return take
    # items: (words, index, documents), counts split into powers of two. The nearest sum above the budget is less than the
    # longest document above it: with more, one document could go.
    span = rest + int(lengths[counts > take].max(initial=0)) + 1
    mask, reach = (1 << span) - 1, 1
    first = np.full(span, -1, np.int64)
    items: list[tuple[int, int, int]] = []
    for i in np.flatnonzero(counts > take):
        spare, k = int(min(counts[i] - take[i], span // lengths[i])), 1
        while spare > 0 and not reach >> rest & 1:
            k = min(k, spare)
            words = k * int(lengths[i])
            fresh = (reach << words) & mask & ~reach
            if fresh:
                bits = np.unpackbits(np.frombuffer(fresh.to_bytes((span + 7) // 8, "little"), np.uint8), bitorder="little")[:span]
                first[np.flatnonzero(bits)] = len(items)
                reach |= fresh
                items.append((words, int(i), k))
            spare -= k
            k *= 2
        if reach >> rest & 1:
            break
    sums = np.flatnonzero(np.unpackbits(np.frombuffer(reach.to_bytes((span + 7) // 8, "little"), np.uint8), bitorder="little")[:span])
    at = int(sums[np.argmin(np.abs(sums - rest))])
    while at:
        words, i, k = items[first[at]]
        take[i] += k
        at -= words
    return take


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("__len")
    lengths, counts = group["__len"].to_numpy(np.int64), group["__n"].to_numpy(np.int64)
    total, target = int((lengths * counts).sum()), float(group["__target"].iloc[0])
    copies = int(target // total) if total else 0
    extra = fit_budget(lengths, counts, target - copies * total) if total else np.zeros(len(lengths), np.int64)
    return pd.DataFrame({"__source": group["__source"], "__len": lengths, "__copies": copies, "__extra": extra})


def mix_sources(docs: DataFrame, share: float = 1.5, weights: tuple = (5, 2, 1), seed: int = 17) -> DataFrame:
    """All rows and columns of docs, with __len, __size, __target and __taken: the words, its source's words and target, and the words taken."""
    docs = docs.withColumn("__len", count_words(F.col("text")))
    small = docs.select("source", "doc_id", "text", "__len")
    hist = small.groupBy(F.col("source").alias("__source"), "__len").agg(F.count(F.lit(1)).alias("__n"))
    hist = cut(hist)
    sizes = hist.groupBy("__source").agg(F.sum(F.col("__len") * F.col("__n")).alias("__size"))
    targets = cut(source_targets(sizes, share, weights))
    named = targets.select(F.col("__source").alias("__of"), "__size", "__target")
    todo = hist.filter("__len > 0").join(named, F.col("__source").eqNullSafe(F.col("__of")))
    plan = todo.select("__source", "__len", "__n", "__target").groupBy("__source").applyInPandas(_plan, "__source string, __len long, __copies long, __extra long")
    plan = cut(plan.join(named, F.col("__source").eqNullSafe(F.col("__of"))).drop("__of"))
    # The documents of a length, in hash order, are cut at the number to take: whole cells below it, a part of one cell.
    hashed = F.xxhash64(F.lit(seed), "doc_id", "text")
    cell = F.shiftrightunsigned(hashed, 56).cast("int")
    cells = small.groupBy(F.col("source").alias("__cs"), F.col("__len").alias("__cl"), cell.alias("__cc")).agg(F.count(F.lit(1)).alias("__cn"))
    cells = cells.join(plan, F.col("__cs").eqNullSafe(F.col("__source")) & (F.col("__cl") == F.col("__len")))
    before = F.coalesce(F.sum("__cn").over(Window.partitionBy("__cs", "__cl").orderBy("__cc").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("__cs", "__cl", "__cc", "__copies", "__size", "__target", "__cn", F.greatest(F.lit(0), F.least("__cn", F.col("__extra") - before)).alias("__k"))
    df = docs.withColumns({"__hash": hashed, "__cell": cell})
    df = df.join(cells, F.col("source").eqNullSafe(F.col("__cs")) & (F.col("__len") == F.col("__cl")) & (F.col("__cell") == F.col("__cc")), "left")
    rank = F.row_number().over(Window.partitionBy("source", "__len", "__cell").orderBy("__hash", "doc_id"))
    more = F.when(F.col("__k") >= F.col("__cn"), 1).when(F.col("__k") <= 0, 0).otherwise((rank <= F.col("__k")).cast("int"))
    df = df.withColumn("__taken", F.when(F.col("__len") > 0, F.col("__len") * (F.col("__copies") + more)).otherwise(F.lit(0)).cast("long"))
    df = df.drop("__cs", "__cl", "__cc", "__copies", "__size", "__target", "__cn", "__k", "__hash", "__cell")
    return df.join(named, F.col("source").eqNullSafe(F.col("__of")), "left").drop("__of")
