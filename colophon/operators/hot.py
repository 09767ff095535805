"""Common keys, found by a sketch before any document travels.

The sketch is a count-min sketch as a table: each key adds to one counter per row of it, picked by a hash with the row's
seed. Tasks combine their counters before the shuffle, so at most ``depth * width`` numbers leave a task; sketches of different days
are put together by adding. A counter is never below the count of a key in it: only keys whose counters are all above the
limit can be above it themselves, and those alone are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH, WIDTH = 2, 1 << 16


def _slot(key: Column, row: int, width: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(row)), F.lit(width)).cast("int")


def sketch(rows: DataFrame, key: str = "key", depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """(row, slot, n): the counters that aren't 0."""
    slots = F.array(*[F.struct(F.lit(r).alias("row"), _slot(F.col(key), r, width).alias("slot")) for r in range(depth)])
    return rows.select(F.explode(slots).alias("s")).groupBy("s.row", "s.slot").agg(F.count(F.lit(1)).alias("n"))


def merge(*sketches: DataFrame) -> DataFrame:
    """The sketch of all rows, from those of parts of them."""
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("row", "slot").agg(F.sum("n").alias("n"))


def hot_keys(rows: DataFrame, most: int, key: str = "key", depth: int = DEPTH, width: int = WIDTH, counters: DataFrame | None = None) -> DataFrame:
    """(key, n): the keys with more than ``most`` rows, exactly. ``counters``: their sketch, if there is one already (of this depth and width)."""
    full = (counters if counters is not None else sketch(rows, key, depth, width)).filter(F.col("n") > most)
    maybe = rows.select(key)
    for r in range(depth):
        # no more than width slots, so what Spark broadcasts here is bounded
        row = full.filter(F.col("row") == r).select("slot")
        maybe = maybe.withColumn("slot", _slot(F.col(key), r, width)).join(F.broadcast(row), "slot", "left_semi").select(key)
    return maybe.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)


def without(rows: DataFrame, hot: DataFrame, few: bool = False, key: str = "key") -> DataFrame:
    """rows whose key isn't hot. ``few``: hot keys are known to be few, and are broadcast, so that no row is shuffled for it."""
    keys = hot.select(key)
    return rows.join(F.broadcast(keys) if few else keys, key, "left_anti")


def total(counters: DataFrame) -> int:
    """How many rows a sketch has seen."""
    return counters.filter("row = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
