"""Pairs within clusters by sorted neighbourhood, and candidates by several keys at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import KEYS
from ..sources.tables import saved
from .verify import features, verify_pairs


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with ``__at``: their number in the order, from 0, over the whole table. Ranges are sorted apart; only their sizes meet, a row for each."""
    ids = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    # written, as ranges are cut anew, and elsewhere, each time they are made
    ids = saved(ids.withColumns({"__range": F.shiftright("__id", 33), "__in": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = ids.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    out = ids.join(F.broadcast(before), "__range").withColumn("__at", F.col("__before") + F.col("__in"))
    return out.select(*rows.columns, "__at")


def neighbours(rows: DataFrame, window: int, *order: str) -> DataFrame:
    """(key, a, b): each pair of rows of one key, a before b, that stand fewer than ``window`` places apart in the order, once.

    Rows are numbered over the whole table and cut into blocks of window - 1 places; a row meets its own block and the next
    one. A block has as many rows as any other, so a key of any size does no harm: the work is rows times window.
    """
    names = [c for c in rows.columns if c != "key"]
    reach = max(1, window - 1)
    at = numbered(rows, "key", *order).select("key", F.struct(*names).alias("r"), "__at", F.floor(F.col("__at") / reach).cast("long").alias("block"))
    left = at.select("key", F.col("r").alias("a"), F.col("__at").alias("__a"), F.explode(F.array("block", F.col("block") + 1)).alias("block"))
    right = at.select("key", F.col("r").alias("b"), F.col("__at").alias("__b"), "block")
    apart = (F.col("__b") - F.col("__a")).between(1, window - 1)
    return left.join(right, ["block", "key"]).filter(apart).select("key", "a", "b")


def verify_neighbours(rows: DataFrame, window: int, blacklist=None, **options) -> DataFrame:
    """(key, a_ident, b_ident, status, reason) of the pairs of each key within the window, by ident and doc. rows: key, ident, doc and the columns of verify.INPUTS; empty keys go."""
    made = features(rows.filter("key <> ''"), blacklist)
    found = verify_pairs(neighbours(made, window, "ident", "doc"), **options)
    return found.select("key", F.col("a.ident").alias("a_ident"), F.col("b.ident").alias("b_ident"), "status", "reason")


def with_keys(docs: DataFrame, kinds: tuple[str, ...] = tuple(KEYS), title: str = "title") -> DataFrame:
    """docs with ``keys``: all keys of the title, in the order of kinds."""
    value = F.coalesce(F.col(title), F.lit(""))
    return docs.withColumn("keys", F.array(*[KEYS[k](value) for k in kinds]))


def _by_key(docs: DataFrame, name: str) -> DataFrame:
    return docs.select(F.struct(*docs.columns).alias(name), F.posexplode("keys").alias("kind", "key")).filter("key <> ''")


def leaders(releases: DataFrame, kinds: tuple[str, ...] = tuple(KEYS)) -> DataFrame:
    """The releases that are the first (by ident and doc) of one of their keys, with ``keys`` and ``leads``: for which kinds they are."""
    lead = _by_key(with_keys(releases, kinds), "a").groupBy("kind", "key").agg(F.min_by("a", F.struct("a.ident", "a.doc")).alias("a"))
    return lead.groupBy("a.ident", "a.doc").agg(F.any_value("a").alias("a"), F.collect_set("kind").alias("leads")).select("a.*", "leads")


def meet(lead: DataFrame, refs: DataFrame) -> DataFrame:
    """(kind, a, b): each of refs (with keys) with the leaders of its keys; kind: the first key that gives the pair.

    A pair is left out at a key if the two share an earlier one that the release leads, so each comes once without being
    compared with others.
    """
    names = [c for c in lead.columns if c != "leads"]
    led = lead.select(F.struct(*names).alias("a"), "leads", F.explode("leads").alias("kind")).withColumn("key", F.get(F.col("a.keys"), F.col("kind")))
    pairs = _by_key(refs, "b").join(led, ["kind", "key"])
    again = F.exists("leads", lambda k: (k < F.col("kind")) & (F.get(F.col("a.keys"), k) == F.get(F.col("b.keys"), k)))
    return pairs.filter(~again).select("kind", "a", "b")


def candidates(releases: DataFrame, refs: DataFrame, kinds: tuple[str, ...] = tuple(KEYS)) -> DataFrame:
    """(kind, a, b): each reference b with the first release a of each of its keys, each pair once. Each side is read once, and gives all its keys."""
    return meet(leaders(releases, kinds), with_keys(refs, kinds))


def verify_candidates(releases: DataFrame, refs: DataFrame, kinds: tuple[str, ...] = tuple(KEYS), blacklist=None, **options) -> DataFrame:
    """candidates, judged by the cascade: (kind, a, b, status, reason). Both sides: ident, doc and the columns of verify.INPUTS; features are made of leaders and references, once each."""
    pairs = meet(features(leaders(releases, kinds), blacklist), features(with_keys(refs, kinds), blacklist))
    return verify_pairs(pairs, **options)
