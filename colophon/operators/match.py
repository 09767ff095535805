"""Matching: records of two sides, or of one cluster, that share a key.

The pivot of a key is its first release by (ident, doc), found by an aggregate that combines before the shuffle, so a
common key costs one row per task; references then join it. Edges never need a key's rows in one place. Only zip_groups,
whose result is one row per key, puts them there; zip_pieces gives the same in rows of bounded size. Over key tables, which
are in buckets by key, a zip reads both sides without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import KeyTable, saved
from .convert import biblioref
from .hot import hot_keys, sketch, total
from .reduce import semi_reduce
from .verify import as_struct, features, verify_pairs


def pivots(releases: DataFrame) -> DataFrame:
    """(key, a): the first release of each key, as a struct; rows need key, ident and doc. Empty keys go."""
    names = [c for c in releases.columns if c != "key"]
    first = F.min_by(F.struct(*names), F.struct("ident", "doc"))
    return releases.filter("key <> ''").groupBy("key").agg(first.alias("a"))


PIECE_BITS = 10


def zip_pieces(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, side, piece, docs): the docs of side 0 and 1 for each key that both have, at most 1 << PIECE_BITS in a row. In the order of piece, docs are in order.

    Rows are dealt by ranges of (key, side, doc), so a common key is spread; pieces are numbered across the ranges.
    """
    keys = left.select("key").filter("key <> ''").intersect(right.select("key"))
    sided = lambda df, n: df.select("key", F.lit(n).alias("side"), "doc")
    rows = sided(left, 0).union(sided(right, 1)).join(keys, "key", "left_semi")
    rows = rows.repartitionByRange("key", "side", "doc").sortWithinPartitions("key", "side", "doc")
    rows = rows.withColumn("piece", F.shiftright(F.monotonically_increasing_id(), PIECE_BITS))
    return rows.groupBy("key", "side", "piece").agg(F.sort_array(F.collect_list("doc")).alias("docs"))


def zip_groups(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, g0, g1): the docs of both sides for each key that both have, in order. A key is one row, so one task must hold its docs: see zip_pieces for common keys."""
    sided = lambda df, n: df.select("key", F.lit(n).alias("side"), "doc")
    docs = lambda n: F.sort_array(F.collect_list(F.when(F.col("side") == n, F.col("doc")))).alias(f"g{n}")
    rows = sided(left, 0).union(sided(right, 1)).filter("key <> ''")
    return rows.groupBy("key").agg(docs(0), docs(1)).filter("size(g0) > 0 AND size(g1) > 0")


def unmatched(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of the right side whose key the left side doesn't have."""
    return right.join(left.select("key").filter("key <> ''"), "key", "left_anti")


def zip_exact(releases: DataFrame, refs: DataFrame, reason: str = "unknown", provenance: str = "join", few_keys: bool = False) -> DataFrame:
    """An edge from each reference to its key's pivot. releases: key, ident, doc, work_id; refs: key, release_ident, work_ident, release_stage, release_year, index, ref_key. ``few_keys``: pivots are known to be few, and are broadcast."""
    status = "exact" if reason in ("doi", "pmid", "pmcid", "arxiv") else "unknown"
    pivot = pivots(releases.select("key", "ident", "doc", "work_id"))
    joined = refs.filter("key <> ''").join(F.broadcast(pivot) if few_keys else pivot, "key")
    c = F.col
    return joined.select(
        *biblioref(
            source_release_ident=c("release_ident"), source_work_ident=c("work_ident"), source_release_stage=c("release_stage"), source_year=c("release_year").cast("string"), ref_index=c("index") + 1, ref_key=c("ref_key"),
            target_release_ident=c("a.ident"), target_work_ident=c("a.work_id"), match_provenance=F.lit(provenance), match_status=F.lit(status), match_reason=F.lit(reason if status == "exact" else "unknown"),
        )
    )


def fuzzy_edge(a: str = "a", b: str = "b") -> list[Column]:
    """The edge from reference b to pivot a of a verified pair; a year counts from 1001 on."""
    c = F.col
    return biblioref(
        source_release_ident=c(f"{b}.ident"), source_work_ident=c(f"{b}.work_id"), source_release_stage=c(f"{b}.release_stage"), source_year=F.when(c(f"{b}.year") > 1000, c(f"{b}.year").cast("string")).otherwise(""), ref_index=c(f"{b}.ref_index"), ref_key=c(f"{b}.ref_key"),
        target_release_ident=c(f"{a}.ident"), target_work_ident=c(f"{a}.work_id"), match_provenance=F.lit("fuzzy"), match_status=c("status"), match_reason=c("reason"),
    )


CONFIRMED = "status IN ('exact', 'strong') AND reason <> 'doi'"


def zip_verify(releases: DataFrame, refs: DataFrame, blacklist=None, few_keys: bool = False, **options) -> DataFrame:
    """Edges from references to their key's pivot that the cascade confirms. Both sides: key, ident, doc and the columns of verify.INPUTS; features are made of the pivots only."""
    left = pivots(releases).select("key", "a.*")
    pivot = as_struct(features(left, blacklist), "a", "key")
    right = as_struct(features(refs.filter("key <> ''"), blacklist), "b", "key")
    return verify_pairs(right.join(F.broadcast(pivot) if few_keys else pivot, "key"), **options).filter(CONFIRMED).select(*fuzzy_edge())


def zip_verify_reduced(releases: DataFrame, refs: DataFrame, error: float = 0.01, seen=None, **options) -> DataFrame:
    """zip_verify, with features made only of references that pass a Bloom filter of the releases' keys. ``seen``: an Observation, which gets their number as ``n``."""
    few = semi_reduce(refs.filter("key <> ''"), releases.filter("key <> ''").select("key"), error)
    if seen is not None:
        few = few.observe(seen, F.count(F.lit(1)).alias("n"))
    return zip_verify(releases, few, **options)


#: At most so many keys can be common ones.
PARTS = 1000


def common_keys(rows: DataFrame, parts: int = PARTS) -> list[str]:
    """The keys, fewer than ``parts``, that hold more than one of so many parts of the rows each."""
    counters = saved(sketch(rows))
    return [r[0] for r in hot_keys(rows, max(1, total(counters) // parts), counters=counters).select("key").collect()]


def zip_tables(zip_, left: KeyTable, right: KeyTable, hot: list[str] | tuple = (), **options) -> DataFrame:
    """zip_exact or zip_verify over key tables of as many buckets: nothing is shuffled. Rows of ``hot`` keys, which would make a bucket too large, are read as plain files and meet their pivots, one per key, by a broadcast."""
    if not hot:
        return zip_(left.rows(), right.rows(), **options)
    is_hot = F.col("key").isin(list(hot))
    cold = zip_(left.rows().filter(~is_hot), right.rows().filter(~is_hot), **options)
    return cold.unionByName(zip_(left.files().filter(is_hot), right.files().filter(is_hot), few_keys=True, **options))


def zip_tables_groups(left: KeyTable, right: KeyTable) -> DataFrame:
    """zip_groups over key tables of as many buckets, without a shuffle."""
    docs = lambda t, n: t.rows().filter("key <> ''").groupBy("key").agg(F.sort_array(F.collect_list("doc")).alias(f"g{n}"))
    return docs(left, 0).join(docs(right, 1), "key")


def _cluster_pairs(rows: DataFrame, blacklist, **options) -> DataFrame:
    """Each reference of a key with the key's first release; rows have a boolean column ref. Keys without a release have none."""
    plain, refs = rows.filter("NOT ref").drop("ref"), rows.filter("ref").drop("ref")
    pivot = as_struct(features(pivots(plain).select("key", "a.*"), blacklist), "a", "key")
    return verify_pairs(as_struct(features(refs, blacklist), "b", "key").join(pivot, "key"), **options)


def ref_cluster(rows: DataFrame, blacklist=None, **options) -> DataFrame:
    """(key, pivot_ident, ref_ident, status, reason) for every reference in a cluster with a release."""
    return _cluster_pairs(rows, blacklist, **options).select("key", F.col("a.ident").alias("pivot_ident"), F.col("b.ident").alias("ref_ident"), "status", "reason")


def cluster_to_biblioref(rows: DataFrame, all_matches: bool = False, blacklist=None, **options) -> DataFrame:
    """Confirmed edges of clusters: of each cluster the first by the reference's (ident, doc), or all."""
    found = _cluster_pairs(rows, blacklist, **options).filter(CONFIRMED)
    if not all_matches:
        found = found.groupBy("key").agg(F.min_by(F.struct("a", "b", "status", "reason"), F.struct("b.ident", "b.doc")).alias("m")).select("key", "m.*")
    return found.select("key", *fuzzy_edge())
