"""Conversions between references, releases, sitemap entries and edges of the citation graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fields
from ..sources.schemas import BIBLIOREF, MARKER, struct_type

#: What stands before an ident in a verifier's lines, and what its edges are said to come from.
RELEASE_URL = "https://example.org/release/"
VERIFIER = "verifier"
SITEMAP_SKIP = 41


def ref_to_release(refs: DataFrame, marker: str = MARKER) -> DataFrame:
    """References as releases: a year counts from 1001 on; stage, type, locator and the bibliographic year aren't taken over. Marked as references in the field ``marker`` of extra."""
    b = lambda name: F.col(f"biblio.{name}")
    names = F.transform(b("contrib_raw_names"), lambda x, i: F.struct(i.alias("index"), x.alias("raw_name"), F.lit("").alias("role")))
    blank = F.lit("")
    ids = F.struct(b("doi").alias("doi"), b("pmid").alias("pmid"), b("pmcid").alias("pmcid"), b("arxiv_id").alias("arxiv"), blank.alias("core"), blank.alias("wikidata_qid"), blank.alias("jstor"))
    mark = F.struct(F.lit("ref").alias("status"), F.struct(F.col("index").alias("index"), F.col("key").alias("key"), blank.alias("locator")).alias("ref"), F.struct(blank.alias("url")).alias("rg"))
    return refs.select(
        F.col("release_ident").alias("ident"), F.col("work_ident").alias("work_id"), b("title").alias("title"), b("publisher").alias("publisher"), b("container_name").alias("container_name"), b("volume").alias("volume"), b("issue").alias("issue"), b("pages").alias("pages"),
        F.when(F.col("release_year") > 1000, F.col("release_year").cast("string")).otherwise("").alias("release_year"), ids.alias("ext_ids"), names.alias("contribs"), F.struct(mark.alias(marker)).alias("extra"),
    )


def sitemap_to_release(entries: DataFrame, marker: str = MARKER) -> DataFrame:
    """(title, url) as releases; the ident is what follows the fixed start of the url, up to an underscore."""
    url = F.col("url")
    ident = F.when(F.octet_length(url) > SITEMAP_SKIP, F.substring_index(F.substr(url, F.lit(SITEMAP_SKIP + 1)), "_", 1)).otherwise("")
    return entries.select(ident.alias("ident"), "title", F.struct(F.struct(F.lit("rg").alias("status"), F.struct(url.alias("url")).alias("rg")).alias(marker)).alias("extra"))


def biblioref(**values: Column) -> list[Column]:
    """The columns of an edge; those not given are empty or 0."""
    return [values.get(f.name, F.lit("" if f.dataType.typeName() == "string" else 0)).cast(f.dataType).alias(f.name) for f in struct_type(BIBLIOREF).fields]


def biblioref_from_pairs(lines: DataFrame, url: str = RELEASE_URL, verifier: str = VERIFIER) -> DataFrame:
    """Edges from lines "key target source" (a join's output) or "target source Status.X Reason.Y" (a verifier's); others, and edges of a record with itself, go."""
    f = fields(F.col("value"))
    n, at = F.size(f), lambda i: F.coalesce(F.get(f, F.lit(i)), F.lit(""))
    ident = lambda i: F.replace(at(i), F.lit(url), F.lit(""))
    of = lambda three, four: F.when(n == 3, three).when(n == 4, four).otherwise("")
    rows = lines.select(
        of(at(2), ident(1)).alias("source"), of(at(1), ident(0)).alias("target"), of(F.lit("join"), F.lit(verifier)).alias("provenance"),
        of(F.lit(""), F.replace(at(2), F.lit("Status."), F.lit(""))).alias("status"), of(F.lit(""), F.replace(at(3), F.lit("Reason."), F.lit(""))).alias("reason"),
    ).filter("source <> target")
    c = F.col
    return rows.select(*biblioref(source_release_ident=c("source"), target_release_ident=c("target"), match_provenance=c("provenance"), match_status=c("status"), match_reason=c("reason"), update_ts=F.unix_timestamp()))


def enrich(edges: DataFrame, releases: DataFrame) -> DataFrame:
    """Edges with stage, work and year of their source, and the work of their target, from releases (ident, work_id, release_stage, year); idents there are unique. Spark broadcasts the releases if they are small."""
    source = releases.select(F.col("ident").alias("source_release_ident"), F.col("work_id").alias("__w"), F.col("release_stage").alias("__s"), F.col("year").cast("string").alias("__y"))
    target = releases.select(F.col("ident").alias("target_release_ident"), F.col("work_id").alias("__t"))
    out = edges.join(source, "source_release_ident", "left").join(target, "target_release_ident", "left")
    new = {"source_work_ident": "__w", "source_release_stage": "__s", "source_year": "__y", "target_work_ident": "__t"}
    return out.withColumns({k: F.coalesce(v, k) for k, v in new.items()}).select(*edges.columns)


def assign_ids(edges: DataFrame) -> DataFrame:
    """Edges with _id (source ident and index) and the present time."""
    return edges.withColumns({"_id": F.concat_ws("_", "source_release_ident", F.col("ref_index").cast("string")), "update_ts": F.unix_timestamp()})
