"""Schemas of the records, and decoding of JSON lines with empty values in place of nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType, VariantType, _parse_datatype_string

# --- Fixed values: the records' fields ------------------------------------------------------------------------------
REF = "biblio struct<arxiv_id string, container_name string, contrib_raw_names array<string>, doi string, issue string, pmcid string, pmid string, pages string, publisher string, title string, unstructured string, url string, volume string, year bigint>, index bigint, key string, ref_source string, release_year int, release_ident string, release_stage string, work_ident string"
RELEASE = "container_id string, container_name string, contribs array<struct<index int, raw_name string, role string>>, ext_ids struct<doi string, pmid string, pmcid string, arxiv string, core string, wikidata_qid string, jstor string>, ident string, publisher string, refs array<struct<container_name string, extra struct<doi string, authors array<string>, key string, year string, locator string, volume string>, index bigint, key string, locator string, year bigint>>, release_date string, release_year variant, release_stage string, release_type string, issue string, volume string, pages string, title string, work_id string, extra struct<container_name string, subtitle variant, crossref struct<type string>, datacite struct<metadataVersion int, relations array<struct<relatedIdentifierType string, relatedIdentifier variant>>>, mark struct<status string, ref struct<index bigint, key string, locator string>, rg struct<url string>>>"
#: The field of a release's extra that says where it comes from; releases of other sources may name it differently.
MARKER = "mark"
SITEMAP = "lastmod string, title string, url string"
BIBLIOREF = "_id string, update_ts bigint, source_release_ident string, source_work_ident string, source_wikipedia_article string, source_release_stage string, source_year string, ref_index bigint, ref_key string, ref_locator string, target_release_ident string, target_work_ident string, target_openlibrary_work string, target_url_surt string, target_url string, match_provenance string, match_status string, match_reason string, target_unstructured string, target_csl string"


def release_fields(marker: str = MARKER) -> str:
    """RELEASE, with its marker under another name."""
    return RELEASE.replace(f", {MARKER} struct<status", f", `{marker}` struct<status")


def struct_type(fields: str) -> StructType:
    return _parse_datatype_string(fields)


def filled(x: Column, kind: DataType) -> Column:
    """x with empty values for nulls at every depth; variants stay null."""
    if isinstance(kind, StructType):
        return F.struct(*[filled(x[f.name], f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, ArrayType):
        deep = isinstance(kind.elementType, (StructType, StringType))
        inner = F.transform(x, lambda e: filled(e, kind.elementType)) if deep else x
        return F.coalesce(inner, F.array().cast(kind))
    if isinstance(kind, VariantType):
        return x
    return F.coalesce(x, F.lit("" if isinstance(kind, StringType) else 0).cast(kind))


def decode(lines: DataFrame, fields: str, column: str = "value", best_effort: bool = True) -> DataFrame:
    """JSON lines -> the fields, filled, with the line as ``doc``. Lines that don't parse go, or fail the job."""
    kind = struct_type(fields)
    probe = StructType([*kind.fields]).add("__bad", "string")
    got = F.from_json(F.col(column), probe, {"mode": "PERMISSIVE" if best_effort else "FAILFAST", "columnNameOfCorruptRecord": "__bad"})
    # behind a generator of one row, as else the filter would take the parsing along and each line be parsed twice
    rows = lines.select(F.col(column).alias("doc"), F.explode(F.array(got)).alias("r")).filter("r.__bad IS NULL AND r IS NOT NULL")
    return rows.select(*[filled(F.col("r")[f.name], f.dataType).alias(f.name) for f in kind.fields], "doc")


def bare(x: Column, kind: DataType) -> Column:
    """x without its empty strings, zeros and empty arrays, at every depth. Structs stay, empty or not."""
    if isinstance(kind, StructType):
        fields = [bare(x[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(x.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        inner = F.transform(x, lambda e: bare(e, kind.elementType)) if isinstance(kind.elementType, StructType) else x
        return F.when(F.size(x) > 0, inner)
    if isinstance(kind, StringType):
        return F.nullif(x, F.lit(""))
    if kind.typeName() in ("integer", "long"):
        return F.nullif(x, F.lit(0).cast(kind))
    return x


def encode(rows: DataFrame, *columns: str) -> DataFrame:
    """One column ``value``: a JSON object per row, without empty strings, zeros and empty arrays at any depth."""
    kept = [f for f in rows.schema.fields if not columns or f.name in columns]
    return rows.select(F.to_json(F.struct(*[bare(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in kept])).alias("value"))
