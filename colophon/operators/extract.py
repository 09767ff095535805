"""Identifiers from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def to_doi(rows: DataFrame, column: str, skip: bool = False) -> DataFrame:
    """rows with the column replaced by the first DOI in it (empty if none); rows without one go if ``skip``."""
    out = rows.withColumn(column, text.to_doi(F.col(column)))
    return out.filter(F.col(column) != "") if skip else out


def doi_in_line(lines: DataFrame, separator: str = "\t", field: int = 1, skip: bool = False, best_effort: bool = False) -> DataFrame:
    """Lines with the field replaced by its first DOI; lines with too few fields go, or fail the job."""
    parts = F.split("value", F.lit("\\Q" + separator + "\\E"))
    few = F.size(parts) < field
    ok = lines.filter(~few) if best_effort else lines.filter(F.when(few, F.raise_error(F.lit(f"a line has fewer than {field} fields")).cast("boolean")).otherwise(True))
    doi = text.to_doi(F.get(parts, F.lit(field - 1)))
    if skip:
        ok = ok.filter(doi != "")
    return ok.select(F.array_join(F.transform(parts, lambda x, i: F.when(i == field - 1, doi).otherwise(x)), separator).alias("value"))


def from_unstructured(refs: DataFrame) -> DataFrame:
    """References with a missing doi or arxiv_id found in the key or the unstructured text: first a key with -bib, then a DOI in the text, then one without hyphens in the key."""
    b = lambda name: F.col(f"biblio.{name}")
    found = lambda x, pattern, group=0: F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))
    key = text.lower(F.col("key"))
    bib = F.when(F.contains(key, F.lit("-bib")), F.nullif(F.substring_index(key, "-bib", 1), F.lit("")))
    first = lambda own, *more: F.coalesce(F.nullif(own, F.lit("")), *more, F.lit(""))
    doi: Column = first(b("doi"), bib, found(b("unstructured"), text.DOI), found(F.col("key"), text.DOI_NO_HYPHEN))
    arxiv = first(b("arxiv_id"), found(b("unstructured"), text.ARXIV_PDF, 1), found(b("unstructured"), text.ARXIV_ABS, 1))
    return refs.withColumn("biblio", F.col("biblio").withField("doi", doi).withField("arxiv_id", arxiv))
