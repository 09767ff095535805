"""Lines, tab-separated and JSON files: reading and writing. Compression follows the file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from .schemas import decode, encode


# --- Fixed values: the names of reasons in text output -----------------------------------------------------------------
REASONS = """
Unknown Appendix Arxiv ArxivVersion Blacklisted BlacklistedFragment BookChapter ChemFormula Component Container
ContainerNameBlacklist ContribIntersectionEmpty CustomBSISubdoc CustomBSIUndated CustomIEEEArxiv CustomIOPMAPattern
CustomPrefix1014288 CustomPrefix105860ChoiceReview CustomPrefix107916 CustomVHS DOI DataciteRelatedID DataciteVersion DatasetDOI
FigshareVersion JaccardAuthors JstorID MaxClusterSizeExceeded NumDiff PMCID PMID PMIDDOIPair PageCount PreprintPublished
PublisherBlacklist ReleaseType SharedDOIPrefix ShortTitle SingularCluster SlugTitleAuthorMatch Subtitle TitleArtifact
TitleAuthorMatch TitleFilename TokenizedAuthors VersionedDOI WorkID Year
""".split()


def reason_name(reason: Column) -> Column:
    """A reason as text output names it (doi: ReasonDOI); one that isn't known stays as it is."""
    names = F.create_map(*[F.lit(x) for r in REASONS for x in (r.lower(), r)])
    return F.concat(F.lit("Reason"), F.coalesce(names[F.lower(reason)], reason))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines that aren't blank."""
    return spark.read.text(path).filter(F.length(text.trim(F.col("value"))) > 0)


def read_json(spark: SparkSession, path: str, fields: str, best_effort: bool = True) -> DataFrame:
    return decode(read_lines(spark, path), fields, best_effort=best_effort)


def read_tsv(spark: SparkSession, path: str, names: list[str], separator: str = "\t") -> DataFrame:
    """Columns of trimmed lines by place; what isn't there is empty."""
    lines = spark.read.text(path).filter(F.length(text.trim(F.col("value"))) > 0)
    return lines.select(*[text.line_column(F.col("value"), separator, i + 1).alias(n) for i, n in enumerate(names)])


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """(pivot_ident, ref_ident, status, reason): what write_matches wrote, statuses and reasons in lower case and without what stands before them."""
    bare = lambda c, head: F.lower(F.regexp_replace(c, f"^{head}", "")).alias(head.lower())
    return read_tsv(spark, path, ["pivot_ident", "ref_ident", "status", "reason"], " ").select("pivot_ident", "ref_ident", bare("status", "Status"), bare("reason", "Reason"))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(key, docs): what write_clusters wrote; documents as JSON."""
    kind = "k string, v array<variant>"
    got = spark.read.text(path).select(F.from_json("value", kind).alias("c"))
    return got.select(F.col("c.k").alias("key"), F.transform("c.v", lambda d: F.to_json(d)).alias("docs"))


def write_stats(stats: DataFrame, path: str) -> None:
    """Lines of total, refs, nonrefs, key, or of n and key, whichever stats has."""
    write_tsv(stats, path, *[c for c in ("total", "refs", "nonrefs", "n") if c in stats.columns], "key")


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """(ident, key, doc): what write_keyed wrote."""
    return read_tsv(spark, path, ["ident", "key", "doc"])


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.text(path)


def write_tsv(rows: DataFrame, path: str, *columns: str) -> None:
    clean = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\n]", "") for c in columns]
    rows.select(F.concat_ws("\t", *clean).alias("value")).write.text(path)


def write_keyed(rows: DataFrame, path: str) -> None:
    """Lines of ident, key, doc; tabs and newlines in them are deleted."""
    write_tsv(rows, path, "ident", "key", "doc")


def write_json(rows: DataFrame, path: str, *columns: str) -> None:
    encode(rows, *columns).write.text(path)


def write_clusters(clusters: DataFrame, path: str) -> None:
    """{"k": key, "v": [documents]} per line; the documents are JSON and stay as they are."""
    value = F.concat(F.lit('{"k": '), F.expr("substr(to_json(named_struct('k', key)), 6, length(to_json(named_struct('k', key))) - 6)"), F.lit(', "v": ['), F.array_join("docs", ","), F.lit("]}"))
    clusters.select(value.alias("value")).write.text(path)


def write_matches(matches: DataFrame, path: str) -> None:
    """"pivot ref Status Reason" per line, separated by spaces."""
    matches.select(F.concat_ws(" ", "pivot_ident", "ref_ident", F.concat(F.lit("Status"), F.initcap("status")), reason_name(F.col("reason"))).alias("value")).write.text(path)
