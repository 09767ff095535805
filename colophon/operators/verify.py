"""Verification of pairs of releases: an ordered cascade of rules, the first of which that holds gives status and reason.

``features`` computes once per release what the rules look at; the rules then compare plain columns of the two sides, in
one CASE. Two rules score author names with nested lambdas; they come late in the cascade and only where no name agrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sets, text
from ..functions.blacklist import Blacklist
from ..sources.schemas import MARKER

#: What features() reads. Strings are never null; subtitles, related and authors are arrays of strings.
INPUTS = "ident work_id title container_id extra_container_name doi pmid arxiv jstor release_type year pages subtitles crossref_type metadata_version relations related authors".split()


def flatten(releases: DataFrame, marker: str = MARKER) -> DataFrame:
    """Decoded releases (sources.schemas.release_fields) as the flat columns of INPUTS, with stage and reference marks."""
    c = F.col
    mark = f"extra.`{marker}`"
    doi_links = F.transform(F.filter("extra.datacite.relations", lambda r: F.lower(r.relatedIdentifierType) == "doi"), lambda r: text.text_of(r.relatedIdentifier))
    return releases.select(
        "ident", "work_id", "title", "container_id", c("extra.container_name").alias("extra_container_name"), c("ext_ids.doi").alias("doi"), c("ext_ids.pmid").alias("pmid"), c("ext_ids.arxiv").alias("arxiv"), c("ext_ids.jstor").alias("jstor"), "release_type",
        text.year_of(c("release_year")).alias("year"), "pages", text.subtitles_of(c("extra.subtitle")).alias("subtitles"), c("extra.crossref.type").alias("crossref_type"), c("extra.datacite.metadataVersion").alias("metadata_version"),
        F.size("extra.datacite.relations").alias("relations"), doi_links.alias("related"), c("contribs.raw_name").alias("authors"), "release_stage", c(f"{mark}.status").alias("mark_status"), c(f"{mark}.ref.index").alias("ref_index"), c(f"{mark}.ref.key").alias("ref_key"),
    )


def features(releases: DataFrame, blacklist: Blacklist | None = None) -> DataFrame:
    """releases with the columns that the rules compare."""
    black = blacklist or Blacklist()
    names = F.array_sort(F.array_distinct(F.filter(F.transform("authors", lambda x: text.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")))
    out = releases.withColumns(
        {"title_lower": text.lower(F.col("title")), "slug": text.slugify(F.col("title")), "names": names, "sub_slugs": F.array_distinct(F.transform("subtitles", text.slugify)), "doi_prefix": text.doi_prefix(F.col("doi")), "parsed": text.parse_pages(F.col("pages"))}
    )
    out = black.mark(out).withColumns(
        {
            "slug_names": F.array_distinct(F.transform("names", text.slugify)),
            "slug_plain": F.replace("slug", F.lit(" "), F.lit("")),
            "slug_digits": text.unify_digits(F.col("slug")),
            "filename": text.looks_like_filename(F.col("title")),
            "appendix": F.col("title").rlike(r"appendix ?[^ ]*\z"),
            "versioned": F.col("doi").rlike(r"(?d)10[.].*/v[0-9]{1,}\z"),
            "figshare": F.regexp_replace("doi", r"[.]v[0-9]+\z", ""),
            "arxiv_base": F.when(F.col("arxiv").rlike(r"(?d)(.*)v[0-9]{1,2}\z"), F.regexp_extract("arxiv", r"(?d)(.*)v[0-9]{1,2}\z", 1)),
            "doi_stem": F.when(F.contains("doi", F.lit(".")), F.regexp_replace("doi", r"(?s)[.][^.]*\z", "")),
            "first_subtitle": F.coalesce(F.get("subtitles", F.lit(0)), F.lit("")),
        }
    )
    return out.withColumns(
        {
            "grams": F.transform(F.slice(F.sort_array("slug_names"), 1, 5), sets.author_grams),
            "name_tokens": F.array_distinct(F.filter(F.flatten(F.transform("slug_names", text.fields)), lambda t: F.length(t) > 2)),
        }
    )


ARTICLES = "('article', 'article-journal')"
IGNORED = "('article', 'article-journal', 'report', 'paper-conference')"
SAME_SLUG = "a.slug = b.slug"
BOTH_YEARS = "a.year > 0 AND b.year > 0"
NO_COMMON_NAME = "size(a.names) > 0 AND NOT arrays_overlap(a.slug_names, b.slug_names)"


def both(column: str, start: str) -> str:
    return f"startswith(a.{column}, '{start}') AND startswith(b.{column}, '{start}')"


def apart(years: int) -> str:
    return f"{BOTH_YEARS} AND abs(a.year - b.year) > {years}"


def pair_types(one: str) -> str:
    return f"a.release_type <> b.release_type AND ((a.release_type = '{one}' AND b.release_type IN {ARTICLES}) OR (b.release_type = '{one}' AND a.release_type IN {ARTICLES}))"


# The rules in order, (condition, status, reason). {least} is the least length of a title.
RULES: list[tuple[str, str, str]] = [
    ("a.doi <> '' AND a.doi = b.doi", "exact", "doi"),
    ("a.work_id <> '' AND a.work_id = b.work_id", "exact", "workid"),
    ("length(a.title) < {least}", "ambiguous", "shorttitle"),
    ("a.blacklisted", "ambiguous", "blacklisted"),
    ("b.blacklisted", "ambiguous", "blacklisted"),
    ("a.fragment", "ambiguous", "blacklistedfragment"),
    ("contains(a.title_lower, 'subject index') AND contains(b.title_lower, 'subject index') AND a.container_id <> '' AND a.container_id <> b.container_id", "different", "container"),
    ("a.title <> '' AND a.title = b.title AND a.metadata_version > 0 AND b.metadata_version > 0 AND a.metadata_version <> b.metadata_version", "exact", "dataciteversion"),
    (both("doi", "10.14288/") + " AND a.doi <> b.doi", "different", "customprefix1014288"),
    (both("doi", "10.3403") + " AND (concat(a.doi, 'u') = b.doi OR concat(b.doi, 'u') = a.doi)", "strong", "custombsiundated"),
    (both("doi", "10.3403") + " AND a.title <> '' AND a.title = b.title AND ((a.first_subtitle <> '' AND size(b.subtitles) = 0) OR (size(a.subtitles) = 0 AND b.first_subtitle <> ''))", "strong", "custombsisubdoc"),
    (both("doi", "10.1149") + " AND startswith(a.doi, '10.1149/ma') <> startswith(b.doi, '10.1149/ma')", "different", "customiopmapattern"),
    ("contains(a.title, 'Zweckverband Volkshochschule') AND a.title <> b.title", "different", "customvhs"),
    ("a.appendix", "ambiguous", "appendix"),
    (both("doi", "10.6084/") + " AND a.figshare = b.figshare", "strong", "figshareversion"),
    ("a.versioned AND b.versioned", "strong", "versioneddoi"),
    ("coalesce(a.doi_stem = b.doi, false) OR coalesce(b.doi_stem = a.doi, false)", "strong", "versioneddoi"),
    ("array_contains(a.related, b.doi) OR array_contains(b.related, a.doi)", "strong", "dataciterelatedid"),
    ("a.arxiv <> '' AND b.arxiv <> '' AND coalesce(a.arxiv_base = b.arxiv_base, false)", "strong", "arxivversion"),
    (f"a.release_type <> b.release_type AND a.release_type NOT IN {IGNORED} AND b.release_type NOT IN {IGNORED}", "different", "releasetype"),
    (pair_types("dataset"), "different", "releasetype"),
    (pair_types("book"), "different", "releasetype"),
    ("a.release_type = 'dataset' AND b.release_type = 'dataset' AND a.doi <> b.doi", "different", "datasetdoi"),
    ("a.release_type = 'chapter' AND b.release_type = 'chapter' AND a.extra_container_name <> '' AND a.extra_container_name <> b.extra_container_name", "different", "bookchapter"),
    ("a.crossref_type = 'component' AND a.title <> b.title", "different", "component"),
    ("a.release_type = 'component' AND b.release_type = 'component' AND a.doi <> '' AND a.doi <> b.doi", "different", "component"),
    (f"{SAME_SLUG} AND a.year <> 0 AND b.year <> 0 AND abs(a.year - b.year) > 40", "different", "year"),
    (f"{SAME_SLUG} AND ((a.doi_prefix = '10.1109' AND b.arxiv <> '') OR (b.doi_prefix = '10.1109' AND a.arxiv <> ''))", "strong", "customieeearxiv"),
    (f"{SAME_SLUG} AND " + both("doi", "10.7916/"), "ambiguous", "customprefix107916"),
    (f"{SAME_SLUG} AND size(a.sub_slugs) > 0 AND size(b.sub_slugs) > 0 AND size(array_union(a.sub_slugs, b.sub_slugs)) > 1", "different", "subtitle"),
    (f"a.title_lower = b.title_lower AND size(a.names) > 0 AND a.names = b.names AND {apart(4)}", "different", "year"),
    ("a.title_lower = b.title_lower AND size(a.names) > 0 AND a.names = b.names", "exact", "titleauthormatch"),
    ("(a.filename OR b.filename) AND a.title <> b.title", "different", "titlefilename"),
    (f"a.title <> '' AND a.title = b.title AND {apart(2)}", "different", "year"),
    ("length(a.slug) < 10 AND a.slug <> b.slug", "ambiguous", "shorttitle"),
    ("a.slug <> a.slug_digits AND a.slug <> b.slug AND a.slug_digits = b.slug_digits", "different", "numdiff"),
    (f"a.slug <> '' AND b.slug <> '' AND a.slug_plain = b.slug_plain AND arrays_overlap(a.slug_names, b.slug_names) AND {apart(4)}", "different", "year"),
    ("a.slug <> '' AND b.slug <> '' AND a.slug_plain = b.slug_plain AND arrays_overlap(a.slug_names, b.slug_names)", "strong", "slugtitleauthormatch"),
    ("a.year > 0 AND a.year = b.year AND a.title_lower = b.title_lower AND ((a.pmid <> '' AND b.doi <> '') OR (b.pmid <> '' AND a.doi <> ''))", "strong", "pmiddoipair"),
    ("a.jstor <> '' AND b.jstor <> '' AND a.jstor <> b.jstor", "different", "jstorid"),
    ("a.container_id <> '' AND a.container_id = b.container_id AND a.doi <> b.doi AND a.doi_prefix <> '10.1126' AND a.doi_prefix = b.doi_prefix", "different", "shareddoiprefix"),
    (NO_COMMON_NAME + " AND CASE WHEN least(size(a.slug_names), size(b.slug_names)) < 3 THEN {score} > 0.9 ELSE {score} > 0.5 END", "strong", "tokenizedauthors"),
    (NO_COMMON_NAME + " AND size(a.name_tokens) > 0 AND size(b.name_tokens) > 0 AND size(array_intersect(a.name_tokens, b.name_tokens)) / size(array_union(a.name_tokens, b.name_tokens)) > 0.35D", "strong", "jaccardauthors"),
    (NO_COMMON_NAME, "different", "contribintersectionempty"),
    ("a.doi_prefix = '10.5860' OR b.doi_prefix = '10.5860'", "ambiguous", "customprefix105860choicereview"),
    ("{pages} AND abs(a.parsed.count - b.parsed.count) > 5", "different", "pagecount"),
    ("a.names = b.names AND a.container_id = b.container_id AND a.year = b.year AND a.title <> b.title AND (contains(a.title, b.title) OR contains(b.title, a.title))", "strong", "titleartifact"),
]
DEFAULT = ("ambiguous", "unknown")
_OVERLAP = "size(array_intersect(x, y)) / size(array_union(x, y))"
SCORE = f"CASE WHEN size(a.grams) = 0 OR size(b.grams) = 0 THEN 0.0D ELSE aggregate(transform(a.grams, x -> array_max(transform(b.grams, y -> CASE WHEN size(x) = 0 AND size(y) = 0 THEN 1.0D ELSE {_OVERLAP} END))), 0.0D, (s, v) -> s + v) / size(a.grams) END"


def verdict(min_title_length: int = 5, strict_pages: bool = True) -> Column:
    """struct(status, reason) of the columns a and b (structs of features): a is the pivot, and some rules look at it alone.

    Page counts are compared only where both page strings do not parse; ``strict_pages=False`` compares them where both do.
    """
    pages = "a.parsed.err AND b.parsed.err" if strict_pages else "NOT a.parsed.err AND NOT b.parsed.err"
    value = lambda status, reason: f"named_struct('status', '{status}', 'reason', '{reason}')"
    # one expression: made column by column, the cascade takes longer to write down than to run on a small table
    cases = "\n".join(f"WHEN {condition} THEN {value(status, reason)}" for condition, status, reason in RULES)
    for name, term in (("least", str(min_title_length)), ("score", f"({SCORE})"), ("pages", pages)):
        cases = cases.replace(f"{{{name}}}", term)
    return F.expr(f"CASE {cases} ELSE {value(*DEFAULT)} END")


def verify_pairs(pairs: DataFrame, **options) -> DataFrame:
    """pairs with structs a and b of features -> with status and reason."""
    out = pairs.withColumn("__v", verdict(**options))
    return out.withColumns({"status": F.col("__v.status"), "reason": F.col("__v.reason")}).drop("__v")


def as_struct(df: DataFrame, name: str, *keep: str) -> DataFrame:
    """The columns of df in one struct, beside those to keep."""
    return df.select(*keep, F.struct(*df.columns).alias(name))
