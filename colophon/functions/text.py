"""Text functions as Column expressions. Strings that are null must have been made empty before (see sources.schemas)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that is trimmed (Unicode's White_Space).
WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
DOI = r"10[.][0-9]{1,8}/[^ ]*[\w]"
DOI_NO_HYPHEN = r"10[.][0-9]{1,8}/[^ -]*[\w]"
ARXIV_PDF = r"http://arxiv.org/pdf/([0-9]{4,4}[.][0-9]{1,8})(v[0-9]{1,2})?(.pdf)?"
ARXIV_ABS = r"http://arxiv.org/abs/([0-9]{4,4}[.][0-9]{1,8})(v[0-9]{1,2})?(.pdf)?"


def trim(x: Column) -> Column:
    return F.regexp_replace(x, f"^{WS}+|{WS}+\\z", "")


def lower(x: Column) -> Column:
    """Letter by letter: no special form of a final sigma, no added dot."""
    return F.lower(F.translate(x, "Σİ", "σi"))


def slugify(x: Column) -> Column:
    """Lower case; letters a to z, digits and single spaces only."""
    return F.btrim(F.regexp_replace(F.regexp_replace(lower(x), r"[^a-z0-9 \t\n]", ""), r"[ \t\n]+", " "))


def fields(x: Column) -> Column:
    """The parts between white space."""
    bare = trim(x)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{WS}+"))


def tokens(x: Column) -> Column:
    return fields(lower(x))


def token_ngrams(x: Column, n: int = 2) -> Column:
    """Each token in pieces of n characters, which don't overlap: "anne k" -> an, ne, k."""
    return F.flatten(F.transform(tokens(x), lambda t: F.regexp_extract_all(t, F.lit(f"(?s).{{1,{n}}}"), F.lit(0))))


def doi_prefix(x: Column) -> Column:
    return F.substring_index(x, "/", 1)


def unify_digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[0-9]+", "<NUM>")


def looks_like_filename(x: Column) -> Column:
    return (F.size(fields(x)) <= 1) & x.rlike(r"(?d).*[.][a-z]{2,3}\z")


def looks_like_component(a: Column, b: Column) -> Column:
    """Whether one is the other without its last part after a dot."""
    shorter = lambda x, y: F.contains(x, F.lit(".")) & (F.regexp_replace(x, r"(?s)[.][^.]*\z", "") == y)
    return shorter(a, b) | shorter(b, a)


def parse_pages(x: Column) -> Column:
    """struct(start, end, err, count): the first "digits-digits"; an end of one digit takes the start's other digits if it is greater than its last.

    err: no such part, a number too large, or start > end. Values that don't parse count as 0; a number too large is the largest.
    """
    most = F.lit(9223372036854775807).cast("decimal(38,0)")
    number = lambda s: F.least(F.coalesce(F.when(F.length(s) <= 38, s.try_cast("decimal(38,0)")), most), most)
    start, end = F.regexp_extract(trim(x), r"([0-9]+)-([0-9]+)", 1), F.regexp_extract(trim(x), r"([0-9]+)-([0-9]+)", 2)
    found = start != ""
    end = F.when((F.length(end) == 1) & (F.length(start) > 1) & (F.right(start, F.lit(1)) < end), F.concat(F.substr(start, F.lit(1), F.length(start) - 1), end)).otherwise(end)
    bare = lambda s: F.regexp_replace(s, "^0+", "")
    big = lambda s: (F.length(bare(s)) > 19) | (number(s) == most) & (bare(s) != "9223372036854775807")
    s = F.when(found, number(start)).otherwise(F.lit(0).cast("decimal(38,0)"))
    e = F.when(found & ~big(start), number(end)).otherwise(F.lit(0).cast("decimal(38,0)"))
    err = ~found | big(start) | big(end) | (s > e)
    return F.struct(s.alias("start"), e.alias("end"), err.alias("err"), (e - s + 1).alias("count"))


def line_column(x: Column, sep: str, n: int) -> Column:
    """The n-th (from 1) part of the trimmed line; empty if there is none."""
    return F.coalesce(F.get(F.split(trim(x), F.lit("\\Q" + sep + "\\E")), F.lit(n - 1)), F.lit(""))


def year_of(x: Column) -> Column:
    """The year of a variant: a number without its fraction, a string of digits (with a sign at most); else 0."""
    kind = F.schema_of_variant(x)
    text = F.try_variant_get(x, "$", "string")
    number = F.try_variant_get(x, "$", "double").try_cast("int")
    return F.when(x.isNull(), 0).when(kind == "STRING", F.coalesce(F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("int")), F.lit(0))).otherwise(F.coalesce(F.when(~kind.startswith("BOOLEAN"), number), F.lit(0)))


def subtitles_of(x: Column) -> Column:
    """The subtitles of a variant: an array of strings, or one string."""
    none = F.array().cast("array<string>")
    kind = F.schema_of_variant(x)
    return F.when(x.isNull(), none).when(kind.startswith("ARRAY"), F.coalesce(F.try_variant_get(x, "$", "array<string>"), none)).when(kind == "STRING", F.array(F.try_variant_get(x, "$", "string"))).otherwise(none)


def text_of(x: Column) -> Column:
    """A variant as text: a string as it is, other values as they print; null is empty."""
    return F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x), F.lit(""))


def to_doi(x: Column) -> Column:
    """The first DOI in the text; empty if there is none."""
    return F.regexp_extract(x, DOI, 0)
