"""Pairs of releases, one or more for each rule of the cascade: what differs from DEFAULTS on either side, and the verdict."""

from __future__ import annotations

DEFAULTS = {
    "ident": "x", "work_id": "", "title": "a study of the northern lakes", "container_id": "", "extra_container_name": "", "doi": "", "pmid": "", "arxiv": "", "jstor": "", "release_type": "", "year": 0,
    "pages": "", "subtitles": [], "crossref_type": "", "metadata_version": 0, "relations": 0, "related": [], "authors": [],
}


def t(**x):
    return x


LONG = "another survey of the southern rivers"
NAMES = {"authors": ["Ann Lee", "Bo Chan"]}

SCENARIOS: dict[str, list[tuple[dict, dict, str, str]]] = {
    "ids": [
        (t(doi="10.1/a"), t(doi="10.1/a"), "exact", "doi"),
        (t(work_id="w1"), t(work_id="w1"), "exact", "workid"),
        (t(title="abc"), t(), "ambiguous", "shorttitle"),
        (t(title="Editorial"), t(), "ambiguous", "blacklisted"),
        (t(), t(title="Book Reviews"), "ambiguous", "blacklisted"),
        (t(), t(title=""), "ambiguous", "blacklisted"),
        (t(title="The Annual General Meeting of 1901"), t(), "ambiguous", "blacklistedfragment"),
        (t(title="Subject Index 1", container_id="c1"), t(title="subject index 2", container_id="c2"), "different", "container"),
        (t(metadata_version=1), t(metadata_version=2), "exact", "dataciteversion"),
        (t(doi="10.14288/1"), t(doi="10.14288/2"), "different", "customprefix1014288"),
        (t(doi="10.3403/00"), t(doi="10.3403/00u"), "strong", "custombsiundated"),
        (t(doi="10.3403/01", subtitles=["part one"]), t(doi="10.3403/02"), "strong", "custombsisubdoc"),
        (t(doi="10.1149/ma2010"), t(doi="10.1149/1.2"), "different", "customiopmapattern"),
        (t(title="Der Zweckverband Volkshochschule heute"), t(title=LONG), "different", "customvhs"),
        (t(title="the second appendix b"), t(title=LONG), "ambiguous", "appendix"),
        (t(doi="10.6084/m9.figshare.12.v1"), t(doi="10.6084/m9.figshare.12.v2"), "strong", "figshareversion"),
        (t(doi="10.17504/abc/v1"), t(doi="10.17504/xyz/v22"), "strong", "versioneddoi"),
        (t(doi="10.55/abc.def"), t(doi="10.55/abc"), "strong", "versioneddoi"),
        (t(relations=1, related=["10.9/q"]), t(doi="10.9/q"), "strong", "dataciterelatedid"),
        (t(doi="10.9/r"), t(relations=2, related=["10.9/s", "10.9/r"]), "strong", "dataciterelatedid"),
        (t(arxiv="2001.00001v1"), t(arxiv="2001.00001v3"), "strong", "arxivversion"),
    ],
    "types": [
        (t(release_type="book"), t(release_type="chapter"), "different", "releasetype"),
        (t(release_type="book"), t(), "different", "releasetype"),
        (t(release_type="dataset"), t(release_type="article"), "different", "releasetype"),
        (t(release_type="article-journal"), t(release_type="book"), "different", "releasetype"),
        (t(release_type="dataset", doi="10.1/a"), t(release_type="dataset", doi="10.1/b"), "different", "datasetdoi"),
        (t(release_type="chapter", extra_container_name="one"), t(release_type="chapter", extra_container_name="two"), "different", "bookchapter"),
        (t(crossref_type="component"), t(title=LONG), "different", "component"),
        (t(release_type="component", doi="10.1/a"), t(release_type="component", doi="10.1/b"), "different", "component"),
        (t(release_type="report", **NAMES), t(release_type="dataset", **NAMES), "exact", "titleauthormatch"),
    ],
    "titles": [
        (t(year=1900), t(year=1950), "different", "year"),
        (t(doi="10.1109/z"), t(arxiv="1901.1"), "strong", "customieeearxiv"),
        (t(doi="10.7916/a"), t(doi="10.7916/b"), "ambiguous", "customprefix107916"),
        (t(subtitles=["first part"]), t(subtitles=["First part!", "second"]), "different", "subtitle"),
        (t(year=2000, **NAMES), t(year=2006, **NAMES), "different", "year"),
        (t(year=2000, **NAMES), t(year=2003, **NAMES), "exact", "titleauthormatch"),
        (t(title="scan0001.pdf"), t(title=LONG), "different", "titlefilename"),
        (t(year=2000), t(year=2003), "different", "year"),
        (t(title="lakes ü"), t(title=LONG), "ambiguous", "shorttitle"),
        (t(title="proceedings volume 12"), t(title="proceedings volume 13"), "different", "numdiff"),
        (t(title="A study-of the northern lakes", year=1990, authors=["Ann Lee"]), t(title="a study of the northern lakes", year=1999, **NAMES), "different", "year"),
        (t(title="A study of the north ern lakes", year=1990, authors=["Ann Lee"]), t(year=1999, **NAMES), "different", "year"),
        (t(title="A study of the north ern lakes", year=1998, authors=["Ann Lee"]), t(year=1999, **NAMES), "strong", "slugtitleauthormatch"),
        (t(pmid="5", year=2001), t(doi="10.2/b", year=2001), "strong", "pmiddoipair"),
    ],
    "authors": [
        (t(jstor="1"), t(jstor="2"), "different", "jstorid"),
        (t(container_id="c", doi="10.2/a"), t(container_id="c", doi="10.2/b"), "different", "shareddoiprefix"),
        (t(authors=["Ann Lee"]), t(authors=["Ann Le e"]), "strong", "tokenizedauthors"),
        (t(authors=["Anna Lena"]), t(authors=["An Na Lena"]), "strong", "tokenizedauthors"),
        (t(authors=["Ann Lee", "Bo Chan", "Cy Dunn"]), t(authors=["Ann Leee", "Bo Chann", "Cy Dunnn", "Ed Foy"]), "strong", "tokenizedauthors"),
        (t(authors=["Mara Ivanova"]), t(authors=["Ivanova Mara Q", "Zed"]), "strong", "jaccardauthors"),
        (t(authors=["Ann Lee"]), t(), "different", "contribintersectionempty"),
        (t(doi="10.5860/choice.1"), t(), "ambiguous", "customprefix105860choicereview"),
        (t(pages="500-100"), t(pages="xii"), "different", "pagecount"),
        (t(pages="1-3"), t(pages="1-30"), "ambiguous", "unknown"),
        (t(title="a study of the northern lakes, part one"), t(), "strong", "titleartifact"),
        (t(), t(), "ambiguous", "unknown"),
    ],
}


def literal(value) -> str:
    """In SQL that Spark and DuckDB both read, but for ARRAY(...)."""
    if isinstance(value, list):
        return "ARRAY(" + ", ".join(map(literal, value)) + ")" if value else "EMPTY"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def side(group: str, which: int) -> str:
    """The select list of one side: a CASE by the part's number for each field."""
    rows = SCENARIOS[group]
    out = []
    for name, default in DEFAULTS.items():
        given = [(i, r[which][name]) for i, r in enumerate(rows) if name in r[which]]
        cases = " ".join(f"WHEN {i} THEN {literal(v)}" for i, v in given)
        out.append((f"CASE p_partkey % {len(rows)} {cases} ELSE {literal(default)} END" if given else literal(default)) + f" AS {name}")
    return ", ".join(out)
