"""The cascade and what it looks at, in DuckDB's SQL, written apart from the operators so the two can be held together."""

from __future__ import annotations

from ..functions.blacklist import FRAGMENTS, TITLES

quote = lambda s: "'" + s.replace("'", "''") + "'"


def slug(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9 \\t\\n]', '', 'g'), '[ \\t\\n]+', ' ', 'g'))"


def features(source: str) -> str:
    """A query over a relation with the fields of a release, adding what the rules look at."""
    pages = lambda g: f"regexp_extract(trim(pages), '([0-9]+)-([0-9]+)', {g})"
    return f"""
    SELECT *, list_sort(list_distinct(list_transform(names, lambda x: {slug("x")}))) AS slug_names,
      CASE WHEN p1 = '' THEN 0 ELSE CAST(p1 AS HUGEINT) END AS p_start,
      CASE WHEN p1 = '' THEN 0 WHEN length(p2) = 1 AND length(p1) > 1 AND right(p1, 1) < p2 THEN CAST(left(p1, length(p1) - 1) || p2 AS HUGEINT) ELSE CAST(p2 AS HUGEINT) END AS p_end
    FROM (SELECT *, lower(title) AS tl, {slug("title")} AS slug,
        list_sort(list_distinct(list_filter(list_transform(authors, lambda x: trim(x)), lambda x: x <> ''))) AS names,
        list_sort(list_distinct(list_transform(subtitles, lambda x: {slug("x")}))) AS subs,
        split_part(doi, '/', 1) AS prefix, {pages(1)} AS p1, {pages(2)} AS p2 FROM ({source}))"""


def final(source: str) -> str:
    grams = "list_distinct(flatten(list_transform(list_filter(string_split(n, ' '), lambda t: t <> ''), lambda t: regexp_extract_all(t, '.{1,2}'))))"
    return f"""
    SELECT *, (p1 = '' OR p_start > p_end) AS p_err, p_end - p_start + 1 AS p_count,
      list_transform(slug_names[1:5], lambda n: {grams}) AS grams,
      list_distinct(list_filter(flatten(list_transform(slug_names, lambda n: string_split(n, ' '))), lambda t: length(t) > 2)) AS toks
    FROM ({features(source)})"""


def verdict() -> str:
    """A CASE over aliases a and b whose value is 'status/reason'."""
    both = lambda p: f"starts_with(a.doi, '{p}') AND starts_with(b.doi, '{p}')"
    apart = lambda n: f"a.year > 0 AND b.year > 0 AND abs(a.year - b.year) > {n}"
    black = lambda x: f"{x} IN ({', '.join(map(quote, sorted(TITLES)))})"
    easy = "('article', 'article-journal', 'report', 'paper-conference')"
    art = "('article', 'article-journal')"
    mixed = lambda k: f"a.release_type <> b.release_type AND '{k}' IN (a.release_type, b.release_type) AND (a.release_type IN {art} OR b.release_type IN {art})"
    same = "a.slug = b.slug"
    plain = "a.slug <> '' AND b.slug <> '' AND replace(a.slug, ' ', '') = replace(b.slug, ' ', '') AND list_has_any(a.slug_names, b.slug_names)"
    apart_names = "len(a.names) > 0 AND NOT list_has_any(a.slug_names, b.slug_names)"
    jac = "CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END"
    score = f"(CASE WHEN len(a.grams) = 0 OR len(b.grams) = 0 THEN 0.0 ELSE list_sum(list_transform(a.grams, lambda x: list_max(list_transform(b.grams, lambda y: {jac})))) / len(a.grams) END)"
    titles = "a.tl = b.tl AND len(a.names) > 0 AND a.names = b.names"
    rules = [
        ("a.doi <> '' AND a.doi = b.doi", "exact/doi"), ("a.work_id <> '' AND a.work_id = b.work_id", "exact/workid"), ("length(a.title) < 5", "ambiguous/shorttitle"),
        (black("a.tl"), "ambiguous/blacklisted"), (black("b.tl"), "ambiguous/blacklisted"), (" OR ".join(f"contains(a.tl, {quote(f)})" for f in FRAGMENTS), "ambiguous/blacklistedfragment"),
        ("contains(a.tl, 'subject index') AND contains(b.tl, 'subject index') AND a.container_id <> '' AND a.container_id <> b.container_id", "different/container"),
        ("a.title <> '' AND a.title = b.title AND a.metadata_version > 0 AND b.metadata_version > 0 AND a.metadata_version <> b.metadata_version", "exact/dataciteversion"),
        (both("10.14288/") + " AND a.doi <> b.doi", "different/customprefix1014288"), (both("10.3403") + " AND (a.doi || 'u' = b.doi OR b.doi || 'u' = a.doi)", "strong/custombsiundated"),
        (both("10.3403") + " AND a.title <> '' AND a.title = b.title AND ((len(b.subtitles) = 0 AND coalesce(a.subtitles[1], '') <> '') OR (len(a.subtitles) = 0 AND coalesce(b.subtitles[1], '') <> ''))", "strong/custombsisubdoc"),
        (both("10.1149") + " AND starts_with(a.doi, '10.1149/ma') <> starts_with(b.doi, '10.1149/ma')", "different/customiopmapattern"),
        ("contains(a.title, 'Zweckverband Volkshochschule') AND a.title <> b.title", "different/customvhs"), ("regexp_matches(a.title, 'appendix ?[^ ]*$')", "ambiguous/appendix"),
        (both("10.6084/") + " AND regexp_replace(a.doi, '[.]v[0-9]+$', '') = regexp_replace(b.doi, '[.]v[0-9]+$', '')", "strong/figshareversion"),
        ("regexp_matches(a.doi, '10[.].*/v[0-9]{1,}$') AND regexp_matches(b.doi, '10[.].*/v[0-9]{1,}$')", "strong/versioneddoi"),
        ("(contains(a.doi, '.') AND regexp_replace(a.doi, '[.][^.]*$', '') = b.doi) OR (contains(b.doi, '.') AND regexp_replace(b.doi, '[.][^.]*$', '') = a.doi)", "strong/versioneddoi"),
        ("list_contains(a.related, b.doi) OR list_contains(b.related, a.doi)", "strong/dataciterelatedid"),
        ("regexp_matches(a.arxiv, 'v[0-9]{1,2}$') AND regexp_matches(b.arxiv, 'v[0-9]{1,2}$') AND regexp_extract(a.arxiv, '(.*)v[0-9]{1,2}$', 1) = regexp_extract(b.arxiv, '(.*)v[0-9]{1,2}$', 1)", "strong/arxivversion"),
        (f"a.release_type <> b.release_type AND a.release_type NOT IN {easy} AND b.release_type NOT IN {easy}", "different/releasetype"), (mixed("dataset"), "different/releasetype"), (mixed("book"), "different/releasetype"),
        ("a.release_type = 'dataset' AND b.release_type = 'dataset' AND a.doi <> b.doi", "different/datasetdoi"),
        ("a.release_type = 'chapter' AND b.release_type = 'chapter' AND a.extra_container_name NOT IN ('', b.extra_container_name)", "different/bookchapter"),
        ("a.crossref_type = 'component' AND a.title <> b.title", "different/component"), ("a.release_type = 'component' AND b.release_type = 'component' AND a.doi NOT IN ('', b.doi)", "different/component"),
        (f"{same} AND a.year <> 0 AND b.year <> 0 AND abs(a.year - b.year) > 40", "different/year"), (f"{same} AND ((a.prefix = '10.1109' AND b.arxiv <> '') OR (b.prefix = '10.1109' AND a.arxiv <> ''))", "strong/customieeearxiv"),
        (f"{same} AND {both('10.7916/')}", "ambiguous/customprefix107916"), (f"{same} AND len(a.subs) > 0 AND len(b.subs) > 0 AND (len(a.subs) > 1 OR len(b.subs) > 1 OR a.subs <> b.subs)", "different/subtitle"),
        (f"{titles} AND {apart(4)}", "different/year"), (titles, "exact/titleauthormatch"),
        ("a.title <> b.title AND ((NOT contains(trim(a.title), ' ') AND regexp_matches(a.title, '[.][a-z]{2,3}$')) OR (NOT contains(trim(b.title), ' ') AND regexp_matches(b.title, '[.][a-z]{2,3}$')))", "different/titlefilename"),
        (f"a.title <> '' AND a.title = b.title AND {apart(2)}", "different/year"), ("length(a.slug) < 10 AND a.slug <> b.slug", "ambiguous/shorttitle"),
        ("regexp_matches(a.slug, '[0-9]') AND a.slug <> b.slug AND regexp_replace(a.slug, '[0-9]+', '<NUM>', 'g') = regexp_replace(b.slug, '[0-9]+', '<NUM>', 'g')", "different/numdiff"),
        (f"{plain} AND {apart(4)}", "different/year"), (plain, "strong/slugtitleauthormatch"),
        ("a.year > 0 AND a.year = b.year AND a.tl = b.tl AND ((a.pmid <> '' AND b.doi <> '') OR (b.pmid <> '' AND a.doi <> ''))", "strong/pmiddoipair"),
        ("a.jstor <> '' AND b.jstor <> '' AND a.jstor <> b.jstor", "different/jstorid"), ("a.container_id <> '' AND a.container_id = b.container_id AND a.doi <> b.doi AND a.prefix <> '10.1126' AND a.prefix = b.prefix", "different/shareddoiprefix"),
        (f"{apart_names} AND {score} > (CASE WHEN least(len(a.slug_names), len(b.slug_names)) < 3 THEN 0.9 ELSE 0.5 END)", "strong/tokenizedauthors"),
        (f"{apart_names} AND len(a.toks) > 0 AND len(b.toks) > 0 AND len(list_intersect(a.toks, b.toks))::DOUBLE / len(list_distinct(list_concat(a.toks, b.toks))) > 0.35", "strong/jaccardauthors"),
        (apart_names, "different/contribintersectionempty"), ("'10.5860' IN (a.prefix, b.prefix)", "ambiguous/customprefix105860choicereview"),
        ("a.p_err AND b.p_err AND abs(a.p_count - b.p_count) > 5", "different/pagecount"),
        ("a.names = b.names AND a.container_id = b.container_id AND a.year = b.year AND a.title <> b.title AND (contains(a.title, b.title) OR contains(b.title, a.title))", "strong/titleartifact"),
    ]
    return "CASE " + "\n".join(f"WHEN {c} THEN '{v}'" for c, v in rules) + " ELSE 'ambiguous/unknown' END"
