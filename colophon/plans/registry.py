"""The queries of the bibliographic engine over the test tables, each with its SQL for DuckDB where it has one.

Roles: a document with an even doc_id is a release, one with an odd doc_id a reference; its title is its first line.
Customers are releases and orders references for the exact zip; parts, orders and lines give identifiers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, sets, text
from ..operators import cluster, convert, extract, match, verify
from ..sources.schemas import REF, decode
from . import duck
from .scenarios import SCENARIOS, side

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL that both engines read, over the files of part and documents."""
    sql = sql.replace("EMPTY", "CAST(ARRAY() AS ARRAY<STRING>)")
    return spark.sql(sql.replace("FROM part", f"FROM parquet.`{sf_dir}/part.parquet`").replace("FROM documents", f"FROM parquet.`{sf_dir}/documents.parquet`"))


def duck_sql(sql: str) -> str:
    return sql.replace("ARRAY(", "list_value(").replace("EMPTY", "CAST([] AS VARCHAR[])")


TITLE = "split_part(text, chr(10), 1)"
KEY = f"regexp_replace(lower({TITLE}), '[^0-9A-Za-z_]+', '', 'g')"


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return t(spark, sf_dir, "documents").select(c("doc_id").cast("string").alias("ident"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), (c("doc_id") % 2 == 1).alias("ref"), c("doc_id").cast("string").alias("doc"))


def keyed(spark: SparkSession, sf_dir: str, key: str = "tnorm") -> DataFrame:
    return keys.derive_key(titled(spark, sf_dir), key)


# --- keys ------------------------------------------------------------------------------------------------------------
def _key(name: str) -> Query:
    return lambda spark, sf_dir: keyed(spark, sf_dir, name).select("ident", "key")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS ident, trim(replace({TITLE}, chr(9), ' ')) AS key FROM documents")
def key_title(spark, sf_dir):
    return _key("title")(spark, sf_dir)


@query(f"SELECT CAST(doc_id AS VARCHAR) AS ident, {KEY} AS key FROM documents")
def key_tnorm(spark, sf_dir):
    return _key("tnorm")(spark, sf_dir)


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS ident, regexp_replace(strip_accents(replace(lower({TITLE}), 'ß', 's')), '[\\s\\pP\\pM´`=<>|+$^~]', '', 'g') AS key FROM documents""")
def key_tsand(spark, sf_dir):
    return _key("tsand")(spark, sf_dir)


@query()
def key_tnysi(spark, sf_dir):
    return _key("tnysi")(spark, sf_dir)


@query(f"SELECT CAST(doc_id AS VARCHAR) AS ident, {KEY} AS key FROM documents WHERE {KEY} <> ''")
def derive_key_skip_empty(spark, sf_dir):
    return keys.derive_key(titled(spark, sf_dir), "tnorm", skip_empty=True).select("ident", "key")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS ident, '10.' || (1000 + o_custkey % 10) || '/o' || o_orderkey AS key FROM orders WHERE o_orderkey % 3 <> 0")
def key_ext_id(spark, sf_dir):
    doi = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("10."), (1000 + F.col("o_custkey") % 10).cast("string"), F.lit("/O"), F.col("o_orderkey").cast("string"))).otherwise("")
    rows = t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("ident"), F.struct(doi.alias("doi")).alias("ext_ids"))
    return keys.key_by_ext_id(rows, "doi").select("ident", "key")


# --- clusters --------------------------------------------------------------------------------------------------------
def _clusters_sql(having: str, where: str = "true") -> str:
    return f"""SELECT key, count(*) AS n, string_agg(ident, ',' ORDER BY ident) AS idents FROM
      (SELECT CAST(doc_id AS VARCHAR) AS ident, doc_id % 2 = 1 AS ref, {KEY} AS key FROM documents) WHERE {where} GROUP BY key HAVING {having}"""


def _clusters(spark, sf_dir, **limits) -> DataFrame:
    return cluster.cluster(keyed(spark, sf_dir), **limits).select("key", F.col("n").cast("long").alias("n"), F.array_join("idents", ",").alias("idents"))


@query(_clusters_sql("count(*) BETWEEN 2 AND 100000"))
def cluster_min2(spark, sf_dir):
    return _clusters(spark, sf_dir)


@query(_clusters_sql("count(*) BETWEEN 2 AND 10"))
def cluster_max(spark, sf_dir):
    return _clusters(spark, sf_dir, most=10)


@query(_clusters_sql("count(*) BETWEEN 2 AND 100000 AND bool_or(ref) AND bool_or(NOT ref)"))
def cluster_both(spark, sf_dir):
    return _clusters(spark, sf_dir, both=True)


@query(_clusters_sql("count(*) BETWEEN 1 AND 100000", "key <> ''"))
def cluster_drop_empty(spark, sf_dir):
    return _clusters(spark, sf_dir, least=1, drop_empty=True)


_STATS = f"SELECT doc_id % 2 = 1 AS ref, {KEY} AS key FROM documents"


@query(f"SELECT key, count(*) AS n FROM ({_STATS}) GROUP BY key")
def cluster_stats_default(spark, sf_dir):
    return cluster.stats(keyed(spark, sf_dir))


@query(f"SELECT key, count(*) AS total, count_if(ref)::BIGINT AS refs, count_if(NOT ref)::BIGINT AS nonrefs FROM ({_STATS}) GROUP BY key")
def cluster_stats_count(spark, sf_dir):
    return cluster.stats(keyed(spark, sf_dir), "count")


@query(f"SELECT key, count(*) AS n FROM ({_STATS}) GROUP BY key HAVING bool_and(ref)")
def cluster_stats_unmatched(spark, sf_dir):
    return cluster.stats(keyed(spark, sf_dir), "unmatched")


@query("SELECT value, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS value FROM documents) GROUP BY value")
def count_unique_lines(spark, sf_dir):
    return cluster.count_lines(t(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value")))


# --- conversions -----------------------------------------------------------------------------------------------------
@query("""SELECT page_id, CASE WHEN strlen(url) > 41 THEN split_part(substr(url, 42), '_', 1) ELSE '' END AS ident, regexp_extract(html, '<title>([^<]*)', 1) AS title, 'rg' AS status, url FROM pages""")
def sitemap_to_release(spark, sf_dir):
    pages = t(spark, sf_dir, "pages").select(F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), "url", "page_id")
    out = convert.sitemap_to_release(pages.withColumn("title", F.struct("title", "page_id")))
    return out.select("title.page_id", "ident", "title.title", F.col("extra.mark.status").alias("status"), F.col("extra.mark.rg.url").alias("url"))


def _refs(spark, sf_dir) -> DataFrame:
    """Order lines as references."""
    c, s = F.col, lambda x: F.col(x).cast("string")
    rows = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    names = F.array("p_brand", "p_type")
    blank = F.lit("")
    biblio = F.struct(blank.alias("arxiv_id"), c("p_brand").alias("container_name"), names.alias("contrib_raw_names"), F.concat(F.lit("10.55/"), s("l_partkey")).alias("doi"), blank.alias("issue"), blank.alias("pmcid"), s("l_suppkey").alias("pmid"), blank.alias("pages"), blank.alias("publisher"), c("p_name").alias("title"), blank.alias("unstructured"), blank.alias("url"), blank.alias("volume"), F.lit(0).cast("long").alias("year"))
    return rows.select(biblio.alias("biblio"), c("l_linenumber").cast("long").alias("index"), s("l_orderkey").alias("key"), (900 + c("l_partkey") % 1200).cast("int").alias("release_year"), s("l_orderkey").alias("release_ident"), blank.alias("work_ident"), blank.alias("release_stage"), blank.alias("ref_source"))


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS ident, p_name AS title, '10.55/' || l_partkey AS doi, CAST(l_suppkey AS VARCHAR) AS pmid, CASE WHEN 900 + l_partkey % 1200 > 1000 THEN CAST(900 + l_partkey % 1200 AS VARCHAR) ELSE '' END AS release_year,
  '0:' || p_brand || ';1:' || p_type AS contribs, 'ref' AS status, CAST(l_linenumber AS BIGINT) AS ref_index, CAST(l_orderkey AS VARCHAR) AS ref_key FROM lineitem JOIN part ON l_partkey = p_partkey""")
def ref_to_release(spark, sf_dir):
    out = convert.ref_to_release(_refs(spark, sf_dir))
    names = F.array_join(F.transform("contribs", lambda x: F.concat(x["index"].cast("string"), F.lit(":"), x.raw_name)), ";")
    return out.select("ident", "title", "ext_ids.doi", "ext_ids.pmid", "release_year", names.alias("contribs"), "extra.mark.status", F.col("extra.mark.ref.index").alias("ref_index"), F.col("extra.mark.ref.key").alias("ref_key"))


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS ident, p_name AS title, 900 + l_partkey % 1200 AS year FROM lineitem JOIN part ON l_partkey = p_partkey""")
def json_round_trip(spark, sf_dir):
    lines = _refs(spark, sf_dir).select(F.to_json(F.struct("biblio", "index", "key", "release_year", "release_ident")).alias("value"))
    return decode(lines, REF).select(F.col("release_ident").alias("ident"), "biblio.title", F.col("release_year").cast("long").alias("year"))


_DOI_TEXT = "CASE WHEN o_orderkey % 4 = 0 THEN 'no id ' || o_custkey ELSE 'see 10.' || (1000 + o_custkey % 90) || '/ab-' || o_orderkey || '. and more' END"
_DOI = r"regexp_extract({}, '10[.][0-9]{{1,8}}/[^ ]*[\w]')"


def _doi_rows(spark, sf_dir) -> DataFrame:
    c, s = F.col, lambda x: x.cast("string")
    value = F.when(c("o_orderkey") % 4 == 0, F.concat(F.lit("no id "), s(c("o_custkey")))).otherwise(F.concat(F.lit("see 10."), s(1000 + c("o_custkey") % 90), F.lit("/ab-"), s(c("o_orderkey")), F.lit(". and more")))
    return t(spark, sf_dir, "orders").select("o_orderkey", value.alias("value"))


@query(f"SELECT o_orderkey, {_DOI.format(_DOI_TEXT)} AS value FROM orders")
def to_doi(spark, sf_dir):
    return extract.to_doi(_doi_rows(spark, sf_dir), "value")


@query(f"SELECT * FROM (SELECT o_orderkey, {_DOI.format(_DOI_TEXT)} AS value FROM orders) WHERE value <> ''")
def to_doi_skip(spark, sf_dir):
    return extract.to_doi(_doi_rows(spark, sf_dir), "value", skip=True)


@query(f"""SELECT o_orderkey || ',' || {_DOI.format(_DOI_TEXT)} || ',x' AS value FROM orders""")
def to_doi_field(spark, sf_dir):
    rows = _doi_rows(spark, sf_dir).select(F.concat_ws(",", F.col("o_orderkey").cast("string"), "value", F.lit("x")).alias("value"))
    return extract.doi_in_line(rows, ",", 2)


def _unstructured(spark, sf_dir, key: Column, uns: Column) -> DataFrame:
    blank = F.lit("")
    biblio = F.struct(blank.alias("doi"), blank.alias("arxiv_id"), uns.alias("unstructured"))
    rows = t(spark, sf_dir, "orders").select("o_orderkey", key.alias("key"), biblio.alias("biblio"))
    return extract.from_unstructured(rows).select("o_orderkey", "biblio.doi", "biblio.arxiv_id")


@query(r"""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '10.77/u' || o_orderkey WHEN o_orderkey % 3 = 0 THEN '10.78/k' || o_custkey ELSE '' END AS doi, '' AS arxiv_id FROM orders""")
def from_unstructured_doi(spark, sf_dir):
    n = F.col("o_orderkey")
    uns = F.when(n % 2 == 0, F.concat(F.lit("Lee, 10.77/u"), n.cast("string"), F.lit(" p. 3"))).otherwise("Lee, nothing")
    key = F.when(n % 3 == 0, F.concat(F.lit("10.78/k"), F.col("o_custkey").cast("string"), F.lit("-r1"))).otherwise("k")
    return _unstructured(spark, sf_dir, key, uns)


@query(r"""SELECT o_orderkey, '' AS doi, CASE o_orderkey % 3 WHEN 0 THEN '1901.' || o_custkey WHEN 1 THEN '1902.' || o_custkey ELSE '' END AS arxiv_id FROM orders""")
def from_unstructured_arxiv(spark, sf_dir):
    n, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    uns = F.when(n % 3 == 0, F.concat(F.lit("at http://arxiv.org/pdf/1901."), cust, F.lit("v2.pdf"))).when(n % 3 == 1, F.concat(F.lit("at http://arxiv.org/abs/1902."), cust)).otherwise("none")
    return _unstructured(spark, sf_dir, F.lit("k"), uns)


@query(r"""SELECT o_orderkey, '10.1111/j.' || o_custkey || '.x' AS doi, '' AS arxiv_id FROM orders""")
def from_unstructured_bibkey(spark, sf_dir):
    key = F.concat(F.lit("10.1111/J."), F.col("o_custkey").cast("string"), F.lit(".x-BIB5|cit5"))
    return _unstructured(spark, sf_dir, key, F.lit("10.2/other"))


@query("SELECT 'o' || o_orderkey AS source_release_ident, 'c' || o_custkey AS target_release_ident, 'join' AS match_provenance FROM orders")
def biblioref_join(spark, sf_dir):
    o, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    lines = t(spark, sf_dir, "orders").select(F.concat(F.lit("k"), c, F.lit("\tc"), c, F.lit(" o"), o).alias("value"))
    return convert.biblioref_from_pairs(lines).select("source_release_ident", "target_release_ident", "match_provenance")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS source_release_ident, CAST(o_custkey AS VARCHAR) AS target_release_ident, 'verifier' AS match_provenance, 'EXACT' AS match_status, 'DOI' AS match_reason FROM orders WHERE o_orderkey <> o_custkey")
def biblioref_verify(spark, sf_dir):
    o, c, u = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.lit(convert.RELEASE_URL)
    lines = t(spark, sf_dir, "orders").select(F.concat(u, c, F.lit(" "), u, o, F.lit(" Status.EXACT Reason.DOI")).alias("value"))
    return convert.biblioref_from_pairs(lines).select("source_release_ident", "target_release_ident", "match_provenance", "match_status", "match_reason")


def _edges(spark, sf_dir) -> DataFrame:
    c = F.col
    rows = t(spark, sf_dir, "orders")
    return rows.select(*convert.biblioref(source_release_ident=c("o_orderkey").cast("string"), target_release_ident=c("o_custkey").cast("string"), ref_index=c("o_orderkey") % 7))


@query("SELECT o_orderkey || '_' || o_orderkey % 7 AS id, CAST(o_custkey AS VARCHAR) AS target_release_ident FROM orders")
def bref_id(spark, sf_dir):
    return convert.assign_ids(_edges(spark, sf_dir)).select(F.col("_id").alias("id"), "target_release_ident")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS source_release_ident, CAST(o_custkey AS VARCHAR) AS target_release_ident, '' AS source_work_ident, coalesce(c_mktsegment, '') AS target_work_ident FROM orders LEFT JOIN customer ON 'x' || c_custkey = 'x' || o_custkey""")
def enrich(spark, sf_dir):
    c = F.col
    known = t(spark, sf_dir, "customer").select(c("c_custkey").cast("string").alias("ident"), c("c_mktsegment").alias("work_id"), F.lit("published").alias("release_stage"), c("c_nationkey").alias("year"))
    edges = _edges(spark, sf_dir).withColumn("source_release_ident", F.concat(F.lit("o"), "source_release_ident"))
    out = convert.enrich(edges, known)
    return out.select(F.substr("source_release_ident", F.lit(2)).alias("source_release_ident"), "target_release_ident", "source_work_ident", "target_work_ident")


# --- matching --------------------------------------------------------------------------------------------------------
_SIDES = f"(SELECT CAST(doc_id AS VARCHAR) AS ident, doc_id % 2 = 1 AS ref, {KEY} AS key FROM documents WHERE {KEY} <> '')"


def _sides(spark, sf_dir):
    rows = keyed(spark, sf_dir)
    return rows.filter("NOT ref"), rows.filter("ref")


@query(f"""SELECT l.key, l.g AS g0, r.g AS g1 FROM (SELECT key, string_agg(ident, ',' ORDER BY ident) AS g FROM {_SIDES} WHERE NOT ref GROUP BY key) l
  JOIN (SELECT key, string_agg(ident, ',' ORDER BY ident) AS g FROM {_SIDES} WHERE ref GROUP BY key) r ON l.key = r.key""")
def zip_groups(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return match.zip_groups(left, right).select("key", F.array_join("g0", ",").alias("g0"), F.array_join("g1", ",").alias("g1"))


@query(f"SELECT ident, key FROM {_SIDES} WHERE ref AND key NOT IN (SELECT key FROM {_SIDES} WHERE NOT ref)")
def unmatched_refs(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return match.unmatched(left, right.filter("key <> ''")).select("ident", "key")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS source_release_ident, o_orderstatus AS source_release_stage, CAST(year(o_orderdate) AS VARCHAR) AS source_year, o_orderkey % 7 + 1 AS ref_index, o_orderpriority AS ref_key, c_name AS target_release_ident, c_mktsegment AS target_work_ident, 'exact' AS match_status, 'doi' AS match_reason
  FROM orders JOIN customer ON o_custkey = c_custkey""")
def zip_exact(spark, sf_dir):
    c = F.col
    releases = t(spark, sf_dir, "customer").select(c("c_custkey").cast("string").alias("key"), c("c_name").alias("ident"), c("c_name").alias("doc"), c("c_mktsegment").alias("work_id"))
    refs = t(spark, sf_dir, "orders").select(c("o_custkey").cast("string").alias("key"), c("o_orderkey").cast("string").alias("release_ident"), F.lit("").alias("work_ident"), c("o_orderstatus").alias("release_stage"), F.year("o_orderdate").alias("release_year"), (c("o_orderkey") % 7).alias("index"), c("o_orderpriority").alias("ref_key"))
    return match.zip_exact(releases, refs, "doi").select("source_release_ident", "source_release_stage", "source_year", "ref_index", "ref_key", "target_release_ident", "target_work_ident", "match_status", "match_reason")


#: Documents as releases and references, in SQL that both engines read.
SYNTH = f"""SELECT CAST(doc_id AS STRING) AS ident, doc_id % 2 = 1 AS ref, CASE WHEN doc_id % 2 = 0 THEN 'w' || CAST(doc_id AS STRING) ELSE '' END AS work_id, {TITLE} AS title, 'c' || CAST(doc_id % 5 AS STRING) AS container_id, source AS extra_container_name,
  CASE WHEN doc_id % 3 = 0 THEN '10.' || CAST(1000 + doc_id % 4 AS STRING) || '/x' || CAST(doc_id AS STRING) ELSE '' END AS doi, CASE WHEN doc_id % 4 = 1 THEN CAST(doc_id AS STRING) ELSE '' END AS pmid,
  CASE WHEN doc_id % 10 = 7 THEN '2001.' || CAST(doc_id AS STRING) || 'v1' ELSE '' END AS arxiv, '' AS jstor, CASE doc_id % 6 WHEN 0 THEN 'article-journal' WHEN 2 THEN 'report' WHEN 3 THEN 'dataset' WHEN 4 THEN 'article' ELSE '' END AS release_type,
  CAST(1990 + doc_id % 20 AS INT) AS year, CAST(doc_id % 100 AS STRING) || '-' || CAST(doc_id % 100 + doc_id % 13 AS STRING) AS pages, CASE WHEN doc_id % 11 = 0 THEN ARRAY(lang) ELSE EMPTY END AS subtitles, '' AS crossref_type, 0 AS metadata_version, 0 AS relations, EMPTY AS related,
  ARRAY(source || ' ' || lang, 'anna ' || lang) AS authors, 'published' AS release_stage, CAST(doc_id % 50 AS BIGINT) AS ref_index, 'k' || CAST(doc_id AS STRING) AS ref_key, CAST(doc_id AS STRING) AS doc FROM documents"""
_DUCK_SYNTH = f"SELECT *, regexp_replace(lower(title), '[^0-9A-Za-z_]+', '', 'g') AS key FROM ({duck_sql(SYNTH)})"
_PAIRS = f"""WITH f AS MATERIALIZED ({duck.final(_DUCK_SYNTH)}), p AS (SELECT key AS pkey, min(doc) AS pdoc FROM f WHERE NOT ref AND key <> '' GROUP BY key),
  v AS (SELECT b.key, a.ident AS pivot_ident, b.ident AS ref_ident, a.work_id AS pivot_work, b.work_id AS ref_work, b.year, b.ref_index, b.ref_key, {duck.verdict()} AS verdict FROM f b JOIN p ON b.key = p.pkey AND b.ref JOIN f a ON a.doc = p.pdoc),
  s AS (SELECT *, split_part(verdict, '/', 1) AS status, split_part(verdict, '/', 2) AS reason FROM v), c AS (SELECT * FROM s WHERE status IN ('exact', 'strong') AND reason <> 'doi')"""
_EDGE = "ref_ident AS source_release_ident, ref_work AS source_work_ident, CAST(year AS VARCHAR) AS source_year, ref_index, ref_key, pivot_ident AS target_release_ident, pivot_work AS target_work_ident, 'fuzzy' AS match_provenance, status AS match_status, reason AS match_reason"
_EDGE_COLUMNS = "source_release_ident source_work_ident source_year ref_index ref_key target_release_ident target_work_ident match_provenance match_status match_reason".split()


def synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark_sql(spark, sf_dir, SYNTH)
    return rows.withColumn("key", keys.key_tnorm(F.col("title"))).filter("key <> ''")


@query(f"{_PAIRS} SELECT {_EDGE} FROM c")
def zip_verify(spark, sf_dir):
    rows = synth(spark, sf_dir)
    return match.zip_verify(rows.filter("NOT ref"), rows.filter("ref")).select(*_EDGE_COLUMNS)


@query(f"{_PAIRS} SELECT key, pivot_ident, ref_ident, status, reason FROM s")
def ref_cluster(spark, sf_dir):
    return match.ref_cluster(synth(spark, sf_dir))


@query(f"{_PAIRS} SELECT {_EDGE} FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ref_ident) AS r FROM c) WHERE r = 1")
def bref(spark, sf_dir):
    return match.cluster_to_biblioref(synth(spark, sf_dir)).select(*_EDGE_COLUMNS)


@query(f"{_PAIRS} SELECT {_EDGE} FROM c")
def bref_all(spark, sf_dir):
    return match.cluster_to_biblioref(synth(spark, sf_dir), all_matches=True).select(*_EDGE_COLUMNS)


def _verify_pairs(group: str) -> None:
    select = lambda which: f"SELECT p_partkey, {side(group, which)} FROM part"

    def run(spark, sf_dir):
        one = lambda which, name: verify.as_struct(verify.features(spark_sql(spark, sf_dir, select(which))), name, "p_partkey")
        pairs = one(0, "a").join(one(1, "b"), "p_partkey")
        return verify.verify_pairs(pairs).select("p_partkey", "status", "reason")

    run.__name__ = f"verify_pairs_{group}"
    fs = [duck.final(duck_sql(select(i))) for i in (0, 1)]
    query(f"SELECT p_partkey, split_part(v, '/', 1) AS status, split_part(v, '/', 2) AS reason FROM (SELECT a.p_partkey, {duck.verdict()} AS v FROM ({fs[0]}) a JOIN ({fs[1]}) b ON a.p_partkey = b.p_partkey)")(run)


for _group in SCENARIOS:
    _verify_pairs(_group)


# --- string sets -----------------------------------------------------------------------------------------------------

def _set_query(name: str, value: Callable[[Column, Column], Column], sql: str) -> None:
    def run(spark, sf_dir):
        letters = lambda x: F.array_distinct(F.split(F.lower(x), ""))
        rows = t(spark, sf_dir, "part").select("p_partkey", letters(F.col("p_name")).alias("a"), letters(F.col("p_type")).alias("b"))
        return rows.select("p_partkey", value(F.col("a"), F.col("b")).alias("value"))

    run.__name__ = name
    query(f"SELECT p_partkey, {sql} AS value FROM (SELECT p_partkey, list_distinct(string_split(lower(p_name), '')) AS a, list_distinct(string_split(lower(p_type), '')) AS b FROM part)")(run)


_set_query("set_union", lambda a, b: sets.join(sets.union(a, b), ""), "array_to_string(list_sort(list_distinct(list_concat(a, b))), '')")
_set_query("set_intersection", lambda a, b: sets.join(sets.intersection(a, b), ""), "array_to_string(list_sort(list_intersect(a, b)), '')")
_set_query("set_jaccard", sets.jaccard, "len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b)))")
_set_query("set_equals", lambda a, b: sets.equals(a, sets.union(b, sets.intersection(a, b))), "list_sort(a) = list_sort(list_distinct(list_concat(b, list_intersect(a, b))))")
_set_query("set_topk", lambda a, b: sets.join(sets.top_k(a, 5), ""), "array_to_string(list_sort(a)[1:5], '')")
_set_query("set_product", lambda a, b: F.size(F.array_distinct(sets.product(a, b))).cast("long"), "len(a) * len(b)")
_set_query("set_filter", lambda a, b: sets.join(sets.keep(a, lambda x: x > "m"), ""), "array_to_string(list_sort(list_filter(a, lambda x: x > 'm')), '')")
_set_query("set_minmax", lambda a, b: (sets.largest(a, b) * 1000 + sets.smallest(a, b)).cast("long"), "greatest(len(a), len(b)) * 1000 + least(len(a), len(b))")
_set_query("set_join", lambda a, b: sets.join(a, "-"), "array_to_string(list_sort(a), '-')")
_set_query("set_contains", lambda a, b: sets.contains(a, "e") & ~sets.is_empty(b), "list_contains(a, 'e') AND len(b) > 0")


# --- text ------------------------------------------------------------------------------------------------------------
def _text_query(name: str, table: str, key: str, value: Callable[[], Column], sql: str) -> None:
    def run(spark, sf_dir):
        return t(spark, sf_dir, table).select(F.col(key), value().alias("value"))

    run.__name__ = name
    query(f"SELECT {key}, {sql} AS value FROM {table}")(run)


_grams = "flatten(list_transform(list_filter(string_split(lower({0}), ' '), lambda t: t <> ''), lambda t: regexp_extract_all(t, '.{{1,2}}')))"
_jac = "len(list_intersect({0}, {1}))::DOUBLE / len(list_distinct(list_concat({0}, {1})))"
_ga, _gb = (f"list_distinct({_grams.format(x)})" for x in ("p_name", "p_type"))
_END = "(CASE WHEN p_size < 10 AND p_partkey >= 10 AND p_partkey % 10 < p_size THEN p_partkey - p_partkey % 10 + p_size ELSE p_size END)"
_c, _s = F.col, lambda x: F.col(x).cast("string")
_text_query("slugify", "documents", "doc_id", lambda: text.slugify(_c("text")), duck.slug("text"))
_text_query("ngrams", "part", "p_partkey", lambda: F.array_join(text.token_ngrams(_c("p_type")), " "), f"array_to_string({_grams.format('p_type')}, ' ')")
_text_query("author_similarity", "part", "p_partkey", lambda: sets.author_similarity(_c("p_name"), _c("p_type")), _jac.format(_ga, _gb))
_text_query(
    "average_score", "part", "p_partkey", lambda: sets.average_score(F.array(sets.author_grams(_c("p_name")), sets.author_grams(_c("p_brand"))), F.array(sets.author_grams(_c("p_type")))),
    f"({_jac.format(_ga, _gb)} + {_jac.format(f'list_distinct({_grams.format("p_brand")})', _gb)}) / 2",
)
_text_query("doi_prefix", "orders", "o_orderkey", lambda: text.doi_prefix(F.concat(F.lit("10."), _s("o_custkey"), F.lit("/a/"), _s("o_orderkey"))), "'10.' || o_custkey")
_text_query("unify_digits", "part", "p_partkey", lambda: text.unify_digits(F.concat("p_brand", F.lit(" x"), _s("p_size"))), "regexp_replace(p_brand || ' x' || p_size, '[0-9]+', '<NUM>', 'g')")
_text_query("filename_like", "part", "p_partkey", lambda: text.looks_like_filename(F.concat(F.when(_c("p_partkey") % 2 == 0, "p 1").otherwise("p"), F.lit("."), F.when(_c("p_partkey") % 3 == 0, "pdf").otherwise("html"))), "p_partkey % 2 <> 0 AND p_partkey % 3 = 0")
_text_query("component_like", "part", "p_partkey", lambda: text.looks_like_component(F.concat(F.lit("10.1/p."), _s("p_partkey")), F.when(_c("p_partkey") % 2 == 0, F.lit("10.1/p")).otherwise("10.1/q")), "p_partkey % 2 = 0")
_text_query("line_column", "part", "p_partkey", lambda: text.line_column(F.concat(F.lit(" "), _s("p_partkey"), F.lit("\t"), "p_name", F.lit("\t"), "p_brand", F.lit("\n")), "\t", 2), "p_name")
_text_query(
    "parse_pages", "part", "p_partkey", lambda: F.concat_ws(":", *[text.parse_pages(F.concat(F.lit("pp. "), _s("p_partkey"), F.lit("-"), _s("p_size")))[k].cast("string") for k in ("start", "end", "err", "count")]),
    f"p_partkey || ':' || {_END} || ':' || (p_partkey > {_END}) || ':' || ({_END} - p_partkey + 1)",
)


def _variant(column: str, value: Column) -> Column:
    return F.variant_get(F.parse_json(F.concat(F.lit('{"v":'), value, F.lit("}"))), "$.v", "variant")


_text_query("release_year", "orders", "o_orderkey", lambda: text.year_of(_variant("y", F.when(_c("o_orderkey") % 3 == 0, _s("o_custkey")).when(_c("o_orderkey") % 3 == 1, F.concat(F.lit('"'), _s("o_custkey"), F.lit('"'))).otherwise(F.lit('"n.d."')))).cast("long"), "CASE WHEN o_orderkey % 3 < 2 THEN o_custkey ELSE 0 END")
_text_query("subtitle", "orders", "o_orderkey", lambda: F.array_join(text.subtitles_of(_variant("s", F.when(_c("o_orderkey") % 3 == 0, F.concat(F.lit('["a","b'), _s("o_custkey"), F.lit('"]'))).when(_c("o_orderkey") % 3 == 1, F.concat(F.lit('"s'), _s("o_custkey"), F.lit('"'))).otherwise(F.lit("7")))), ";"), "CASE o_orderkey % 3 WHEN 0 THEN 'a;b' || o_custkey WHEN 1 THEN 's' || o_custkey ELSE '' END")
