"""Queries over what is stored - key tables, the edge store, files, rejects - and over pairs, candidates and sketches.

Each writes to a new folder in the shared one and reads back what it returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blacklist import Blacklist, title_table
from ..operators import cluster, convert, match, pairs, verify
from ..sources import edges, files, rejects, schemas, tables
from . import duck
from .registry import _DUCK_SYNTH, _EDGE_COLUMNS, KEY, ORACLES, TITLE, _clusters_sql, _edges, _refs, keyed, query, synth, t

BUCKETS = 8
c = F.col


def text_of(name: str):
    return F.col(name).cast("string")


# --- key tables --------------------------------------------------------------------------------------------------------
RELEASE_KEYS = "key string, ident string, doc string, work_id string"
REF_KEYS = "key string, release_ident string, work_ident string, release_stage string, release_year int, index bigint, ref_key string"
#: Many customers share a key, so that a pivot has to be chosen; some keys are empty.
_NATION_KEY = "CASE WHEN {0} % 25 = 3 THEN '' ELSE 'n' || {0} % 25 END"
_ZIP_BUCKETED = f"""WITH p AS (SELECT {_NATION_KEY.format("c_nationkey")} AS key, min(c_name) AS ident, arg_min(c_mktsegment, c_name) AS work_id FROM customer GROUP BY ALL)
  SELECT CAST(o_orderkey AS VARCHAR) AS source_release_ident, o_orderkey % 7 + 1 AS ref_index, o_orderpriority AS ref_key, ident AS target_release_ident, work_id AS target_work_ident
  FROM orders JOIN p ON key = {_NATION_KEY.format("o_custkey")} WHERE key <> ''"""


def _nation(x):
    return F.when(x % 25 == 3, "").otherwise(F.concat(F.lit("n"), (x % 25).cast("string")))


def key_tables(spark, sf_dir: str) -> tuple[tables.KeyTable, tables.KeyTable]:
    """Customers as releases, orders as references: orders come on two days, the first of which is written twice."""
    left, right = (tables.key_table(spark, columns, BUCKETS) for columns in (RELEASE_KEYS, REF_KEYS))
    people = t(spark, sf_dir, "customer")
    left.write_day(people.select(_nation(c("c_nationkey")).alias("key"), c("c_name").alias("ident"), c("c_name").alias("doc"), c("c_mktsegment").alias("work_id")), "1")
    orders = t(spark, sf_dir, "orders")
    rows = orders.select(
        _nation(c("o_custkey")).alias("key"), text_of("o_orderkey").alias("release_ident"), F.lit("").alias("work_ident"), c("o_orderstatus").alias("release_stage"),
        F.year("o_orderdate").alias("release_year"), (c("o_orderkey") % 7).cast("long").alias("index"), c("o_orderpriority").alias("ref_key"), "o_orderkey",
    )
    right.write_day(rows.filter("o_orderkey % 2 = 0"), "1")
    right.write_day(rows.filter("o_orderkey % 2 = 1"), "2")
    right.write_day(rows.filter("o_orderkey % 2 = 0"), "1")
    return left, right


_ZIP_COLUMNS = "source_release_ident ref_index ref_key target_release_ident target_work_ident".split()


@query(_ZIP_BUCKETED)
def zip_bucketed(spark, sf_dir):
    return match.zip_tables(match.zip_exact, *key_tables(spark, sf_dir), reason="doi").select(*_ZIP_COLUMNS)


@query(_ZIP_BUCKETED)
def zip_bucketed_hot(spark, sf_dir):
    left, right = key_tables(spark, sf_dir)
    hot = match.common_keys(right.rows(), 26)
    return match.zip_tables(match.zip_exact, left, right, hot, reason="doi").select(*_ZIP_COLUMNS)


@query(ORACLES["zip_groups"])
def zip_bucketed_groups(spark, sf_dir):
    rows = keyed(spark, sf_dir).select("key", "ident", "doc", F.lit("").alias("work_id"), "ref")
    sides = [tables.key_table(spark, RELEASE_KEYS, BUCKETS) for _ in range(2)]
    for side, table in enumerate(sides):
        table.write_day(rows.filter(c("ref") == F.lit(bool(side))), "1")
    return match.zip_tables_groups(*sides).select("key", F.array_join("g0", ",").alias("g0"), F.array_join("g1", ",").alias("g1"))


@query(ORACLES["zip_verify"])
def zip_verify_reduced(spark, sf_dir):
    rows = synth(spark, sf_dir)
    return match.zip_verify_reduced(rows.filter("NOT ref"), rows.filter("ref")).select(*_EDGE_COLUMNS)


# --- a blacklist of any size ---------------------------------------------------------------------------------------------
#: Titles of parts with a number; those with a number below 100 are on the list. Some hold a fragment.
_NUMBERED = "p_name || ' ' || (p_partkey % 150) || CASE p_partkey % 7 WHEN 0 THEN ', records of meetings' ELSE '' END"


@query(f"""WITH x AS (SELECT p_partkey, lower({_NUMBERED}) AS title FROM part), listed AS (SELECT DISTINCT lower(p_name) || ' ' || n AS title FROM part, range(100) AS r(n))
  SELECT p_partkey, title IN (SELECT title FROM listed) AS blacklisted, contains(title, 'records of meetings') AS fragment FROM x""")
def blacklist_table(spark, sf_dir):
    parts = t(spark, sf_dir, "part")
    number = F.explode(F.sequence(F.lit(0), F.lit(99)))
    listed = title_table(parts.select(F.lower("p_name").alias("p_name"), number.alias("n")).select(F.concat_ws(" ", "p_name", text_of("n")).alias("title")))
    title = F.concat("p_name", F.lit(" "), (c("p_partkey") % 150).cast("string"), F.when(c("p_partkey") % 7 == 0, ", records of meetings").otherwise(""))
    rows = parts.select("p_partkey", F.lower(title).alias("title_lower"))
    return Blacklist(titles=listed).mark(rows).select("p_partkey", "blacklisted", "fragment")


# --- the phonetic key, letter by letter ------------------------------------------------------------------------------------
def _nysiis_sql(source: str) -> str:
    """(ident, key): the code of relation source (ident, name). The recursion stops at ten letters: what ends a code can't reach the first six of them."""
    vowel = lambda x: f"{x} IN ('A', 'E', 'I', 'O', 'U')"
    put = f"""CASE WHEN {vowel("c")} THEN 'A' WHEN c = 'Q' THEN 'G' WHEN c = 'Z' THEN 'S' WHEN c = 'M' THEN 'N' WHEN c = 'K' THEN 'C' WHEN c = 'P' AND n1 = 'H' THEN 'F'
      WHEN c = 'H' AND NOT ({vowel("last")} AND {vowel("n1")}) OR c = 'W' AND {vowel("last")} THEN last ELSE c END"""
    return f"""
  w0 AS (SELECT ident, upper(regexp_replace(translate(name, 'ıſ', 'is'), '[^A-Za-z]+', '', 'g')) AS w FROM ({source})),
  w1 AS (SELECT ident, CASE WHEN starts_with(w, 'MAC') THEN 'MCC' || substr(w, 4) WHEN starts_with(w, 'KN') THEN 'NN' || substr(w, 3) WHEN starts_with(w, 'K') THEN 'C' || substr(w, 2)
    WHEN starts_with(w, 'PH') OR starts_with(w, 'PF') THEN 'FF' || substr(w, 3) WHEN starts_with(w, 'SCH') THEN 'SSS' || substr(w, 4) ELSE w END AS w FROM w0),
  w2 AS (SELECT ident, regexp_replace(regexp_replace(w, '(EE|IE)$', 'Y'), '(DT|RT|RD|NT|ND)$', 'D') AS w FROM w1),
  fold AS (SELECT ident, w, 1 AS i, left(w, 1) AS out, left(w, 1) AS last, NULL::VARCHAR AS now, NULL::VARCHAR AS nxt FROM w2
    UNION ALL SELECT ident, w, i + 1, CASE WHEN skip OR put = last THEN out ELSE out || put END, CASE WHEN skip THEN last ELSE put END,
      CASE WHEN skip THEN nxt WHEN c = 'E' AND n1 = 'V' THEN 'F' WHEN sch THEN 'S' WHEN c = 'P' AND n1 = 'H' THEN 'F' ELSE nxt END, CASE WHEN sch THEN 'S' END
    FROM (SELECT *, {put} AS put, c = 'K' AND n1 = 'N' AS skip, c = 'S' AND n1 = 'C' AND n2 = 'H' AS sch
      FROM (SELECT *, coalesce(now, substr(w, i + 1, 1)) AS c, coalesce(nxt, substr(w, i + 2, 1)) AS n1, substr(w, i + 3, 1) AS n2 FROM fold WHERE i < length(w) AND length(out) < 10))),
  nysiis AS (SELECT ident, left(CASE WHEN i < length(w) OR length(out) < 2 THEN out
    ELSE regexp_replace(regexp_replace(regexp_replace(out, 'S$', ''), '(.)AY$', '\\1Y'), 'A$', '') END, 6) AS key FROM fold WHERE i >= length(w) OR length(out) >= 10)"""


_TITLES = f"SELECT CAST(doc_id AS VARCHAR) AS ident, {TITLE} AS name FROM documents"
ORACLES["key_tnysi"] = f"WITH RECURSIVE {_nysiis_sql(_TITLES)} SELECT ident, key FROM nysiis"


# --- candidates, neighbours, common keys -----------------------------------------------------------------------------------
_KINDS = "title tnorm tnysi tsand".split()


@query(f"""WITH RECURSIVE {_nysiis_sql(_TITLES)},
  k AS MATERIALIZED (SELECT ident, CAST(ident AS BIGINT) % 2 = 1 AS ref, trim(replace(name, chr(9), ' ')) AS title, regexp_replace(lower(name), '[^0-9A-Za-z_]+', '', 'g') AS tnorm, nysiis.key AS tnysi,
    regexp_replace(strip_accents(replace(lower(name), 'ß', 's')), '[\\s\\pP\\pM´`=<>|+$^~]', '', 'g') AS tsand FROM ({_TITLES}) JOIN nysiis USING (ident)),
  pairs AS ({" UNION ALL ".join(f"SELECT {i} AS kind, p.ident AS release, r.ident AS ref FROM (SELECT {n} AS key, min(ident) AS ident FROM k WHERE NOT ref AND {n} <> '' GROUP BY 1) p JOIN k r ON r.ref AND r.{n} = p.key" for i, n in enumerate(_KINDS))})
  SELECT release, ref, min(kind) AS kind FROM pairs GROUP BY release, ref""")
def key_candidates(spark, sf_dir):
    rows = keyed(spark, sf_dir).drop("key")
    found = pairs.candidates(rows.filter("NOT ref"), rows.filter("ref"), tuple(_KINDS))
    return found.select(c("a.ident").alias("release"), c("b.ident").alias("ref"), "kind")


WINDOW = 5


@query(f"""WITH f AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ident, doc) AS place FROM ({duck.final(_DUCK_SYNTH)}) WHERE key <> ''),
  v AS (SELECT a.key, a.ident AS a_ident, b.ident AS b_ident, {duck.verdict()} AS verdict FROM f a JOIN f b ON a.key = b.key AND b.place - a.place BETWEEN 1 AND {WINDOW - 1})
  SELECT key, a_ident, b_ident, split_part(verdict, '/', 1) AS status, split_part(verdict, '/', 2) AS reason FROM v""")
def cluster_neighbours(spark, sf_dir):
    return pairs.verify_neighbours(synth(spark, sf_dir).drop("ref"), WINDOW)


@query(_clusters_sql("count(*) BETWEEN 2 AND 10"))
def cluster_apart(spark, sf_dir):
    return cluster.cluster_apart(keyed(spark, sf_dir), most=10).select("key", c("n").cast("long").alias("n"), F.array_join("idents", ",").alias("idents"))


@query(_clusters_sql("count(*) BETWEEN 2 AND 100000", "key <> ''").replace(KEY, f"CASE WHEN doc_id % 9 = 4 THEN '' ELSE {KEY} END"))
def cluster_empty_keys(spark, sf_dir):
    rows = keyed(spark, sf_dir).withColumn("key", F.when(c("ident").cast("long") % 9 == 4, "").otherwise(c("key")))
    return cluster.cluster(rows, drop_empty=True).select("key", c("n").cast("long").alias("n"), F.array_join("idents", ",").alias("idents"))


# --- edges -----------------------------------------------------------------------------------------------------------------
def _run_of_edges(spark, sf_dir: str, which: str, at: int, target: str) -> DataFrame:
    rows = t(spark, sf_dir, "orders").filter(which)
    made = convert.biblioref(source_release_ident=text_of("o_orderkey"), target_release_ident=F.concat(F.lit(target), text_of("o_custkey")), ref_index=c("o_orderkey") % 7, update_ts=F.lit(at) + c("o_orderkey") % 2 * 10)
    return rows.select(*made).withColumn("_id", F.concat_ws("_", "source_release_ident", text_of("ref_index")))


@query("""WITH runs AS (SELECT o_orderkey, 'a' || o_custkey AS target, 100 + o_orderkey % 2 * 10 AS ts FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'b' || o_custkey, 105 + o_orderkey % 2 * 10 FROM orders WHERE o_orderkey % 3 <> 1
    UNION ALL SELECT o_orderkey, 'c' || o_custkey, 95 + o_orderkey % 2 * 10 FROM orders WHERE o_orderkey % 5 = 0)
  SELECT o_orderkey || '_' || o_orderkey % 7 AS id, max(ts)::BIGINT AS update_ts, arg_max(target, ts) AS target_release_ident FROM runs GROUP BY o_orderkey""")
def edge_store(spark, sf_dir):
    """Three runs that overlap, the last of them late; the first is repeated."""
    store = edges.EdgeStore(spark, tables.shared_folder(spark, "edges"), BUCKETS)
    runs = [("o_orderkey % 3 <> 0", 100, "a"), ("o_orderkey % 3 <> 1", 105, "b"), ("o_orderkey % 5 = 0", 95, "c")]
    for run in (*runs, runs[0]):
        store.upsert(_run_of_edges(spark, sf_dir, *run))
    return store.read().select(c("_id").alias("id"), "update_ts", "target_release_ident")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS source_release_ident, CASE WHEN s.c_custkey IS NULL THEN '' ELSE s.c_mktsegment END AS source_work_ident, CASE WHEN s.c_custkey IS NULL THEN '' ELSE 'published' END AS source_release_stage,
  CASE WHEN s.c_custkey IS NULL THEN '' ELSE CAST(s.c_nationkey AS VARCHAR) END AS source_year, coalesce(t.c_mktsegment, '') AS target_work_ident FROM orders LEFT JOIN customer s ON s.c_custkey = o_orderkey LEFT JOIN customer t ON t.c_custkey = o_custkey + 3""")
def enrich_both(spark, sf_dir):
    """Sources and targets that are known, and others that aren't."""
    known = t(spark, sf_dir, "customer").select(text_of("c_custkey").alias("ident"), c("c_mktsegment").alias("work_id"), F.lit("published").alias("release_stage"), c("c_nationkey").alias("year"))
    made = _edges(spark, sf_dir).withColumn("target_release_ident", (c("target_release_ident").cast("long") + 3).cast("string"))
    return convert.enrich(made, known).select("source_release_ident", "source_work_ident", "source_release_stage", "source_year", "target_work_ident")


# --- rejects ---------------------------------------------------------------------------------------------------------------
_SITE = "title string, ident string, year bigint"
#: Every sixth order makes a line that is no record, each for its own reason.
_LINE = """CASE o_orderkey % 12 WHEN 0 THEN '{"ident": "' || o_orderkey WHEN 1 THEN '[' || o_orderkey || ']' WHEN 2 THEN '{"ident": "' || o_orderkey || '", "title": "x", "year": "soon"}'
  WHEN 3 THEN '{"title": "only ' || o_orderkey || '"}' WHEN 4 THEN '{"ident": "' || o_orderkey || '", "title": ""}' WHEN 5 THEN ' ' ELSE '{"ident": "' || o_orderkey || '", "title": "t", "year": ' || o_custkey || '}' END"""
_CAUSES = "CASE o_orderkey % 12 WHEN 0 THEN 'syntax' WHEN 1 THEN 'no object' WHEN 2 THEN 'field type' WHEN 3 THEN 'no ident' WHEN 4 THEN 'no title' END"


def _judged(spark, sf_dir: str) -> DataFrame:
    lines = t(spark, sf_dir, "orders").select(F.expr(_LINE).alias("value"))
    path = tables.shared_folder(spark, "judged")
    rejects.write_judged(rejects.judge(lines, _SITE, rejects.UNUSABLE), path)
    return rejects.read_judged(spark, path, _SITE)


@query(f"SELECT cause, doc FROM (SELECT {_CAUSES} AS cause, {_LINE} AS doc FROM orders) WHERE cause IS NOT NULL")
def rejects_by_cause(spark, sf_dir):
    return rejects.rejected(_judged(spark, sf_dir))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS ident, 't' AS title, o_custkey AS year FROM orders WHERE o_orderkey % 12 > 5")
def rejects_good(spark, sf_dir):
    return rejects.good(_judged(spark, sf_dir)).select("ident", "title", "year")


# --- files: written, and read again ----------------------------------------------------------------------------------------
@query("SELECT line AS value FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[^\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x0B]')")
def files_lines(spark, sf_dir):
    """The lines of documents, without those that are blank."""
    path = tables.shared_folder(spark, "lines")
    # a carriage return would end a line, too
    files.write_lines(t(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value")), path)
    return files.read_lines(spark, path)


@query(f"SELECT CAST(doc_id AS VARCHAR) AS ident, {KEY} AS key, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'a' || doc_id || 'bc' END AS doc FROM documents WHERE {KEY} <> ''")
def files_keyed(spark, sf_dir):
    """Keyed lines; tabs and newlines in documents are deleted, an empty document stays empty."""
    rows = keyed(spark, sf_dir).filter("key <> ''")
    doc = F.when(c("ident").cast("long") % 4 == 0, "").otherwise(F.concat(F.lit("a"), "ident", F.lit("\tb\nc")))
    path = tables.shared_folder(spark, "keyed")
    files.write_keyed(rows.withColumn("doc", doc), path)
    return files.read_keyed(spark, path)


@query(f"""SELECT key, string_agg('"' || ident || '"', ',' ORDER BY ident) AS docs FROM (SELECT CAST(doc_id AS VARCHAR) AS ident, 'k"' || {KEY} AS key FROM documents) GROUP BY key HAVING count(*) BETWEEN 2 AND 100000""")
def files_clusters(spark, sf_dir):
    """Clusters as JSON lines; keys with a quote come back."""
    rows = keyed(spark, sf_dir).withColumns({"key": F.concat(F.lit('k"'), "key"), "doc": F.concat(F.lit('"'), "ident", F.lit('"'))})
    path = tables.shared_folder(spark, "clusters")
    files.write_clusters(cluster.cluster(rows), path)
    return files.read_clusters(spark, path).select("key", F.array_join("docs", ",").alias("docs"))


_NAMES = {n.lower(): n for n in files.REASONS}
_CASES = list(dict.fromkeys((s, r) for _, s, r in verify.RULES))


@query(f"""WITH names AS (SELECT {duck.quote(" ".join(f"Status{s.capitalize()} Reason{_NAMES[r]}" for s, r in _CASES))} AS all_names)
  SELECT 'p' || p_partkey || ' r' || p_partkey || ' ' || split_part(all_names, ' ', 2 * (p_partkey % {len(_CASES)})::INT + 1) || ' ' || split_part(all_names, ' ', 2 * (p_partkey % {len(_CASES)})::INT + 2) AS value FROM part, names""")
def files_matches(spark, sf_dir):
    """A line for each verdict, with every status and reason that the cascade gives."""
    case = F.get(F.array(*[F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason")) for s, r in _CASES]), (c("p_partkey") % len(_CASES)).cast("int"))
    rows = t(spark, sf_dir, "part").select(F.concat(F.lit("p"), text_of("p_partkey")).alias("pivot_ident"), F.concat(F.lit("r"), text_of("p_partkey")).alias("ref_ident"), case.alias("v")).select("*", "v.*")
    path = tables.shared_folder(spark, "matches")
    files.write_matches(rows, path)
    return files.read_lines(spark, path)


@query(f"SELECT count(*) || chr(9) || count_if(ref) || chr(9) || count_if(NOT ref) || chr(9) || key AS value FROM (SELECT doc_id % 2 = 1 AS ref, {KEY} AS key FROM documents WHERE {KEY} <> '') GROUP BY key")
def files_stats(spark, sf_dir):
    path = tables.shared_folder(spark, "stats")
    files.write_stats(cluster.stats(keyed(spark, sf_dir).filter("key <> ''"), "count"), path)
    return files.read_lines(spark, path)


@query("""SELECT '{"biblio":{"container_name":"' || p_brand || '","contrib_raw_names":["' || p_brand || '","' || p_type || '"],"doi":"10.55/' || l_partkey || '","pmid":"' || l_suppkey || '","title":"' || p_name || '"},"index":' || l_linenumber || ',"key":"' || l_orderkey || '","release_year":' || (900 + l_partkey % 1200) || ',"release_ident":"' || l_orderkey || '"}' AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey""")
def json_encode(spark, sf_dir):
    """References as JSON lines, without what is empty at any depth."""
    path = tables.shared_folder(spark, "json")
    files.write_json(_refs(spark, sf_dir), path)
    return files.read_lines(spark, path)


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS ident, p_name AS title, '10.55/' || l_partkey AS doi, CAST(l_suppkey AS VARCHAR) AS pmid, CASE WHEN 900 + l_partkey % 1200 > 1000 THEN 900 + l_partkey % 1200 ELSE 0 END AS year,
  p_brand || ';' || p_type AS authors, 'ref' AS mark_status, CAST(l_linenumber AS BIGINT) AS ref_index, CAST(l_orderkey AS VARCHAR) AS ref_key FROM lineitem JOIN part ON l_partkey = p_partkey""")
def flatten_releases(spark, sf_dir):
    """References converted to releases under another marker, written as JSON, decoded, and flattened to what the cascade reads."""
    marker = "origin"
    path = tables.shared_folder(spark, "releases")
    files.write_json(convert.ref_to_release(_refs(spark, sf_dir), marker), path)
    rows = verify.flatten(files.read_json(spark, path, schemas.release_fields(marker)), marker)
    return rows.select("ident", "title", "doi", "pmid", c("year").cast("long").alias("year"), F.array_join("authors", ";").alias("authors"), "mark_status", "ref_index", "ref_key")
