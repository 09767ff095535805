"""Key tables, reduction, title tables, rejects, sketches, pairs, candidates, the edge store, and names in files."""

import itertools
import json
import random

import pytest
from pyspark.sql import Observation, Row
from pyspark.sql import functions as F

from colophon.functions.blacklist import Blacklist, contains_any, load, pattern_of, title_table
from colophon.functions.keys import KEYS
from colophon.operators import cluster, convert, hot, match, pairs, reduce, verify
from colophon.plans.scenarios import DEFAULTS
from colophon.sources import edges, files, rejects, schemas, tables
from colophon.streaming import lines as streams

RELEASES = "key string, ident string, doc string, work_id string"
REFS = "key string, release_ident string, work_ident string, release_stage string, release_year int, index bigint, ref_key string"
KIND = "ident string, work_id string, title string, container_id string, extra_container_name string, doi string, pmid string, arxiv string, jstor string, release_type string, year int, pages string, subtitles array<string>, crossref_type string, metadata_version int, relations int, related array<string>, authors array<string>"


def plan_of(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def edge(df):
    return sorted(map(tuple, df.select("source_release_ident", "ref_index", "target_release_ident", "target_work_ident").collect()))


def some_tables(spark, tmp_path, n=400):
    left, right = (tables.key_table(spark, c, 4, path=None) for c in (RELEASES, REFS))
    releases = spark.createDataFrame([(f"k{i % 40}" if i % 11 else "", f"r{i:04}", f"d{i % 3}", f"w{i}") for i in range(n)], RELEASES)
    refs = spark.createDataFrame([("k7" if i % 3 else f"k{i % 60}", f"s{i}", "", "", 2000, i, "x") for i in range(3 * n)], REFS)
    return left, right, releases, refs


def test_zip_of_tables(spark, tmp_path):
    left, right, releases, refs = some_tables(spark, tmp_path)
    left.write_day(releases, "2020-01-01")
    right.write_day(refs.filter("index < 500"), "2020-01-01")
    found = match.zip_tables(match.zip_exact, left, right, reason="doi")
    # no Exchange above either scan, also where nothing is broadcast
    keys = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        for df in (found, match.zip_tables_groups(left, tables.key_table(spark, RELEASES, 4, path=left.path))):
            plan = plan_of(df)
            assert "Exchange" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan
    finally:
        for k in keys:
            spark.conf.unset(k)
    assert edge(found) == edge(match.zip_exact(releases, refs.filter("index < 500"), reason="doi"))


def test_days_of_a_table(spark, tmp_path):
    """A new day is added, and a day written again, without touching the files of others; another session finds the table by its folder."""
    left, right, releases, refs = some_tables(spark, tmp_path)
    files_of = lambda: {r[0] for r in right.files().select(F.input_file_name()).distinct().collect()}
    right.write_day(refs.filter("index < 500"), "a")
    first = files_of()
    right.write_day(refs.filter("index >= 500"), "b")
    both = files_of()
    assert first < both and right.days() == ["a", "b"] and right.rows().count() == refs.count()
    right.write_day(refs.filter("index >= 500"), "b")
    assert first < files_of() and right.rows().count() == refs.count()
    again = tables.key_table(spark, REFS, 4, path=right.path)
    assert sorted(map(tuple, again.rows().collect())) == sorted(map(tuple, refs.collect()))
    right.drop()
    left.write_day(releases, "a")
    assert edge(match.zip_tables(match.zip_exact, left, again)) == edge(match.zip_exact(releases, refs))


def test_hot_keys_of_a_zip(spark, tmp_path):
    left, right, releases, refs = some_tables(spark, tmp_path)
    left.write_day(releases, "a")
    right.write_day(refs, "a")
    found = match.common_keys(right.rows(), 10)
    assert found == ["k7"]
    assert edge(match.zip_tables(match.zip_exact, left, right, found)) == edge(match.zip_exact(releases, refs))


def test_zip_groups_in_one_pass(spark):
    rows = spark.createDataFrame([("a", "2"), ("a", "1"), ("b", "3"), ("", "4")], "key string, doc string")
    got = match.zip_groups(rows, rows.filter("key <> 'b'"))
    assert [tuple(r) for r in got.collect()] == [("a", ["1", "2"], ["1", "2"])]
    assert plan_of(got).partition("Initial Plan")[0].count("Exchange ") == 1


# --- reduction -----------------------------------------------------------------------------------------------------------
def test_bloom_filter(spark):
    keys, rows = spark.range(0, 20_000).select(F.col("id").cast("string").alias("key")), spark.range(0, 200_000).select(F.col("id").cast("string").alias("key"))
    for error in (0.1, 0.01):
        kept = reduce.semi_reduce(rows, keys, error)
        n = kept.count()
        assert kept.join(keys, "key", "left_semi").count() == 20_000
        assert n - 20_000 < 1.5 * error * 180_000, (n, error)
    words, bits = reduce.shape(20_000, 0.01)
    assert reduce.error_rate(20_000 / words, bits) <= 0.01 < reduce.error_rate(20_000 / (words * 0.9), bits)
    # too large a filter: all rows stay; no keys: none do
    assert reduce.semi_reduce(rows, keys, 0.01, most_words=100).count() == 200_000
    assert reduce.semi_reduce(rows, keys.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None,), ("1",)], "key string")
    assert [r.key for r in reduce.semi_reduce(nulls, keys).collect()] == ["1"]


def records(spark, rows):
    """(key, ident, title, ...) as the inputs of the cascade."""
    made = [(r.pop("key"), json.dumps(r), "published", 0, "", *{**DEFAULTS, **r}.values()) for r in ({**r} for r in rows)]
    return spark.createDataFrame(made, "key string, doc string, release_stage string, ref_index long, ref_key string, " + KIND)


def test_features_of_matched_references_alone(spark):
    releases = records(spark, [{"key": f"k{i}", "ident": f"r{i}", "title": f"The Lakes of the North {i}", "authors": ["Ann Lee"]} for i in range(200)])
    refs = records(spark, [{"key": f"k{i}", "ident": f"s{i}", "title": f"The lakes of the north {i}", "authors": ["Ann Lee"]} for i in range(100, 5000)])
    seen = Observation()
    got = match.zip_verify_reduced(releases, refs, seen=seen)
    rows = lambda df: sorted(map(tuple, df.drop("update_ts").collect()))
    found = rows(got)
    assert found == rows(match.zip_verify(releases, refs)) and len(found) == 100
    assert 100 <= seen.get["n"] <= 100 + 0.03 * 4800


# --- titles and fragments --------------------------------------------------------------------------------------------------
def test_title_table(spark):
    listed = spark.createDataFrame([("editorial",), ("editorial",), (None,), ("cover",)], "title string")
    rows = spark.createDataFrame([(1, "editorial"), (2, "Cover"), (3, None), (4, "the cover"), (5, "cover")], "i int, title_lower string")
    for size in (1 << 20, 0):
        table = title_table(listed, broadcast=size)
        assert table.small == (size > 0)
        got = Blacklist(titles=table).mark(rows).orderBy("i").collect()
        assert [r.blacklisted for r in got] == [True, False, False, False, True]
    few, many = load(listed), load(listed, most=1)
    assert few.titles == {"editorial", "cover"}
    one = {"ident": "a", "title": "Editorial", "key": "k"}
    for black in (few, many):
        f = verify.features(records(spark, [one]), black)
        assert f.first().blacklisted and not f.first().fragment
        pair = verify.as_struct(f, "a", "key").join(verify.as_struct(f, "b", "key"), "key")
        assert verify.verify_pairs(pair).first().reason == "blacklisted"


def test_one_search_for_many_parts(spark):
    rng = random.Random(3)
    parts = {"".join(rng.choices("ab.|(", k=rng.randrange(1, 5))) for _ in range(30)} | {"\\E", "a+b", "é x"}
    texts = ["".join(rng.choices("ab.|(+\\Eé x", k=rng.randrange(9))) for _ in range(800)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for few in (parts, list(parts)[:3], ["b|a"]):
        got = {r.i: r.v for r in df.select("i", contains_any(F.col("t"), few).alias("v")).collect()}
        assert got == {i: any(p in t for p in few) for i, t in enumerate(texts)}
    assert not df.filter(contains_any(F.col("t"), [])).count() and df.filter(contains_any(F.col("t"), ["", "q"])).count() == len(texts)
    assert pattern_of(["records of meetings", "records of men"]).count("records") == 1


# --- rejects ---------------------------------------------------------------------------------------------------------------
FIELDS = "ident string, title string, year bigint"
LINES = ['{"ident":"1","title":"t","year":3}', "", "  ", '{"ident":"2"', "[1]", '"x"', "7", '{"ident":"3","title":"t","year":"soon"}', '{"title":"t"}', '{"ident":"4","title":null}', "not json"]
CAUSES = ["syntax", "no object", "no object", "no object", "field type", "no ident", "no title", "syntax"]


def judged_rows(df):
    return sorted((r.doc, r.cause) for r in rejects.rejected(df).collect())


def test_rejects(spark, tmp_path):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    judged = rejects.judge(lines, FIELDS, rejects.UNUSABLE)
    want = sorted(zip([x for x in LINES[3:]], CAUSES))
    assert judged_rows(judged) == want
    path = str(tmp_path / "out")
    assert rejects.write_judged(judged, path) == (9, 8)
    back = rejects.read_judged(spark, path, FIELDS)
    assert judged_rows(back) == want
    assert [(r.ident, r.title, r.year, r.doc) for r in rejects.good(back).collect()] == [("1", "t", 3, LINES[0])]
    assert "PartitionFilters: [isnotnull(is_reject" in plan_of(rejects.good(back))
    with pytest.raises(rejects.TooManyRejects) as e:
        rejects.write_judged(judged, path, most_share=0.5, least=2)
    assert (e.value.rejects, e.value.lines) == (8, 9)
    assert rejects.write_judged(judged, path, most_share=0.5, least=8) == (9, 8)
    # what is good without rules is what decode gives
    plain = rejects.good(rejects.judge(lines, FIELDS))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, schemas.decode(lines, FIELDS).collect()))
    assert rejects.write_judged(rejects.judge(lines.limit(0), FIELDS), str(tmp_path / "none"), 0.0) == (0, 0)


def test_rejects_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(LINES[k::2]))
    judged = rejects.judge(streams.read_line_stream(spark, str(tmp_path / "in"), 1), FIELDS, rejects.UNUSABLE)
    rejects.write_judged_stream(judged, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    both = [rejects.read_judged(spark, str(tmp_path / "out" / f"batch={k}"), FIELDS) for k in range(2)]
    assert judged_rows(both[0].union(both[1])) == sorted(zip(LINES[3:], CAUSES))


# --- common keys -------------------------------------------------------------------------------------------------------------
def test_common_keys_stay_home(spark):
    """One key of a million rows: none of its documents is shuffled."""
    n = F.col("id")
    rows = spark.range(1_000_600).select(F.when(n < 1_000_000, "hot").otherwise(F.concat(F.lit("k"), (n % 250).cast("string"))).alias("key"), n.cast("string").alias("ident"), n.cast("string").alias("doc"), (n % 2 == 1).alias("ref"))
    seen = Observation()
    got = cluster.cluster_apart(rows, most=100_000, seen=seen)
    plain = lambda df: sorted((r.key, r.n, r.idents) for r in df.collect())
    small = rows.filter("key <> 'hot'")
    assert plain(got) == plain(cluster.cluster(small))
    assert seen.get["n"] == 600
    assert [tuple(r) for r in hot.hot_keys(rows, 100_000).collect()] == [("hot", 1_000_000)]


def test_sketches_add_up(spark):
    rows = spark.createDataFrame([(f"k{i % 7}",) for i in range(70)] + [("x",)] * 30 + [(None,)] * 5, "key string")
    parts = [rows.limit(40), rows.subtract(rows.limit(0)).limit(0).union(rows).filter("key = 'x'")]
    merged = hot.merge(*[hot.sketch(p, width=8) for p in parts])
    whole = hot.sketch(parts[0].union(parts[1]), width=8)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))
    # with few counters many keys share one: the answer stays exact
    for width in (1, 2, 64):
        assert sorted(map(tuple, hot.hot_keys(rows, 9, width=width).collect())) == [("k0", 10), ("k1", 10), ("k2", 10), ("k3", 10), ("k4", 10), ("k5", 10), ("k6", 10), ("x", 30)]
    assert hot.hot_keys(rows, 30).collect() == []
    assert hot.total(hot.sketch(rows)) == 105


# --- pairs -------------------------------------------------------------------------------------------------------------------
def test_neighbours(spark):
    rng = random.Random(2)
    rows = [(f"k{rng.choice([0, 0, 0, 1, 2, rng.randrange(30)])}", f"{i:03}", f"d{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "key string, ident string, doc string").repartition(5)
    for window in (1, 2, 5, 300):
        got = sorted((r.key, r.a.ident, r.b.ident) for r in pairs.neighbours(df, window, "ident", "doc").collect())
        want = []
        for k, members in itertools.groupby(sorted(rows), key=lambda r: r[0]):
            idents = [m[1] for m in members]
            want += [(k, idents[i], idents[j]) for i in range(len(idents)) for j in range(i + 1, min(i + window, len(idents)))]
        assert got == sorted(want), window


def test_neighbours_of_a_common_key(spark):
    """100,000 members of one key: each meets its neighbours, over the borders of ranges too."""
    rows = spark.range(100_000).select(F.lit("k").alias("key"), F.format_string("%06d", "id").alias("ident"))
    got = pairs.neighbours(rows, 3, "ident")
    apart = F.col("b.ident").cast("int") - F.col("a.ident").cast("int")
    assert {tuple(r) for r in got.groupBy(apart.alias("d")).count().collect()} == {(1, 99_999), (2, 99_998)}


def test_candidates(spark):
    rng = random.Random(7)
    words = ["Lake", "lake", "Lakes", "Läke", "the", "Knight", "night", "x", "!!"]
    rows = [(f"{i:03}", " ".join(rng.choices(words, k=rng.randrange(3))), f"d{i}") for i in range(160)] + [("000", None, "again")]
    df = spark.createDataFrame(rows, "ident string, title string, doc string")
    releases, refs = df.filter("CAST(ident AS INT) % 2 = 0"), df.filter("CAST(ident AS INT) % 2 = 1")
    kinds = tuple(KEYS)
    got = sorted((r.kind, r.a.ident, r.a.doc, r.b.ident) for r in pairs.candidates(releases, refs).collect())
    want: dict = {}
    keyed = lambda d: [(r.ident, r.doc, r["keys"]) for r in pairs.with_keys(d).collect()]
    left, right = keyed(releases), keyed(refs)
    for k in range(len(kinds)):
        first: dict = {}
        for i, d, ks in sorted(left):
            first.setdefault(ks[k], (i, d))
        for i, _, ks in right:
            if ks[k] and ks[k] in first:
                want.setdefault((*first[ks[k]], i), k)
    assert got == sorted((k, *pair) for pair, k in want.items())
    assert {k for k, *_ in got} >= {0, 1}


def test_verified_candidates(spark):
    release = {"ident": "a", "title": "The Lakes of the North", "authors": ["Ann Lee"]}
    refs = [{"ident": "b", "title": "The lakes, of the north!", "authors": ["Ann Lee"]}, {"ident": "c", "title": "Rivers"}]
    made = lambda rows: records(spark, [{**r, "key": ""} for r in rows]).drop("key")
    got = pairs.verify_candidates(made([release]), made(refs)).collect()
    assert [(r.kind, r.a.ident, r.b.ident, r.status) for r in got] == [(1, "a", "b", "strong")]


# --- edges -------------------------------------------------------------------------------------------------------------------
def some_edges(spark, ids, at, target):
    rows = spark.createDataFrame([(i,) for i in ids], "i string")
    return rows.select(*convert.biblioref(_id=F.col("i"), update_ts=F.lit(at), target_release_ident=F.lit(target)))


def latest(store):
    return sorted((r["_id"], r.update_ts, r.target_release_ident) for r in store.read().collect())


def test_edge_store(spark, tmp_path):
    store = edges.EdgeStore(spark, str(tmp_path / "edges"), 4)
    assert latest(store) == []
    store.upsert(some_edges(spark, [], 1, "x"))
    a, b = some_edges(spark, ["1", "2", "3"], 10, "a"), some_edges(spark, ["2", "3", "4"], 20, "b")
    store.upsert(a)
    store.upsert(b)
    want = [("1", 10, "a"), ("2", 20, "b"), ("3", 20, "b"), ("4", 20, "b")]
    assert latest(store) == want
    # runs again, late ones and ties change nothing that isn't newer
    store.upsert(a)
    store.upsert(b.union(b))
    assert latest(store) == want
    one = edges.EdgeStore(spark, str(tmp_path / "one"), 4)
    one.upsert(b.union(a))
    assert latest(one) == want
    for order in (("t", "u"), ("u", "t")):
        tied = edges.EdgeStore(spark, str(tmp_path / f"tied{order[0]}"), 2)
        for x in order:
            tied.upsert(some_edges(spark, ["1"], 5, x))
        assert len(latest(tied)) == 1
    assert latest(edges.EdgeStore(spark, str(tmp_path / "tiedt"), 2)) == latest(edges.EdgeStore(spark, str(tmp_path / "tiedu"), 2))


def test_an_upsert_leaves_other_buckets(spark, tmp_path):
    store = edges.EdgeStore(spark, str(tmp_path / "edges"), 8)
    store.upsert(some_edges(spark, [str(i) for i in range(100)], 1, "a"))
    names = lambda: {p.parent.name: p.name for p in (tmp_path / "edges").rglob("part-*.parquet")}
    before = names()
    store.upsert(some_edges(spark, ["7"], 2, "b"))
    after = names()
    assert len(before) == 8 and sum(before[k] != after[k] for k in before) == 1


def test_edges_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, (ids, at) in enumerate([(["1", "2"], 10), (["2", "3"], 20)]):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"i": i, "at": at}) for i in ids))
    lines = streams.read_line_stream(spark, str(tmp_path / "in"), 1)
    rows = schemas.decode(lines, "i string, at bigint").select(*convert.biblioref(_id=F.col("i"), update_ts=F.col("at"), target_release_ident=F.lit("t")))
    store = edges.EdgeStore(spark, str(tmp_path / "edges"), 2)
    streams.upsert_stream(rows, store, str(tmp_path / "cp")).awaitTermination()
    assert latest(store) == [("1", 10, "t"), ("2", 20, "t"), ("3", 20, "t")]


# --- names and files ---------------------------------------------------------------------------------------------------------
def test_every_reason_has_its_name(spark, tmp_path):
    given = list(dict.fromkeys((s, r) for _, s, r in verify.RULES)) + [verify.DEFAULT]
    names = {n.lower(): n for n in files.REASONS}
    assert len(files.REASONS) == len(names) == 48 and {r for _, r in given} <= set(names)
    rows = spark.createDataFrame([Row(pivot_ident=f"p{i}", ref_ident="r", status=s, reason=r) for i, (s, r) in enumerate(given)])
    files.write_matches(rows, str(tmp_path / "m"))
    lines = {r.value for r in spark.read.text(str(tmp_path / "m")).collect()}
    assert lines == {f"p{i} r Status{s.capitalize()} Reason{names[r]}" for i, (s, r) in enumerate(given)}
    assert {(r.status, r.reason) for r in files.read_matches(spark, str(tmp_path / "m")).collect()} == set(given)


def test_marker_of_another_source(spark):
    line = json.dumps({"ident": "a", "title": "T", "extra": {"origin": {"status": "ref", "ref": {"index": 4, "key": "k"}}}})
    rows = schemas.decode(spark.createDataFrame([(line,)], "value string"), schemas.release_fields("origin"))
    r = verify.flatten(rows, "origin").first()
    assert (r.mark_status, r.ref_index, r.ref_key) == ("ref", 4, "k")
    assert schemas.struct_type(schemas.release_fields()) == schemas.struct_type(schemas.RELEASE)
