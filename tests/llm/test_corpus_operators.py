"""Dedup, joins and search across documents, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from colophon.llm import additive_quantisation, components, near_duplicates, substring_dedup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, block string, n_shingles int, root string"


def corpus(seed, n=120, words=60):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "bcdfg" for b in ("a", "eh", "ion", "ü")]
    rows = []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 4, 12, words, 3 * words]))]
        if rows and rng.random() < 0.5:
            other = WORD.findall(rng.choice(rows)[1] or "")
            w = other if rng.random() < 0.5 else w + other[rng.randrange(1 + len(other)) :]
            for _ in range(rng.randrange(3)):
                if w:
                    w = [*w]
                    w[rng.randrange(len(w))] = rng.choice(vocabulary).upper()
        rows.append((i * 3 % n, rng.choice([" ", "  ", "\n"]).join(w)))
    rows += [(5, None), (None, "alpha beta " * 30), (None, "alpha beta " * 30), (7, rows[0][1]), (7, rows[0][1]), (8, ""), (9, "aaaa " * 100), (10, "x" * 900)]
    return [(i, t, "b", 1, "r") for i, t in rows]


def in_order(rows, digest):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, digest(r[1])))


def brute(rows, tokens, window):
    """(tokens, mask) for each row, rows in the order of id; ties are in the order of the digest of their text."""
    seen, out = set(), []
    for r in in_order(rows, lambda t: hashlib.blake2b((t or "").encode(), digest_size=16).digest()[:8][::-1]):
        w = tokens(r[1] or "")
        mask = [False] * len(w)
        for a in range(len(w) - window + 1):
            k = bytes(w[a : a + window]) if isinstance(w, bytes) else tuple(w[a : a + window])
            if k in seen:
                mask[a : a + window] = [True] * window
            seen.add(k)
        out.append((r[0], w, mask))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, KIND)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256, r.text) for r in substring_dedup.dedup_substrings(docs).collect())
    want = []
    for i, w, mask in brute(rows, WORD.findall, 20):
        kept = " ".join(x for x, m in zip(w, mask) if not m)
        want.append((str(i), len(w), sum(mask), hashlib.sha256(kept.encode()).hexdigest(), kept))
    assert got == sorted(want)


@pytest.mark.parametrize("seed", [3, 4])
def test_suffix_dedup(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, KIND)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_suffixes(docs).collect())
    want = []
    for i, b, mask in brute(rows, str.encode, 100):
        spans = sum(m and (k == 0 or not mask[k - 1]) for k, m in enumerate(mask))
        want.append((str(i), len(b), sum(mask), spans, hashlib.sha256(bytes(x for x, m in zip(b, mask) if not m)).hexdigest()))
    assert got == sorted(want)


def test_salted_anchors(spark, monkeypatch):
    """An anchor that very many documents share is split over salts."""
    from colophon.llm import repeats

    monkeypatch.setattr(repeats, "SALT_ROWS", 4)
    rng = random.Random(9)
    line = " ".join(f"common{k}" for k in range(30))
    rows = [(i, " ".join([f"l{rng.randrange(4)}", line, f"r{rng.randrange(9)}", *[f"own{i}x{k}" for k in range(30)]]), "b", 1, "r") for i in range(60)]
    docs = spark.createDataFrame(rows, KIND).coalesce(1)
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(docs).collect()}
    assert got == {i: sum(m) for i, _, m in brute(rows, WORD.findall, 20)}
    got = {r.doc_id: r.n_removed for r in suffix_dedup.dedup_suffixes(docs).collect()}
    assert got == {i: sum(m) for i, _, m in brute(rows, str.encode, 100)}


def test_one_document_with_one_line(spark, monkeypatch):
    """An anchor that a single document holds very often is split too."""
    from colophon.llm import repeats

    monkeypatch.setattr(repeats, "SALT_ROWS", 4)
    rows = [(1, "the same line again and again, of some words\n" * 200, "b", 1, "r"), (2, "x " * 300 + "- " * 300, "b", 1, "r"), (3, "before " + "the same line again and again, of some words\n" * 9, "b", 1, "r")]
    docs = spark.createDataFrame(rows, KIND)
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(docs).collect()}
    assert got == {i: sum(m) for i, _, m in brute(rows, WORD.findall, 20)}
    got = {r.doc_id: r.n_removed for r in suffix_dedup.dedup_suffixes(docs).collect()}
    assert got == {i: sum(m) for i, _, m in brute(rows, str.encode, 100)}


def test_later_ones():
    from colophon.llm.repeats import LAST_ID, later_ones

    seen = {}
    assert later_ones([b"a", b"b", b"a", b"a"], [5, 7, 3, 9], seen) == [True, False, False, True]
    assert later_ones([b"a", b"b", b"c"], [1, 7, LAST_ID], seen) == [False, True, False]
    assert later_ones([b"a", b"c"], [2, LAST_ID], seen) == [True, True]


def thue_morse(letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(1024))


def test_long_words(spark):
    """Two words that a polynomial modulo 2**64 can't tell apart."""
    one, other = thue_morse("ab"), thue_morse("ba")
    rows = [(1, " ".join([one] * 10 + [f"w{k}" for k in range(10)]), "b", 1, "r"), (2, " ".join([other] * 10 + [f"w{k}" for k in range(10)]), "b", 1, "r"), (3, " ".join([one] * 10 + [f"w{k}" for k in range(10)]) + " x", "b", 1, "r")]
    docs = spark.createDataFrame(rows, KIND)
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(docs).collect()} == {1: 0, 2: 0, 3: 20}
    assert {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_too_many_tokens():
    from colophon.llm import repeats

    with pytest.raises(ValueError, match="too many"):
        repeats.anchored(substring_dedup_kind(), repeats.Tokens(np.lib.stride_tricks.as_strided(np.zeros(1, np.uint64), (1 << 28,), (0,)), np.array([1 << 28])))


def substring_dedup_kind():
    from colophon.llm import repeats

    return repeats.Kind(20, 8, repeats.word_tokens, substring_dedup.extended)


def star(n, rng):
    """A text and near copies of it, of which those with three edits link with nothing but by chance."""
    base = [f"b{k}" for k in range(150)]
    rows = []
    for i in range(n):
        w = list(base)
        for at in rng.sample(range(150), rng.choice([1, 3, 3, 3, 4])):
            w[at] = f"e{i}x{at}" if rng.random() < 0.8 else f"e{at}"
        rows.append((i, " ".join(w), "b", 1, "r"))
    return rows


def components_of(rows, percent=80):
    s = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {r[0]: find(i) for i, r in enumerate(rows)}


def test_near_copies_of_a_text_that_is_not_there(spark):
    rows = star(300, random.Random(12))
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, KIND)).collect()}
    assert got == components_of(rows)


def test_near_copies_make_no_square(spark, monkeypatch):
    """2,000 near copies: the pairs that are verified stay few beside the square."""
    rows, made = star(2000, random.Random(13)), []
    verified = near_duplicates._verified

    def counted(pairs, sets, percent):
        made.append(pairs.count())
        return verified(pairs, sets, percent)

    monkeypatch.setattr(near_duplicates, "_verified", counted)
    assert near_duplicates.near_duplicates(spark.createDataFrame(rows, KIND)).count() == 2000
    print(made)
    assert sum(made) < 2000 * 2000 / 40


def test_dedup_of_nothing(spark):
    docs = spark.createDataFrame(corpus(1), KIND).limit(0)
    assert substring_dedup.dedup_substrings(docs).count() == suffix_dedup.dedup_suffixes(docs).count() == near_duplicates.near_duplicates(docs).count() == 0


def test_deep_shallow():
    rng = random.Random(5)
    for _ in range(30):
        pool = list({bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(90, 140))) for _ in range(5)} | {b"", b"a", b"a\0", b"a\0\0"})
        strings = list({(rng.choice(pool) + rng.choice(pool))[rng.randrange(60) :][: rng.randrange(1, 160)] for _ in range(60)} | set(pool))
        order, common = suffix_dedup.deep_shallow(strings)
        out = [strings[i] for i in order]
        assert out == sorted(strings)
        for a, b, c in zip(out, out[1:], common[1:]):
            assert c == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize(("seed", "percent"), [(6, 80), (7, 50)])
def test_near_duplicates(spark, seed, percent):
    rows = corpus(seed, n=200)
    s = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), 1 << 62), r[0])
    want = sorted((str(r[0]), len(s[i]), str(least.get(find(i)) if s[i] else r[0])) for i, r in enumerate(rows))
    docs = spark.createDataFrame(rows, KIND)
    got = near_duplicates.near_duplicates(docs, percent=percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    kept = near_duplicates.keep_one(docs, percent=percent).collect()
    groups = {find(i) for i in range(len(rows)) if s[i]}
    assert len([r for r in kept if shingles(r.text)]) == len(groups)
    assert {r.doc_id for r in kept if shingles(r.text)} == {least.get(g) for g in groups}


def test_components(spark):
    rng = random.Random(8)
    links = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [(f"m{rng.randrange(60)}", f"m{rng.randrange(60)}") for _ in range(40)] + [("hub", f"s{i}") for i in range(50)] + [("x", "x"), (None, "y")]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a string, b string")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a and b and a != b:
            parent[find(a)] = find(b)
    assert set(got) == set(parent)
    for a in got:
        for b in got:
            assert (got[a] == got[b]) == (find(a) == find(b))


def test_nearest(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    v = (centres[rng.integers(0, 20, 3000)] + 0.3 * rng.normal(size=(3000, 16))).astype(np.float32)
    v[100:140] = v[0]
    rows = [(int(i), x.tolist(), "k") for i, x in enumerate(v)] + [(5000, None, "k"), (5050, [0.0] * 16, "k"), (5100, [1.0, None] + [0.0] * 14, "k"), (5150, [float("nan")] * 16, "k"), (5200, [1.0] * 3, "k"), (None, [1.0] * 16, "k"), (50, v[50].tolist(), "k")]
    got = additive_quantisation.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, key string")).collect()
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(range(0, 3000, 50))
    hits = 0
    for q, rs in found.items():
        s = unit @ unit[q]
        s[q] = -2
        best = np.lexsort((np.arange(3000), -np.round(s, 12)))[:5]
        rs.sort()
        assert [r[0] for r in rs] == [1, 2, 3, 4, 5] and all(a[2] >= b[2] for a, b in zip(rs, rs[1:]))
        assert all(abs(r[2] - s[r[1]]) < 1e-12 for r in rs)
        hits += len({r[1] for r in rs} & set(best.tolist()))
    assert hits / (5 * len(found)) >= 0.9
    assert [r[1] for r in sorted(found[0])] == [100, 101, 102, 103, 104]
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>, key string")
    assert additive_quantisation.nearest(few).count() == 2
    assert additive_quantisation.nearest(few.limit(0)).count() == 0


def test_nearest_misses_none(spark):
    """Near copies whose codes are equal, and directions without structure: all are found, in order, with few to rerank."""
    rng = np.random.default_rng(8)
    copies = rng.normal(size=16) + 1e-4 * rng.normal(size=(1500, 16))
    v = np.concatenate([copies, rng.normal(size=(1500, 16))])[rng.permutation(3000)]
    v[700] = 1e200 * v[50]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(additive_quantisation.nearest(df, rerank=32, block=50_000).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    unit = v / np.abs(v).max(1)[:, None]
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    for q in range(0, 3000, 50):
        s = unit @ unit[q]
        s[q] = -2
        assert got[q] == np.lexsort((np.arange(3000), -s))[:5].tolist()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage = prose(60)
    rows = [(i, prose(80) + "\n" + prose(20), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(100 + i, rows[i][1], "en", "s1", 1) for i in range(5)] + [(200 + i, prose(60) + "\n" + passage, "en", "s2", 1) for i in range(4)]
    rows += [(300, "too short", "en", "s0", 1), (301, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept, seen = [], []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id: r for r in docs.collect()})
        kept.append(set(seen[-1]))
    clean = set(range(40)) | set(range(200, 204))
    assert kept[0] == clean | set(range(100, 105))
    assert kept[1] == clean == kept[2]
    assert [len(WORD.findall(seen[2][i].text)) for i in (0, 200, 201, 203)] == [100, 120, 60, 60]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and {r.doc_id for r in out.collect()} == kept[3]
    assert out.filter(F.col("n_tokens") == 0).count() == 0


def test_pipeline_of_odd_tables(spark, tmp_path):
    """An empty table, columns named like results, a long text, nulls."""
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int, clean_text string, ids string, other0 int"
    spark.createDataFrame([], kind).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(i, long if i == 1 else " ".join(f"v{i}x{k}" for k in range(90)), "en", "s", 1, "mine", i or 0, "own", "own", 5) for i in [*range(6), None]] + [(7, None, None, None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "odd" / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in kind.split(", ")]
        got = docs.collect()
        assert {(r.kept, r.clean_text, r.ids, r.other0) for r in got} == {("mine", "own", "own", 5)}
        assert all(r.n_words == (r.doc_id or 0) and r.n_chars == len(r.text) for r in got)
        if k < 3:
            assert {r.doc_id for r in got} == {*range(6), None}
        docs.write.parquet(str(tmp_path / f"odd{k}"))
        docs = spark.read.parquet(str(tmp_path / f"odd{k}"))
