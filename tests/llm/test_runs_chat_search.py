"""Periodic runs, chat formatting and ranked search, against brute force."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from colophon.llm import chat_format, periodic_runs, queries, ranked_search
from colophon.llm.oracles import ORACLES

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# --- periodic runs -----------------------------------------------------------------------------------------------------
def brute_runs(w, least=6, times=4):
    """(start, length, period) of all runs, by trying every period at every place."""
    n, out = len(w), []
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j + p - i
            if j > i and length >= max(least, times * p) and not any(all(w[x] == w[x + q] for x in range(i, i + length - q)) for q in range(1, p)):
                out.append((i, length, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def described(text):
    w = WORD.findall(text or "")
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept), kept


def repetitive(rng):
    w = []
    for _ in range(rng.randrange(5)):
        w += [rng.choice("abcd") for _ in range(rng.randrange(1, 6))] * rng.randrange(1, 9) + [rng.choice("ab") for _ in range(rng.randrange(3))]
    return rng.choice([" ", "\n", " \t "]).join(w)


@pytest.mark.parametrize("seed", range(4))
def test_runs(seed):
    rng = random.Random(seed)
    texts = [None, "", " \n", *[repetitive(rng) for _ in range(60)]]
    assert periodic_runs.describe_texts(texts) == [described(t) for t in texts]


def test_runs_in_blocks(monkeypatch):
    """Few candidates at a time, also fewer than one period has."""
    monkeypatch.setattr(periodic_runs, "BLOCK", 3)
    rng = random.Random(5)
    texts = [repetitive(rng) for _ in range(8)]
    assert periodic_runs.describe_texts(texts) == [described(t) for t in texts]


def test_other_limits():
    rng = random.Random(6)
    for least, times in ((1, 2), (9, 2), (4, 3)):
        w = WORD.findall(repetitive(rng) + " " + repetitive(rng))
        got = periodic_runs.find_runs(np.array([ord(x) for x in w]), np.array([len(w)]), least, times)
        assert [tuple(r) for r in got[:, 1:].tolist()] == brute_runs(w, least, times)


def test_long_texts():
    assert periodic_runs.describe_texts(["a " * 300_000])[0][:5] == (1, 0, 300_000, 1, 300_000_000)
    turning = " ".join(str(i % 5000) for i in range(100_000))
    assert periodic_runs.describe_texts([turning, "x"])[0][:5] == (1, 0, 100_000, 5000, 20_000)
    # a Fibonacci word: very many runs under times = 2
    a, b = "a", "ab"
    while len(b) < 400:
        a, b = b, b + a
    got = periodic_runs.find_runs(np.array([ord(x) for x in b]), np.array([len(b)]), 2, 2)
    assert [tuple(r) for r in got[:, 1:].tolist()] == brute_runs(b, 2, 2)


def test_runs_of_odd_tables(spark):
    rows = [(1, "a " * 9, "x", 1), (1, "a " * 9, "x", 1), (None, "b c " * 5, "x", 1), (2, None, None, None), (3, "", "x", 1), (4, " ".join(f"w{k % 700}" for k in range(60_000)), "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs string, __runs int")
    got = periodic_runs.periodic_runs(docs)
    assert got.columns == docs.columns
    out = {(r.doc_id, r.n_runs, *r["__runs"][:7]) for r in got.collect()}
    assert out == {(i, n, *described(t)[:7]) for i, t, n, _ in rows[:5]} | {(4, "x", 1, 0, 60_000, 700, 85_714, sha("0,60000,700\n"), sha(" ".join(f"w{k}" for k in range(700))))}
    assert got.count() == len(rows)
    assert periodic_runs.periodic_runs(docs.limit(0)).collect() == []


def planted(i, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(i).encode())
    if h % 10 or not w:
        return text
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(w[:a] + [w[a + (i - a) % p] for i in range(a, n)])


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_op12(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in rows if len(r.text or "") < 3000]  # the brute force takes the cube of a text's words
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, FOLDER).collect()}
    assert len(got) == len(rows) and len(short) > 60
    for r in short:
        assert got[r.doc_id] == described(planted(r.doc_id, r.text))[:7], r.doc_id
    docs = spark.createDataFrame([(i, t) for i in range(300, 340) for t in ("a b c d e f g h i j k l m", "x", "", None)], "doc_id long, text string")
    assert [tuple(r) for r in periodic_runs.planted(docs).collect()] == [(i, planted(i, t)) for i, t in map(tuple, docs.collect())]


# --- chat formatting ---------------------------------------------------------------------------------------------------
BITS = ["[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "</s>", "<<ROLE ", "<</ROLE>>", ">>", "\\", "\\[", "\\\\", "<", "[", "/", " ok ", "\n", "é", "😀", ">"]


def odd_text(rng):
    return "".join(rng.choice(BITS) for _ in range(rng.randrange(8)))


@pytest.mark.parametrize("seed", range(3))
def test_round_trip(seed):
    rng = random.Random(seed)
    for _ in range(400):
        turns = [(rng.choice(["user", "assistant", "system", "", "tool", odd_text(rng)]), odd_text(rng)) for _ in range(rng.randrange(1, 7))]
        text, mask = chat_format.format_turns(turns)
        assert [(role, chat_format.unescape(text[a:b])) for role, a, b in chat_format.parse(text)] == turns
        assert [chat_format.unescape(text[a:b]) for a, b in mask] == [t for role, t in turns if role == "assistant"]


def test_only_conflicts_are_escaped():
    plain = [("user", r"C:\new [1] <b> a >> b"), ("assistant", r"\n is a newline, \x too")]
    assert chat_format.format_turns(plain) == (r"[INST]C:\new [1] <b> a >> b[/INST]\n is a newline, \x too</s>", [(34, 57)])
    both = "</s>[INST] ok [/INST]"
    assert chat_format.format_turns([("user", both)])[0] == r"[INST]\</s>\[INST] ok \[/INST][/INST]"
    assert chat_format.format_turns([("user", "a\\")])[0] == "[INST]a\\\\[/INST]"
    for broken in ("[INST]a", "a</s>b", "[INST]a</s>", "<<ROLE x", "a[/INST]</s>"):
        with pytest.raises(chat_format.Malformed):
            list(chat_format.parse(broken))


def digests(rows):
    """By conversation: what read_back gives but for formatted_chars."""
    hashed = lambda t: t or ""
    out = {}
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", hashed(r[3])) for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))]
        said = "".join(t for role, t in turns if role == "assistant")
        out[c] = len(turns), sha("".join(f"{role}\n{t}\n" for role, t in turns)), len(said), sha(said)
    return out


def test_conversations(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None]), rng.choice([odd_text(rng), "plain", None, ""])) for c in [*range(40), None] for t in range(rng.randrange(1, 9))]
    rows += [(7, 0, rows[0][2], rows[0][3])]
    rows += [(50, None, "user", "last"), (50, 3, "assistant", "long " * 60_000), (50, -1, "system", "first"), (51, 1, "user", "twice"), (51, 1, "user", "twice")]
    rng.shuffle(rows)
    # ties of turn and role are in the order of a hash: here each (conversation, turn, role) has one text
    rows = list({(r[0], r[1], r[2]): r for r in rows}.values()) + [(51, 1, "user", "twice")]
    docs = spark.createDataFrame([(*r, "p", 1) for r in rows], "conv_id long, turn long, role string, text string, piece string, edge int").repartition(4)
    made = chat_format.format_conversations(docs)
    got = {r.conv_id: tuple(r)[1:] for r in chat_format.read_back(made).collect()}
    assert {k: v[:4] for k, v in got.items()} == digests(rows)
    chars = Counter()
    for r in made.collect():
        chars[r.conv_id] += len(r.formatted)
    assert {k: v[4] for k, v in got.items()} == chars
    assert chat_format.read_back(chat_format.format_conversations(docs.limit(0))).collect() == []


def test_pieces_of_a_conversation(spark, monkeypatch):
    """A conversation larger than a piece comes in several, each of bounded size; they meet again in order."""
    turns = [(1, "user" if i % 2 else "assistant", f"</s> {i}") for i in range(50)] + [(2, "user", "x")] + [(3, "assistant", "y")]
    monkeypatch.setattr(chat_format, "PIECE_TURNS", 8)
    rows = list(chat_format._format(iter(turns), 5))
    assert [r[0] for r in rows] == [1] * 7 + [2, 3] and [r[3] for r in rows] == [8] * 6 + [2, 1, 1]
    assert [r[2] for r in rows] == [True] * 7 + [False, True] and [r[1] for r in rows] == list(range(5, 14))
    made = spark.createDataFrame([(*r[:4], r[4], r[5]) for r in rows], chat_format.FORMATTED).repartition(5)
    got = {r.conv_id: tuple(r)[1:5] for r in chat_format.read_back(made).collect()}
    assert got == digests([(c, i, role, t) for i, (c, role, t) in enumerate(turns)])


# --- ranked search -----------------------------------------------------------------------------------------------------
def fold(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def best(docs, items, k=10):
    """(item, rank, doc, score) by scoring every document for every item."""
    d = [(i, fold(t)) for i, t in docs]
    d = [(i, w, Counter(w)) for i, w in d if w]
    n, total = len(d), sum(len(w) for _, w, _ in d)
    df = Counter(t for _, _, c in d for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(fold(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, w, c in d:
            m = 10 + 90 * len(w) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out)


def library(seed, n=90):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("Al", "be", "ça", "d9", "é") for b in ("x", "Y", "漢", "")]
    text = lambda: rng.choice([" ", "-", "\u00a0 "]).join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.choice([0, 1, 3, 10, 40])))
    docs = [(i * 7 % n, text()) for i in range(n)]
    docs += [(5, docs[0][1]), (5, docs[0][1]), (None, "al alx bex"), (None, "al alx bex"), (200, None), (201, "--- !!"), (202, "zz " * 30_000), *[(300 + i, "the same text alx") for i in range(40)]]
    items = [(i, text()) for i in range(12)] + [(3, "alx again"), (20, None), (21, "!!"), (22, "unheardof"), (23, "ZZ zz"), (None, "alx"), (24, "the same text")]
    return docs, items


@pytest.mark.parametrize(("seed", "shard", "broadcast"), [(1, 8, None), (2, 1000, None), (3, 8, 0)])
def test_search(spark, tmp_path, seed, shard, broadcast):
    docs, items = library(seed)
    table = spark.createDataFrame([(*r, "w", 1) for r in docs], "doc_id long, text string, term string, shard int").repartition(3)
    ranked_search.index_rows(table, shard).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    asked = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    got = ranked_search.search(index, asked, most_broadcast=broadcast)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == best(docs, items)
    # an index of new documents beside an old one
    ranked_search.index_rows(table.limit(0)).write.parquet(str(tmp_path / "none"))
    assert ranked_search.search(spark.read.parquet(str(tmp_path / "none")), asked).collect() == []
    assert ranked_search.search(index, asked.limit(0)).collect() == []


def test_indexes_side_by_side(spark, tmp_path):
    docs, items = library(4)
    for k in range(2):
        rows = ranked_search.index_rows(spark.createDataFrame(docs[k::2], "doc_id long, text string").coalesce(1))
        rows.withColumn("shard", 2 * F.col("shard") + k).write.mode("append").parquet(str(tmp_path / "index"))
    got = ranked_search.search(spark.read.parquet(str(tmp_path / "index")), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == best(docs, items)


@pytest.mark.parametrize("front", [1, 40, 1 << 20])
def test_treaps(monkeypatch, front):
    """The walk finds what scoring all finds, without scoring all; also with little room, equal impacts and sorted ones."""
    monkeypatch.setattr(ranked_search, "FRONT", front)
    rng = np.random.default_rng(front)
    n, terms = 2000, 40
    places = [np.sort(rng.choice(n, int(rng.integers(1, n if t < 6 else 150)), replace=False)) for t in range(terms)]
    impacts = [np.full(len(p), 7) if t % 5 == 0 else np.sort(rng.integers(1, 999, len(p))) if t % 5 == 1 else rng.integers(1, 99_999, len(p)) for t, p in enumerate(places)]
    weights = rng.integers(1, 9000, terms)
    askers = [sorted(rng.choice(15, int(rng.integers(1, 7)), replace=False).tolist()) for _ in range(terms)]
    treaps = ranked_search.Treaps(places, impacts, weights, askers)
    place = treaps.place
    for t, (a, b) in enumerate(zip(treaps.first, treaps.last)):
        for u in range(a, b):
            for child, side in ((treaps.left[u], -1), (treaps.right[u], 1)):
                if child >= 0:
                    assert a <= child < b and (place[child] - place[u]) * side > 0 and treaps.gain[child] <= treaps.gain[u]
    item, where, score, scored = treaps.search(10)
    got = sorted(zip(item.tolist(), (-score).tolist(), where.tolist()))
    want = []
    for i in {x for a in askers for x in a}:
        all_ = np.zeros(n, np.int64)
        for t in range(terms):
            if i in askers[t]:
                all_[places[t]] += impacts[t] * weights[t]
        want += [(i, -s, d) for s, d in sorted(((-all_[d], d) for d in np.flatnonzero(all_)))[:10] for s in (-s,)]
    assert got == sorted(want)
    assert scored < 0.5 * 15 * n


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_chat_format", "op13_ranked_search"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    got = queries.QUERIES[name](spark, FOLDER)
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))
