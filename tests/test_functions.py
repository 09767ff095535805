import itertools
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from colophon.functions import keys, sets, text
from colophon.functions.unicode import decomposed


def values(spark, column, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(len(rows[0]))))
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_text(spark):
    c, d = F.col("c0"), F.col("c1")
    assert values(spark, text.slugify(c), ("",), (" ",), (" Optimize everything",), ("ABCü~",)) == ["", "", "optimize everything", "abc"]
    assert values(spark, text.looks_like_component(c, d), ("", ""), ("100.1", "100"), ("100ABC.123", "100ABC"), ("100ABC", "100ABC.1")) == [False, True, True, True]
    assert values(spark, F.array_join(text.token_ngrams(c), " "), ("Anne K Lam",), ("",)) == ["an ne k la m", ""]
    assert values(spark, text.to_doi(c), ("xxx 10.123/12312 xxx",), ("none",)) == ["10.123/12312", ""]
    assert values(spark, text.trim(c), ("  a b　\n",), ("\x0b",)) == ["a b", ""]
    assert values(spark, text.lower(c), ("ΟΔΟΣ",), ("İ",)) == ["οδοσ", "i"]
    assert values(spark, text.looks_like_filename(c), ("a.pdf",), ("a b.pdf",), ("a.html",)) == [True, False, False]
    assert values(spark, text.line_column(c, "\t", 2), (" a\tb\n",), ("a",)) == ["b", ""]


def test_pages(spark):
    p = text.parse_pages(F.col("c0"))
    got = values(spark, F.struct(p.start.cast("string"), p.end.cast("string"), p.err), ("120-5",), ("689-698",), ("",), ("500-100",), ("99999999999999999999-3",), ("5-3",))
    assert [tuple(g) for g in got] == [("120", "125", False), ("689", "698", False), ("0", "0", True), ("500", "100", True), ("9223372036854775807", "0", True), ("5", "3", True)]


def test_variants(spark):
    v = F.variant_get(F.parse_json(F.col("c0")), "$.v", "variant")
    assert values(spark, text.year_of(v), ('{"v":2014}',), ('{"v":"2014"}',), ('{"v":2014.7}',), ('{"v":" 12 "}',), ('{"v":[1]}',), ("{}",)) == [2014, 2014, 2014, 0, 0, 0]
    assert values(spark, text.subtitles_of(v), ('{"v":["a","b"]}',), ('{"v":"s"}',), ('{"v":"[1]"}',), ('{"v":3}',), ("{}",)) == [["a", "b"], ["s"], ["[1]"], [], []]


def test_keys(spark):
    c = F.col("c0")
    assert values(spark, keys.key_tsand(c), ("abc",), ("abc++***##???ßßß",), ("A k",), ("Title: foo",), ("Æther é",)) == ["abc", "abcsss", "ak", "title", "aethere"]
    assert values(spark, keys.key_tsand(c, strip_prefix=True), ("Title: foo",)) == ["foo"]
    assert values(spark, keys.key_tnorm(c), (" A b_c!\t2",), ("漢字",)) == ["ab_c2", ""]
    assert values(spark, keys.key_title(c), (" a\tb\nc ",)) == ["a b c"]
    assert values(spark, keys.key_tnysi(c), ("",), ("AS",), ("Knight",), ("Macdonald",), ("Phillips",)) == ["", "", "NAGT", "MCDANA", "FALAP"]


@pytest.mark.parametrize(("a", "b", "want"), [([], [], 1.0), (["x"], [], 0.0), (["x", "y"], ["y", "z"], 1 / 3)])
def test_jaccard(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(sets.jaccard(F.col("a"), F.col("b")).alias("v")).first().v == pytest.approx(want)


def test_sets(spark):
    df = spark.createDataFrame([(["2", "3", "4", "8"], ["1", "2"], [])], "a array<string>, b array<string>, e array<string>")
    a, b, e = F.col("a"), F.col("b"), F.col("e")
    row = df.select(sets.top_k(a, 2).alias("k"), sets.size(sets.union(a, b)).alias("u"), sets.intersection(a, b).alias("i"), sets.equals(a, a).alias("q"), sets.largest().alias("hi"), sets.smallest().alias("lo"), sets.average_score(F.array(a), F.slice(F.array(e), 1, 0)).alias("s"), sets.join(sets.add(b, F.lit("0")), ",").alias("j"), F.size(sets.product(a, b)).alias("p")).first()
    assert (row.k, row.u, row.i, row.q, row.hi, row.lo, row.s, row.j, row.p) == (["2", "3"], 5, ["2"], True, 0, 2147483647, 0.0, "0,1,2", 8)


VOWELS = frozenset("AEIOU")


def nysiis_code(name: str) -> str:
    """The phonetic code letter by letter, as the names' own rules say it."""
    # letter by letter: a letter whose upper case is several letters stays as it is, and so isn't one of A to Z
    s = [u for u in map(str.upper, name) if len(u) == 1 and "A" <= u <= "Z"]
    if not s:
        return ""
    word = "".join(s)
    for head, new in (("MAC", "MCC"), ("KN", "NN"), ("K", "C"), ("PH", "FF"), ("PF", "FF"), ("SCH", "SSS")):
        if word.startswith(head):
            word = new + word[len(head) :]
            break
    if word[-2:] in ("EE", "IE"):
        word = word[:-2] + "Y"
    elif word[-2:] in ("DT", "RT", "RD", "NT", "ND"):
        word = word[:-2] + "D"
    s = list(word)
    out, last, i = [s[0]], s[0], 1
    at = lambda j: s[j] if 0 <= j < len(s) else ""
    while i < len(s):
        c = s[i]
        if c in "AIOU":
            s[i] = "A"
        elif c == "E":
            if at(i + 1) == "V":
                s[i + 1] = "F"
            s[i] = "A"
        elif c in "QZM":
            s[i] = {"Q": "G", "Z": "S", "M": "N"}[c]
        elif c == "K":
            if at(i + 1) == "N":
                del s[i]
            else:
                s[i] = "C"
        elif c == "S" and s[i : i + 3] == ["S", "C", "H"]:
            s[i + 1] = s[i + 2] = "S"
        elif c == "P" and at(i + 1) == "H":
            s[i] = s[i + 1] = "F"
        elif c == "H" and not (at(i - 1) in VOWELS and at(i + 1) in VOWELS) or c == "W" and at(i - 1) in VOWELS:
            s[i] = s[i - 1]
        if s[i] != last:
            out.append(s[i])
        last = s[i]
        i += 1
    if len(out) > 1:
        if out[-1] == "S":
            out.pop()
        if out[-2:] == ["A", "Y"] and len(out) > 2:
            del out[-2]
        if out and out[-1] == "A":
            out.pop()
    return "".join(out[:6])


def test_phonetic_letters(spark):
    """Letters whose upper case is several letters are dropped, not widened."""
    assert nysiis_code("straße") == nysiis_code("strae") == "STR"
    assert nysiis_code("\ufb01sh") == nysiis_code("sh")
    assert values(spark, keys.nysiis(F.col("c0")), ("straße",), ("\ufb01sh",), ("\u0131\u017fa",)) == ["STR", nysiis_code("sh"), nysiis_code("isa")]


def test_phonetic_code(spark):
    """The native fold gives what the loop gives: every short name over the letters that rules look at, and random long ones."""
    rng = random.Random(4)
    letters = "AEKNSCHPMQZWVFDTRIYLX"
    names = ["".join(x) for n in range(4) for x in itertools.product(letters, repeat=n)]
    for start in ("", "MAC", "KN", "K", "PH", "PF", "SCH"):
        names += [start + "".join(rng.choices(letters, k=rng.randrange(1, 14))) + rng.choice(["", "EE", "IE", "DT", "ND", "S", "AY", "SCH", "SCHCH", "EV", "KN"]) for _ in range(13_000)]
    names += ["".join(rng.choices("aeé \u0131\u017fKßx-\n'", k=6)) for _ in range(500)]
    assert len(names) > 100_000
    got = spark.createDataFrame(list(enumerate(names)), "i int, c0 string").select("i", keys.nysiis(F.col("c0")).alias("v")).collect()
    wrong = [(names[r.i], r.v) for r in got if r.v != nysiis_code(names[r.i])]
    assert len(got) == len(names) and wrong == []


def test_decomposition(spark):
    """Every code point: natively what unicodedata gives, once marks and punctuation are dropped."""
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    # together, too; but for marks, as Java may not know the newest ones and so leaves them, in whatever order
    plain = [c for c in points if ord(c) < 0x30000 and not unicodedata.category(c).startswith("M")]
    texts = points + ["a" + "".join(plain[k : k + 400]) + "z" for k in range(0, len(plain), 400)]
    rows = [(i, t, unicodedata.normalize("NFKD", t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, t string, want string")
    dropped = lambda x: F.regexp_replace(x, keys.DROPPED, "")
    out = df.select("i", dropped(decomposed(F.col("t"))).alias("got"), dropped(F.col("want")).alias("want"))
    assert [(r.i, r.got, r.want) for r in out.filter("NOT got <=> want").limit(5).collect()] == []


def test_keys_stay_native(spark):
    """Neither the slug nor the phonetic key needs a Python worker."""
    df = spark.range(1).select(F.lit("é").alias("title"))
    for key in keys.KEYS.values():
        plan = df.select(key(F.col("title")))._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_prefixes(spark):
    c = F.col("c0")
    cases = [("Original Article: Title: x",), ("article: title: x\ny",), ("an article: x",)]
    assert values(spark, keys.key_tsand(c), *cases) == ["originalarticle", "article", "anarticlex"]
    assert values(spark, keys.key_tsand(c, strip_prefix=True), *cases) == ["x", "xy", "anarticlex"]
