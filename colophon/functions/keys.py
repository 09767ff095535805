"""Keys of titles and identifiers. ``KEYS`` maps a name to a function from title Column to key Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text
from .unicode import decomposed

# --- Fixed values: characters that keys replace (lower case; upper-case ones are lowered before), and their spelling ---
LETTERS = {
    "æ": "ae", "ð": "d", "ø": "o", "þ": "th", "ß": "s", "đ": "d", "ħ": "h", "ı": "i", "ĸ": "k", "ł": "l", "ŋ": "n", "œ": "oe",
    "ŧ": "t", "µ": "u", "ƒ": "f", "∂": "", "ʖ": "", "∑": "", "∏": "", "ˆ": "", "☃": "", "ˇ": "",
}
PREFIXES = ("original article: ", "original article ", "article: ", "title: ")
DROPPED = r"[\t\n\f\r \p{P}\p{M}\x{2000}-\x{206F}\x{2E00}-\x{2E7F}’`·“”‘’“”«»「」¿–±§_°ʖ©®¤=<>|+$^~≈√∫≤≥÷ƒ∆¬£¢∞¥◊€]"


def key_title(title: Column) -> Column:
    return F.regexp_replace(text.trim(title), r"[\t\n]", " ")


def key_tnorm(title: Column) -> Column:
    """ASCII letters, digits and underscores of the lowered title."""
    return F.regexp_replace(text.lower(key_title(title)), r"[^0-9A-Za-z_]+", "")


def key_tsand(title: Column, strip_prefix: bool = False) -> Column:
    """Slug: letters spelled plainly, decomposed, without punctuation, marks, symbols and spaces.

    A title that starts with one of PREFIXES gives that prefix as its key; ``strip_prefix`` drops the prefix instead.
    """
    slug = text.lower(text.trim(key_title(title)))
    if strip_prefix:
        slug = F.regexp_replace(slug, "^" + "".join(f"(?:{p})?" for p in PREFIXES), "")
    else:
        slug = F.regexp_replace(slug, f"(?s)^({'|'.join(PREFIXES)}).*", "$1")
    slug = F.replace(slug, F.lit("&apos;"), F.lit("'"))
    one = {k: v for k, v in LETTERS.items() if len(v) <= 1}
    both = sorted(one, key=lambda k: not one[k])  # those that vanish come last
    slug = F.translate(slug, "".join(both), "".join(one[k] for k in both))
    for k, v in LETTERS.items():
        if len(v) > 1:
            slug = F.replace(slug, F.lit(k), F.lit(v))
    return text.lower(F.regexp_replace(decomposed(slug), DROPPED, ""))


#: What ends a code can't reach its first six letters once so many stand.
ENOUGH = 10


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is made once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _nysiis_step(state: Column, at: Column) -> Column:
    """One letter of the code. The state: what stands already, the letter put last, and letters that replace the next two. It stays small, as Spark copies it at each letter."""
    letter = lambda k: F.coalesce(at[k], F.lit(""))
    here = F.struct(F.coalesce(state.now, letter("0")).alias("c"), F.coalesce(state.next, letter("1")).alias("n1"), letter("2").alias("n2"))
    return F.when(F.length(state.out) >= ENOUGH, state).otherwise(_let(here, lambda x: _nysiis_letter(state, x.c, x.n1, x.n2)))


def _nysiis_letter(state: Column, c: Column, n1: Column, n2: Column) -> Column:
    """The state after letter c, which n1 and n2 follow."""
    vowel = lambda x: x.isin("A", "E", "I", "O", "U")
    sch, ph = (c == "S") & (n1 == "C") & (n2 == "H"), (c == "P") & (n1 == "H")
    put = (
        F.when(vowel(c), "A").when(c == "Q", "G").when(c == "Z", "S").when(c == "M", "N").when(c == "K", "C").when(ph, "F")
        .when((c == "H") & ~(vowel(state.last) & vowel(n1)) | (c == "W") & vowel(state.last), state.last)
        .otherwise(c)
    )
    now = F.when((c == "E") & (n1 == "V"), "F").when(sch, "S").when(ph, "F").otherwise(state.next)
    made = lambda out, last, now, then: F.struct(out.alias("out"), last.alias("last"), now.alias("now"), then.alias("next"))
    grown = lambda p: made(F.when(p == state.last, state.out).otherwise(F.concat(state.out, p)), p, now, F.when(sch, F.lit("S")))
    skipped = made(state.out, state.last, state.next, F.lit(None).cast("string"))
    return F.when((c == "K") & (n1 == "N"), skipped).otherwise(_let(put, grown))


# How a name's first and last letters are spelled before the others are looked at, and a code's last letters after.
HEADS = (("MAC", "MCC"), ("KN", "NN"), ("K", "C"), ("PH", "FF"), ("PF", "FF"), ("SCH", "SSS"))
TAILS = (("EE|IE", "Y"), ("DT|RT|RD|NT|ND", "D"))
ENDS = (("S$", ""), ("(?<=.)AY$", "Y"), ("A$", ""))


def nysiis(x: Column) -> Column:
    """New York State phonetic code of the letters A to Z in a name, six letters at most: a fold over the letters."""
    # two other letters have one of A to Z as their upper case
    plain = F.upper(F.regexp_replace(F.translate(x, "\u0131\u017f", "is"), "[^A-Za-z]+", ""))
    word = None
    for old, new in HEADS:
        case = F if word is None else word
        word = case.when(F.startswith(plain, F.lit(old)), F.concat(F.lit(new), F.substr(plain, F.lit(len(old) + 1))))
    word = word.otherwise(plain)
    for old, new in TAILS:
        word = F.regexp_replace(word, f"({old})$", new)
    return _let(F.split(word, ""), _nysiis_fold)


def _nysiis_fold(letters: Column) -> Column:
    first, none = F.coalesce(F.get(letters, F.lit(0)), F.lit("")), F.lit(None).cast("string")
    zero = F.struct(first.alias("out"), first.alias("last"), none.alias("now"), none.alias("next"))
    # each letter from the second on with the two after it
    rest = F.arrays_zip(*[F.slice(letters, k, F.size(letters)) for k in (2, 3, 4)])

    def ended(state: Column) -> Column:
        short = state.out
        for old, new in ENDS:
            short = F.regexp_replace(short, old, new)
        return F.left(F.when(F.length(state.out).between(2, ENOUGH - 1), short).otherwise(state.out), F.lit(6))

    return F.aggregate(rest, zero, _nysiis_step, ended)


def key_tnysi(title: Column) -> Column:
    return nysiis(key_title(title))


KEYS: dict[str, Callable[[Column], Column]] = {"title": key_title, "tnorm": key_tnorm, "tnysi": key_tnysi, "tsand": key_tsand}


def derive_key(docs: DataFrame, key: str = "tsand", skip_empty: bool = False, ident: str = "ident", title: str = "title") -> DataFrame:
    """docs with ident trimmed and a column ``key``; rows without a key go if ``skip_empty``."""
    out = docs.withColumn(ident, text.trim(F.coalesce(F.col(ident), F.lit(""))))
    out = out.withColumn("key", text.trim(KEYS[key](F.coalesce(F.col(title), F.lit("")))))
    return out.filter("key <> ''") if skip_empty else out


def key_by_ext_id(releases: DataFrame, name: str) -> DataFrame:
    """releases keyed by one of their identifiers (doi, pmid, pmcid, arxiv), in lower case; those without it go."""
    return releases.withColumn("key", text.lower(text.trim(F.coalesce(F.col(f"ext_ids.{name}"), F.lit(""))))).filter("key <> ''")
