"""Compatibility decomposition (NFKD) as native expressions.

The table is Unicode's own, read from Python's ``unicodedata`` when a plan is made. Combining marks are left out of it, as
keys drop them, and with them the question of their order: most letters then become one letter, which ``translate`` does; the
rest become several and are looked up one by one, only in texts that hold such a letter. Hangul syllables are arithmetic.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode's first Hangul syllable, and the first and number of leading, vowel and trailing letters.
SYLLABLE, LEADING, VOWEL, TRAILING = 0xAC00, (0x1100, 19), (0x1161, 21), (0x11A7, 28)
SYLLABLES = LEADING[1] * VOWEL[1] * TRAILING[1]


def without_marks(s: str) -> str:
    return "".join(c for c in s if not unicodedata.category(c).startswith("M"))


@functools.cache
def _decompositions() -> dict[str, str]:
    """Every character but Hangul syllables that decomposes, and into what, without marks."""
    out = {}
    for c in map(chr, range(0x80, 0x110000)):
        d = unicodedata.normalize("NFKD", c) if unicodedata.decomposition(c) else c
        if d != c:
            out[c] = without_marks(d)
    return out


def _class(characters: list[str]) -> str:
    """The inside of a regular expression's class."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, characters)):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs)


def _letters(first: int, n: int) -> Column:
    return F.split(F.lit(" ".join(map(chr, range(first, first + n)))), " ")


def _hangul(c: Column) -> Column:
    at = F.ascii(c) - SYLLABLE
    vowels, ends = VOWEL[1] * TRAILING[1], TRAILING[1]
    of = lambda letters, i: F.get(_letters(*letters), F.floor(i).cast("int"))
    end = F.when(at % ends == 0, "").otherwise(of(TRAILING, at % ends))
    return F.concat(of(LEADING, at / vowels), of(VOWEL, (at % vowels) / ends), end)


def decomposed(x: Column) -> Column:
    """x in NFKD, without the combining marks of what was decomposed."""
    table = _decompositions()
    one = {k: v for k, v in table.items() if len(v) <= 1}
    both = sorted(one, key=lambda k: not one[k])  # those that vanish come last
    many = [k for k, v in table.items() if len(v) > 1]
    values = F.split(F.lit("\x01".join(table[k] for k in many)), "\x01")
    first, last = chr(SYLLABLE), chr(SYLLABLE + SYLLABLES - 1)

    def letter(c: Column) -> Column:
        listed = F.get(values, F.position(c, F.lit("".join(many))) - 1)
        return F.when(c.between(first, last), _hangul(c)).otherwise(F.coalesce(listed, c))

    simple = F.translate(x, "".join(both), "".join(one[k] for k in both))
    long = rf"[{_class(many)}{first}-{last}]"
    whole = F.when(x.rlike(long), F.array_join(F.transform(F.split(simple, ""), letter), "")).otherwise(simple)
    return F.when(x.rlike(r"[^\x00-\x7F]"), whole).otherwise(x)
