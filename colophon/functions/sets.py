"""Sets of strings as arrays without repeats. Results that are sets have no set order unless they say so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import token_ngrams


def make(x: Column) -> Column:
    return F.array_distinct(x)


def size(x: Column) -> Column:
    return F.size(x)


def is_empty(x: Column) -> Column:
    return F.size(x) == 0


def contains(x: Column, value) -> Column:
    return F.array_contains(x, value)


def add(x: Column, value: Column) -> Column:
    return F.array_union(x, F.array(value))


def equals(a: Column, b: Column) -> Column:
    return (F.size(a) == F.size(b)) & (F.size(F.array_except(a, b)) == 0)


def intersection(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def union(a: Column, b: Column) -> Column:
    return F.array_union(a, b)


def ordered(x: Column) -> Column:
    return F.sort_array(x)


def top_k(x: Column, k: int) -> Column:
    """The k least, in order."""
    return F.slice(F.sort_array(x), 1, k)


def product(a: Column, b: Column) -> Column:
    """All pairs, as arrays of two."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.array(x, y))))


def jaccard(a: Column, b: Column) -> Column:
    """Two empty sets are equal: 1."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def join(x: Column, separator: str) -> Column:
    """The members in order, in one string."""
    return F.array_join(F.sort_array(x), separator)


def largest(*sets: Column) -> Column:
    return F.greatest(*map(F.size, sets), F.lit(0), F.lit(0))


def smallest(*sets: Column) -> Column:
    return F.least(*map(F.size, sets), F.lit(2147483647), F.lit(2147483647))


def keep(x: Column, predicate) -> Column:
    return F.filter(x, predicate)


def author_grams(name: Column) -> Column:
    return F.array_distinct(token_ngrams(name, 2))


def author_similarity(a: Column, b: Column) -> Column:
    return jaccard(author_grams(a), author_grams(b))


def average_score(a_grams: Column, b_grams: Column) -> Column:
    """Mean over the left names' bigram sets of their best similarity with one on the right; 0 if there are none on either side."""
    best = F.transform(a_grams, lambda x: F.array_max(F.transform(b_grams, lambda y: jaccard(x, y))))
    total = F.aggregate(best, F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a_grams) == 0) | (F.size(b_grams) == 0), F.lit(0.0)).otherwise(total / F.size(a_grams))
