"""Titles that say nothing about a record. The lists are parameters, sets or tables; the defaults are short."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TITLES = frozenset(
    {"", "abstract", "abstracts", "acknowledgements", "advertisement", "announcements", "appendix", "author index", "book review", "book reviews", "contents", "correction", "corrigendum", "cover", "editorial", "errata", "erratum", "foreword", "front matter", "index", "introduction", "letter to the editor", "masthead", "news", "notes", "obituary", "preface", "receive tables of contents by e-mail", "references", "reviews", "table of contents", "title page"}
)
# Parts of titles that results must not match on.
FRAGMENTS = (
    "air quality data from the life+respira project in pamplona",
    "animaux vivants exclus ceux de la division",
    "ieee membership application",
    "irish studies, seminar",
    "les conventions de genève",
    "nouvelles du corps médical",
    "student government minutes:",
    "untersuchung einzelner abdominaler regionen und organe",
    "annual general meeting",
    "records of meetings",
)


#: Beyond so many bytes of titles a table isn't broadcast.
BROADCAST = 64 << 20


@dataclass(frozen=True)
class TitleTable:
    """Distinct titles in a table of any size, as they compare with lower-case ones; ``small``: it was measured, and may be broadcast."""

    titles: DataFrame
    small: bool

    def mark(self, rows: DataFrame, title: str, into: str) -> DataFrame:
        """rows with a boolean column ``into``: whether the table has the title."""
        right = self.titles.select(F.col("title").alias("__title"), F.lit(True).alias("__listed"))
        out = rows.join(F.broadcast(right) if self.small else right, F.col(title) == F.col("__title"), "left")
        return out.withColumn(into, F.col("__listed").isNotNull()).drop("__title", "__listed")


@dataclass(frozen=True)
class Blacklist:
    """titles: a set, which goes into the plan as a literal, or a TitleTable, which is joined."""

    titles: frozenset | TitleTable = TITLES
    fragments: tuple = FRAGMENTS

    def mark(self, rows: DataFrame, title: str = "title_lower") -> DataFrame:
        """rows with the columns ``blacklisted`` and ``fragment``, by a column of lower-case titles."""
        if isinstance(self.titles, TitleTable):
            rows = self.titles.mark(rows, title, "blacklisted")
        else:
            rows = rows.withColumn("blacklisted", F.col(title).isin(sorted(self.titles)))
        return rows.withColumn("fragment", contains_any(F.col(title), self.fragments))


def pattern_of(parts) -> str:
    """A regular expression that finds any of the parts: a tree of their common beginnings, so that a place of the text is looked at once, however many parts there are."""
    tree: dict = {}
    for part in parts:
        node = tree
        for c in part:
            node = node.setdefault(c, {})
        node[""] = {}

    def write(node: dict) -> str:
        if "" in node:  # a part ends here; that longer ones go on doesn't matter
            return ""
        branches = []
        for c, below in sorted(node.items()):
            text = c
            while len(below) == 1 and "" not in below:
                ((c, below),) = below.items()
                text += c
            branches.append("".join(x if x.isalnum() else f"\\x{{{ord(x):X}}}" for x in text) + write(below))
        return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"

    return write(tree)


def contains_any(x: Column, parts) -> Column:
    """Whether x holds any of the parts: one search for all."""
    parts = [p for p in parts]
    if not parts:
        return F.lit(False)
    return F.lit(True) if "" in parts else x.rlike(pattern_of(parts))


def title_table(table: DataFrame, column: str = "title", broadcast: int = BROADCAST) -> TitleTable:
    """A table of titles, of any size, to be joined; its size is measured once."""
    titles = table.select(F.col(column).alias("title")).filter("title IS NOT NULL").distinct()
    size = table.agg(F.coalesce(F.sum(F.octet_length(column) + 32), F.lit(0))).first()[0]
    return TitleTable(titles, size <= broadcast)


def load(table: DataFrame, column: str = "title", most: int = 100_000) -> Blacklist:
    """A blacklist from a table of titles: a literal set of up to ``most``, a TitleTable beyond."""
    rows = table.select(column).filter(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) > most:
        return Blacklist(titles=title_table(table, column))
    return Blacklist(titles=frozenset(r[0] for r in rows))
