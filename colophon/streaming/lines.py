"""Streams of JSON lines: the per-record operators run on them as they are, and a stream of references joins fixed pivots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.keys import derive_key
from ..operators.convert import ref_to_release
from ..operators.extract import from_unstructured
from ..operators.match import CONFIRMED, fuzzy_edge, pivots
from ..operators.verify import as_struct, features, verify_pairs
from ..sources.edges import EdgeStore
from ..sources.schemas import REF, decode


def read_line_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return lines.filter(F.length(text.trim(F.col("value"))) > 0)


def refs_of(lines: DataFrame) -> DataFrame:
    """References of a stream (or table) of lines, with missing identifiers found."""
    return from_unstructured(decode(lines, REF))


def keyed_refs(lines: DataFrame, key: str = "tsand") -> DataFrame:
    return derive_key(ref_to_release(refs_of(lines)), key, skip_empty=True)


def match_stream(refs: DataFrame, releases: DataFrame, blacklist=None) -> DataFrame:
    """Confirmed edges of a stream of keyed references (columns of verify.INPUTS) to a fixed table of releases; no state is kept."""
    pivot = as_struct(features(pivots(releases).select("key", "a.*"), blacklist), "a", "key")
    pairs = as_struct(features(refs.filter("key <> ''"), blacklist), "b", "key").join(pivot, "key")
    return verify_pairs(pairs).filter(CONFIRMED).select(*fuzzy_edge())


def write_stream(rows: DataFrame, out: str, checkpoint: str, form: str = "parquet"):
    """Writes what is there and stops; exactly once, by the checkpoint."""
    return rows.writeStream.format(form).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_stream(edges: DataFrame, store: EdgeStore, checkpoint: str):
    """Puts the edges of a stream into a store, batch by batch; a batch that is repeated changes nothing."""
    return edges.writeStream.foreachBatch(lambda rows, _: store.upsert(rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def map_lines(lines: DataFrame, function: Callable[[str], str | None]) -> DataFrame:
    """A Python function per line, for what has no other form; an empty result drops the line."""

    def run(parts):
        import pandas as pd

        for x in parts:
            got = [function(v) for v in x["value"]]
            yield pd.DataFrame({"value": [g for g in got if g]}, dtype="object")

    return lines.select("value").mapInPandas(run, "value string")
