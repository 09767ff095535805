"""Lines that don't make a record, kept with their cause instead of dropped or failing the job.

One pass judges every line; what is written holds good rows and rejects side by side, in two folders, and their numbers are
observed while it is. A job whose rejects are too many fails after that pass, with the rejects there to be looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text
from .schemas import filled, struct_type

#: Causes by the JSON itself; others are the caller's rules.
SYNTAX, NO_OBJECT, FIELD = "syntax", "no object", "field type"
#: A record without these can't be matched.
UNUSABLE = (("no ident", "ident = ''"), ("no title", "title = ''"))


class TooManyRejects(Exception):
    """Rejects above the limits: ``rejects`` of ``lines``."""

    def __init__(self, rejects: int, lines: int, path: str):
        super().__init__(f"{rejects} of {lines} lines were rejected; they are in {path}")
        self.rejects, self.lines = rejects, lines


def _cause(doc: Column) -> Column:
    value = F.try_parse_json(doc)
    return F.when(value.isNull(), SYNTAX).when(~F.schema_of_variant(value).startswith("OBJECT"), NO_OBJECT).otherwise(FIELD)


def judge(lines: DataFrame, fields: str, rules: tuple = (), column: str = "value") -> DataFrame:
    """(record, doc, cause): of each line that isn't blank, its fields, filled, or why there are none. rules: (cause, SQL over the record's fields); the first that holds rejects the line. Works on streams alike."""
    kind = struct_type(fields)
    probe = StructType([*kind.fields]).add("__bad", "string")
    got = F.from_json(F.col(column), probe, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    some = lines.filter(F.length(text.trim(F.col(column))) > 0)
    # each line is parsed once: behind a generator of one row, and so for the record made of it
    rows = some.select(F.col(column).alias("doc"), F.explode(F.array(got)).alias("r"))
    record = F.struct(*[filled(F.col("r")[f.name], f.dataType).alias(f.name) for f in kind.fields])
    rows = rows.select("doc", F.explode(F.array(F.when(F.col("r").isNotNull() & F.col("r.__bad").isNull(), record))).alias("record"))
    cause = F.when(F.col("record").isNull(), _cause(F.col("doc")))
    if rules:
        own = F.lit(None).cast("string")
        for name, test in reversed(rules):
            own = F.when(F.expr(test), name).otherwise(own)
        rows = rows.select("record.*", "doc", "record").select("doc", "record", own.alias("own"))
        cause = F.coalesce(cause, F.col("own"))
    cause = cause.alias("cause")
    return rows.select(F.when(cause.isNull(), F.col("record")).alias("record"), "doc", cause)


def _kept(judged: DataFrame, reject: bool) -> DataFrame:
    """Rejects, or the others; of what was written one folder alone is read."""
    if "is_reject" in judged.columns:
        return judged.filter(F.col("is_reject") == F.lit(reject))
    return judged.filter(F.col("cause").isNotNull() if reject else F.col("cause").isNull())


def good(judged: DataFrame) -> DataFrame:
    """The fields of good rows, and doc."""
    return _kept(judged, False).select("record.*", "doc")


def rejected(judged: DataFrame) -> DataFrame:
    return _kept(judged, True).select("cause", "doc")


def write_judged(judged: DataFrame, path: str, most_share: float = 1.0, least: int = 0) -> tuple[int, int]:
    """Writes both kinds in one pass; gives (lines, rejects). Fails if more than ``least`` and more than ``most_share`` of the lines are rejects."""
    seen = Observation()
    counted = judged.observe(seen, F.count(F.lit(1)).alias("lines"), F.count("cause").alias("rejects"))
    counted.withColumn("is_reject", F.col("cause").isNotNull()).write.mode("overwrite").partitionBy("is_reject").parquet(path)
    lines, rejects = seen.get["lines"], seen.get["rejects"]
    if rejects > least and rejects > most_share * lines:
        raise TooManyRejects(rejects, lines, path)
    return lines, rejects


def read_judged(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """What write_judged wrote: record, doc, cause, and is_reject, by which it is in two folders."""
    schema = StructType().add("record", struct_type(fields)).add("doc", "string").add("cause", "string").add("is_reject", "boolean")
    return spark.read.schema(schema).parquet(path)


def write_judged_stream(judged: DataFrame, path: str, checkpoint: str, most_share: float = 1.0, least: int = 0):
    """write_judged of each batch of a stream, into a folder of its own, which a repeated batch writes anew."""

    def batch(rows: DataFrame, number: int) -> None:
        write_judged(rows, f"{path}/batch={number}", most_share, least)

    return judged.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
