"""Key tables: keyed records in buckets by key, sorted within, so that a zip of two of them shuffles nothing.

A table has one folder per day of rows, each with the same buckets; a day is added, or written again, without touching the
others. The rows of a very common key make one bucket, and so one task of a zip, larger than the rest; a zip can take
such keys apart: see operators.match.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder in the one that driver and executors share, spark.checkpoint.dir; where it is unset, a local master gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = f"file://{tempfile.gettempdir()}"
    return f"{found.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again, so that it is made once and survives lost executors."""
    path = shared_folder(df.sparkSession, "saved")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class KeyTable:
    """A bucketed table in the session's catalog, over files in a folder that outlives it."""

    spark: SparkSession
    name: str
    path: str
    columns: str
    buckets: int

    def open(self, found: bool) -> KeyTable:
        """Puts the table into the catalog, with its days if there are any already."""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({self.columns}, day STRING) USING parquet PARTITIONED BY (day) "
            f"CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        if found:
            self.spark.sql(f"MSCK REPAIR TABLE {self.name}")
        return self

    def write_day(self, rows: DataFrame, day: str) -> None:
        """Writes the rows of a day; what stood there for that day goes. Rows are dealt to the buckets; a bucket that a common key fills comes in several files, from several tasks."""
        names = ", ".join(f"`{c}`" for c in self.spark.table(self.name).columns if c != "day")
        dealt = rows.hint("rebalance", "key")
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (day = {{day}}) SELECT {names} FROM {{dealt}}", day=day, dealt=dealt)
        self.spark.sql(f"REFRESH TABLE {self.name}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).drop("day")

    def files(self) -> DataFrame:
        """The same rows, read without regard to buckets."""
        return self.spark.read.schema(f"{self.columns}, day string").parquet(self.path).drop("day")

    def days(self) -> list[str]:
        return [r[0].partition("=")[2] for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect()]

    def drop(self) -> None:
        """Takes the table out of the catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def key_table(spark: SparkSession, columns: str, buckets: int, name: str | None = None, path: str | None = None) -> KeyTable:
    """A key table with these columns, one of which is ``key``: a new one, or the one whose files are at path."""
    made = f"keys_{uuid.uuid4().hex}"
    return KeyTable(spark, name or made, path or shared_folder(spark, "keys"), columns, buckets).open(path is not None)
