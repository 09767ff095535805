"""A store of edges: the latest edge of each ``_id``, in buckets of ids, each a folder that an upsert replaces as a whole.

An upsert reads and writes only the buckets that its edges fall in. Of equal ids the greatest ``update_ts`` stays, ties by a
hash of the whole edge, so edges may come in any order and any number of times: a run that is repeated changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import BIBLIOREF, struct_type
from .tables import saved


@dataclass(frozen=True)
class EdgeStore:
    """Edges (the columns of BIBLIOREF) below path. ``buckets`` must not change once edges are there: it follows from how much a task should rewrite, about the store's size / 256 MB."""

    spark: SparkSession
    path: str
    buckets: int = 64

    def _schema(self):
        return struct_type(BIBLIOREF).add("bucket", "integer")

    def read(self) -> DataFrame:
        return self._all().drop("bucket")

    def _all(self) -> DataFrame:
        try:
            return self.spark.read.schema(self._schema()).parquet(self.path)
        except Exception as e:  # nothing was written yet
            if getattr(e, "getCondition", lambda: "")() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self._schema())

    def upsert(self, edges: DataFrame) -> None:
        names = struct_type(BIBLIOREF).names
        bucket = F.pmod(F.xxhash64("_id"), F.lit(self.buckets)).cast("int")
        # written first: edges carry the time at which they are made, and are read twice
        new = saved(edges.select(*names, bucket.alias("bucket")))
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # as many as buckets at most
        if not touched:
            return
        rows = self._all().filter(F.col("bucket").isin(touched)).unionByName(new)
        latest = F.max_by(F.struct(*names), F.struct("update_ts", F.xxhash64(*names)))
        merged = saved(rows.groupBy("bucket", "_id").agg(latest.alias("e")).select("e.*", "bucket"))
        # a bucket is one folder; as many tasks as buckets write at most one file each
        dealt = merged.repartition(len(touched), "bucket")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
