"""Ids kept by their first letters, so that short handles of some ids are found from the ranges of these alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import finding


class HandleIndex:
    """A Parquet table of ids at ``root``, in ``buckets`` folders by a hash of the first ``least`` letters and sorted within.

    A handle depends only on ids of the same first letters, so the table holds no
    handles: new ids are appended, and none of those before is written again. ``least``
    and ``buckets`` must be those that the table was made with. Null ids aren't kept.
    """

    def __init__(self, spark: SparkSession, root: str, least: int = 8, buckets: int = 256):
        self.spark, self.root, self.least, self.buckets = spark, root, least, buckets

    def _bucket(self, column: str) -> Column:
        return (F.crc32(F.substring(column, 1, self.least)) % self.buckets).cast("int")

    def _read(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], "id string, bucket int")
        return self.spark.read.schema("id string, bucket int").parquet(self.root)

    def near(self, hits: DataFrame, column: str = "transaction_id") -> DataFrame:
        """``column``: the ids kept that have first letters of a hit; only these hits' folders are read."""
        return finding.near(self._in_folders(hits, column).select(F.col("id").alias(column)), hits, column, self.least)

    def _in_folders(self, ids: DataFrame, column: str) -> DataFrame:
        """What is kept in the folders that ``ids`` belong to."""
        kept = self._read()
        if not kept.inputFiles():
            return kept
        wanted = [r[0] for r in ids.where(F.col(column).isNotNull()).select(self._bucket(column).alias("bucket")).distinct().collect()]
        return kept.where(F.col("bucket").isin(wanted))

    def add(self, ids: DataFrame, column: str = "transaction_id") -> None:
        """Keep ids that aren't kept yet; adding again, as after a job that died, changes nothing.

        New ids and those of their folders are brought together once, by folder, and sorted
        once: of each id the first row stays, if it isn't one that is kept.
        """
        new = ids.where(F.col(column).isNotNull()).select(F.col(column).alias("id"), self._bucket(column).alias("bucket"), F.lit(True).alias("new"))
        both = new.unionByName(self._in_folders(ids, column).withColumn("new", F.lit(False))).repartition("bucket")
        first = F.row_number().over(Window.partitionBy("bucket", "id").orderBy("new"))
        both = both.withColumn("k", first).where("k = 1 and new").select("id", "bucket")
        both.write.partitionBy("bucket").mode("append").option("compression", "zstd").parquet(self.root)

    def handles(self, hits: DataFrame, column: str = "transaction_id") -> DataFrame:
        """``column, handle`` of the hits that are kept."""
        return finding.handles_of(hits, self.near(hits, column), column, self.least)
