"""The inbox as a stream: each new file is parsed once, in batches that end when the inbox is read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.bank_csv import described, parse_payloads

FILE = "path string, modificationTime timestamp, length long, content binary"


def import_available(spark: SparkSession, inbox: str, bronze: str, checkpoint: str, format_of: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append new payloads and their records to ``bronze``, a folder for each batch.

    A batch that is run again after a failure overwrites its own folders, and
    payloads of earlier batches are left out, so nothing is stored twice. ``format_of`` adds ``source_format`` (default: the
    first bank's).
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = described(batch)
        rows = format_of(rows) if format_of else rows.withColumn("source_format", F.lit("danske-csv-v1"))
        rows = rows.dropDuplicates(["payload_id", "declared_account_id"])
        path = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{bronze}/raw_payloads")
        new = rows
        if path.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).exists(path):
            before = batch.sparkSession.read.parquet(f"{bronze}/raw_payloads").where(F.col("batch") < batch_id)
            rows = rows.join(before.select("payload_id", "declared_account_id"), ["payload_id", "declared_account_id"], "left_anti")
            new = rows.join(before.select("payload_id"), "payload_id", "left_anti")
        rows.write.mode("overwrite").parquet(f"{bronze}/raw_payloads/batch={batch_id}")
        parse_payloads(new.dropDuplicates(["payload_id"])).write.mode("overwrite").parquet(f"{bronze}/source_records/batch={batch_id}")

    files = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).load(inbox)
    return files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
