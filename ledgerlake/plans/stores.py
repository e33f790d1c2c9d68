"""Bronze and Silver as tables in a folder: appended runs, replaced caches, and whole versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.bank_csv import parse_payloads

RUN = "import_run_id string, payload_id string, declared_account_id string, source_format string, original_filename string, exported_on date, covers_from date, covers_through date, started_at timestamp, outcome string, repeat_of string, refusals array<string>"
PAYLOAD = "payload_id string, byte_length int, content binary"
RECORD = "payload_id string, source_format string, record_ordinal int, fields map<string,string>, first_date date, last_date date, reason string"
VERSIONS = "version string, family string, n long, at timestamp"


class _Folder:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")


class BronzeStore(_Folder):
    """What was imported: payloads as bytes, runs, and the records derived from payloads, which can be derived again."""

    @property
    def runs(self) -> DataFrame:
        return self._read("import_runs", RUN)

    def runs_in_order(self) -> DataFrame:
        return self.runs.orderBy("started_at", "import_run_id")

    @property
    def payloads(self) -> DataFrame:
        return self._read("raw_payloads", PAYLOAD)

    @property
    def records(self) -> DataFrame:
        return self._read("source_records", RECORD)

    def records_of(self, payload_id: str) -> DataFrame:
        return self.records.where((F.col("payload_id") == payload_id) & F.col("reason").isNull()).orderBy("record_ordinal")

    def failures(self, source_format: str) -> DataFrame:
        return self.records.where((F.col("source_format") == source_format) & F.col("reason").isNotNull()).select("payload_id", "reason")

    def append(self, runs: DataFrame, payloads: DataFrame) -> None:
        """Append runs, and payloads that aren't there yet; payloads first, so that no run lacks its bytes.

        Run again after a failure, neither is stored twice.
        """
        new = payloads.dropDuplicates(["payload_id"]).join(self.payloads.select("payload_id"), "payload_id", "left_anti")
        new.selectExpr("payload_id", "byte_length", "content").write.mode("append").parquet(f"{self.root}/raw_payloads")
        fresh = runs.join(self.runs.select("import_run_id"), "import_run_id", "left_anti")
        fresh.select([F.col(c.split()[0]) for c in RUN.split(", ")]).write.mode("append").parquet(f"{self.root}/import_runs")

    def replace_records(self, parsed: DataFrame) -> None:
        """Replace the records of the payloads that ``parsed`` has; others' stay."""
        rows = parsed.withColumn("shard", F.substring("payload_id", 1, 2))
        shards = [r[0] for r in rows.select("shard").distinct().collect()]  # 256 at most
        old = self._read("source_records", RECORD + ", shard string").where(F.col("shard").isin(shards))
        kept = old.join(parsed.select("payload_id").distinct(), "payload_id", "left_anti")
        # Read whole before its own folders are overwritten.
        at = f"{self.root}/staged/{uuid.uuid4().hex}"
        kept.unionByName(rows.select(kept.columns)).write.parquet(at)
        staged = self.spark.read.parquet(at)
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{self.root}/source_records")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def rederive(self) -> None:
        """Parse every stored payload again in its declared format; one with several is refused."""
        declared = self.runs.where("outcome = 'stored'").select("payload_id", "source_format").distinct()
        twice = [r[0] for r in declared_twice(self.runs).limit(100).collect()]
        if twice:
            raise ValueError(f"declared in several formats: {', '.join(twice)}")
        self.replace_records(parse_payloads(self.payloads.join(declared, "payload_id")))


def declared_twice(runs: DataFrame) -> DataFrame:
    """Payloads that stored runs declare in more than one format."""
    return runs.where("outcome = 'stored'").groupBy("payload_id").agg(F.count_distinct("source_format").alias("formats")).where("formats > 1")


class SilverStore(_Folder):
    """The merged history, replaced as a whole: a version is read only once its manifest is written."""

    def replace(self, families: dict[str, DataFrame]) -> str:
        version = uuid.uuid4().hex
        counts = []
        for name, df in families.items():
            df.write.parquet(f"{self.root}/versions/{version}/{name}")
            counts.append((version, name, self.spark.read.parquet(f"{self.root}/versions/{version}/{name}").count()))
        made = self.spark.createDataFrame(counts, "version string, family string, n long").withColumn("at", F.current_timestamp())
        made.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return version

    def current(self) -> str:
        last = self._read("manifest", VERSIONS).orderBy(F.desc("at")).limit(1).first()
        if last is None:
            raise LookupError("Silver has not been built")
        return last["version"]

    def read(self) -> dict[str, DataFrame]:
        """All families of one version, whatever is written meanwhile."""
        version = self.current()
        names = [r["family"] for r in self._read("manifest", VERSIONS).where(F.col("version") == version).collect()]
        return {n: self.spark.read.parquet(f"{self.root}/versions/{version}/{n}") for n in names}
