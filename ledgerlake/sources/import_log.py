"""The import log: one JSON line for each import run, in the order in which they were written, and what it restores."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "format int, import_run_id string, account_id string, source_format string, archive_path string, payload_sha256 string, exported_on date, exported_on_source string, covers_from date, covers_through date, started_at string, outcome string, repeat_of string, refusal_reasons array<string>"
FIELDS = [x.split()[0] for x in ENTRY.replace("array<string>", "array").split(", ")]


class LogDamaged(ValueError):
    """All faults of a log."""


def append(path: str, entries: Iterable[dict]) -> None:
    """Append entries and force them to disk. The log lies with its one writer, not in the tables' store."""
    p = Path(path)
    data = "".join(json.dumps({k: e.get(k) for k in FIELDS}, ensure_ascii=False, default=str) + "\n" for e in entries).encode()
    with p.open("ab") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())


def read(spark: SparkSession, content: bytes) -> DataFrame:
    """Complete lines as ``ordinal`` and ``ENTRY``; a last line without its end was cut off and is left out.

    A line that names no run, or a run named twice, is damage.
    """
    lines = content.decode("utf-8").split("\n")[:-1]
    rows = spark.createDataFrame(list(enumerate(lines, 1)), "ordinal int, line string")
    got = rows.select("ordinal", F.from_json("line", ENTRY).alias("e")).select("ordinal", "e.*")
    bad = got.where("import_run_id is null").select("ordinal").unionByName(got.groupBy("import_run_id").agg(F.max("ordinal").alias("ordinal"), F.count("*").alias("n")).where("n > 1").select("ordinal"))
    found = sorted(r["ordinal"] for r in bad.limit(1000).collect())
    if found:
        raise LogDamaged(", ".join(f"line {n}" for n in found))
    return got


def replay(logged: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The logged runs that Bronze lacks, in order; and ``import_run_id, problem`` of all that keeps them from being restored.

    ``held``: Bronze's runs, ``import_run_id, payload_id, account_id, outcome, repeat_of``.
    They must be exactly the log's first runs, as logged; a repeat must name an
    earlier stored run of the same bytes and account.
    """
    named = logged.withColumnRenamed("payload_sha256", "payload_id")
    same = ["payload_id", "account_id", "outcome", "repeat_of"]
    n = held.count()
    both = held.select("import_run_id", F.struct(*same).alias("h")).join(named.select("import_run_id", "ordinal", F.struct(*same).alias("l")), "import_run_id", "full_outer")
    rest = named.where(F.col("ordinal") > n)
    of = named.select(F.col("import_run_id").alias("repeat_of"), F.col("ordinal").alias("at"), F.col("payload_id").alias("p"), F.col("account_id").alias("a"), F.col("outcome").alias("o"))
    links = rest.where("repeat_of is not null").join(of, "repeat_of", "left")
    good = F.coalesce((F.col("at") < F.col("ordinal")) & (F.col("o") == "stored") & (F.col("p") == F.col("payload_id")) & (F.col("a") == F.col("account_id")), F.lit(False))
    say = lambda df, problem: df.select("import_run_id", F.lit(problem).alias("problem"))
    problems = say(both.where("h is not null and l is not null and h <> l"), "differs-from-log").unionByName(say(both.where((F.col("h").isNotNull() & (F.coalesce("ordinal", F.lit(n + 1)) > n)) | (F.col("h").isNull() & (F.col("ordinal") <= n))), "not-the-logs-first-runs")).unionByName(say(links.where(~good), "invalid-repeat-link"))
    return rest.orderBy("ordinal"), problems


def wrong_bytes(restored: DataFrame, archived: DataFrame) -> DataFrame:
    """Runs whose archived export is gone or doesn't have the bytes that the log names. ``archived``: ``archive_path, content``."""
    rows = restored.join(archived.select("archive_path", F.sha2("content", 256).alias("now")), "archive_path", "left")
    return rows.where("now is null or now <> payload_id").select("import_run_id", "archive_path")
