"""Bronze: what becomes of an import run, and which payloads are in conflict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_refusals(runs: DataFrame) -> DataFrame:
    """``refusals``: every rule that a declared range breaks, in their order.

    ``runs``: ``covers_from, covers_through, exported_on`` and the payload's
    ``first_date, last_date`` (null: no records).
    """
    rules = {
        "range-starts-after-end": F.col("covers_from") > F.col("covers_through"),
        "range-ends-after-export": F.col("covers_through") > F.col("exported_on"),
        "transaction-before-range": F.col("first_date") < F.col("covers_from"),
        "transaction-after-range": F.col("last_date") > F.col("covers_through"),
    }
    return runs.withColumn("refusals", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])))


def run_outcomes(runs: DataFrame) -> DataFrame:
    """``outcome, repeat_of``: refused, a repeat of the same bytes in the same account, in conflict with another account's, or stored.

    ``runs``: ``import_run_id, payload_id, declared_account_id, started_at,
    refusals``. Runs are taken in order of their start; only the first stored run of
    a payload stores it.
    """
    good = F.size("refusals") == 0
    w = Window.partitionBy("payload_id").orderBy("started_at", "import_run_id")
    first = F.first(F.when(good, F.struct("import_run_id", "declared_account_id")), ignorenulls=True).over(w)
    rows = runs.withColumn("__first", first)
    own = F.col("__first.import_run_id") == F.col("import_run_id")
    outcome = F.when(~good, "refused").when(own, "stored").when(F.col("__first.declared_account_id") != F.col("declared_account_id"), "account-conflict").otherwise("repeat")
    rows = rows.withColumn("outcome", outcome)
    return rows.withColumn("repeat_of", F.when(F.col("outcome") == "repeat", F.col("__first.import_run_id"))).drop("__first")


def conflicting_payloads(runs: DataFrame) -> DataFrame:
    """Payloads declared in more than one format or for more than one account."""
    got = runs.groupBy("payload_id").agg(F.count_distinct("source_format").alias("formats"), F.count_distinct("declared_account_id").alias("accounts"))
    return got.where("formats > 1 or accounts > 1")


def counted_runs(runs: DataFrame, admitted: DataFrame) -> DataFrame:
    """Runs that count as evidence: not refused, and of an admitted payload of their account."""
    return runs.where("outcome <> 'refused'").join(admitted.select("declared_account_id", "payload_id"), ["declared_account_id", "payload_id"], "left_semi")
