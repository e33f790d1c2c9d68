"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], as one JSON line; ``views`` is what the tables that they share took to write."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (sys.path[0], os.environ.get("PYTHONPATH", "")) if x)

from ledgerlake.plans.gold_queries import QUERIES  # noqa: E402
from ledgerlake.plans.views import Views  # noqa: E402
from ledgerlake.session import local  # noqa: E402

HEADLINE = ["monthly_overview", "category_spending", "group_rollup", "reconciliation", "account_sequence", "balance_check", "month_coverage", "monthly_balances", "rule_classify", "transfer_candidates", "transfer_match", "publication_diff", "handles", "completeness", "transaction_id_hash", "silver_merge", "gold_transactions", "report_overview"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local(os.environ.get("BENCH_CPUS", "8"), memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    began = time.time()
    Views(spark, sf_dir).write()
    views, took = round(time.time() - began, 3), {}
    for name in HEADLINE:
        if name in QUERIES:
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "ledger queries, total seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "views": views, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
