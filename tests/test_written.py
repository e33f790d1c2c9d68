"""What balances, decisions and views shuffle and write."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from test_cost import records_shuffled
from test_spread import facts, shuffled

from ledgerlake.operators import decisions, measures, sequence
from ledgerlake.plans import views
from ledgerlake.plans.views import Views


def test_links_read_one_shuffle(spark):
    n = 8000
    rows = spark.range(n).selectExpr("CAST(id % 10 AS int) AS account_id", "CAST(id DIV 10 AS int) AS account_sequence", "date_add(date'2031-01-01', CAST(id DIV 400 AS int)) AS transaction_date", "CAST(1 AS decimal(18,2)) AS amount", "CAST(id DIV 10 AS decimal(38,2)) AS balance_after")
    lost = rows.limit(1).withColumn("transaction_date", F.lit(None).cast("date"))
    got = []
    with shuffled(spark):
        # Before, twice.
        assert records_shuffled(spark, lambda: got.extend(sequence.chain_links(rows.unionByName(lost)).groupBy("verified").count().collect())) < 1.5 * n
    assert [tuple(r) for r in got] == [(True, n)]


def test_balances_stay_with_their_account(spark):
    accounts = spark.range(100).selectExpr("CAST(id AS int) AS account_id").groupBy("account_id").agg(F.lit("complete").alias("coverage"))
    balances = accounts.select("account_id", F.explode(F.sequence(F.lit(date(2031, 1, 1)), F.lit(date(2037, 8, 1)), F.expr("interval 1 month"))).alias("month"), F.lit(0).cast("decimal(38,2)").alias("opening_balance"), F.lit(5).cast("decimal(38,2)").alias("closing_balance"), "coverage")
    rows = spark.createDataFrame([(k % 100, date(2031, 1, 1) + timedelta(k), "income") for k in range(300)], "account_id int, transaction_date date, transaction_type string").withColumns({"amount": F.lit(5).cast("decimal(18,2)"), "measure": F.col("transaction_type")})
    got = []
    with shuffled(spark):
        # Before, every month of an account: 8,000.
        assert records_shuffled(spark, lambda: got.extend(measures.reconciliation(rows, balances).groupBy("income", "internal_residual").count().collect())) < 2000
    assert sorted((float(r["income"]), float(r["internal_residual"]), r["count"]) for r in got) == [(0.0, 5.0, 7700), (5.0, 0.0, 300)]


def test_measure_of_the_category_beside(spark):
    df = facts(spark).withColumns({"transaction_type": F.when(F.col("account_id") == 0, "refund").when(F.col("account_id") == 1, None).when(F.col("account_id") == 2, "transfer").otherwise("income"), "category_id": F.when(F.col("account_id") != 3, "c")})
    categories = spark.createDataFrame([("c", "g", "expense")], "category_id string, group_id string, direction string")
    got = measures.measured_by_category(df, categories)
    want = measures.measured(df, df.where("category_id is not null"), categories)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_decisions_are_shuffled_to_targets_and_back(spark):
    df = facts(spark)
    accounts = spark.createDataFrame([(k, None) for k in range(40)], "account_id int, closed_on date")
    log = df.select(F.concat(F.lit("d"), "transaction_id").alias("decision_id"), F.lit("classify").alias("kind"), F.array("transaction_id").alias("targets"), F.lit(None).cast("int").alias("counterpart_account_id"))
    got = []
    with shuffled(spark):
        # Decisions, transactions and what is found, and accounts; before, two times more.
        assert records_shuffled(spark, lambda: got.extend(decisions.applicability(log, df, accounts).groupBy("reason").count().collect())) < 4.2 * 800
    assert [tuple(r) for r in got] == [(None, 800)]


def test_decisions_of_every_kind(spark):
    df = facts(spark).withColumn("amount", F.when(F.col("transaction_id") == "t0", 0).when(F.col("transaction_id") == "t2", -1).otherwise(1).cast("decimal(18,2)"))
    # The second account is declared twice, open and closed.
    accounts = spark.createDataFrame([(0, None), (1, None), (1, date(2030, 1, 1))], "account_id int, closed_on date")
    log = spark.createDataFrame(
        [("a", "classify", ["t0"], None), ("b", "pair", ["t1", "t2"], None), ("c", "pair", ["t1", "t3"], None), ("d", "pair", ["t2", "t42"], None), ("e", "one-sided-transfer", ["t4"], 0), ("f", "one-sided-transfer", ["t4"], 1), ("g", "one-sided-transfer", ["t4"], 99), ("h", "classify", ["t5", "none"], None), ("i", "classify", ["t5"], None), ("i", "classify", ["t0"], None)],
        "decision_id string, kind string, targets array<string>, counterpart_account_id int",
    )
    got = sorted((r["decision_id"], tuple(r["present"]), r["reason"] or "") for r in decisions.applicability(log, df, accounts).collect())
    inside = "inside-managed-period"
    # A decision id that comes twice is one decision.
    assert got == [("a", ("t0",), "zero-amount"), ("b", ("t1", "t2"), ""), ("c", ("t1", "t3"), "amounts-do-not-cancel"), ("d", ("t2", "t42"), "same-account"), ("e", ("t4",), inside), ("f", ("t4",), ""), ("f", ("t4",), inside), ("g", ("t4",), ""), ("h", ("t5",), "target-missing"), ("i", ("t0", "t5"), "zero-amount")]


@pytest.mark.parametrize("texts", [0, 200_000])
def test_history_is_written_without_transactions(spark, tmp_path, monkeypatch, texts):
    day = date(2031, 1, 1)
    made = {
        "customer": ([(1, "me"), (2, "me")], "c_custkey long, c_mktsegment string"),
        "part": ([(0, "ring", "PROMO", "Brand#1"), (1, None, "SMALL", "Brand#3"), (2, "ring", "PROMO", "Brand#1")], "p_partkey long, p_name string, p_type string, p_brand string"),
        "orders": ([(k, 1 + k % 2, day + timedelta(k)) for k in range(6)], "o_orderkey long, o_custkey long, o_orderdate date"),
        "lineitem": ([(k, k % 3, 1, 1, 1.0, 2.0 + k, "RA"[k % 2], "F") for k in range(6)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string"),
        "events": ([(0, 1)], "event_id long, user_id long"),
    }
    for name, (rows, kinds) in made.items():
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(views, "PART_TEXTS", texts)
    v = Views(spark, str(tmp_path))
    rows = sorted(map(str, v.history.collect()))
    assert len(rows) == 6 and v.has("history") and not v.has("unordered")
    first = sorted(map(str, v.transactions.collect()))
    assert not v.has("unordered") and sorted(map(str, v.unordered.collect())) == first
    views._KEPT.pop(v._key("history"))
    # Of written transactions the history is the same.
    assert sorted(map(str, Views(spark, str(tmp_path)).history.collect())) == rows
