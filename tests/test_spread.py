"""Rows without a key, and all rows of a month, aren't brought to one task."""

from contextlib import contextmanager
from datetime import date, datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlake.operators import coverage, decisions, measures, retention, sequence
from ledgerlake.plans import reports


@contextmanager
def shuffled(spark):
    """Joins are shuffled as they are planned, as with tables of any size."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, x in conf.items():
        spark.conf.set(k, x)
    try:
        yield
    finally:
        for k, x in before.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)


def fullest(df):
    """The share of the rows that the fullest task has."""
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes) / sum(sizes)


def facts(spark, n=800):
    rows = [(f"t{k}", k % 40, date(2031, 1, 1) + timedelta(k % 50), "transfer", f"g{k // 2}" if k < 8 else None) for k in range(n)]
    return spark.createDataFrame(rows, "transaction_id string, account_id int, transaction_date date, transaction_type string, transfer_group_id string").withColumn("amount", F.lit(1).cast("decimal(18,2)"))


def test_decisions_without_a_counterpart(spark):
    df = facts(spark)
    accounts = spark.createDataFrame([(k, None) for k in range(40)], "account_id int, closed_on date")
    log = df.select(F.concat(F.lit("d"), "transaction_id").alias("decision_id"), F.when(F.col("account_id") == 0, "one-sided-transfer").otherwise("classify").alias("kind"), F.array("transaction_id").alias("targets"), F.when(F.col("account_id") == 0, F.lit(1)).alias("counterpart_account_id"))
    with shuffled(spark):
        got = decisions.applicability(log, df, accounts)
        assert fullest(got) < 0.5
        assert {r["reason"]: r["count"] for r in got.groupBy("reason").count().collect()} == {None: 780, "inside-managed-period": 20}


def test_rows_without_a_group(spark):
    df = facts(spark)
    with shuffled(spark):
        got = reports.with_other_leg(df, df)
        assert fullest(got) < 0.5 and fullest(df.repartition("transfer_group_id")) > 0.9
        assert {r["transaction_id"]: (r["counterpart_transaction_id"], r["counterpart_account_id"]) for r in got.where("counterpart_transaction_id is not null").collect()} == {f"t{k}": (f"t{k ^ 1}", k ^ 1) for k in range(8)}
        assert got.count() == 800
        summary = measures.transfer_summary(df)
        assert (summary.first()["paired"], summary.first()["one_sided"]) == (8, 792)
        plan = summary._jdf.queryExecution().executedPlan().toString()
        assert any("transfer_group_id" in x and x.count("#") > 1 for x in plan.splitlines() if "hashpartitioning" in x)


def test_backups_are_gathered_by_day_before_windows(spark):
    start = datetime(2030, 1, 1)
    made = [(k, start + timedelta(hours=7 * k)) for k in range(2000)]
    sets = spark.createDataFrame([*made, (9999, None)], "set_id long, created_at timestamp")
    today = date(2031, 8, 10)
    got = retention.kept_backups(sets, F.lit(today))
    want = {9999: "monthly"}
    for k, at in made:
        age, later = (today - at.date()).days, [b for b in made if b[1] > at]
        of_day, of_month = not any(b.date() == at.date() for _, b in later), not any((b.year, b.month) == (at.year, at.month) for _, b in later)
        kept = "recent" if age < 14 else "daily" if age < 365 and of_day else "monthly" if of_month else None
        if kept:
            want[k] = kept
    assert {r["set_id"]: r["kept"] for r in got.collect()} == want and set(want.values()) == {"recent", "daily", "monthly"}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate")


def test_an_accounts_months_stay_where_they_were_made(spark):
    df = facts(spark).withColumns({"account_sequence": F.row_number().over(Window.partitionBy("account_id").orderBy("transaction_id")), "balance_after": F.lit(1).cast("decimal(18,2)")})
    accounts = spark.createDataFrame([(k, None) for k in range(40)], "account_id int, closed_on date")
    exports = spark.createDataFrame([(k, date(2031, 1, 1), date(2032, 3, 1), date(2032, 4, 1)) for k in range(40)], "account_id int, covers_from date, covers_through date, exported_on date")
    ranges = sequence.evidence_ranges(exports)
    with shuffled(spark):
        spine = coverage.month_spine(df, accounts, ranges)
        got = coverage.with_late_bookings(coverage.monthly_balances(spine, df, coverage.month_coverage(spine, df, ranges)), exports)
        assert got.count() == spine.count() > 400
        plan = got._jdf.queryExecution().executedPlan().toString()
        # Only a month's rows are gathered by account and month, not the months themselves.
        assert sum("hashpartitioning(account_id" in x and " month#" in x for x in plan.splitlines()) <= 1


def test_history_is_dealt_out_once(spark):
    from ledgerlake.plans.views import Views

    class Given(Views):
        transactions = facts(spark)

    made = Views.__dict__["history"].func.__closure__
    plan = next(c.cell_contents for c in made if callable(c.cell_contents) and c.cell_contents.__name__ == "history")(Given(spark, ""))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_only_refunds_and_measures_that_are_not_zero_are_shuffled(spark):
    df = facts(spark).withColumns({"transaction_type": F.when(F.col("account_id") == 0, "refund").when(F.col("account_id") == 1, None).otherwise("income"), "month": F.trunc("transaction_date", "MM"), "category_id": F.lit("c")})
    categories = spark.createDataFrame([("c", "g", "expense")], "category_id string, group_id string, direction string")
    with shuffled(spark):
        rows = measures.measured(df, df, categories)
        assert {(r["transaction_type"], r["measure"]): r["count"] for r in rows.groupBy("transaction_type", "measure").count().collect()} == {("income", "income"): 760, ("refund", "expense"): 20, (None, None): 20}
        join = rows._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")
        assert len(join) == 2 and join[1].splitlines()[1].count("Filter") + join[1].splitlines()[2].count("Filter") > 0
        flat = measures.month_measures(rows, df, categories)
        more = flat.withColumn("value", F.when(F.col("name") == "g", 0).otherwise(F.col("value")).cast("decimal(38,2)"))
        got = measures.compare(flat, more)
        assert {(r["kind"], r["after"]) for r in got.collect()} == {("group", 0)}
        assert "(value" in got._jdf.queryExecution().optimizedPlan().toString() and " = 0" in got._jdf.queryExecution().optimizedPlan().toString()
