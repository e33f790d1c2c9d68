"""Measures of the reports: sums over types, categories and months.

Transactions and allocations are the same money and are never added together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import TOTAL, sum_if
from ..session import small


def measured(transactions: DataFrame, allocations: DataFrame, categories: DataFrame) -> DataFrame:
    """``measure`` of each transaction: income, expense, or for a refund its category's direction."""
    of = allocations.join(categories.select("category_id", "direction"), "category_id").groupBy("transaction_id").agg(F.max("direction").alias("__direction"))
    kind = F.col("transaction_type")
    # Only refunds need their category: all others have their measure by type, and aren't shuffled.
    refund = F.coalesce(kind == "refund", F.lit(False))
    refunds = transactions.where(refund).join(of, "transaction_id", "left").select(*transactions.columns, F.col("__direction").alias("measure"))
    return transactions.where(~refund).withColumn("measure", F.when(kind.isin("income", "expense"), kind)).unionByName(refunds)


def measured_by_category(transactions: DataFrame, categories: DataFrame) -> DataFrame:
    """``measure`` of transactions that have their category beside them (``category_id``), as ``measured`` has it: nothing is shuffled for it."""
    of = categories.groupBy("category_id").agg(F.max("direction").alias("__direction"))
    kind = F.col("transaction_type")
    measure = F.when(kind == "refund", F.col("__direction")).when(kind.isin("income", "expense"), kind)
    return transactions.join(small(of), "category_id", "left").select(*transactions.columns, measure.alias("measure"))


def figures(rows: DataFrame, *by: str) -> DataFrame:
    """Income, expenses, net, savings rate, and unclassified and adjustment money, in one pass."""
    m, kind, amount = F.col("measure"), F.col("transaction_type"), F.col("amount")
    out = [sum_if(m == "income", amount).alias("income"), (-sum_if(m == "expense", amount)).cast(TOTAL).alias("expenses")]
    for name, value in (("unclassified", "unknown"), ("adjustments", "adjustment")):
        out += [
            sum_if((kind == value) & (amount > 0), amount).alias(f"{name}_in"),
            sum_if((kind == value) & (amount < 0), amount).alias(f"{name}_out"),
            F.count_if(kind == value).alias(f"{name}_count"),
        ]
    got = rows.groupBy(*by).agg(*out).withColumn("net", (F.col("income") - F.col("expenses")).cast(TOTAL))
    rate = F.col("net").cast("decimal(19,2)") / F.col("income").cast("decimal(19,2)")
    return got.withColumn("savings_rate", F.when(F.col("income") > 0, rate))


def category_spending(allocations: DataFrame, categories: DataFrame, *by: str) -> DataFrame:
    """Spending of the expense-direction categories, refunds taken off; it may be negative."""
    rows = allocations.join(categories.where("direction = 'expense'").select("category_id", "group_id"), "category_id")
    return rows.groupBy(*by, "group_id", "category_id").agg((-F.sum("amount")).cast(TOTAL).alias("spending"))


def group_rollup(allocations: DataFrame, categories: DataFrame) -> DataFrame:
    """Spending by category, by group and in all, from one pass; ``level`` 0, 1, 3."""
    rows = allocations.join(categories.where("direction = 'expense'").select("category_id", "group_id"), "category_id")
    return rows.rollup("group_id", "category_id").agg((-F.sum("amount")).cast(TOTAL).alias("spending"), F.grouping_id().cast("int").alias("level"))


def transfer_summary(transactions: DataFrame, *by: str) -> DataFrame:
    """Legs, money in and out, pairs of which both legs are seen, and legs alone."""
    legs = transactions.where("transaction_type = 'transfer'")
    # A leg without a group is alone, lest all of them come to one task.
    alone = F.when(F.col("transfer_group_id").isNull(), F.col("transaction_id"))
    in_group = F.count("*").over(Window.partitionBy(*by, "transfer_group_id", alone))
    legs = legs.withColumn("__n", F.when(F.col("transfer_group_id").isNotNull(), in_group).otherwise(1))
    amount = F.col("amount")
    return legs.groupBy(*by).agg(
        F.count("*").alias("legs"),
        sum_if(amount > 0, amount).alias("money_in"),
        sum_if(amount < 0, amount).alias("money_out"),
        F.count_if(F.col("__n") == 2).alias("paired"),
        F.count_if(F.col("__n") != 2).alias("one_sided"),
    )


def reconciliation(rows: DataFrame, balances: DataFrame) -> DataFrame:
    """Activity of each account-month against its balances.

    ``internal_residual`` is what closing has beyond opening and all activity. In a
    no_data month activity is unknown, and so is the residual. An account has its
    months with activity as one list, in which each month looks for itself, so
    balances stay where their account is.
    """
    kind, amount = F.col("transaction_type"), F.col("amount")
    month = F.trunc("transaction_date", "MM")
    activity = rows.groupBy("account_id", month.alias("month")).agg(
        sum_if(F.col("measure") == "income", amount).alias("income"),
        (-sum_if(F.col("measure") == "expense", amount)).cast(TOTAL).alias("expenses"),
        sum_if(kind == "transfer", amount).alias("transfers"),
        sum_if(kind == "unknown", amount).alias("unclassified"),
        sum_if(kind == "adjustment", amount).alias("adjustments"),
    )
    parts = ["income", "expenses", "transfers", "unclassified", "adjustments"]
    lists = activity.groupBy("account_id").agg(F.collect_list(F.struct("month", *parts)).alias("__months"))
    own = F.get(F.filter("__months", lambda x: x["month"] == F.col("month")), F.lit(0))
    got = balances.join(lists, "account_id", "left").withColumn("__own", own).select(*balances.columns, *[F.col(f"__own.{p}") for p in parts])
    got = got.withColumns({p: F.when(F.col("coverage") != "no_data", F.coalesce(p, F.lit(0))).cast(TOTAL) for p in parts})
    total = F.col("opening_balance") + F.col("income") - F.col("expenses") + F.col("transfers") + F.col("unclassified") + F.col("adjustments")
    return got.withColumn("internal_residual", (F.col("closing_balance") - total).cast(TOTAL))


def month_measures(rows: DataFrame, allocations: DataFrame, categories: DataFrame) -> DataFrame:
    """A publication's measures by month and account as rows ``kind, name, value``: what a diff compares."""
    got = figures(rows, "account_id", "month")
    names = ["income", "expenses", "unclassified_in", "unclassified_out", "unclassified_count"]
    flat = got.select("account_id", "month", F.explode(F.array(*[F.struct(F.lit("figure").alias("kind"), F.lit(n).alias("name"), F.col(n).cast(TOTAL).alias("value")) for n in names])).alias("m")).select("account_id", "month", "m.*")
    owned = allocations.join(categories.select("category_id", "group_id"), "category_id")
    sums = owned.groupBy("account_id", "month", "group_id", "category_id").agg(F.sum("amount").cast(TOTAL).alias("value"))
    by_category = sums.select("account_id", "month", F.lit("category").alias("kind"), F.col("category_id").alias("name"), "value")
    by_group = sums.groupBy("account_id", "month", "group_id").agg(F.sum("value").cast(TOTAL).alias("value"))
    by_group = by_group.select("account_id", "month", F.lit("group").alias("kind"), F.col("group_id").alias("name"), "value")
    return flat.unionByName(by_category).unionByName(by_group)


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changed measures of two publications; one that is absent counts as 0, so none that is 0 is shuffled."""
    key = ["account_id", "month", "kind", "name"]
    before, after = before.where("value <> 0"), after.where("value <> 0")
    both = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), key, "full_outer")
    zero = F.lit(0).cast(TOTAL)
    both = both.withColumn("before", F.coalesce("before", zero)).withColumn("after", F.coalesce("after", zero))
    return both.where("before <> after")


def directed(changed: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``changed`` measures with ``change``: spending of an expense category or group grows as amounts fall, everything else as they rise.

    ``before`` and ``after`` are the publications' categories; where a direction
    differs, the later one counts. A row for each changed measure.
    """
    both = before.select("category_id", "group_id", "direction", F.lit(0).alias("at")).unionByName(after.select("category_id", "group_id", "direction", F.lit(1).alias("at")))
    of = lambda kind, column: both.groupBy(F.lit(kind).alias("kind"), F.col(column).alias("name")).agg(F.max(F.struct("at", "direction"))["direction"].alias("direction"))
    ways = of("category", "category_id").unionByName(of("group", "group_id"))
    rise = F.col("after") - F.col("before")
    return changed.join(ways, ["kind", "name"], "left").withColumn("change", F.when(F.col("direction") == "expense", -rise).otherwise(rise).cast(TOTAL)).drop("direction")
