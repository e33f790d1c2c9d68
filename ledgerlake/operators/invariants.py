"""Invariants of a publication, each as the rows that break it; empty frames are good."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def violations(transactions: DataFrame, allocations: DataFrame, categories: DataFrame, accounts: DataFrame) -> DataFrame:
    """``invariant, subject`` of every violation.

    ``transactions`` need ``account_sequence`` and ``transfer_group_id`` beside their
    type and amount.
    """
    kind, amount = F.col("transaction_type"), F.col("amount")
    say = lambda df, name, subject="transaction_id": df.select(F.lit(name).alias("invariant"), F.col(subject).cast("string").alias("subject"))
    w = Window.partitionBy("account_id").orderBy("account_sequence")
    ordered = transactions.withColumns({"__k": F.row_number().over(w), "__d": F.lag("transaction_date").over(w)})
    both = allocations.alias("a").join(transactions.alias("t"), "transaction_id", "left")
    of = allocations.join(categories.select("category_id", "direction"), "category_id", "left").select("transaction_id", "direction", F.col("amount").alias("part"))
    typed = transactions.join(of, "transaction_id", "left")
    wrong = ((kind == "income") & ((F.col("direction") != "income") | (amount <= 0))) | ((kind == "expense") & ((F.col("direction") != "expense") | (amount >= 0)))
    reverse = (kind == "refund") & (((F.col("direction") == "income") & (amount >= 0)) | ((F.col("direction") == "expense") & (amount <= 0)))
    groups = transactions.where("transfer_group_id is not null").groupBy("transfer_group_id").agg(F.count("*").alias("n"), F.count_distinct("account_id").alias("accounts"), F.sum("amount").alias("total"))
    closed = transactions.join(accounts.select("account_id", "closed_on"), "account_id").where("transaction_date > closed_on")
    parts = [
        say(ordered.where((F.col("__k") != F.col("account_sequence")) | (F.col("transaction_date") < F.col("__d"))), "sequence"),
        say(both.where((F.col("t.amount").isNull()) | (F.col("a.amount") != F.col("t.amount"))), "allocation-equals-transaction"),
        say(allocations.groupBy("transaction_id").count().where("count > 1"), "one-allocation"),
        say(typed.where(wrong | reverse), "sign-and-direction"),
        say(groups.where("n <> 2 or accounts <> 2 or total <> 0"), "transfer-pair", "transfer_group_id"),
        say(closed, "after-closing"),
        say(categories.groupBy("group_id").agg(F.count_distinct("direction").alias("n")).where("n > 1"), "one-direction-a-group", "group_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
