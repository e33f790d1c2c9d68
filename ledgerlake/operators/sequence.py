"""Order and balance chains.

What runs through an account's rows is taken by day: windows hold one day of an
account, and what a day hands on to the next (rows, sums, its first row, its last
stated balance) goes through a window over days, of which a calendar has few. Both
read one shuffle by account and day, so no task has all rows of an account.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def occurrences(rows: DataFrame, export: str, *key: str, order: str) -> DataFrame:
    """``occurrence``: how often an identical row has come in its export so far."""
    w = Window.partitionBy(export, *key).orderBy(order)
    return rows.withColumn("occurrence", F.row_number().over(w))


def day_positions(rows: DataFrame, export: str, day: str, order: str) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(export, day).orderBy(order)))


def account_sequence(rows: DataFrame, *order: str, account: str = "account_id", day: str | None = None) -> DataFrame:
    """``account_sequence`` by ``order``; with ``day``, a date that comes first in the order and isn't null, an account is numbered day by day."""
    if day is None:
        return rows.withColumn("account_sequence", F.row_number().over(Window.partitionBy(account).orderBy(*order)))
    dealt = rows.repartition(account, day)
    days = dealt.groupBy(account, day).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(account).orderBy(day).rowsBetween(Window.unboundedPreceding, -1))
    days = days.select(account, day, F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(account, day).orderBy(*order))
    got = dealt.withColumn("__own", own).join(days, [account, day])
    return got.select(*rows.columns, (F.col("__before") + F.col("__own")).cast("int").alias("account_sequence"))


def chain_errors(rows: DataFrame, export: str = "payload_id", order: str = "record_ordinal") -> DataFrame:
    """Booked rows that state no balance, or one that doesn't follow the previous row's.

    ``rows``: ``readable, booking_status, amount, balance``. An unreadable record or
    a missing balance leaves the next link unchecked; rows not booked are passed over.
    """
    links = rows.where("not readable or booking_status = 'booked'")
    return links.withColumn("code", chain_code(export, order=order)).where("code is not null")


def chain_code(*by: str, order: str) -> Column:
    """What is wrong with a row's balance, among the rows of its ``by`` that make the chain."""
    before = F.lag(F.when(F.col("readable"), F.col("balance"))).over(Window.partitionBy(*by).orderBy(order))
    code = F.when(F.col("balance").isNull(), "missing-balance").when(before + F.col("amount") != F.col("balance"), "balance-chain-break")
    return F.when(F.col("readable"), code)


def balance_check(rows: DataFrame, account: str = "account_id", order: str = "account_sequence", day: str = "transaction_date") -> DataFrame:
    """``balance_check`` of ``amount`` and ``balance_after``: opening, consistent, break or missing_balance.

    A stated balance is compared with the last one stated before plus all amounts
    since; after a break the chain goes on from the break's own balance. ``day``
    rises with ``order``, and neither it nor the account is null; rows without such a
    column are taken account by account.
    """
    given = rows.columns
    if day not in given:
        rows = rows.withColumn(day, F.lit(0))
    w, earlier = Window.partitionBy(account, day).orderBy(order), lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    stated = F.when(F.col("balance_after").isNotNull(), F.struct("balance_after", "__sum"))
    dealt = rows.repartition(account, day).withColumns({"__sum": F.sum("amount").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__own": F.row_number().over(w)})
    dealt = dealt.withColumn("__near", F.last(stated, ignorenulls=True).over(earlier(w)))
    over_days = Window.partitionBy(account).orderBy(day)
    last = F.max(F.when(F.col("balance_after").isNotNull(), F.struct(order, "balance_after", "__sum")))
    days = dealt.groupBy(account, day).agg(F.sum("amount").alias("__total"), last.alias("__last"))
    days = days.withColumns({"__before": F.coalesce(F.sum("__total").over(earlier(over_days)), F.lit(0)), "__day": F.row_number().over(over_days)})
    anchor = F.when(F.col("__last").isNotNull(), F.struct(F.col("__last.balance_after").alias("balance_after"), (F.col("__before") + F.col("__last.__sum")).alias("sum")))
    days = days.select(account, day, "__before", "__day", F.last(anchor, ignorenulls=True).over(earlier(over_days)).alias("__far"))
    got = dealt.join(days, [account, day])
    near = F.col("__near").isNotNull()
    balance = F.when(near, F.col("__near.balance_after")).otherwise(F.col("__far.balance_after"))
    since = F.col("__sum") - F.when(near, F.col("__near.__sum")).otherwise(F.col("__far.sum") - F.col("__before"))
    check = (
        F.when((F.col("__day") == 1) & (F.col("__own") == 1) & F.col("balance_after").isNotNull(), "opening")
        .when(F.col("balance_after").isNull(), "missing_balance")
        .when(balance.isNull(), "opening")
        .when(balance + since == F.col("balance_after"), "consistent")
        .otherwise("break")
    )
    return got.select(*given, check.alias("balance_check"))


def chain_links(rows: DataFrame, account: str = "account_id", order: str = "account_sequence") -> DataFrame:
    """``account, link_from, link_to, verified``: from each row's date to the next row's, open-ended after the last."""
    row, key = F.struct("transaction_date", "amount", "balance_after"), [account, "transaction_date"]
    # Rows without a key have no link. They are left out before rows are dealt out, so that both steps below read one shuffle.
    dealt = rows.where(F.col(account).isNotNull() & F.col("transaction_date").isNotNull()).select(account, order, "transaction_date", "amount", "balance_after").repartition(*key)
    days = dealt.groupBy(*key).agg(F.min(F.struct(F.col(order).alias("at"), row.alias("row")))["row"].alias("__first"))
    days = days.select(*key, F.lead("__first").over(Window.partitionBy(account).orderBy("transaction_date")).alias("__later"))
    near = F.lead(row).over(Window.partitionBy(*key).orderBy(order))
    rows = dealt.withColumn("__near", near).join(days, key).withColumn("__next", F.coalesce("__near", "__later"))
    verified = F.coalesce(F.col("balance_after") + F.col("__next.amount") == F.col("__next.balance_after"), F.lit(False))
    end = F.coalesce(F.col("__next.transaction_date"), F.lit("9999-12-31").cast("date"))
    return rows.select(account, order, F.col("transaction_date").alias("link_from"), end.alias("link_to"), F.when(F.col("__next").isNull(), F.col("balance_after").isNotNull()).otherwise(verified).alias("verified"))


def evidence_ranges(exports: DataFrame, account: str = "account_id") -> DataFrame:
    """Declared ranges as maximal stretches of days; ranges that touch are one."""
    w = Window.partitionBy(account).orderBy("covers_from", "covers_through")
    seen = F.max("covers_through").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("covers_from") > F.date_add(seen, 1), F.lit(True)).cast("int")
    part = exports.withColumn("__new", new).withColumn("__part", F.sum("__new").over(w))
    return part.groupBy(account, "__part").agg(F.min("covers_from").alias("covers_from"), F.max("covers_through").alias("covers_through")).drop("__part")
