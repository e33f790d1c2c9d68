"""What one account's evidence says about its months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import month_of
from .sequence import chain_links


def month_spine(history: DataFrame, accounts: DataFrame, ranges: DataFrame) -> DataFrame:
    """``account_id, opened, month``: the managed period of each account with a transaction.

    From its first booked month to the latest month of any account's evidence, or
    to its closing month if that is earlier. The latest month is one value.
    """
    opened = history.groupBy("account_id").agg(month_of(F.min("transaction_date")).alias("opened"))
    latest = ranges.agg(month_of(F.max("covers_through")).alias("latest"))
    rows = opened.join(accounts.select("account_id", "closed_on"), "account_id").crossJoin(F.broadcast(latest))
    last = F.least(F.col("latest"), F.coalesce(month_of("closed_on"), F.col("latest")))
    rows = rows.withColumn("__last", last).where(F.col("__last") >= F.col("opened"))
    return rows.select("account_id", "opened", F.explode(F.sequence("opened", "__last", F.expr("interval 1 month"))).alias("month"))


def _months_of(spans: DataFrame, start: str, end: str, last: DataFrame, *lists: tuple[Column, str]) -> DataFrame:
    """An account's row with lists of months: those that a span of days touches, up to the account's last month, and of which a condition holds."""
    spans = spans.join(last, "account_id")
    to = F.least(month_of(end), F.col("last_month"))
    spans = spans.withColumn("__to", to).where(F.col("__to") >= month_of(start))
    spans = spans.withColumn("month", F.explode(F.sequence(month_of(start), F.col("__to"), F.expr("interval 1 month"))))
    return spans.groupBy("account_id").agg(*[F.collect_set(F.when(when, F.col("month"))).alias(name) for when, name in lists])


def _last_months(spine: DataFrame) -> DataFrame:
    return spine.groupBy("account_id").agg(F.max("month").alias("last_month"))


def _in(months: str):
    return F.coalesce(F.array_contains(months, F.col("month")), F.lit(False))


def month_coverage(spine: DataFrame, history: DataFrame, ranges: DataFrame) -> DataFrame:
    """``account_id, month, coverage``: no_data, partial or complete.

    Ranges and unchecked links are dealt out to the months they touch, of which an
    account has a list; its months look themselves up there, so they stay where the
    spine made them. The first managed month is partial at best.
    """
    last = _last_months(spine)
    whole = (F.col("covers_from") <= F.col("month")) & (F.last_day("month") <= F.col("covers_through"))
    touched = _months_of(ranges, "covers_from", "covers_through", last, (F.lit(True), "__touched"), (whole, "__whole"))
    broken = _months_of(chain_links(history).where("not verified"), "link_from", "link_to", last, (F.lit(True), "__broken"))
    rows = spine.join(touched, "account_id", "left").join(broken, "account_id", "left")
    state = (
        F.when(~_in("__touched"), "no_data")
        .when(F.col("month") == F.col("opened"), "partial")
        .when(_in("__whole") & ~_in("__broken"), "complete")
        .otherwise("partial")
    )
    return rows.select("account_id", "month", state.alias("coverage"))


def with_late_bookings(rows: DataFrame, exports: DataFrame, window_days: int = 7) -> DataFrame:
    """Rows of an account's months with ``late_bookings_settled``: an export made that long after the month's end covers its last day."""
    end = F.last_day("month")
    good = (F.col("exported_on") >= F.date_add(end, window_days)) & end.between(F.col("covers_from"), F.col("covers_through"))
    seen = _months_of(exports, "covers_from", "covers_through", _last_months(rows), (good, "__settled"))
    return rows.join(seen, "account_id", "left").select(*rows.columns, _in("__settled").alias("late_bookings_settled"))


def late_bookings(spine: DataFrame, exports: DataFrame, window_days: int = 7) -> DataFrame:
    """``account_id, month, late_bookings_settled`` of the spine's months."""
    return with_late_bookings(spine.select("account_id", "month"), exports, window_days)


def monthly_balances(spine: DataFrame, history: DataFrame, coverage: DataFrame) -> DataFrame:
    """``account_id, month, opening_balance, closing_balance, coverage``; ``coverage`` is the spine with each month's state, so the spine isn't read again.

    From the month's first and last rows; a complete quiet month carries the latest
    earlier balance; no_data has neither. A missing balance stays missing. An
    account has its months with rows as one list, in which each month looks for
    itself and for the latest before it.
    """
    ends = history.groupBy("account_id", month_of("transaction_date").alias("month")).agg(
        F.min_by(F.struct("amount", "balance_after"), "account_sequence").alias("first"),
        F.max_by("balance_after", "account_sequence").alias("b"),
    )
    a = F.col("first.balance_after") - F.col("first.amount")
    ends = ends.groupBy("account_id").agg(F.array_sort(F.collect_list(F.struct("month", a.cast("decimal(38,2)").alias("opening"), F.col("b").cast("decimal(38,2)").alias("closing")))).alias("__ends"))
    rows = coverage.join(ends, "account_id", "left")
    upto = F.filter("__ends", lambda e: e["month"] <= F.col("month"))
    rows = rows.withColumn("__last", F.try_element_at(upto, F.lit(-1))).drop("__ends")
    own, known = F.coalesce(F.col("__last.month") == F.col("month"), F.lit(False)), F.col("coverage") != "no_data"
    carried = F.when(known & ~own & (F.col("coverage") == "complete"), F.col("__last.closing"))
    return rows.select(
        "account_id",
        "month",
        F.when(known & own, F.col("__last.opening")).otherwise(carried).alias("opening_balance"),
        F.when(known & own, F.col("__last.closing")).otherwise(carried).alias("closing_balance"),
        "coverage",
    )


def opening_gap(balances: DataFrame) -> DataFrame:
    """``opening_gap``: a month's opening less the previous calendar month's closing."""
    w = Window.partitionBy("account_id").orderBy("month")
    before = F.lag(F.struct("month", "closing_balance")).over(w)
    rows = balances.withColumn("__before", before)
    near = F.col("__before.month") == F.add_months("month", -1)
    return rows.withColumn("opening_gap", F.when(near, F.col("opening_balance") - F.col("__before.closing_balance")).cast("decimal(38,2)")).drop("__before")


def combined_status(rows: DataFrame, *by: str) -> DataFrame:
    """``status`` of several account-months; those ``outside_history`` don't contribute, and nothing at all is no_data."""
    inside = F.col("coverage") != "outside_history"
    n = F.count_if(inside)
    none = F.count_if(inside & (F.col("coverage") == "no_data"))
    whole = F.count_if(inside & (F.col("coverage") == "complete"))
    status = F.when(n == none, "no_data").when(n == whole, "complete").otherwise("partial")
    return rows.groupBy(*by).agg(status.alias("status"), F.count_if(~F.col("late_bookings_settled")).alias("unsettled"))


def account_months(rows: DataFrame, accounts: DataFrame, first: str, last: str) -> DataFrame:
    """The months from ``first`` to ``last`` of every account, judged.

    A snapshot gives its own coverage. Without any, an account is no_data and
    settled; before its first month or after its closing month it is
    outside_history; else no_data and unsettled.
    """
    known = rows.groupBy("account_id").agg(F.min("month").alias("first_month"))
    spine = accounts.select("account_id", "closed_on", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("month"))
    asked = rows.where(F.col("month").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    got = spine.join(known, "account_id", "left").join(asked, ["account_id", "month"], "left")
    outside = (F.col("month") < F.col("first_month")) | (F.col("month") > month_of("closed_on"))
    coverage = F.when(F.col("coverage").isNotNull(), F.col("coverage")).when(F.col("first_month").isNull(), "no_data").when(outside, "outside_history").otherwise("no_data")
    settled = F.when(F.col("coverage").isNotNull(), F.col("late_bookings_settled")).when(F.col("first_month").isNull(), True).otherwise(F.coalesce(outside, F.lit(False)))
    return got.select("account_id", "month", coverage.alias("coverage"), settled.alias("late_bookings_settled"))
