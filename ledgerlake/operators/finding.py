"""Finding transactions, their short handles, and what the bank's labels suggest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import TOTAL, fold
from ..session import small


def handles(ids: DataFrame, column: str = "transaction_id", least: int = 8) -> DataFrame:
    """``handle``: the shortest prefix of at least ``least`` characters that only one id has.

    An id shares its longest prefix with a neighbour in sorted order. Ids are cut
    into ranges by their first ``least`` characters: within one range neighbours
    are compared, and across ranges no longer prefix is shared.
    """
    w = Window.partitionBy(F.substring(column, 1, least)).orderBy(column)

    def shared(other):
        n = F.least(F.length(column), F.length(other))
        at = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(F.col(column), i, F.lit(1)) != F.substring(other, i, F.lit(1)))
        return F.when(other.isNotNull(), F.coalesce(F.get(at, F.lit(0)) - 1, n)).otherwise(0)

    rows = ids.withColumns({"__a": F.lag(column).over(w), "__b": F.lead(column).over(w)})
    size = F.greatest(F.lit(least), F.greatest(shared(F.col("__a")), shared(F.col("__b"))) + 1)
    return rows.withColumn("handle", F.substring(F.col(column), F.lit(1), size)).drop("__a", "__b")


def near(ids: DataFrame, hits: DataFrame, column: str = "transaction_id", least: int = 8) -> DataFrame:
    """The ids that share their first ``least`` characters with a hit, on which alone hits' handles depend."""
    first = F.substring(column, 1, least)
    wanted = small(hits.select(first.alias("__first")).distinct())
    return ids.withColumn("__first", first).join(wanted, "__first", "left_semi").drop("__first")


def handles_of(hits: DataFrame, ids: DataFrame, column: str = "transaction_id", least: int = 8) -> DataFrame:
    """``column, handle`` of the hits that are among ``ids``; only ids of their ranges are compared."""
    named = handles(near(ids.select(column), hits, column, least), column, least)
    return named.join(hits.select(column), column, "left_semi")


def find(rows: DataFrame, text: str, month: str | None = None, account=None) -> DataFrame:
    """Transactions whose folded description holds the folded text."""
    # Texts are folded last, of the rows that are left.
    if month is not None:
        rows = rows.where(F.trunc("transaction_date", "MM") == F.lit(month).cast("date"))
    if account is not None:
        rows = rows.where(F.col("account_id") == account)
    return rows.where(fold(F.col("description")).contains(text.casefold()))


def label_pairs(rows: DataFrame) -> DataFrame:
    """Bank label pairs by folded spelling: the most used spelling, rows, and their sum, for each currency apart.

    ``rows``: ``category, subcategory, currency, amount``; a spelling's use is counted
    over all currencies. First by exact spelling, then by fold.
    """
    exact = rows.groupBy("category", "subcategory", "currency").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    exact = exact.withColumns({"f": fold(F.col("category")), "g": fold(F.col("subcategory"))})
    used = exact.groupBy("f", "g", "category", "subcategory").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("f", "g").orderBy(F.desc("n"), "category", F.asc_nulls_last("subcategory"))
    named = used.withColumn("k", F.row_number().over(w)).where("k = 1").select(F.col("f").alias("pf"), F.col("g").alias("pg"), "category", "subcategory")
    sums = exact.groupBy("f", "g", "currency").agg(F.sum("n").alias("n_rows"), F.sum("total").cast(TOTAL).alias("total"), F.count("*").alias("spellings"))
    got = sums.join(named, F.col("f").eqNullSafe(F.col("pf")) & F.col("g").eqNullSafe(F.col("pg")))
    return got.select("category", "subcategory", "currency", "n_rows", "total", "spellings")


def label_directions(pairs: DataFrame) -> DataFrame:
    """Each label's direction: income only if the sum of every pair of it is above zero in every currency."""
    income = F.bool_and(F.col("total") > 0)
    return pairs.groupBy("category").agg(F.when(income, "income").otherwise("expense").alias("direction"), F.count("*").alias("pairs"))
