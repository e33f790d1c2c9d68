"""Reading a publication: scans that prune by month and account, lineage, and reviews with their targets."""

from __future__ import annotations

from collections.abc import Collection
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import month_of
from ..operators.gold import Gold
from .catalog import Catalog, fingerprint

#: Tables whose files are dealt out by month, so that a range of months reads only its own.
BY_MONTH = {"transactions": ["month"], "allocations": ["month"], "monthly_balances": ["month"]}
NAMES = ("transactions", "allocations", "monthly_balances", "lineage", "review_items", "accounts", "owners", "categories")


def fingerprints(gold: Gold) -> DataFrame:
    """``account_id, month, table_name, fingerprint``: what a comparison of two publications reads first."""
    tables = {"transactions": gold.transactions, "allocations": gold.allocations, "monthly_balances": gold.monthly_balances}
    each = [fingerprint(df, "account_id", "month").select("account_id", "month", F.lit(name).alias("table_name"), "fingerprint") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, each)


def publish(catalog: Catalog, gold: Gold, recipe: str, label: str | None = None, configuration: str | None = None) -> int | None:
    """Publish all tables, and the fingerprints of their account months; ``configuration`` is the text that they were built by."""
    return catalog.publish(gold.tables() | {"fingerprints": fingerprints(gold)}, recipe, label, BY_MONTH, configuration)


def open_publication(catalog: Catalog, publication_id: int | None = None) -> GoldTables:
    """The tables of one publication, the current one by default; later ones aren't seen."""
    k = catalog.current() if publication_id is None else publication_id
    return GoldTables(Gold(**{n: catalog.read(n, k) for n in NAMES}), k, catalog.read("fingerprints", k))


class GoldTables:
    """Scans of one publication. ``account_ids``: None is all accounts, an empty collection none; many accounts come as a table with ``account_id``."""

    def __init__(self, gold: Gold, publication_id: int = 0, prints: DataFrame | None = None) -> None:
        self.gold, self.publication_id, self.prints = gold, publication_id, prints

    @property
    def accounts(self) -> DataFrame:
        return self.gold.accounts

    @property
    def owners(self) -> DataFrame:
        return self.gold.owners

    @property
    def categories(self) -> DataFrame:
        return self.gold.categories

    @staticmethod
    def _of(rows: DataFrame, account_ids: Collection | DataFrame | None) -> DataFrame:
        if account_ids is None:
            return rows
        if isinstance(account_ids, DataFrame):
            return rows.join(account_ids.select("account_id"), "account_id", "left_semi")
        if isinstance(account_ids, str):
            raise TypeError("account_ids is a collection of ids, not a text")
        return rows.where(F.col("account_id").isin(list(account_ids)) if account_ids else F.lit(False))

    def _days(self, rows: DataFrame, start: date, end: date, account_ids: Collection | DataFrame | None) -> DataFrame:
        """Days from ``start`` to ``end``, both included; the month column prunes files."""
        first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
        rows = rows.where(F.col("month").between(month_of(first), month_of(last)) & F.col("transaction_date").between(first, last))
        return self._of(rows, account_ids).join(self.accounts.select("account_id", "currency"), "account_id")

    def transactions(self, start: date, end: date, account_ids: Collection | DataFrame | None = None) -> DataFrame:
        return self._days(self.gold.transactions, start, end, account_ids)

    def allocations(self, start: date, end: date, account_ids: Collection | DataFrame | None = None) -> DataFrame:
        return self._days(self.gold.allocations, start, end, account_ids)

    def monthly_balances(self, first: date, last: date, account_ids: Collection | DataFrame | None = None) -> DataFrame:
        months = F.col("month").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
        return self._of(self.gold.monthly_balances.where(months), account_ids).join(self.accounts.select("account_id", "currency"), "account_id")

    def lineage(self, transactions: DataFrame) -> DataFrame:
        """Lineage of the transactions that ``transactions(transaction_id)`` names."""
        return self.gold.lineage.join(transactions.select("transaction_id"), "transaction_id", "left_semi")

    def review_targets(self) -> DataFrame:
        """``review_item_id, at, transaction_id`` with the transaction's and its account's columns; null for a target that is gone."""
        targets = self.gold.review_items.select("review_item_id", F.posexplode("transaction_ids").alias("at", "transaction_id"))
        facts = self.gold.transactions.select("transaction_id", "account_id", "transaction_date", "amount", "description")
        names = self.accounts.select("account_id", "display_name", "currency")
        return targets.join(facts, "transaction_id", "left").join(names, "account_id", "left")

    def review_items(self, kind: str | None = None, account_id=None) -> DataFrame:
        """Items with their targets in order; of a kind, and with a target on an account, if asked."""
        items = self.gold.review_items
        if kind is not None:
            items = items.where(F.col("kind") == kind)
        targets = self.review_targets()
        if account_id is not None:
            items = items.join(targets.where(F.col("account_id") == account_id).select("review_item_id"), "review_item_id", "left_semi")
        each = targets.where("account_id is not null").groupBy("review_item_id").agg(F.array_sort(F.collect_list(F.struct("at", "transaction_id", "account_id", "display_name", "transaction_date", "amount", "description"))).alias("targets"))
        return items.join(each, "review_item_id", "left")

    def reviews_by_kind(self) -> DataFrame:
        return self.gold.review_items.groupBy("kind").agg(F.count("*").alias("items"))
