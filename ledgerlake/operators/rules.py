"""Classification rules as columns: each rule is one condition, or many are looked up in an index; all run in one projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import derived_type, fold
from . import rule_index

#: Rules up to which each is a condition of its own in the plan; more are indexed.
CONDITIONS = 200
#: Different descriptions up to which each is looked up in the index once, and not with every row that has it.
TEXTS = 200_000


@dataclass(frozen=True)
class When:
    """Conditions that all hold; of several texts any. A rule without one matches nothing."""

    account: str | int | None = None
    contains: tuple[str, ...] = ()
    starts_with: tuple[str, ...] = ()
    regex: tuple[str, ...] = ()
    sign: str | None = None
    amount_min: Decimal | None = None
    amount_max: Decimal | None = None
    date_from: date | None = None
    date_to: date | None = None
    bank_category: str | None = None
    bank_subcategory: str | None = None

    def column(self, text: Column) -> Column:
        """``text`` is the folded description."""
        amount, day, all_of = F.col("amount"), F.col("transaction_date"), []
        any_of = lambda found: found[0] if len(found) == 1 else F.greatest(*found)
        if self.account is not None:
            all_of.append(F.col("account_id") == self.account)
        if self.contains:
            all_of.append(any_of([text.contains(x.casefold()) for x in self.contains]))
        if self.starts_with:
            all_of.append(any_of([text.startswith(x.casefold()) for x in self.starts_with]))
        if self.regex:
            all_of.append(any_of([F.col("description").rlike("(?iu)" + x.replace("(?P<", "(?<")) for x in self.regex]))
        if self.sign is not None:
            all_of.append(amount > 0 if self.sign == "positive" else amount < 0)
        for limit, test in ((self.amount_min, amount.__ge__), (self.amount_max, amount.__le__), (self.date_from, day.__ge__), (self.date_to, day.__le__)):
            if limit is not None:
                all_of.append(test(F.lit(limit)))
        for name, value in (("bank_category", self.bank_category), ("bank_subcategory", self.bank_subcategory)):
            if value is not None:
                all_of.append(fold(F.col(name)) == value.casefold())
        out = F.lit(bool(all_of))
        for x in all_of:
            out = out & x
        return F.coalesce(out, F.lit(False))


@dataclass(frozen=True)
class Rule:
    """One outcome: a category, an adjustment's reason, or a claim that this is a transfer."""

    rule_id: str
    when: When
    priority: int = 0
    category: str | None = None
    adjustment: str | None = None
    transfer_claim: bool = False
    notes: dict[str, str] = field(default_factory=dict, compare=False, hash=False)

    def outcome(self) -> str:
        return f"category:{self.category}" if self.category else f"adjustment:{self.adjustment}" if self.adjustment is not None else "claim:"


MATCH = "array<struct<priority:int,rule_id:string,outcome:string>>"


class UnknownCategory(ValueError):
    """Rules that assign a category which isn't in the taxonomy."""


def known_categories(rules: Sequence[Rule], categories: DataFrame) -> None:
    """Refuse rules with categories that don't exist, before any row is classified."""
    wanted = {r.category for r in rules if r.category}
    if not wanted:
        return
    found = {r[0] for r in categories.where(F.col("category_id").isin(sorted(wanted))).select("category_id").distinct().collect()}
    bad = [f"{r.rule_id}: {r.category}" for r in rules if r.category and r.category not in found]
    if bad:
        raise UnknownCategory("; ".join(bad))


def _by_text(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``rows`` with ``__text``, the folded description, and ``__under``, the rules that the index has under it, found once for each description; as they are, if there are too many."""
    held, _ = rule_index.split(rules)
    if not held or rows.agg(F.approx_count_distinct("description")).first()[0] > TEXTS:
        return rows
    texts = rows.where("description is not null").select(F.col("description").alias("__description")).distinct()
    texts = texts.withColumn("__text", fold(F.col("__description")))
    texts = texts.withColumn("__under", rule_index.under_text(held, F.col("__text")))
    return rows.join(F.broadcast(texts), F.col("description") == F.col("__description"), "left")


def matches(rules: Sequence[Rule], text: Column, indexed: bool, of_text: Column | None = None) -> Column:
    """The rules that a row meets; ``text`` is its folded description. Indexed or not, they are the same."""
    held, plain = rule_index.split(rules) if indexed else ([], rules)
    hits = [F.when(r.when.column(text), F.struct(F.lit(r.priority).alias("priority"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.outcome()).alias("outcome"))) for r in plain]
    own = F.array_compact(F.array(*hits)) if hits else F.array().cast(MATCH)
    return F.concat(own, rule_index.hits(held, text, of_text)) if held else own


def classify(rows: DataFrame, rules: Sequence[Rule], categories: DataFrame, indexed: bool | None = None) -> DataFrame:
    """Each transaction's rule outcome: ``transaction_type, category_id, rule_ids, review_kind, claims_transfer, adjustment_reason``.

    The highest priority decides; rules of it that differ conflict. A category takes
    its type from its direction and the amount's sign; zero is a sign mismatch. Rules
    with a category that ``categories`` doesn't have are refused (``UnknownCategory``).
    More than ``CONDITIONS`` rules are looked up in an index (``rule_index``), which
    ``indexed`` sets otherwise; the outcomes are the same.
    """
    known_categories(rules, categories)
    indexed = len(rules) > CONDITIONS if indexed is None else indexed
    rows = rows.drop("transaction_type", "category_id", "direction")
    rows = _by_text(rows, rules) if indexed else rows
    known = "__under" in rows.columns
    rows = rows if known else rows.withColumn("__text", fold(F.col("description")))
    rows = rows.withColumn("__hits", matches(rules, F.col("__text"), indexed, F.col("__under") if known else None))
    top = F.array_max(F.transform("__hits", lambda x: x["priority"]))
    rows = rows.withColumn("__top", top)
    rows = rows.withColumn("__ties", F.filter("__hits", lambda x: x["priority"] == F.col("__top")))
    rows = rows.withColumn("__outcomes", F.array_distinct(F.transform("__ties", lambda x: x["outcome"])))
    outcomes = F.col("__outcomes")
    rows = rows.withColumn("__what", F.when(F.size(outcomes) == 1, F.get(outcomes, F.lit(0))).when(F.size(outcomes) > 1, "conflict:"))
    kind = F.substring_index("__what", ":", 1)
    value = F.substring(F.col("__what"), F.instr("__what", ":") + 1, F.length("__what"))
    rows = rows.withColumn("__kind", F.coalesce(kind, F.lit("none"))).withColumn("__category", F.when(kind == "category", value))
    # Only rules' categories are met, so these are broadcast, however large the taxonomy is.
    wanted = categories.where(F.col("category_id").isin(sorted({r.category for r in rules if r.category})))
    rows = rows.join(F.broadcast(wanted.select(F.col("category_id").alias("__category"), "direction")), "__category", "left")
    made = derived_type(F.col("direction"), F.col("amount"))
    kind = F.col("__kind")
    good = (kind == "category") & (made != "unknown")
    review = F.when(kind == "none", "unclassified").when(kind == "conflict", "rule-conflict").when((kind == "category") & ~good, "sign-mismatch").when(kind == "claim", "unmatched-transfer")
    out = rows.select(
        *[c for c in rows.columns if not c.startswith("__") and c != "direction"],
        F.when(kind == "adjustment", "adjustment").when(good, made).otherwise("unknown").alias("transaction_type"),
        F.when(good, F.col("__category")).alias("category_id"),
        F.array_sort(F.transform("__ties", lambda x: x["rule_id"])).alias("rule_ids"),
        review.alias("review_kind"),
        (kind == "claim").alias("claims_transfer"),
        F.when(kind == "adjustment", value).alias("adjustment_reason"),
    )
    return out


def allocations(rows: DataFrame) -> DataFrame:
    """One for each transaction with a category."""
    rows = rows.where("category_id is not null")
    return rows.select(F.concat_ws("/", "transaction_id", "category_id").alias("allocation_id"), "transaction_id", "account_id", "transaction_date", "category_id", "amount")
