"""Gold: every booked transaction classified, in one dataflow.

Rules say what they make of each transaction; decisions in force overrule them;
transfer matching pairs claimed legs that no decision has decided; what is settled
gives types, allocations, reviews and lineage. Precedence: decision, pair, ambiguous
set, rule.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import derived_type, hash_parts, month_of
from ..session import attached, meeting, sifted, stash, unstash
from . import coverage, decisions, rules, sequence, transfers

EVIDENCE = "struct<basis:string,counterpart_account_id:string,counterpart_transaction_id:string,date_gap_days:int,claim_rule_ids:array<string>>"
REVIEW = "review_item_id string, kind string, transaction_ids array<string>, rule_ids array<string>, decision_id string, reason string"


@dataclass
class Gold:
    """A publication's tables."""

    transactions: DataFrame
    allocations: DataFrame
    monthly_balances: DataFrame
    lineage: DataFrame
    review_items: DataFrame
    accounts: DataFrame
    owners: DataFrame
    categories: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def configuration_problems(history: DataFrame, accounts: DataFrame, categories: DataFrame, made: Sequence[rules.Rule], in_force: DataFrame) -> DataFrame:
    """``problem, subject``: whatever keeps a build from starting, all of it.

    Transactions of undeclared accounts, accounts closed before their latest
    transaction, decisions and rules that name an account or a category that isn't
    declared, a transaction in two decisions, and a decision id used twice.
    """
    say = lambda df, problem, subject: df.select(F.lit(problem).alias("problem"), F.col(subject).cast("string").alias("subject"))
    spark = history.sparkSession
    latest = history.groupBy("account_id").agg(F.max("transaction_date").alias("latest"))
    closed = latest.join(accounts.select("account_id", "closed_on"), "account_id").where("closed_on < latest")
    targets = in_force.select("decision_id", F.explode("targets").alias("target")).distinct()
    wanted = spark.createDataFrame([(r.category, r.rule_id) for r in made if r.category], "category_id string, rule_id string")
    named = in_force.where("counterpart_account_id is not null").select("decision_id", F.col("counterpart_account_id").cast(dict(accounts.dtypes)["account_id"]).alias("account_id"))
    parts = [
        say(latest.join(accounts, "account_id", "left_anti"), "undeclared-account", "account_id"),
        say(closed, "closed-before-latest-transaction", "account_id"),
        say(named.join(accounts, "account_id", "left_anti"), "decision-names-unknown-account", "decision_id"),
        say(in_force.where("category is not null").join(categories.select(F.col("category_id").alias("category")), "category", "left_anti"), "decision-names-unknown-category", "decision_id"),
        say(wanted.join(categories, "category_id", "left_anti"), "rule-names-unknown-category", "rule_id"),
        say(targets.groupBy("target").count().where("count > 1"), "target-decided-twice", "target"),
        say(in_force.groupBy("decision_id").count().where("count > 1"), "decision-id-used-twice", "decision_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def decided(by_rule: DataFrame, history: DataFrame, in_force: DataFrame, accounts: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What applicable decisions make of their targets, by ``transaction_id``; and the reviews of those that don't apply.

    ``by_rule``: transactions that hold all targets, with ``claim_rule_ids``; ``history``: all.
    ``in_force``: ``decision_id, kind, targets, category, adjustment, counterpart_account_id``;
    kinds ``classify``, ``pair`` and ``one-sided-transfer``.
    """
    mine = in_force.where(F.col("kind").isin("classify", "pair", "one-sided-transfer"))
    judged = decisions.applicability(mine.withColumn("counterpart_account_id", F.col("counterpart_account_id").cast(dict(accounts.dtypes)["account_id"])), history, accounts, by_rule)
    judged = stash(judged, "judged")
    kind = F.lit("decision-not-applicable")
    bad = judged.where("reason is not null")
    ids = F.to_json(F.concat(F.array(kind, F.col("decision_id")), F.col("present")))
    reviews = bad.select(F.sha2(ids, 256).alias("review_item_id"), kind.alias("kind"), F.col("present").alias("transaction_ids"), F.array().cast("array<string>").alias("rule_ids"), "decision_id", "reason")
    good = mine.join(judged.where("reason is null").select("decision_id"), "decision_id", "left_semi")
    of = by_rule.select("transaction_id", "account_id", "amount", "transaction_date", "claim_rule_ids")
    rows = good.select("*", F.explode("targets").alias("transaction_id")).drop("targets").join(of, "transaction_id")
    rows = rows.join(categories.select(F.col("category_id").alias("category"), "direction"), "category", "left")
    both = rows.where("kind = 'pair'").groupBy("decision_id").agg(F.array_sort(F.collect_list(F.struct("transaction_id", "account_id", "transaction_date", "claim_rule_ids"))).alias("legs"))
    rows = rows.join(both, "decision_id", "left")
    other = F.get(F.filter("legs", lambda x: x["transaction_id"] != F.col("transaction_id")), F.lit(0))
    claims = F.array_sort(F.array_distinct(F.flatten(F.transform("legs", lambda x: x["claim_rule_ids"]))))
    days = F.transform("legs", lambda x: x["transaction_date"])
    manual = F.struct(F.lit("manual_pair").alias("basis"), other["account_id"].cast("string").alias("counterpart_account_id"), other["transaction_id"].alias("counterpart_transaction_id"), F.datediff(F.array_max(days), F.array_min(days)).alias("date_gap_days"), claims.alias("claim_rule_ids"))
    alone = F.struct(F.lit("one_sided").alias("basis"), F.col("counterpart_account_id").cast("string"), F.lit(None).cast("string"), F.lit(None).cast("int"), F.col("claim_rule_ids"))
    is_pair, is_one = F.col("kind") == "pair", F.col("kind") == "one-sided-transfer"
    out = rows.select(
        "transaction_id",
        F.when(is_pair | is_one, "transfer").when(F.col("category").isNotNull(), derived_type(F.col("direction"), F.col("amount"))).otherwise("adjustment").alias("transaction_type"),
        F.when(~is_pair & ~is_one, F.col("category")).alias("category_id"),
        F.when(is_pair, F.sha2(F.to_json(F.transform("legs", lambda x: x["transaction_id"])), 256)).alias("transfer_group_id"),
        F.when(is_pair, manual.cast(EVIDENCE)).when(is_one, alone.cast(EVIDENCE)).alias("transfer_evidence"),
        F.when(~is_pair & ~is_one & F.col("category").isNull(), F.col("adjustment")).alias("adjustment_reason"),
        "decision_id",
    )
    return out, reviews


@dataclass
class Classified:
    """Every transaction with its outcome, and all review items (``REVIEW``); ``kept`` are the tables that both are read from.

    An outcome: ``transaction_type, category_id, transfer_group_id, transfer_evidence,
    adjustment_reason, rule_ids, decision_id, classification_source, review_kind,
    review_item_id, reason``, and ``more``, the reviews of decisions that name it.
    """

    rows: DataFrame
    reviews: DataFrame
    kept: list[DataFrame]


def classify(history: DataFrame, accounts: DataFrame, categories: DataFrame, made: Sequence[rules.Rule], in_force: DataFrame, matching: Callable[[DataFrame], DataFrame] = transfers.match) -> Classified:
    """All of ``history``, booked transactions with ``account_sequence``, settled.

    Only rows that decisions may name are shuffled to these, and all rows are written
    once, with what rules and decisions make of them; pairs are added as rows are read.
    ``matching``: ``transfers.match``, or ``transfers.single_pairs``.
    """
    no_rules, null = F.array().cast("array<string>"), lambda kind: F.lit(None).cast(kind)
    named = stash(in_force.select(F.explode("targets").alias("transaction_id")).distinct(), "targets")
    ruled = lambda rows: rules.classify(rows, made, categories).withColumn("claim_rule_ids", F.when(F.col("claims_transfer"), F.col("rule_ids")).otherwise(no_rules))
    targets = stash(ruled(meeting(history, named, ["transaction_id"])).select("transaction_id", "account_id", "amount", "transaction_date", "claim_rule_ids"), "target-rows")
    manual, not_applicable = decided(targets, history, in_force, accounts, categories)
    over = manual.select("transaction_id", F.col("transaction_type").alias("type"), F.col("category_id").alias("category"), F.col("transfer_group_id").alias("group"), F.col("transfer_evidence").alias("evidence"), F.col("adjustment_reason").alias("adjustment"), "decision_id")
    # Reviews of one transaction are on its row; those of decisions name theirs.
    not_applicable = stash(not_applicable, "not-applicable")
    more = not_applicable.where("decision_id is not null").select("review_item_id", F.explode("transaction_ids").alias("transaction_id")).groupBy("transaction_id").agg(F.collect_list("review_item_id").alias("more"))
    facts = stash(over.join(more, "transaction_id", "full_outer"), "decided")
    # Decisions come first, as rules then look at each row once.
    written = rows = stash(ruled(attached(history, facts, ["transaction_id"])), "ruled")
    unstash(named, targets, facts)

    is_claim = F.size("claim_rule_ids") > 0
    free = rows.where("type is null").withColumn("size", F.abs("amount"))
    # Legs of an amount that no leg claims have no partner.
    sizes = stash(free.where(is_claim).select("size").distinct(), "sizes")
    matched = stash(matching(sifted(free, sizes, ["size"], sizes.count()).where("__may").drop("__may", "size")), "matched")
    unstash(sizes)
    evidence = F.struct("basis", F.col("counterpart_account_id").cast("string"), "counterpart_transaction_id", "date_gap_days", "claim_rule_ids").cast(EVIDENCE)
    paired = F.col("state") == "paired"
    pairs = matched.select("transaction_id", paired.alias("paired"), F.when(paired, evidence).alias("pair_evidence"), "set_id")
    rows = transfers.with_reason(rows, free.where(is_claim), accounts, history).withColumnRenamed("reason", "__reason")
    rows = attached(rows, pairs, ["transaction_id"])
    paired, held, by_hand = F.coalesce("paired", F.lit(False)), F.coalesce(~F.col("paired"), F.lit(False)), F.col("type").isNotNull()
    by_rule = ~by_hand & ~paired & ~held
    review = F.when(held, transfers.AMBIGUOUS).when(by_rule, F.col("review_kind"))
    kind = F.when(by_hand, F.col("type")).when(paired, "transfer").when(held, "unknown").otherwise(F.col("transaction_type"))
    proof = F.coalesce("evidence", "pair_evidence")
    source = F.when(F.col("decision_id").isNotNull(), "manual").when(proof.isNotNull(), "transfer_match").when((F.size("rule_ids") > 0) & (kind != "unknown"), "rule").otherwise("unclassified")
    out = rows.select(
        *history.columns,
        kind.alias("transaction_type"),
        F.when(by_hand, F.col("category")).when(by_rule, F.col("category_id")).alias("category_id"),
        F.when(by_hand, F.col("group")).when(paired, F.col("set_id")).alias("transfer_group_id"),
        proof.alias("transfer_evidence"),
        F.when(by_hand, F.col("adjustment")).when(by_rule, F.col("adjustment_reason")).alias("adjustment_reason"),
        "rule_ids",
        "decision_id",
        source.alias("classification_source"),
        review.alias("review_kind"),
        F.when(held, F.col("set_id")).when(review.isNotNull(), hash_parts(review, F.col("transaction_id"))).alias("review_item_id"),
        F.when(by_rule & is_claim, F.col("__reason")).alias("reason"),
        "more",
    )
    own = out.where(F.col("review_kind") != transfers.AMBIGUOUS).select("review_item_id", F.col("review_kind").alias("kind"), F.array("transaction_id").alias("transaction_ids"), "rule_ids", null("string").alias("decision_id"), "reason")
    held = matched.where("state = 'ambiguous' and legs is not null").select(F.col("set_id").alias("review_item_id"), F.lit(transfers.AMBIGUOUS).alias("kind"), F.col("legs").alias("transaction_ids"), F.col("claim_rule_ids").alias("rule_ids"), null("string").alias("decision_id"), null("string").alias("reason"))
    return Classified(out, own.unionByName(held).unionByName(not_applicable), [written, matched, not_applicable])


def lineage(rows: DataFrame) -> DataFrame:
    """How each of a build's transactions came to its outcome."""
    items = F.concat(F.coalesce("more", F.array().cast("array<string>")), F.array_compact(F.array("review_item_id")))
    return rows.select("transaction_id", F.col("transaction_id").alias("silver_transaction_id"), "classification_source", "rule_ids", "decision_id", "transfer_evidence", items.alias("review_item_ids"), "bank_category", "adjustment_reason")


def checked(history: DataFrame, accounts: DataFrame, categories: DataFrame, made: Sequence[rules.Rule], in_force: DataFrame) -> None:
    """Refuse a configuration that has a problem, naming up to a thousand."""
    found = [tuple(r) for r in configuration_problems(history, accounts, categories, made, in_force).orderBy("problem", "subject").limit(1000).collect()]
    if found:
        raise ValueError("; ".join(f"{p}: {s}" for p, s in found))


def build(history: DataFrame, exports: DataFrame, accounts: DataFrame, owners: DataFrame, categories: DataFrame, made: Sequence[rules.Rule], in_force: DataFrame, late_booking_days: int = 7) -> Gold:
    """All tables of a publication from booked history; nothing is built if the configuration has a problem.

    ``history``: ``transaction_id, account_id, transaction_date, account_sequence,
    amount, description, bank_category, bank_subcategory, balance_after``.
    ``exports``: the counted exports' declared ranges.
    """
    if not 0 <= late_booking_days <= 366:
        raise ValueError("late_booking_days is from 0 to 366")
    checked(history, accounts, categories, made, in_force)
    settled = classify(history, accounts, categories, made, in_force)
    rows, reviews = settled.rows, settled.reviews
    month = month_of("transaction_date").alias("month")
    facts = stash(sequence.balance_check(rows).select("transaction_id", "account_id", "transaction_date", month, "account_sequence", "amount", "description", "transaction_type", "transfer_group_id", "balance_after", "balance_check"), "facts")
    parts = rules.allocations(rows).withColumn("month", month_of("transaction_date"))
    ranges = sequence.evidence_ranges(exports)
    spine = coverage.month_spine(history, accounts, ranges)
    cover = coverage.month_coverage(spine, history, ranges)
    balances = coverage.with_late_bookings(coverage.monthly_balances(spine, history, cover), exports, late_booking_days)
    bounds = exports.groupBy("account_id").agg(F.min("covers_from").alias("coverage_start"), F.max("covers_through").alias("evidence_through"))
    return Gold(facts, parts, balances, lineage(rows), reviews, accounts.join(bounds, "account_id", "left"), owners, categories)
