"""A household of two accounts, rules, transfers, decisions and the chain."""

import hashlib
import json
import random
from datetime import date, timedelta
from decimal import Decimal as D

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import coverage, decisions, invariants, measures, rules, sequence, transfers

#: A made-up household. The daily account began at 750.00 and the reserve at 42000.00;
#: on 4 August the bank states 29.00 less than the chain gives.
ROWS = [
    ("daily", 1, "2031-06-05", "18000.00", "income", "wage", None, "18750.00", "opening"),
    ("daily", 2, "2031-06-11", "-412.35", "expense", "food", None, "18337.65", "consistent"),
    ("daily", 3, "2031-06-17", "-5000.00", "transfer", None, "X1", "13337.65", "consistent"),
    ("daily", 4, "2031-07-01", "-6200.00", "expense", "housing", None, "7137.65", "consistent"),
    ("daily", 5, "2031-07-09", "-233.10", "expense", "food", None, "6904.55", "consistent"),
    ("daily", 6, "2031-07-15", "99.95", "refund", "food", None, "7004.50", "consistent"),
    ("daily", 7, "2031-07-28", "18000.00", "income", "wage", None, "25004.50", "consistent"),
    ("daily", 8, "2031-08-04", "-75.00", "unknown", None, None, "24900.50", "break"),
    ("daily", 9, "2031-08-21", "-610.00", "expense", "power", None, "24290.50", "consistent"),
    ("daily", 10, "2031-09-01", "-6200.00", "expense", "housing", None, "18090.50", "consistent"),
    ("daily", 11, "2031-09-26", "18000.00", "income", "wage", None, "36090.50", "consistent"),
    ("reserve", 1, "2031-06-17", "5000.00", "transfer", None, "X1", "47000.00", "opening"),
    ("reserve", 2, "2031-09-30", "31.25", "income", "yield", None, "47031.25", "consistent"),
]
BALANCES = {
    ("daily", "2031-06"): ("750.00", "13337.65", "partial", True),
    ("daily", "2031-07"): ("13337.65", "25004.50", "partial", True),
    ("daily", "2031-08"): ("24975.50", "24290.50", "partial", True),
    ("daily", "2031-09"): ("24290.50", "36090.50", "complete", True),
    ("daily", "2031-10"): (None, None, "partial", False),
    ("reserve", "2031-06"): ("42000.00", "47000.00", "partial", True),
    ("reserve", "2031-07"): ("47000.00", "47000.00", "complete", True),
    ("reserve", "2031-08"): ("47000.00", "47000.00", "complete", True),
    ("reserve", "2031-09"): ("47000.00", "47031.25", "complete", True),
    ("reserve", "2031-10"): (None, None, "partial", False),
}
CATEGORIES = [("wage", "earnings", "income"), ("yield", "earnings", "income"), ("housing", "home", "expense"), ("power", "home", "expense"), ("food", "living", "expense")]


@pytest.fixture(scope="module")
def worked(spark):
    rows = [(f"{a}-{k}", a, k, date.fromisoformat(d), D(x), t, c, g, D(b), e) for a, k, d, x, t, c, g, b, e in ROWS]
    history = spark.createDataFrame(rows, "transaction_id string, account_id string, account_sequence int, transaction_date date, amount decimal(19,2), transaction_type string, category_id string, transfer_group_id string, balance_after decimal(19,2), expected string")
    accounts = spark.createDataFrame([("daily", None), ("reserve", None)], "account_id string, closed_on date")
    exports = spark.createDataFrame([(a, f"run-{a}", date(2031, 6, 1), date(2031, 10, 6), date(2031, 10, 8)) for a in ("daily", "reserve")], "account_id string, import_run_id string, covers_from date, covers_through date, exported_on date")
    return history, accounts, exports, spark.createDataFrame(CATEGORIES, "category_id string, group_id string, direction string")


def test_balance_check(worked):
    assert all(r["balance_check"] == r["expected"] for r in sequence.balance_check(worked[0]).collect())


def test_monthly_balances(worked):
    history, accounts, exports, _ = worked
    ranges = sequence.evidence_ranges(exports)
    spine = coverage.month_spine(history, accounts, ranges)
    cover = coverage.month_coverage(spine, history, ranges)
    got = coverage.monthly_balances(spine, history, cover).join(coverage.late_bookings(spine, exports), ["account_id", "month"]).collect()
    text = lambda x: None if x is None else str(x)
    assert {(r["account_id"], r["month"].isoformat()[:7]): (text(r["opening_balance"]), text(r["closing_balance"]), r["coverage"], r["late_bookings_settled"]) for r in got} == BALANCES


def test_july_and_august(worked):
    history, _, _, categories = worked
    parts = rules.allocations(history).withColumn("month", history.transaction_date)
    rows = measures.measured(history, parts, categories).withColumn("month", F.date_format("transaction_date", "yyyy-MM"))
    got = {r["month"]: r for r in measures.figures(rows, "month").collect()}
    july, august = got["2031-07"], got["2031-08"]
    assert (july["income"], july["expenses"], july["net"], round(july["savings_rate"], 4)) == (D("18000.00"), D("6333.15"), D("11666.85"), D("0.6482"))
    assert (august["income"], august["expenses"], august["net"], august["savings_rate"]) == (0, D("610.00"), D("-610.00"), None)
    assert (august["unclassified_out"], august["unclassified_in"], august["unclassified_count"]) == (D("-75.00"), 0, 1)
    assert {r["category_id"]: r["spending"] for r in measures.category_spending(parts.where("date_format(transaction_date, 'yyyy-MM') = '2031-07'"), categories).collect()} == {"housing": D("6200.00"), "food": D("133.15")}
    summary = measures.transfer_summary(history).first()
    assert (summary["legs"], summary["paired"], summary["one_sided"]) == (2, 2, 0)


def test_invariants(worked, spark):
    history, accounts, _, categories = worked
    parts = rules.allocations(history)
    assert invariants.violations(history, parts, categories, accounts).count() == 0
    bad = history.withColumn("transfer_group_id", history.account_id)
    assert {r["invariant"] for r in invariants.violations(bad, parts, categories, accounts).collect()} == {"transfer-pair"}


def test_missing_balances_bridge(spark):
    rows = [("a", k, D(x), None if b is None else D(b)) for k, (x, b) in enumerate([("1", None), ("5", "10"), ("2", None), ("3", "15"), ("1", "99"), ("1", "100")], 1)]
    df = spark.createDataFrame(rows, "account_id string, account_sequence int, amount decimal(19,2), balance_after decimal(19,2)")
    got = [r["balance_check"] for r in sequence.balance_check(df).orderBy("account_sequence").collect()]
    assert got == ["missing_balance", "opening", "missing_balance", "consistent", "break", "consistent"]


def plain_matching(legs):
    """The stages in one loop over all legs, for comparison."""
    legs = sorted(legs, key=lambda x: (x["account_id"], x["account_sequence"]))
    done = {}
    for gap in range(4):
        free = [x for x in legs if x["transaction_id"] not in done]
        near = {}
        for o in free:
            for i in free:
                if o["amount"] < 0 and i["amount"] == -o["amount"] and o["account_id"] != i["account_id"] and abs((o["transaction_date"] - i["transaction_date"]).days) == gap and (o["claim_rule_ids"] or i["claim_rule_ids"]):
                    near.setdefault(o["transaction_id"], set()).add(i["transaction_id"])
                    near.setdefault(i["transaction_id"], set()).add(o["transaction_id"])
        by_id, seen = {x["transaction_id"]: x for x in legs}, set()
        for start in near:
            if start in seen:
                continue
            group, queue = {start}, [start]
            while queue:
                for y in near[queue.pop()] - group:
                    group.add(y)
                    queue.append(y)
            seen |= group
            outs, ins = ([x for x in legs if x["transaction_id"] in group and (x["amount"] < 0) == s] for s in (True, False))
            alike = lambda xs: len({(x["account_id"], x["transaction_date"], x["description"]) for x in xs}) == 1
            if len(outs) == len(ins) == 1 or (alike(outs) and alike(ins)):
                basis = ("date_gap" if gap else "same_day") if len(outs) == len(ins) == 1 else "repeated_legs"
                for o, i in zip(outs, ins, strict=False):
                    done[o["transaction_id"]] = ("paired", basis, i["transaction_id"])
                    done[i["transaction_id"]] = ("paired", basis, o["transaction_id"])
            else:
                done |= {k: ("ambiguous", None, None) for k in group}
        assert by_id
    return done


@pytest.mark.parametrize("seed", range(3))
def test_transfers_like_plain_version(spark, seed):
    rng = random.Random(seed)
    legs, count = [], {}
    for k in range(260):
        account = rng.choice("abcd")
        count[account] = count.get(account, 0) + 1
        legs.append({"transaction_id": f"t{k:03}", "account_id": account, "account_sequence": count[account], "transaction_date": date(2026, 1, 1) + timedelta(rng.randrange(60)), "amount": D(rng.choice([-50, -20, -10, 0, 10, 20, 50])), "description": rng.choice("xy"), "claim_rule_ids": ["r1"] if rng.random() < 0.5 else []})
    df = spark.createDataFrame(pd.DataFrame(legs), "transaction_id string, account_id string, account_sequence int, transaction_date date, amount decimal(19,2), description string, claim_rule_ids array<string>")
    got = {r["transaction_id"]: (r["state"], r["basis"], r["counterpart_transaction_id"]) for r in transfers.match(df).collect()}
    assert got == plain_matching(legs)


def test_islands_of_many_accounts(spark):
    """Sets that are connected through representatives only, with up to eight accounts on near days: sixty amounts, of which each is a case."""
    legs, count, want = [], {}, {}
    for seed in range(60):
        rng = random.Random(seed)
        accounts, own = "abcdefgh"[: rng.randrange(2, 9)], []
        for k in range(rng.randrange(2, 40)):
            account = rng.choice(accounts)
            count[account] = count.get(account, 0) + 1
            own.append({"transaction_id": f"t{seed:02}{k:03}", "account_id": account, "account_sequence": count[account], "transaction_date": date(2031, 1, 1) + timedelta(rng.randrange(5)), "amount": D(rng.choice([-10 - seed, 10 + seed])), "description": rng.choice("xy"), "claim_rule_ids": ["r1"] if rng.random() < rng.choice([0.1, 0.5, 0.9]) else []})
        want |= plain_matching(own)
        legs += own
    df = spark.createDataFrame(pd.DataFrame(legs), "transaction_id string, account_id string, account_sequence int, transaction_date date, amount decimal(19,2), description string, claim_rule_ids array<string>")
    got = transfers.match(df).collect()
    assert {r["transaction_id"]: (r["state"], r["basis"], r["counterpart_transaction_id"]) for r in got} == want
    # A held set's members are listed with its first leg in account order, and name it.
    by_id = {x["transaction_id"]: x for x in legs}
    for r in got:
        if r["state"] == "ambiguous" and r["legs"]:
            assert r["legs"] == sorted(r["legs"], key=lambda t: (by_id[t]["account_id"], by_id[t]["account_sequence"])) and r["legs"][0] == r["transaction_id"]
            assert r["set_id"] == hashlib.sha256(json.dumps(["ambiguous-transfer", *r["legs"]], separators=(",", ":")).encode()).hexdigest()
            assert {x["transaction_id"] for x in got if x["set_id"] == r["set_id"]} == set(r["legs"])


def test_one_amount_of_many_accounts(spark):
    """A third of all legs have one amount: 3,000 accounts on one day are one held set, apart from alike legs, which pair by rank."""
    rows = spark.range(3000).selectExpr("concat('h', lpad(id, 5, '0')) AS transaction_id", "id AS account_id", "1 AS account_sequence", "date'2031-01-01' AS transaction_date", "CAST(if(id % 2 = 0, -5, 5) AS decimal(19,2)) AS amount", "'x' AS description", "array('r') AS claim_rule_ids")
    alike = spark.range(2000).selectExpr("concat('a', id) AS transaction_id", "id % 2 AS account_id", "CAST(id AS int) AS account_sequence", "date'2031-01-01' AS transaction_date", "CAST(if(id % 2 = 0, -7, 7) AS decimal(19,2)) AS amount", "'x' AS description", "array('r') AS claim_rule_ids")
    more = spark.range(4000).selectExpr("concat('m', id) AS transaction_id", "id % 2 AS account_id", "CAST(id AS int) AS account_sequence", "date'2031-01-01' AS transaction_date", "CAST(if(id % 2 = 0, -100 - id, 99 + id) AS decimal(19,2)) AS amount", "'x' AS description", "array('r') AS claim_rule_ids")
    got = transfers.match(rows.unionByName(alike).unionByName(more)).groupBy("state", "basis").count().collect()
    assert {(r["state"], r["basis"]): r["count"] for r in got} == {("ambiguous", None): 3000, ("paired", "repeated_legs"): 2000, ("paired", "same_day"): 4000}


def test_unmatched_reason_like_plain_version(spark):
    rng = random.Random(9)
    day = lambda: date(2031, 3, 1) + timedelta(rng.randrange(40))
    accounts = [(a, day() if rng.random() < 0.5 else None) for a in "abcdef"]
    history = [(a, day()) for a in "abcde" for _ in range(3)]
    legs = [(f"t{k}", rng.choice("abcdef"), day()) for k in range(60)]
    latest = {a: max((d for x, d in history if x == a), default=date.min) for a, _ in accounts}
    late = lambda own, d: any(a != own and (c is None or c >= d - timedelta(3)) and latest[a] < d + timedelta(3) for a, c in accounts)
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((legs, "transaction_id string, account_id string, transaction_date date"), (accounts, "account_id string, closed_on date"), (history, "account_id string, transaction_date date"))]
    got = {r["transaction_id"]: r["reason"] for r in transfers.unmatched_reason(*frames).collect()}
    assert got == {t: "counterpart-may-not-be-imported" if late(a, d) else "no-candidate" for t, a, d in legs}


def test_rules_and_decisions(spark):
    columns = "transaction_id string, account_id string, transaction_date date, amount decimal(19,2), description string, bank_category string, bank_subcategory string"
    rows = [("t1", "a", date(2026, 1, 2), D("-10"), "NETTO Æble", "Mad", None), ("t2", "a", date(2026, 1, 3), D("0"), "netto", None, None), ("t3", "b", date(2026, 1, 3), D("10"), "overførsel", None, None), ("t4", "b", date(2026, 1, 4), D("5"), "x", "mAD", "y")]
    df = spark.createDataFrame(rows, columns)
    cats = spark.createDataFrame([("food", "g", "expense")], "category_id string, group_id string, direction string")
    made = [
        rules.Rule("r1", rules.When(contains=("netto",)), 1, category="food"),
        rules.Rule("r2", rules.When(regex=("æBLE$",)), 1, category="food"),
        rules.Rule("r3", rules.When(starts_with=("OVERFØR",)), 1, transfer_claim=True),
        rules.Rule("r4", rules.When(bank_category="MAD", bank_subcategory="Y"), 2, adjustment="fix"),
        rules.Rule("r5", rules.When(), 9, category="food"),
    ]
    got = {r["transaction_id"]: (r["transaction_type"], r["category_id"], r["rule_ids"], r["review_kind"], r["claims_transfer"], r["adjustment_reason"]) for r in rules.classify(df, made, cats).collect()}
    assert got == {
        "t1": ("expense", "food", ["r1", "r2"], None, False, None),
        "t2": ("unknown", None, ["r1"], "sign-mismatch", False, None),
        "t3": ("unknown", None, ["r3"], "unmatched-transfer", True, None),
        "t4": ("adjustment", None, ["r4"], None, False, "fix"),
    }
    with pytest.raises(rules.UnknownCategory, match="r6: nowhere"):
        rules.classify(df, [rules.Rule("r6", rules.When(account="a"), category="nowhere")], cats)
    log = spark.createDataFrame([("d1", "classify", ["t2"], None), ("d2", "pair", ["t1", "t3"], None), ("d3", "pair", ["t1", "zz"], None), ("d4", "one-sided-transfer", ["t1"], "b"), ("d5", "one-sided-transfer", ["t1"], "new")], "decision_id string, kind string, targets array<string>, counterpart_account_id string")
    accounts = spark.createDataFrame([("a", None), ("b", None), ("new", None)], "account_id string, closed_on date")
    reasons = {r["decision_id"]: r["reason"] for r in decisions.applicability(log, df, accounts).collect()}
    assert reasons == {"d1": "zero-amount", "d2": None, "d3": "target-missing", "d4": "inside-managed-period", "d5": None}
