"""Orders and chains of a busy account, day by day, against one pass over its rows."""

import random
import re
from datetime import date, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import sequence

SCHEMA = "account_id string, transaction_date date, id int, amount decimal(19,2), balance_after decimal(19,2)"


def ledger(seed):
    rng, rows = random.Random(seed), []
    for account in ("hot", *"abcdefgh"):
        balance = D(100)
        for k in range(400 if account == "hot" else rng.randrange(0, 40)):
            amount = D(rng.randrange(-9, 10))
            balance += amount + (rng.choice([0] * 9 + [3]))
            rows.append([account, date(2031, 1, 1) + timedelta(k // rng.choice([1, 2, 7]) if account != "hot" else k // 9), k, amount, balance if rng.random() < 0.6 else None])
    for account in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == account), key=lambda r: r[2])
        for r, day in zip(own, sorted(r[1] for r in own), strict=True):
            r[1] = day
    rng.shuffle(rows)
    return [tuple(r) for r in rows]


def one_pass(rows):
    """Per (account, id): number, check and link."""
    out = {}
    for account in {r[0] for r in rows}:
        own, anchor, since = sorted((r for r in rows if r[0] == account), key=lambda r: (r[1], r[2])), None, D(0)
        for n, (_, day, k, amount, balance) in enumerate(own, 1):
            since += amount
            check = "missing_balance" if balance is None else "opening" if n == 1 or anchor is None else "consistent" if anchor + since == balance else "break"
            if balance is not None:
                anchor, since = balance, D(0)
            after = own[n] if n < len(own) else None
            good = balance is not None and (after is None or (after[4] is not None and balance + after[3] == after[4]))
            out[account, k] = (n, check, day, after[1] if after else date(9999, 12, 31), good)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_days_hand_on_what_a_pass_over_the_account_carries(spark, seed):
    rows = ledger(seed)
    df = sequence.account_sequence(spark.createDataFrame(rows, SCHEMA), "transaction_date", "id", day="transaction_date")
    checks = {(r["account_id"], r["id"]): (r["account_sequence"], r["balance_check"]) for r in sequence.balance_check(df).collect()}
    links = {(r["account_id"], r["account_sequence"]): (r["link_from"], r["link_to"], r["verified"]) for r in sequence.chain_links(df).collect()}
    want = one_pass(rows)
    assert checks == {k: v[:2] for k, v in want.items()}
    assert links == {(a, v[0]): v[2:] for (a, _), v in want.items()}
    plain = sequence.account_sequence(spark.createDataFrame(rows, SCHEMA), "transaction_date", "id")
    assert {(r["account_id"], r["id"], r["account_sequence"]) for r in plain.collect()} == {(*k, v[0]) for k, v in want.items()}


def test_rows_are_dealt_by_account_and_day(spark):
    """No window or exchange on the account alone reads rows: only days, which are summed before."""
    df = spark.createDataFrame(ledger(1), SCHEMA).withColumn("account_sequence", F.col("id"))
    for made in (sequence.balance_check(df), sequence.chain_links(df), sequence.account_sequence(df.drop("account_sequence"), "transaction_date", "id", day="transaction_date")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        alone = re.findall(r"hashpartitioning\(account_id#\d+, \d+\)", plan)
        assert len(alone) == 1 and len(re.findall(r"hashpartitioning\(account_id#\d+, transaction_date#\d+, \d+\), REPARTITION", plan)) >= 1
        got = made.collect()
        assert len(got) == df.count()
