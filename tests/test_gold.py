"""The Gold queries on rows whose legs have several candidates, and what the build shuffles."""

import random
from collections import defaultdict
from datetime import date, datetime, timedelta
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F
from test_cost import records_shuffled
from test_oracles import plain
from test_spread import shuffled

from ledgerlake import session
from ledgerlake.operators import gold, rules, transfers
from ledgerlake.plans.gold_queries import ORACLES, QUERIES

LEGS = "transaction_id string, account_id int, account_sequence int, transaction_date date, amount decimal(18,2), description string, claim_rule_ids array<string>"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of tables: an outgoing leg with a candidate on its day and one two days later, a single pair, and two legs that share one."""
    out = tmp_path_factory.mktemp("tables")
    lines = [(1, 0, "R", "100.00"), (3, 0, "A", "100.00"), (5, 2, "A", "100.00"), (1, 9, "R", "70.00"), (3, 10, "A", "70.00"), (5, 20, "R", "55.00"), (7, 20, "R", "55.00"), (3, 20, "A", "55.00")]
    # Accounts with even numbers have decisions on their first four rows.
    lines += [(a, 30 + 7 * k, f, "31.00") for a, f in ((2, "R"), (4, "A")) for k in range(5)]
    day = datetime(1998, 3, 1)
    orders = [(k, a, day + timedelta(d)) for k, (a, d, _, _) in enumerate(lines)]
    items = [(k, k % 3, 1, 1, 1.0, float(x), f, "F") for k, (_, _, f, x) in enumerate(lines)]
    parts = [(0, "dark ring", "PROMO", "Brand#1"), (1, "cold ring", "SMALL", "Brand#3"), (2, "hot ring", "LARGE", "Brand#3")]
    made = {
        "customer": ([(k, "me") for k in range(1, 9)], "c_custkey long, c_mktsegment string"),
        "part": (parts, "p_partkey long, p_name string, p_type string, p_brand string"),
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"),
        "lineitem": (items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string"),
        "events": ([(0, day, 1, "purchase", 1.0)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"),
    }
    for name, (rows, kinds) in made.items():
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{out}/{name}.parquet")
    return str(out)


@pytest.mark.parametrize("name", ["gold_transactions", "gold_reviews", "gold_lineage", "reviews_by_kind"])
def test_query_equals_sql_where_legs_have_several_candidates(spark, tables, name):
    con = duckdb.connect()
    for t in ("customer", "part", "orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{tables}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, tables)
    columns = sorted(df.columns)
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall())
    if name == "gold_lineage":
        # The two legs of 70, and of 31 those whose decisions don't apply or that have none; the three of 100 and the three of 55 are no single pairs.
        found = [r["transaction_id"] for r in df.where("counterpart_transaction_id is not null").collect()]
        assert len(found) > 4 and not any(x.endswith(("-100.00", "-55.00")) for x in found) and sum(x.endswith("-70.00") for x in found) == 2


def test_single_pairs_are_each_others_only_candidates(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(f"t{k}", rnd.choice((None, 1, 2, 3, 4)), k, date(2031, 1, 1) + timedelta(rnd.randrange(60)), Decimal(rnd.choice((-1, 1)) * rnd.randrange(6)), "x", ["r"] if rnd.random() < 0.4 else []) for k in range(400)]
    near = defaultdict(set)
    for a in rows:
        for b in rows:
            if a[4] < 0 and b[4] == -a[4] and None not in (a[1], b[1]) and a[1] != b[1] and abs((a[3] - b[3]).days) <= 3 and (a[6] or b[6]):
                near[a[0]].add(b[0])
                near[b[0]].add(a[0])
    want = {a: next(iter(b)) for a, b in near.items() if len(b) == 1 and len(near[next(iter(b))]) == 1}
    legs = spark.createDataFrame(rows, LEGS)
    for few in (session.BROADCAST_ROWS, 0):
        monkeypatch.setattr(session, "BROADCAST_ROWS", few)
        got = {r["transaction_id"]: (r["counterpart_transaction_id"], r["date_gap_days"], r["claim_rule_ids"]) for r in transfers.single_pairs(legs).collect()}
        day = {r[0]: r[3] for r in rows}
        assert len(want) > 10 and got == {a: (b, abs((day[a] - day[b]).days), ["r"]) for a, b in want.items()}


def test_a_sieve_loses_no_row(spark, monkeypatch):
    rows, keys = spark.range(20000).selectExpr("concat('t', id) AS k", "id AS v"), spark.range(0, 20000, 40).selectExpr("concat('t', id) AS k", "2 * id AS w")
    marked = session.sifted(rows, keys, ["k"], 500)
    assert marked.count() == 20000 and marked.where("__may").join(keys, "k").count() == 500 and marked.where("__may").count() < 3000
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    got = session.attached(rows, keys, ["k"])
    assert got.count() == 20000 and got.where("w = 2 * v").count() == got.where("w is not null").count() == session.meeting(rows, keys, ["k"]).count() == 500


def test_rows_that_no_decision_names_are_not_shuffled(spark, monkeypatch):
    n = 6000
    history = spark.range(n).selectExpr("concat('t', id) AS transaction_id", "CAST(id % 50 AS int) AS account_id", "CAST(id DIV 50 AS int) AS account_sequence", "date_add(date'2031-01-01', CAST(id DIV 50 AS int)) AS transaction_date", "CAST(if(id % 2 = 0, -1 - id DIV 2, 1 + id DIV 2) AS decimal(18,2)) AS amount", "if(id % 20 = 0, 'ring', 'shop') AS description", "CAST(NULL AS string) AS bank_category", "CAST(NULL AS string) AS bank_subcategory")
    accounts = spark.createDataFrame([(k, None) for k in range(50)], "account_id int, closed_on date")
    categories = spark.createDataFrame([("food", "expense")], "category_id string, direction string")
    force = spark.createDataFrame([(f"d{k}", "classify", [f"t{k * 50 + 1}"], "food", None, None) for k in range(100)], "decision_id string, kind string, targets array<string>, category string, adjustment string, counterpart_account_id string")
    made = [rules.Rule("ring", rules.When(contains=("ring",)), 1, transfer_claim=True), rules.Rule("shop", rules.When(contains=("shop",)), 1, category="food")]
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(session, "SIEVE_WORDS", 64)
    got = []
    with shuffled(spark):
        moved = records_shuffled(spark, lambda: got.extend(gold.classify(history, accounts, categories, made, force, transfers.single_pairs).rows.groupBy("classification_source").count().collect()))
    # 300 claims pair with the next row, on another account; 100 rows are decided, of which some would have been such a row.
    assert {r["classification_source"]: r["count"] for r in got}["manual"] == 100 and sum(r["count"] for r in got) == n
    # Before, rows were shuffled some ten times.
    assert moved < 3 * n
