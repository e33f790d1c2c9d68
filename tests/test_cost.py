"""What a step does for each row: patterns, copies of a column, shuffles."""

import time
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F
from test_spread import shuffled

from ledgerlake.functions import columns as C
from ledgerlake.operators import merging, rules, silver, transfers
from ledgerlake.plans.handle_index import HandleIndex
from ledgerlake.plans.queries import GIVEN, MANY_RULES, QUERIES
from ledgerlake.plans.views import Views

SF = "/root/testdata/sf0.001"


def test_minor_units_read_one_pattern_a_row(spark):
    rows = [("-0012.5", -1250), ("12", 1200), ("0000000000000000000000000000007.25", 725), ("-0", 0), ("1.00\n", "not-an-amount"), ("1.000", "excess-places"), (".5", "not-an-amount"), ("92233720368547758.08", "out-of-range")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "a string")
    got = df.select("a", C.minor_units(F.col("a"), F.lit("DKK")).alias("m"))
    assert {r["a"]: r["m"]["refusal"] or r["m"]["units"] for r in got.collect()} == dict(rows)
    plan = QUERIES["minor_units"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_" not in plan
    # The amount's text is made once, not at each place that reads it.
    assert plan.count("l_extendedprice") <= 8 and plan.count("as decimal(18,2)) as string") <= 2


def records_shuffled(spark, f):
    """How many records a step writes for shuffles."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def total():
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    f()
    time.sleep(1)
    return total() - before


def test_ids_are_brought_to_their_folders_once(spark, tmp_path):
    ids = spark.range(8000).selectExpr("id", "sha2(string(id), 256) AS transaction_id")
    index = HandleIndex(spark, str(tmp_path / "ids"), buckets=16)
    with shuffled(spark):
        assert 8000 <= records_shuffled(spark, lambda: index.add(ids)) < 9000
        # 4,000 kept before, 4,000 new, and the 8,000 beside them.
        more = spark.range(4000, 12000).selectExpr("id", "sha2(string(id), 256) AS transaction_id")
        assert 16000 <= records_shuffled(spark, lambda: index.add(more)) < 17000
    kept = spark.read.parquet(str(tmp_path / "ids"))
    assert (kept.count(), kept.select("id").distinct().count()) == (12000, 12000)


def test_a_find_of_a_few_rows_shuffles_only_these(spark):
    v = Views(spark, SF)
    n = v.transactions.count()
    with shuffled(spark):
        got = []
        assert records_shuffled(spark, lambda: got.extend(QUERIES["find_transactions"](spark, SF).collect())) < n / 4 and got


def test_rules_are_looked_up_once_for_each_description(spark, monkeypatch):
    rows = [(f"t{k}", k % 3, date(1995 + k % 3, 1, 1), Decimal(k % 7 - 3), (None, "", "A F small ring", "a f SMALL RINGS", "other red spring", "plate")[k % 6]) for k in range(600)]
    df = spark.createDataFrame(rows, "transaction_id string, account_id int, transaction_date date, amount decimal(18,2), description string").withColumns({c: F.lit(None).cast("string") for c in ("bank_category", "bank_subcategory")})
    categories = spark.createDataFrame([(c, "expense") for c in GIVEN], "category_id string, direction string")
    made = [r for k, r in enumerate(MANY_RULES) if k % 40 == 0 or r.rule_id[:2] in ("s-", "p-")]
    got = rules.classify(df, made, categories, indexed=True)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # Letters of three are taken from descriptions that are gathered already.
    assert plan.count("regexp_extract_all") == 1 and plan.index("regexp_extract_all") < plan.index("Aggregate [")
    plain = sorted(map(str, rules.classify(df, made, categories, indexed=False).collect()))
    assert sorted(map(str, got.collect())) == plain and {r["account_id"] for r in got.where("size(rule_ids) > 0").collect()} == {0, 1, 2}
    monkeypatch.setattr(rules, "TEXTS", 2)
    many = rules.classify(df, made, categories, indexed=True)
    assert "Aggregate [" not in many._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, many.collect())) == plain


def test_legs_of_held_sets_are_shuffled_a_few_times(spark):
    n = 6000
    legs = spark.range(n).selectExpr("concat('t', id) AS transaction_id", "id AS account_id", "1 AS account_sequence", "date_add(date'2031-01-01', CAST(id % 5 AS int)) AS transaction_date", "CAST(if(id % 2 = 0, -5, 5) AS decimal(19,2)) AS amount", "'x' AS description", "array('r') AS claim_rule_ids")
    got = []
    with shuffled(spark):
        # To their amount's days, to representatives, to their set and into its list; before, nine times.
        assert records_shuffled(spark, lambda: got.extend(transfers.match(legs).groupBy("state").count().collect())) < 5 * n
    assert [tuple(r) for r in got] == [("ambiguous", n)]


def test_records_of_a_merge_are_shuffled_a_few_times(spark):
    """Twenty accounts with three exports of a hundred rows, of which each is in two."""
    days = "date_add(date'2031-01-01', CAST(k % 10 AS int))"
    runs = spark.range(60).selectExpr("concat('run-', id) AS import_run_id", "concat('p', id) AS payload_id", "id % 20 AS account_id", "date_add(date'2031-02-01', CAST(id AS int)) AS exported_on", "CAST(NULL AS timestamp) AS started_at", "date'2031-01-01' AS covers_from", "date'2031-01-10' AS covers_through")
    typed = spark.range(6000).selectExpr("id % 60 AS p", "id DIV 60 AS k").selectExpr("concat('p', p) AS payload_id", "CAST(k % 10 * 10 + k DIV 10 AS int) + 1 AS record_ordinal", f"{days} AS transaction_date", "CAST(1 AS decimal(19,2)) AS amount", "concat('x', k) AS description", "CAST(k % 10 * 10 + k DIV 10 AS decimal(19,2)) AS balance", "'booked' AS booking_status", "true AS labelled", "true AS readable", "CAST(array() AS array<struct<code:string,message:string>>) AS errors")
    got = []
    with shuffled(spark):
        n = records_shuffled(spark, lambda: got.extend(silver.merge(runs, typed).where("family = 'transaction'").groupBy("status").count().collect()))
    assert [r["count"] for r in got] == [2000]
    # Ten times each record; before, eighteen times.
    assert n < 13 * 6000


def test_what_all_exports_of_a_day_show_alike_is_summed_by_day(spark, monkeypatch):
    """Ten accounts with three exports of two hundred rows that are the same, but for one row that the last of each third account lacks."""
    runs = spark.range(30).selectExpr("concat('run-', id) AS import_run_id", "concat('p', id) AS payload_id", "id % 10 AS account_id", "date_add(date'2031-02-01', CAST(id AS int)) AS exported_on", "CAST(NULL AS timestamp) AS started_at", "date'2031-01-01' AS covers_from", "date'2031-01-10' AS covers_through")
    typed = spark.range(6000).selectExpr("id % 30 AS p", "id DIV 30 AS k").where("not (p >= 20 and p % 3 = 0 and k = 0)").selectExpr("concat('p', p) AS payload_id", "CAST(k AS int) + 1 AS record_ordinal", "date_add(date'2031-01-01', CAST(k DIV 20 AS int)) AS transaction_date", "CAST(1 AS decimal(19,2)) AS amount", "concat('x', k) AS description", "CAST(k AS decimal(19,2)) AS balance", "'booked' AS booking_status", "true AS labelled", "true AS readable", "CAST(array() AS array<struct<code:string,message:string>>) AS errors")
    kept, got = {}, []
    write = merging.stash
    monkeypatch.setattr(merging, "stash", lambda df, name: kept.setdefault(name, write(df, name)) if name not in kept else write(df, name))
    with shuffled(spark):
        n = records_shuffled(spark, lambda: got.extend(silver.merge(runs, typed).where("family in ('result', 'review')").groupBy("family", "code").count().collect()))
    # Runs 21, 24 and 27; the balance at their first day's end doesn't follow from the row that isn't there.
    assert sorted((r["family"], r["code"] or "", r["count"]) for r in got) == [("result", "", 27), ("result", "review", 3), ("review", "dropped-transaction", 3), ("review", "export-disagreement", 3)]
    # Into their exports and into their days; before, eight times.
    assert n < 4 * 6000
    # Rounds read the three rows' identities, each of two exports, and a sum for each account and day.
    assert kept["shown"].count() == 6 and kept["identities"].where("alike").count() == 100
