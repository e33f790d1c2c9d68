"""Stores, logs, drafts and configuration checks; a publication built, written and read again."""


import re
from datetime import UTC, date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import finding, gold, measures, rules, suggesting
from ledgerlake.plans import gold_tables, reports, stores
from ledgerlake.plans.catalog import Catalog
from ledgerlake.sources import bank_csv, config, decision_log, import_log

HEAD = '"Dato","Tekst","Beløb","Saldo","Status","Afstemt"\n'


def payload(text):
    return (HEAD + f'"04.05.2032","{text}","-19,00","81,00","Udført","Nej"\n').encode("cp1252")


def test_bronze_store(spark, tmp_path):
    store = stores.BronzeStore(spark, str(tmp_path))
    assert store.runs.count() == 0
    run = lambda k, p, fmt="danske-csv-v1": (f"r{k}", p, "shared", fmt, "x.csv", date(2032, 5, 5), date(2032, 5, 1), date(2032, 5, 4), datetime(2032, 5, 5, k), "stored", None, [])
    runs = spark.createDataFrame([run(2, "pb"), run(1, "pa")], stores.RUN)
    payloads = spark.createDataFrame([(p, len(payload(p)), bytearray(payload(p))) for p in ("pa", "pb")], stores.PAYLOAD)
    store.append(runs, payloads)
    store.append(runs, payloads)
    assert [r["import_run_id"] for r in store.runs_in_order().collect()] == ["r1", "r2"] and store.payloads.count() == 2
    store.rederive()
    store.replace_records(bank_csv.parse_payloads(spark.createDataFrame([("pb", "danske-csv-v1", bytearray(b"no header"))], "payload_id string, source_format string, content binary")))
    assert [r["fields"]["Tekst"] for r in store.records_of("pa").collect()] == ["pa"]
    assert [r["payload_id"] for r in store.failures("danske-csv-v1").collect()] == ["pb"]
    store.append(spark.createDataFrame([run(3, "pa", "synthetic-ledger-v1")], stores.RUN), payloads)
    with pytest.raises(ValueError, match="pa"):
        store.rederive()


def test_silver_store_reads_whole_versions(spark, tmp_path):
    store = stores.SilverStore(spark, str(tmp_path))
    with pytest.raises(LookupError):
        store.read()
    store.replace({"transactions": spark.range(2), "reviews": spark.range(1)})
    old = store.read()
    store.replace({"transactions": spark.range(5)})
    assert old["transactions"].count() == 2 and store.read()["transactions"].count() == 5 and list(store.read()) == ["transactions"]


def test_import_log(spark, tmp_path):
    entry = lambda k, outcome="stored", repeat=None, payload="p": {"format": 2, "import_run_id": f"r{k}", "account_id": "a", "payload_sha256": payload, "outcome": outcome, "repeat_of": repeat, "archive_path": f"x{k}", "exported_on": date(2032, 5, k)}
    path = tmp_path / "imports.jsonl"
    import_log.append(str(path), [entry(1), entry(2, "repeat", "r1"), entry(3, "repeat", "r9")])
    logged = import_log.read(spark, path.read_bytes() + b'{"cut')
    assert [r["import_run_id"] for r in logged.orderBy("ordinal").collect()] == ["r1", "r2", "r3"] and logged.first()["exported_on"] == date(2032, 5, 1)
    held = spark.createDataFrame([("r1", "p", "a", "stored", None)], "import_run_id string, payload_id string, account_id string, outcome string, repeat_of string")
    rest, problems = import_log.replay(logged, held)
    assert [r["import_run_id"] for r in rest.collect()] == ["r2", "r3"] and [tuple(r) for r in problems.collect()] == [("r3", "invalid-repeat-link")]
    other = spark.createDataFrame([("r2", "p", "a", "stored", None)], held.schema)
    assert {tuple(r) for r in import_log.replay(logged, other)[1].collect()} == {("r2", "differs-from-log"), ("r2", "not-the-logs-first-runs"), ("r1", "not-the-logs-first-runs"), ("r3", "invalid-repeat-link")}
    archived = spark.createDataFrame([("x2", bytearray(b"?"))], "archive_path string, content binary")
    assert import_log.wrong_bytes(rest, archived).count() == 2
    with pytest.raises(import_log.LogDamaged, match="line 2"):
        import_log.read(spark, b'{"import_run_id":"r1"}\n{"x":1}\n')


def test_decision_log_prefixes(tmp_path):
    path = tmp_path / "decisions.jsonl"
    decision_log.append(str(path), [{"decision_id": "d1"}, {"decision_id": "d2"}])
    content = path.read_bytes()
    hashes = decision_log.prefix_hashes(content)
    assert len(hashes) == 3 and decision_log.rewritten(content, {1: (2, hashes[2]), 2: (1, "x"), 3: (7, hashes[1])}) == [2, 3]


def test_drafts(spark):
    assert [suggesting.slug(x) for x in ("Mad & Drikke", "Løn: År 2", "Café", "!?")] == ["mad-drikke", "loen-aar-2", "cafe", "x"]
    assert suggesting.unique_ids(["a", "a", "transfer", "b"], ["b"]) == ["a", "a-2", "transfer-2", "b-2"]
    rows = spark.createDataFrame([("Mad", "Købmand", D("-5")), ("MAD", "købmand", D("-6")), ("Mad", "Købmand", D("-7")), ("Løn", None, D("9")), ("Bil", "Benzin", D("-1"))], "category string, subcategory string, amount decimal(19,2)")
    made = (rules.Rule("car", rules.When(bank_category="BIL"), category="x"),)
    taxonomy, ruled = suggesting.drafts(rows, made)
    read = config.read_taxonomy(taxonomy)
    assert read.categories == {"koebmand": ("Købmand", "mad"), "loen": ("Løn", "loen")} and read.groups["loen"][1] == "income" and read.groups["mad"][1] == "expense"
    assert sorted(r.category for r in config.read_rules(ruled, read)) == ["koebmand", "loen"]


def test_check_lists_everything():
    texts = {"accounts": '[owners]\nme = "Me"\n[account.a]\ndisplay_name="A"\naccount_type="odd"\nowner="you"\ncurrency="DKK"\nsource_format="danske-csv-v1"\n', "taxonomy": '[group.g]\nname="G"\ndirection="expense"\n[category.transfer]\nname="T"\ngroup="g"\n', "profile": 'root="r"\ninbox="i"\nlate_booking_days=400\n'}
    found = config.check(texts, {"danske-csv-v1"}, b"{\n")
    assert [x.split(":")[0] for x in found] == ["profile", "accounts", "accounts", "taxonomy", "decisions"]
    good = config.read_accounts('[owners]\nme = "Me"\n[account.a]\ndisplay_name="A"\naccount_type="current"\nowner="me"\ncurrency="DKK"\nsource_format="danske-csv-v1"\nclosed_on=2032-01-01\n', {"danske-csv-v1"})
    assert good == ([("a", "A", "current", "me", "DKK", "danske-csv-v1", None, date(2032, 1, 1))], [("me", "Me", 1)])
    tax = config.read_taxonomy('[group.g]\nname="G"\ndirection="expense"\n[category.c]\nname="C"\ngroup="g"\n')
    for bad in ('when={description_contains=[1]}\nthen={category="c"}', 'when={description_regex=" "}\nthen={category="c"}', 'when={account="a"}\nthen={transfer_claim=false}', 'when={account="a"}\nthen={adjustment=" "}'):
        with pytest.raises(config.ConfigurationError):
            config.read_rules(f'[[rule]]\nid="r"\n{bad}\n', tax)
    assert config.read_profile('root="r"\ninbox="i"\n').late_booking_days == 7


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    """Two accounts; a claim that pairs, one that doesn't, a decision of each kind, and one that doesn't apply."""
    rows = [
        ("t1", "a", 1, date(2032, 5, 3), "-70.00", "to savings", "30.00"),
        ("t2", "b", 1, date(2032, 5, 4), "70.00", "from daily", "570.00"),
        ("t3", "a", 2, date(2032, 5, 5), "-9.00", "to nobody", "21.00"),
        ("t4", "a", 3, date(2032, 5, 6), "-4.00", "shop", "17.00"),
        ("t5", "a", 4, date(2032, 6, 1), "40.00", "wages", "57.00"),
        ("t6", "a", 5, date(2032, 6, 2), "-3.00", "corrected", "54.00"),
        ("t7", "a", 6, date(2032, 6, 3), "-2.00", "abroad", "52.00"),
        ("t8", "a", 7, date(2032, 6, 4), "1.50", "shop", "53.50"),
        ("t9", "b", 2, date(2032, 6, 5), "-3.00", "mystery", "567.00"),
    ]
    history = spark.createDataFrame([(t, a, k, d, D(x), text, D(b), None, None) for t, a, k, d, x, text, b in rows], "transaction_id string, account_id string, account_sequence int, transaction_date date, amount decimal(19,2), description string, balance_after decimal(19,2), bank_category string, bank_subcategory string")
    accounts = spark.createDataFrame([("a", "Daily", "current", "me", "DKK", None), ("b", "Savings", "savings", "me", "DKK", None), ("c", "New", "savings", "you", "DKK", None)], "account_id string, display_name string, account_type string, owner_id string, currency string, closed_on date")
    owners = spark.createDataFrame([("you", "You", 2), ("me", "Me", 1)], "owner_id string, display_name string, display_order int")
    categories = spark.createDataFrame([("food", "Food", "g", "G", "expense"), ("pay", "Pay", "h", "H", "income")], "category_id string, name string, group_id string, group_name string, direction string")
    exports = spark.createDataFrame([(x, f"run-{x}", date(2032, 5, 1), date(2032, 6, 20), date(2032, 6, 21)) for x in "ab"], "account_id string, import_run_id string, covers_from date, covers_through date, exported_on date")
    made = [rules.Rule("shop", rules.When(contains=("shop",)), 1, category="food"), rules.Rule("to", rules.When(starts_with=("to ",)), 1, transfer_claim=True)]
    force = spark.createDataFrame([("d1", "classify", ["t5"], "pay", None, None), ("d2", "classify", ["t6"], None, "bank error", None), ("d3", "one-sided-transfer", ["t7"], None, None, "c"), ("d4", "pair", ["t8", "t9"], None, None, None)], "decision_id string, kind string, targets array<string>, category string, adjustment string, counterpart_account_id string")
    built = gold.build(history, exports, accounts, owners, categories, made, force)
    catalog = Catalog(spark, str(tmp_path_factory.mktemp("gold")))
    assert gold_tables.publish(catalog, built, "recipe-1") == 1 and gold_tables.publish(catalog, built, "recipe-1") is None
    return history, exports, accounts, owners, categories, made, force, catalog


def test_gold_build(published):
    t = gold_tables.open_publication(published[-1])
    got = {r["transaction_id"]: (r["transaction_type"], r["transfer_group_id"] is not None) for r in t.gold.transactions.collect()}
    assert got == {"t1": ("transfer", True), "t2": ("transfer", True), "t3": ("unknown", False), "t4": ("expense", False), "t5": ("income", False), "t6": ("adjustment", False), "t7": ("transfer", False), "t8": ("refund", False), "t9": ("unknown", False)}
    line = {r["transaction_id"]: r for r in t.gold.lineage.collect()}
    assert {k: (r["classification_source"], r["decision_id"]) for k, r in line.items()} == {"t1": ("transfer_match", None), "t2": ("transfer_match", None), "t3": ("unclassified", None), "t4": ("rule", None), "t5": ("manual", "d1"), "t6": ("manual", "d2"), "t7": ("manual", "d3"), "t8": ("rule", None), "t9": ("unclassified", None)}
    e = line["t1"]["transfer_evidence"]
    assert (e["basis"], e["counterpart_account_id"], e["counterpart_transaction_id"], e["date_gap_days"], e["claim_rule_ids"]) == ("date_gap", "b", "t2", 1, ["to"])
    assert (line["t7"]["transfer_evidence"]["basis"], line["t6"]["adjustment_reason"]) == ("one_sided", "bank error")
    items = {(r["kind"], tuple(r["transaction_ids"])): (r["rule_ids"], r["decision_id"], r["reason"], [x["display_name"] for x in r["targets"]]) for r in t.review_items().collect()}
    assert items == {("unmatched-transfer", ("t3",)): (["to"], None, "counterpart-may-not-be-imported", ["Daily"]), ("unclassified", ("t9",)): ([], None, None, ["Savings"]), ("decision-not-applicable", ("t8", "t9")): ([], "d4", "amounts-do-not-cancel", ["Daily", "Savings"])}
    assert t.review_items("unclassified").count() == 1 and t.review_items(account_id="b").count() == 2
    assert len(line["t8"]["review_item_ids"]) == 1 and len(line["t9"]["review_item_ids"]) == 2


def test_scans_prune_and_select(published):
    t = gold_tables.open_publication(published[-1])
    may = t.transactions(date(2032, 5, 4), date(2032, 5, 31))
    assert sorted(r["transaction_id"] for r in may.collect()) == ["t2", "t3", "t4"] and "currency" in may.columns
    plan = may._jdf.queryExecution().explainString(may.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(month" in plan
    assert t.transactions(date(2032, 5, 1), date(2032, 6, 30), ["b"]).count() == 2 and t.transactions(date(2032, 5, 1), date(2032, 6, 30), []).count() == 0
    with pytest.raises(TypeError):
        t.allocations(date(2032, 5, 1), date(2032, 6, 30), "a")
    assert sorted((r["account_id"], r["month"].month) for r in t.monthly_balances(date(2032, 6, 1), date(2032, 6, 1)).collect()) == [("a", 6), ("b", 6)]
    assert t.lineage(may.where("transaction_id = 't4'")).count() == 1


def test_reports(published):
    t = gold_tables.open_publication(published[-1])
    context = reports.ReportContext(1, frozenset("ab"), date(2032, 6, 1), date(2032, 6, 22))
    options = reports.selection_options(t, context.reference_date)
    assert [r["owner_id"] for r in options["owners"].collect()] == ["me", "you"] and tuple(options["months"].first()) == (date(2032, 5, 1), date(2032, 6, 1))
    got = reports.monthly_overview(t, context)
    f, trusted = got["figures"].first(), got["trust"].first()
    assert (f["income"], f["expenses"], f["net"], f["adjustments_out"], f["unclassified_out"]) == (D("40.00"), D("-1.50"), D("41.50"), D("-3.00"), D("-3.00"))
    assert (trusted["status"], trusted["provisional"], len(trusted["unsettled"])) == ("partial", ["current_month", "late_bookings_unsettled"], 2)
    assert [(r["category_id"], r["spending"]) for r in got["categories"].collect()] == [("food", D("-1.50"))]
    nothing = reports.monthly_overview(t, reports.ReportContext(1, frozenset("c"), date(2032, 6, 1), date(2032, 7, 1)))
    assert nothing["trust"].first()["status"] == "no_data" and nothing["figures"].first()["income"] is None and nothing["categories"].count() == 0
    with pytest.raises(reports.InvalidSelection) as e:
        reports.spending_detail(t, reports.ReportContext(1, frozenset({"zz"}), date(2040, 1, 1), date(2032, 6, 22)), category_id="nothing")
    assert e.value.reasons == ["unknown_account", "month_out_of_range", "unknown_category"] and e.value.unknown == {"zz"}
    with pytest.raises(ValueError):
        reports.monthly_overview(t, reports.ReportContext(9, frozenset("a"), date(2032, 6, 1), date(2032, 6, 22)))
    detail = reports.spending_detail(t, context, group_id="g", year_to_date=True)
    assert [r["transaction_id"] for r in detail["rows"].collect()] == ["t8", "t4"] and detail["total"].first()["total"] == D("2.50")
    activity = reports.account_activity(t, context)
    assert [(r["account_id"], r["balance"]) for r in activity["accounts"].collect()] == [("a", D("53.50")), ("b", D("567.00"))]
    assert [r["transaction_id"] for r in activity["rows"].collect()] == ["t9", "t8", "t7", "t6", "t5"]
    may = reports.account_activity(t, reports.ReportContext(1, frozenset("a"), date(2032, 5, 1), date(2032, 6, 22)))
    assert {r["transaction_id"]: r["counterpart_account_id"] for r in may["rows"].collect()} == {"t1": "b", "t3": None, "t4": None}
    checked = {r["account_id"]: (r["internal_residual"], r["opening_gap"]) for r in reports.diagnostics(t, context)["reconciliations"].collect()}
    assert checked == {"a": (D("0.00"), D("0.00")), "b": (D("0.00"), D("0.00"))}
    assert reports.completeness(t, context.reference_date).count() == 6
    found = reports.find_transactions(t, published[0], "SHOP")
    assert [(r["transaction_id"], r["category_name"]) for r in found.collect()] == [("t4", "Food"), ("t8", "Food")]
    with pytest.raises(LookupError):
        reports.find_transactions(t, published[0].where("transaction_id <> 't4'"), "shop").count()


def test_accounts_as_a_table(spark, published):
    t = gold_tables.open_publication(published[-1])
    of = lambda ids, month=6: reports.ReportContext(1, ids, date(2032, month, 1), date(2032, 6, 22))
    table = lambda *ids: spark.createDataFrame([(x,) for x in ids], "account_id string")
    for read in (lambda c: reports.monthly_overview(t, c)["figures"], lambda c: reports.account_activity(t, c)["accounts"], lambda c: reports.account_activity(t, c)["rows"], lambda c: reports.spending_detail(t, c, group_id="g")["rows"], lambda c: reports.diagnostics(t, c)["reconciliations"]):
        assert [tuple(r) for r in read(of(table("a", "b"))).collect()] == [tuple(r) for r in read(of(frozenset("ab"))).collect()]
    with pytest.raises(reports.InvalidSelection) as e:
        reports.selected(t, of(table("a", "zz")))
    assert e.value.reasons == ["unknown_account"] and e.value.unknown == {"zz"}
    with pytest.raises(reports.InvalidSelection) as e:
        reports.selected(t, of(table()))
    assert e.value.reasons == ["no_accounts"]
    trusted = reports.trust(t, reports.selected(t, of(table("a", "b"))), date(2032, 5, 1), date(2032, 6, 1), date(2032, 6, 22)).first()
    assert (trusted["n_incomplete"], trusted["n_unsettled"]) == (len(trusted["account_months"]), len(trusted["unsettled"]))
    gone = reports.incomplete_by_account(t, reports.selected(t, of(table("a", "b"))), date(2032, 5, 1), date(2032, 6, 1)).collect()
    assert sorted((r["account_id"], m) for r in gone for m in r["months"]) == [(x["account_id"], x["month"]) for x in trusted["account_months"]]


def test_no_account_ids_in_a_reports_plan(spark):
    from ledgerlake.plans.gold_queries import QUERIES

    plan = QUERIES["account_activity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "account_id" in plan and not [x for x in plan.splitlines() if "account_id" in x and " IN (" in x]


def test_open_reviews(spark, published):
    t = gold_tables.open_publication(published[-1])
    silver = spark.createDataFrame([("i1", "dropped-transaction", "a", None), ("i2", "dropped-transaction", "b", "d7")], "review_item_id string, kind string, account_id string, resolved_by string")
    results = spark.createDataFrame([("r1", "a", "quarantined", ["i1"]), ("r2", "b", "quarantined", ["i2"]), ("r3", "a", "accepted", [])], "import_run_id string, account_id string, status string, review_item_ids array<string>")
    got = reports.open_reviews(t, silver, results)
    assert [(r["review_item_id"], r["import_run_id"]) for r in got["silver"].collect()] == [("i1", "r1")] and [r["import_run_id"] for r in got["runs"].collect()] == ["r2"]
    only = reports.open_reviews(t, silver, results, kind="unclassified", account_id="b")
    assert only["silver"].count() == 0 and only["runs"].count() == 0 and only["gold"].count() == 1


def test_second_publication_and_problems(published):
    history, exports, accounts, owners, categories, made, force, catalog = published
    later = gold.build(history, exports, accounts, owners, categories, [*made, rules.Rule("m", rules.When(contains=("mystery",)), 1, category="food")], force)
    assert gold_tables.publish(catalog, later, "recipe-2") == 2
    before, after = gold_tables.open_publication(catalog, 1), gold_tables.open_publication(catalog, 2)
    got = reports.compare_publications(before, after)
    changes = {(r["kind"], r["name"]): (r["before"], r["after"], r["change"]) for r in got["measures"].collect()}
    food = before.categories.where("category_id = 'food'").first()["group_id"]
    assert got["measures"].count() == len(changes) and changes["category", "food"] == changes["group", food] and changes["category", "food"][2] == D("3.00")
    assert changes["figure", "unclassified_count"] == (D("1.00"), D("0.00"), D("-1.00")) and changes["figure", "unclassified_out"][2] == D("3.00") and changes["figure", "expenses"][2] == D("3.00")
    assert set(changes) == {("category", "food"), ("group", food), ("figure", "unclassified_count"), ("figure", "unclassified_out"), ("figure", "expenses")}
    # Only the account months that differ are read: the same lines as from whole tables.
    whole = reports.compare_publications(gold_tables.GoldTables(before.gold), gold_tables.GoldTables(after.gold))
    assert all(reports.same_rows(got[k], whole[k]) for k in got) and reports.changed_months(before, after).count() == 1
    assert re.search(r"PartitionFilters: \[[^\]]*month", got["measures"]._jdf.queryExecution().toString())
    assert all(df.isEmpty() for df in reports.compare_publications(before, before).values())
    assert [(r["kind"], r["change"]) for r in got["reviews"].collect()] == [("unclassified", "closed")] and got["coverage"].count() == 0
    assert reports.same_rows(before.gold.monthly_balances, after.gold.monthly_balances) and not reports.same_rows(before.gold.allocations, after.gold.allocations)
    assert [r["is_current"] for r in catalog.readable().orderBy("publication_id").collect()] == [False, True]
    closed = accounts.withColumn("closed_on", F.when(F.col("account_id") == "a", F.lit(date(2032, 5, 31))))
    with pytest.raises(ValueError, match="closed-before-latest-transaction: a"):
        gold.build(history, exports, closed, owners, categories, made, force)
    with pytest.raises(ValueError, match="late_booking_days"):
        gold.build(history, exports, accounts, owners, categories, made, force, 400)


def test_words_and_dates(spark):
    assert reports.known_on(datetime(2032, 6, 30, 22, 30, tzinfo=UTC)) == date(2032, 7, 1) and reports.danish_list(["a", "b", "c"]) == "a, b og c"
    shown = spark.createDataFrame([(D("-9020.5"),), (D("0"),)], "x decimal(19,2)").select(reports.danish_amount(F.col("x"))).collect()
    assert [r[0] for r in shown] == ["−9.020,50 kr.", "0,00 kr."]
    files = spark.createDataFrame([("a", "k-0123456789-20320505.csv", date(2032, 5, 5), "0123456789"), ("a", "x.csv", None, None), (None, "y-20320505.csv", date(2032, 5, 5), None), ("a", "k-9999999999-20320505.csv", date(2032, 5, 5), "9999999999")], "declared_account_id string, original_filename string, exported_on date, account_number string")
    accounts = spark.createDataFrame([("a", "0123456789")], "account_id string, bank_account_number string")
    assert sorted(r["problem"] for r in bank_csv.misfiled(files, accounts).collect()) == ["another-account-number", "no-export-date", "not-in-an-account-folder"]


def test_directed_changes(spark):
    changed = spark.createDataFrame([("a", "category", "x", D("10"), D("13")), ("a", "group", "g", D("10"), D("13")), ("a", "category", "y", D("1"), D("5")), ("a", "figure", "x", D("1"), D("2")), ("a", "category", "gone", D("4"), D("0"))], "account_id string, kind string, name string, before decimal(38,2), after decimal(38,2)")
    before = spark.createDataFrame([("x", "g", "income"), ("y", "h", "income"), ("gone", "g", "expense")], "category_id string, group_id string, direction string")
    after = spark.createDataFrame([("x", "g", "expense"), ("y", "h", "income"), ("z", "g", "expense")], "category_id string, group_id string, direction string")
    got = measures.directed(changed, before, after).collect()
    assert sorted((r["kind"], r["name"], r["change"]) for r in got) == [("category", "gone", D("4.00")), ("category", "x", D("-3.00")), ("category", "y", D("4.00")), ("figure", "x", D("1.00")), ("group", "g", D("-3.00"))]


def test_label_pairs_by_currency(spark):
    rows = spark.createDataFrame([("Mad", None, "DKK", D("5")), ("MAD", None, "DKK", D("5")), ("Mad", None, "EUR", D("-7")), ("Bil", "x", "DKK", D("1"))], "category string, subcategory string, currency string, amount decimal(19,2)")
    got = finding.label_pairs(rows)
    assert sorted(tuple(r) for r in got.select("category", "currency", "n_rows", "total", "spellings").collect()) == [("Bil", "DKK", 1, D("1.00"), 1), ("Mad", "DKK", 2, D("10.00"), 2), ("Mad", "EUR", 1, D("-7.00"), 1)]
    assert {r["category"]: r["direction"] for r in finding.label_directions(got).collect()} == {"Mad": "expense", "Bil": "income"}
