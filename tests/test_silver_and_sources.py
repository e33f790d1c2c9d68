"""Bank exports from bytes to merged transactions; configuration, the decision log, the catalog and the inbox stream."""

import json
import os
from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import columns as C
from ledgerlake.operators import bronze, silver
from ledgerlake.plans.catalog import Catalog, NothingPublished, PointerMoved, fingerprint
from ledgerlake.sources import bank_csv, config, decision_log
from ledgerlake.streaming.inbox import import_available

HEAD = '"Dato","Tekst","Beløb","Saldo","Status","Afstemt"'


def export(*rows, head=HEAD):
    return "\r\n".join([head, *(",".join(f'"{x}"' for x in r) for r in rows)]).encode("cp1252") + b"\r\n"


def test_parser():
    good, span, fault = bank_csv.parse_danske(export(("09.07.2031", 'kig ""ind""', "-2.310,75", "689,25", "Udført", "Nej"), ("07.07.2031", "x", "1,00", "2,00", "Udført", "Nej")))
    assert fault is None and good[0]["Tekst"] == 'kig "ind"' and good[0]["Beløb"] == "-2.310,75" and span == (date(2031, 7, 7), date(2031, 7, 9))
    for bad, word in ((b"\x81", "1252"), (b'"a","b"\n', "header"), (HEAD.encode("cp1252") + b'\n"09.07.2031","x"\n', "fields"), (HEAD.encode("cp1252") + b"\n09.07.2031\n", "quoted"), (b"", "header"), (HEAD.encode("cp1252") + b'\n"09.07.2031",\n', "quoted")):
        assert word in bank_csv.parse_danske(bad)[2]
    for day in ("31.06.2031", "9.7.2031", "09-07-2031", ""):
        assert "date" in bank_csv.parse_danske(export((day, "", "", "", "", "")))[2]


@pytest.mark.parametrize("delimiter", [",", ";"])
@pytest.mark.parametrize("ending", ["\n", "\r\n", "\r"])
@pytest.mark.parametrize("written,text", [(r"C:\temp", r"C:\temp"), ("slut\\", "slut\\"), (r"et \"ord\" her", 'et "ord" her'), ('et ""ord""', 'et "ord"'), (r"\n\\", r"\n\\"), ("to\nlinjer", "to\nlinjer"), ("a,b;c", "a,b;c")])
def test_parser_quotes_and_breaks(delimiter, ending, written, text):
    row = ("09.07.2031", written, "1,00", "2,00", "Udført", written)
    content = ending.join([HEAD.replace(",", delimiter), delimiter.join(f'"{x}"' for x in row), ""]).encode("cp1252")
    records, _, fault = bank_csv.parse_danske(content)
    assert fault is None and [(r["Tekst"], r["Afstemt"]) for r in records] == [(text, text)]


def test_second_format(spark):
    records, span, fault = bank_csv.parse_ledger("when\tsum\tmemo\tbal\tstate\n2031-07-09\t-12.50\tæbler\t80.00\tbooked\n".encode())
    assert fault is None and span == (date(2031, 7, 9),) * 2 and records[0]["Beløb"] == "-12,50" and records[0]["Dato"] == "09.07.2031"
    assert bank_csv.parse_ledger(b"when\tsum\n")[2] and bank_csv.parse_ledger(b"when\tsum\tmemo\tbal\tstate\n2031-7-9\t1\tx\t\tbooked\n")[2]
    rows = spark.createDataFrame([("p", "no-such-format", bytearray(b"x"))], "payload_id string, source_format string, content binary")
    assert "no-such-format" in bank_csv.parse_payloads(rows).first()["reason"]


def run(k, account, day, first, last):
    return (f"run-{k}", f"p{k}", account, date.fromisoformat(day), datetime(2031, 7, 20, k), date.fromisoformat(first), date.fromisoformat(last))


RUNS = "import_run_id string, payload_id string, account_id string, exported_on date, started_at timestamp, covers_from date, covers_through date"


def merged(spark, runs, files, decisions=()):
    payloads = spark.createDataFrame([(p, "danske-csv-v1", bytearray(b)) for p, b in files.items()], "payload_id string, source_format string, content binary")
    typed = silver.typed_records(bank_csv.parse_payloads(payloads).where("reason is null").drop("reason", "source_format", "first_date", "last_date"))
    return typed, silver.merge(spark.createDataFrame(runs, RUNS), typed, spark.createDataFrame(list(decisions), silver.DECISIONS) if decisions else None)


def bread(balance, text="BAGERI"):
    return ("10.07.2031", text, "-41,50", balance, "Udført", "Nej")


def test_overlapping_exports_merge(spark):
    a = export(("09.07.2031", "BOGHANDEL", "-64,90", "1.145,50", "Udført", "Nej"), bread("1.104,00"))
    b = export(bread("1.104,00"), bread("1.062,50"), ("11.07.2031", "HONORAR", "2.300,00", "3.362,50", "Udført", "Nej"), ("11.07.2031", "SENERE", "-1,00", "", "Venter", "Nej"))
    typed, out = merged(spark, [run(1, "shared", "2031-07-10", "2031-07-09", "2031-07-10"), run(2, "shared", "2031-07-11", "2031-07-10", "2031-07-11")], {"p1": a, "p2": b})
    rows = out.collect()
    assert [r["status"] for r in sorted((r for r in rows if r["family"] == "result"), key=lambda r: r["import_run_id"])] == ["accepted", "accepted"]
    got = sorted((r["transaction_date"].day, r["day_sequence"], str(r["amount"]), r["occurrence"]) for r in rows if r["family"] == "transaction")
    assert got == [(9, 1, "-64.90", 1), (10, 1, "-41.50", 1), (10, 2, "-41.50", 2), (11, 1, "2300.00", 1)]
    assert sum(r["family"] == "evidence" for r in rows) == 5
    families = silver.in_order(out)
    assert [r["amount"] for r in families["transactions"].collect()] == [D("-64.90"), D("-41.50"), D("-41.50"), D("2300.00")] and families["review_items"].count() == 0
    assert [r["description"] for r in silver.unbooked(typed, out).collect()] == ["SENERE"] and silver.run_errors(typed).count() == 0


def test_dropped_transaction_needs_a_decision(spark):
    a, b = export(bread("812,25"), bread("770,75")), export(bread("812,25"))
    runs = [run(1, "shared", "2031-07-10", "2031-07-09", "2031-07-10"), run(2, "shared", "2031-07-11", "2031-07-09", "2031-07-11")]
    rows = merged(spark, runs, {"p1": a, "p2": b})[1].collect()
    review = [r for r in rows if r["family"] == "review"]
    assert [(r["code"], r["status"], r["occurrence"]) for r in review] == [("dropped-transaction", "open", 2)] and len(review[0]["review_item_id"]) == 64
    assert sum(r["family"] == "transaction" for r in rows) == 2
    rows = merged(spark, runs, {"p1": a, "p2": b}, [("withdrawn", None, review[0]["transaction_id"], None, None)])[1].collect()
    assert sum(r["family"] == "transaction" for r in rows) == 1 and all(r["status"] == "accepted" for r in rows if r["family"] == "result")


def test_new_words_for_the_same_transaction(spark):
    a, b = export(bread("812,25")), export(bread("812,25", "BAGERIET PAA HJOERNET"))
    runs = [run(1, "shared", "2031-07-10", "2031-07-09", "2031-07-10"), run(2, "shared", "2031-07-11", "2031-07-09", "2031-07-11")]
    rows = merged(spark, runs, {"p1": a, "p2": b})[1].collect()
    known = next(r["transaction_id"] for r in rows if r["family"] == "review")
    rows = merged(spark, runs, {"p1": a, "p2": b}, [("same-transaction", None, known, "p2", 1)])[1].collect()
    assert [(r["transaction_id"], r["description"], r["payload_id"]) for r in rows if r["family"] == "transaction"] == [(known, "BAGERI", "p2")]
    assert sorted(r["payload_id"] for r in rows if r["family"] == "evidence" and r["transaction_id"] == known) == ["p1", "p2"]
    rows = merged(spark, runs, {"p1": a, "p2": b}, [("void-import-run", "run-1", None, None, None)])[1].collect()
    assert [r["description"] for r in rows if r["family"] == "transaction"] == ["BAGERIET PAA HJOERNET"]


def test_balances_that_disagree_and_break(spark):
    a, b = export(bread("812,25")), export(bread("900,00"))
    runs = [run(1, "shared", "2031-07-10", "2031-07-10", "2031-07-10"), run(2, "shared", "2031-07-11", "2031-07-10", "2031-07-10")]
    rows = merged(spark, runs, {"p1": a, "p2": b})[1].collect()
    assert [r["code"] for r in rows if r["family"] == "review"] == ["export-disagreement"]
    broken = export(bread("812,25"), bread("700,00"))
    one = [run(1, "shared", "2031-07-10", "2031-07-10", "2031-07-10")]
    typed, out = merged(spark, one, {"p1": broken})
    assert [(r["status"], r["code"]) for r in out.collect() if r["family"] == "result"] == [("quarantined", "errors")]
    assert [(r["record_ordinal"], r["code"]) for r in silver.run_errors(typed).collect()] == [(2, "balance-chain-break")]
    assert any(r["family"] == "transaction" for r in merged(spark, one, {"p1": broken}, [("accept-discrepancy", "run-1", None, None, None)])[1].collect())


def test_typed_errors(spark):
    rows = [("p", 1, {"Dato": "9.7.2031", "Tekst": "x", "Beløb": "1,234", "Saldo": "", "Status": "Nope", "Afstemt": ""}), ("p", 2, {"Dato": "09.07.2031"}), ("p", 3, {"Dato": "09.07.2031", "Tekst": "x", "Beløb": "1.234,5", "Saldo": "1,0", "Status": "Udført", "Afstemt": ""})]
    got = silver.typed_records(spark.createDataFrame(rows, "payload_id string, record_ordinal int, fields map<string,string>")).orderBy("record_ordinal").collect()
    assert [[e["code"] for e in r["errors"]] for r in got] == [["unparseable-date", "unparseable-decimal", "unknown-status"], ["wrong-field-count"], []]
    assert (got[2]["amount"], got[2]["balance"]) == (D("1234.50"), D("1.00"))


def test_formats_are_plugged_in(spark):
    payloads = spark.createDataFrame([("p", "danske-csv-v1", bytearray(export(bread("812,25")))), ("q", "synthetic-ledger-v1", bytearray(b"when\tsum\tmemo\tbal\tstate\n2031-07-09\t-12.50\tx\t80.00\tbooked\n"))], "payload_id string, source_format string, content binary")
    records = bank_csv.parse_payloads(payloads).drop("reason", "first_date", "last_date")
    assert {(r["payload_id"], r["amount"]) for r in silver.typed_by_format(records).collect()} == {("p", D("-41.50")), ("q", D("-12.50"))}
    doubled = {"danske-csv-v1": silver.typed_records, "synthetic-ledger-v1": lambda r: silver.typed_records(r).withColumn("amount", (F.col("amount") * 2).cast("decimal(19,2)"))}
    assert {r["amount"] for r in silver.typed_by_format(records, doubled).collect()} == {D("-41.50"), D("-25.00")}
    with pytest.raises(ValueError, match="synthetic-ledger-v1"):
        silver.typed_by_format(records, {"danske-csv-v1": silver.typed_records})


def test_text_helpers(spark):
    df = spark.createDataFrame([("\xa0HONORAR  JULI\xa0",), (" \t ",)], "t string").select(C.identity_text(F.col("t")).alias("i"), C.label(F.col("t")).alias("l"))
    assert [tuple(r) for r in df.collect()] == [("HONORAR JULI", "HONORAR  JULI"), ("", None)]


def test_case_folding_of_all_letters(spark):
    rows = [("".join(chr(c) for c in range(k, k + 64) if not 0xD800 <= c < 0xE000),) for k in range(0, 0x110000, 64)] + [(chr(c),) for c in range(0x2000)] + [("",), ("ÆBLE Straße µ İstanbul ﬁ",)]
    got = spark.createDataFrame(rows, "t string").select("t", C.fold(F.col("t")).alias("f")).collect()
    assert all(r["f"] == r["t"].casefold() for r in got) and spark.createDataFrame([(None,)], "t string").select(C.fold(F.col("t"))).first()[0] is None


def test_minor_units(spark):
    rows = [("12.50", "DKK"), ("-3", "DKK"), ("0.000", "DKK"), ("1.234", "DKK"), ("92233720368547758.07", "DKK"), ("92233720368547758.08", "DKK"), ("-92233720368547758.08", "DKK"), ("00012.5", "DKK"), ("1e3", "DKK"), (None, "DKK"), ("1", "XXX"), ("1", None), ("-0.05", "DKK"), ("0" * 300 + "7", "DKK")]
    df = spark.createDataFrame(rows, "a string, c string").select(C.minor_units(F.col("a"), F.col("c")).alias("m"), "c")
    got = df.select("m.*", C.from_minor_units(F.col("m.units"), F.col("c")).alias("back")).collect()
    assert [r["units"] for r in got] == [1250, -300, None, None, 2**63 - 1, None, -(2**63), 1250, None, None, None, None, -5, 700]
    assert [r["refusal"] for r in got if r["units"] is None] == ["excess-places", "excess-places", "out-of-range", "not-an-amount", "not-an-amount", "unknown-currency", "unknown-currency"]
    assert all(r["back"] is None if r["units"] is None else r["back"] == D(r["units"]).scaleb(-2) for r in got)


def test_run_outcomes(spark):
    rows = [("r1", "p", "a", 1, []), ("r2", "p", "a", 2, []), ("r3", "p", "b", 3, []), ("r4", "q", "a", 4, ["range-starts-after-end"]), ("r5", "q", "a", 5, [])]
    df = spark.createDataFrame(rows, "import_run_id string, payload_id string, declared_account_id string, started_at int, refusals array<string>")
    got = {r["import_run_id"]: (r["outcome"], r["repeat_of"]) for r in bronze.run_outcomes(df).collect()}
    assert got == {"r1": ("stored", None), "r2": ("repeat", "r1"), "r3": ("account-conflict", None), "r4": ("refused", None), "r5": ("stored", None)}


def test_configuration_lists_every_problem(spark):
    tax = config.read_taxonomy('[group.g]\nname="G"\ndirection="expense"\n[category.c]\nname="C"\ngroup="g"\n')
    assert tax.frame(spark).first()["direction"] == "expense"
    made = config.read_rules('[[rule]]\nid="r"\nwhen={description_contains=["a","b"], amount_min="-5.00"}\nthen={category="c"}\n', tax)
    assert made[0].when.contains == ("a", "b") and made[0].when.amount_min == D("-5.00")
    with pytest.raises(config.ConfigurationError) as e:
        config.read_rules('[[rule]]\nid="r"\nwhen={}\nthen={category="zz", adjustment="x"}\n[[rule]]\nid="r"\nwhen={description_regex="("}\nthen={category="c"}\n', tax)
    assert len(e.value.problems) == 5
    ranges = config.read_ranges('format=1\n[default]\nfrom=2026-01-01\nthrough=2026-02-01\n[account.b]\nthrough=2026-03-01\n', {"a", "b"})
    assert ranges["b"][1] == date(2026, 3, 1)


def test_decision_log(spark):
    entry = lambda i, kind, targets, over=(), **more: json.dumps({"decision_id": i, "kind": kind, "targets": targets, "supersedes": list(over)} | more)
    lines = [entry("d1", "classify", ["t1"], category="c"), entry("d2", "classify", ["t1"], category="c"), entry("d3", "classify", ["t1"], ["d1"], adjustment="a"), entry("d4", "withdrawn", ["t1"]), entry("d5", "retract", [], ["d4"]), entry("d6", "pair", ["t1"]), "{", '{"a":1,"a":2}', '{"cut']
    log = decision_log.read_log("\n".join(lines).encode())
    assert list(log.in_force) == ["d3"] and len(log.problems) == 6
    assert log.frame(spark).first()["decision_id"] == "d3"


def test_decision_log_of_odd_shapes():
    good = {"decision_id": "d", "kind": "classify", "targets": ["t"], "category": "c"}
    odd = [{"targets": [["x"]]}, {"targets": 5}, {"targets": None}, {"record": 3}, {"record": {"payload_id": 1, "record_ordinal": 1}}, {"record": {"payload_id": "p", "record_ordinal": True}}, {"kind": ["x"]}, {"kind": None}, {"decision_id": 7}, {"supersedes": "d"}, {"category": 4}, {"category": None}, {"adjustment": "a"}, {"targets": []}]
    lines = [json.dumps(good | {"decision_id": f"d{k}"} | x) for k, x in enumerate(odd)] + ["3", "null", "[]", '"x"', "[" * 100_000, json.dumps(good)]
    log = decision_log.read_log(("\n".join(lines) + "\n").encode())
    assert list(log.in_force) == ["d"] and len(log.problems) == len(lines) - 1
    kinds = [("pair", ["t"]), ("pair", ["t", "u"]), ("one-sided-transfer", ["v"]), ("same-transaction", ["w"]), ("retract", [])]
    log = decision_log.read_log("".join(json.dumps({"decision_id": f"k{n}", "kind": k, "targets": t}) + "\n" for n, (k, t) in enumerate(kinds)).encode())
    assert list(log.in_force) == ["k1"] and len(log.problems) == 3


def test_claims_by_payload():
    same = lambda i, payload, over=(): json.dumps({"decision_id": i, "kind": "same-transaction", "targets": ["t"], "record": {"payload_id": payload, "record_ordinal": 1}, "supersedes": list(over)})
    gone = lambda i, over=(): json.dumps({"decision_id": i, "kind": "withdrawn", "targets": ["t"], "supersedes": list(over)})
    read = lambda *lines: decision_log.read_log(("\n".join(lines) + "\n").encode())
    assert list(read(same("a", "p"), same("b", "q"), same("c", "p")).in_force) == ["a", "b"]
    assert list(read(same("a", "p"), same("b", "q"), gone("c")).in_force) == ["a", "b"] and list(read(same("a", "p"), same("b", "q"), gone("c", ["a", "b"])).in_force) == ["c"]
    assert list(read(gone("a"), same("b", "p", ["a"]), same("c", "p", ["a"]), same("d", "q")).in_force) == ["b", "d"]


def test_two_publishers_that_interleave(spark, tmp_path):
    frame = lambda n: {"t": spark.range(n)}
    one, two = Catalog(spark, str(tmp_path)), Catalog(spark, str(tmp_path))
    assert one.publish(frame(1), "a", configuration="[rules]") == 1
    seen = two._last()
    assert one.publish(frame(2), "b", configuration="[rules]") == 2
    # The second publisher read the pointer before the first one moved it.
    two._last = lambda: seen
    with pytest.raises(PointerMoved):
        two.publish(frame(3), "c")
    del two._last
    assert two.current() == 2 and one.read("t").count() == 2 and [r["to_id"] for r in one.moves.orderBy("move").collect()] == [1, 2]
    assert two.publish(frame(3), "c", configuration="[other]") == 4 and one.current() == 4
    rows = {r["publication_id"]: r for r in one.publications.collect()}
    assert rows[2]["rows"] == {"t": 2} and rows[1]["configuration"] == rows[2]["configuration"] and rows[3]["configuration"] is None
    assert [one.configuration(k) for k in (1, 2, 3, 4)] == ["[rules]", "[rules]", None, "[other]"] and len([p for p in (tmp_path / "configurations").iterdir() if p.suffix != ".crc"]) == 2


def test_an_abandoned_move(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    c.publish({"t": spark.range(1)}, "a")
    left = tmp_path / "pointer_moves" / f"{2:012d}.json"
    left.touch()
    assert c.current() == 1
    with pytest.raises(PointerMoved):
        c.publish({"t": spark.range(2)}, "b")
    os.utime(left, (1, 1))
    assert c.publish({"t": spark.range(2)}, "b") == 3 and c.current() == 3


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    with pytest.raises(NothingPublished):
        c.current()
    frame = lambda n: {"t": spark.range(n)}
    assert [c.publish(frame(1), "a"), c.publish(frame(1), "a"), c.publish(frame(2), "b"), c.publish(frame(3), "c", "keep"), c.publish(frame(4), "d")] == [1, None, 2, 3, 4]
    assert c.read("t").count() == 4 and c.read("t", 2).count() == 2
    assert c.undo() == 3 and c.current() == 3
    assert c.stale() == [1, 2] and c.retain(["t"]) == [1, 2]
    with pytest.raises(LookupError):
        c.read("t", 1)
    assert c.restore_boundary() == 1_000_000 and c.publish(frame(1), "e") == 1_000_000
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string"), spark.createDataFrame([("y", 2), ("x", 1)], "b string, a int")
    assert fingerprint(a).first() == fingerprint(b).first() != fingerprint(a.limit(1)).first()


def test_inbox_stream(spark, tmp_path):
    inbox = tmp_path / "inbox" / "shared"
    inbox.mkdir(parents=True)
    one = export(bread("812,25"))
    (inbox / "konto-1234567890-20310711.csv").write_bytes(one)
    import_available(spark, str(tmp_path / "inbox"), str(tmp_path / "bronze"), str(tmp_path / "at")).awaitTermination(120)
    (inbox / "konto-1234567890-20310712 (1).csv").write_bytes(export(bread("770,75")))
    import_available(spark, str(tmp_path / "inbox"), str(tmp_path / "bronze"), str(tmp_path / "at")).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "bronze/raw_payloads")).orderBy("exported_on").collect()
    assert [(r["declared_account_id"], str(r["exported_on"]), r["account_number"]) for r in rows] == [("shared", "2031-07-11", "1234567890"), ("shared", "2031-07-12", "1234567890")]
    assert spark.read.parquet(str(tmp_path / "bronze/source_records")).count() == 2
