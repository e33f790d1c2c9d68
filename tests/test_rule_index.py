"""Indexed rules against a condition for each rule."""

import random
from datetime import date, timedelta
from decimal import Decimal as D

import pytest

from ledgerlake.operators import rule_index, rules

WORDS = ["Netto", "RENT", "æble", "Straße", "Kiosk", "ﬁsk", "İzmir", "ıris", "şeker", "x", "42", "😀bar", "K2"]
SCHEMA = "transaction_id string, account_id string, transaction_date date, amount decimal(19,2), description string, bank_category string, bank_subcategory string"
CATEGORIES = [("in", "income"), ("out", "expense")]


def made_up(rng, n):
    some = lambda p, x: x if rng.random() < p else None
    word = lambda: rng.choice(WORDS + ["et", "ti", "", "ren", "NETTO k"])
    patterns = [r"netto", r"\bren.*t$", r"ki?osk", "ne(tt|xx)o", "[kx]2", "iris", "k2|42", r"stra+", "^x", "ö*rent"]
    out = []
    for i in range(n):
        when = rules.When(
            account=some(0.2, rng.choice(["a", "b", "Ab", "7"])),
            contains=tuple(word() for _ in range(rng.choice([0, 0, 1, 2]))),
            starts_with=tuple(word() for _ in range(rng.choice([0, 0, 0, 1, 2]))),
            regex=tuple(rng.choice(patterns) for _ in range(rng.choice([0, 0, 0, 1, 2]))),
            sign=some(0.2, rng.choice(["positive", "negative"])),
            amount_min=some(0.2, D(rng.randint(-500, 100)) / 100),
            amount_max=some(0.2, rng.choice([D("3.5"), D("1.2345678"), D("-0.01")])),
            date_from=some(0.2, date(2030, 1, rng.randint(1, 9))),
            date_to=some(0.2, date(2030, 1, rng.randint(5, 20))),
            bank_category=some(0.2, rng.choice(["Mad", "MASSE"])),
            bank_subcategory=some(0.1, rng.choice(["Mad", "x"])),
        )
        kind = rng.randrange(3)
        out.append(rules.Rule(f"r{i:04d}", when, rng.randrange(4), category=rng.choice(["in", "out"]) if kind == 0 else None, adjustment=f"adj:{i % 5}" if kind == 1 else None, transfer_claim=kind == 2))
    return out


def rows_of(rng, n):
    out = []
    for i in range(n):
        text = rng.choice([None, "", " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))), rng.choice(WORDS).upper()])
        out.append((f"t{i}", rng.choice(["a", "b", "ab", "7", None]), rng.choice([None, date(2030, 1, 1) + timedelta(rng.randrange(20))]), rng.choice([None, D(rng.randint(-500, 500)) / 100]), text, rng.choice([None, "MAD", "maße"]), rng.choice([None, "mad", "X"])))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_same_outcomes_as_conditions(spark, seed):
    rng = random.Random(seed)
    rows = rows_of(rng, 300)
    rows += [rows[0], ("long", "a", date(2030, 1, 3), D("1.00"), "rent " + "z" * 100_000 + " netto", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    cats = spark.createDataFrame(CATEGORIES, "category_id string, direction string")
    made = made_up(rng, 60)
    held, plain = rule_index.split(made)
    assert held and plain
    want = rules.classify(df, made, cats, indexed=False).collect()
    got = rules.classify(df, made, cats, indexed=True).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(bool(r["rule_ids"]) for r in want) > 50


def test_no_rows_and_no_rules(spark):
    cats = spark.createDataFrame(CATEGORIES, "category_id string, direction string")
    one = spark.createDataFrame([("t", "a", date(2030, 1, 1), D("-1.00"), "Netto", None, None)], SCHEMA)
    assert rules.classify(one.limit(0), made_up(random.Random(1), 20), cats, indexed=True).count() == 0
    assert rules.classify(one, [], cats, indexed=True).first()["review_kind"] == "unclassified"
    assert rules.classify(one, [rules.Rule("r", rules.When(), category="out")], cats, indexed=True).first()["review_kind"] == "unclassified"


def test_thousands_of_rules_by_default(spark):
    """The plan holds no condition for each rule, and every row meets its own two rules."""
    made = [rules.Rule(f"r{i}", rules.When(contains=(f"shop {i:05d}",)), 1, category="out") for i in range(4000)]
    made += [rules.Rule(f"a{i}", rules.When(account=f"acc{i}"), 1, category="out") for i in range(1000)]
    rows = [(f"t{i}", f"acc{i % 1000}", date(2030, 1, 1), D("-1.00"), f"SHOP {i:05d} x", None, None) for i in range(4000)]
    cats = spark.createDataFrame(CATEGORIES, "category_id string, direction string")
    df = rules.classify(spark.createDataFrame(rows, SCHEMA), made, cats)
    assert len(df._jdf.queryExecution().analyzed().expressions().toString()) < 100_000
    assert {r["transaction_id"]: r["rule_ids"] for r in df.collect()} == {f"t{i}": sorted([f"r{i}", f"a{i % 1000}"]) for i in range(4000)}


@pytest.mark.parametrize("pattern,text", [("Netto", "netto"), (r"\bblue\b.*rent", "blue"), ("ab?cd", "cd"), ("ab*", "a"), ("a+bc", "bc"), ("fish", "sh"), ("a|b", ""), ("(abc)", ""), ("[abc]d", ""), (r"abc\.de", ""), ("a{2}bcd", ""), ("", ""), ("ab?", "a"), ("\\", "")])
def test_needed_text(pattern, text):
    assert rule_index.needed_text(pattern) == text


def test_the_key_of_fewest_rules_is_taken():
    when = rules.When
    made = [rules.Rule(f"r{i}", w) for i, w in enumerate([
        when(account="a", contains=("Netto",)), when(account="b", contains=("netto",)), when(account="b", contains=("nett", "c")), when(account="b"),
        when(starts_with=("Ab", "a rather long text"), bank_category="MAD"), when(regex=("gran+d",), bank_category="mad"), when(sign="positive"), when(contains=("",)),
    ])]
    counts = rule_index.uses(made)
    got = [rule_index.keys(r.when, counts) for r in made]
    assert got == [["a:a"], ["t:tto"], ["a:b"], ["a:b"], ["p:ab", "p:a rather lon"], ["t:gra"], None, None]
