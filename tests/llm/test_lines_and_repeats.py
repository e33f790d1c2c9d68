import hashlib
import random

import pytest

from ledgerlake.llm import line_dedup as ld
from ledgerlake.llm import suffix_dedup as sd


def test_lines_like_plain_version(spark):
    rng = random.Random(4)
    words = "alpha beta gamma delta epsilon zeta".split()
    boiler = ["Copyright 2024 Example Corp all rights reserved", "Read more at https://x.example now please", "user {} logged in from host {} today ok"]
    docs: dict[int, str | None] = {0: None, 1: "", 2: "one two"}
    for i in range(3, 70):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 5))]
        lines += [b.format(rng.choice(words), rng.randint(1, 9)) for b in boiler if rng.random() < 0.5]
        rng.shuffle(lines)
        docs[i] = "\n".join(lines)
    docs[70] = docs[71] = "a long line that repeats here\n" * 400
    df = spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id long, text string, n_lines string").repartition(4)
    got = {r["doc_id"]: r for r in ld.drop_recurring_lines(df).collect()}
    want = ld.brute_force(docs)
    assert {i: r["text"] for i, r in got.items()} == want
    assert sum(r["n_dropped"] for r in got.values()) > 50 and got[0]["n_lines"] == 0
    assert all("Copyright" not in (r["text"] or "") for i, r in got.items() if "Copyright" in (docs[i] or "") and any("Copyright" in (docs[j] or "") for j in range(i)))


def test_lines_null_ids_and_nothing(spark):
    line = "the very same line again"
    df = spark.createDataFrame([(None, line)] * 3 + [(k, line) for k in range(6)], "doc_id long, text string")
    got = ld.drop_recurring_lines(df).collect()
    assert sorted((r["doc_id"] is None, r["text"]) for r in got) == [(False, "")] * 5 + [(False, line)] + [(True, line)] * 3
    assert ld.drop_recurring_lines(df.limit(0)).count() == 0


def test_long_line_of_two_documents(spark):
    passage = "this passage of more than ten plain words stands in two otherwise different documents only"
    fields = "on 3 May 1998 the ship of 40 guns left the harbour with 312 men aboard"
    docs = {1: f"one thing first\n{passage}", 2: f"{fields}\nanother thing here", 3: f"{passage}\nlast of all\n{fields}", 4: fields.replace("312", "313"), 5: "last of all"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in ld.drop_recurring_lines(df).collect()}
    assert got == docs | {3: "last of all"} == ld.brute_force(docs)


def test_short_lines_and_scripts_without_spaces(spark):
    chinese = "这一段文字没有空格但是在两个不同的文件里都出现过一次"
    docs: dict[int, str | None] = {k: f"Les.\n\npage {k}\nAnd more." for k in range(5)} | {5: "And more.\nRare.", 6: f"{chinese}\nRare.", 7: f"x\n{chinese}"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in ld.drop_recurring_lines(df).collect()}
    assert got == docs | {k: f"\npage {k}" for k in range(1, 5)} | {5: "Rare.", 7: "x"} == ld.brute_force(docs)


@pytest.mark.parametrize("length,hot", [(48, 30_000), (60, 2)])
def test_repeats_like_brute_force(spark, monkeypatch, length, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    rng = random.Random(length)
    make = lambda n, a="abcdefgh é": "".join(rng.choice(a) for _ in range(n))
    passage, other = make(150), make(90)
    texts: list[str | None] = [None, "", "short", make(length), "a" * 300, "ab" * 200, make(900, "ab")]
    texts += [make(rng.randint(0, 80)) + passage + make(rng.randint(0, 80)) for _ in range(25)]
    texts += [make(40) + other[: rng.randint(30, 90)] + make(40) for _ in range(15)] + [make(200)] * 3
    texts += [passage[k : k + 70] + make(30) for k in range(0, 80, 7)] + [(x := make(100)) + x]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(3, texts[3])], "doc_id long, text string").repartition(3)
    want = sd.brute_force([(t or "").encode() for t in [*texts, texts[3]]], length)
    got = {}
    for r in sd.drop_repeats(df, length).collect():
        got.setdefault(r["doc_id"], []).append((r["n_removed"], r["n_spans"], bytes(r["kept"])))
    for k in range(len(texts)):
        assert got[k][0] == want[k], k
    assert got[3] == [want[3], want[-1]]
    assert sd.drop_repeats(df.limit(0), length).count() == 0


def test_kept_digest(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    r = sd.drop_repeats(df).first()
    assert (r["n_bytes"], hashlib.sha256(bytes(r["kept"])).hexdigest()) == (1, hashlib.sha256(b"x").hexdigest())
