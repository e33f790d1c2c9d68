import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import language, pii, quality
from plain_pii import revealing

PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base(text):
    out = []
    for rank, (kind, p) in enumerate(PLAIN):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda d=d: 14 <= len(d) <= 19 and luhn(d), "phone": lambda d=d: 10 <= len(d) <= 15}[kind]()
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{a}:{z}" for a, _, z, k in sorted(out)]


TEXTS = [
    None, "", "é😀 mail a.b@c-d.example.org, x", "a@b.c+d@e.f@g.h.i", "@@x@y a@b", "1.2.3.4.5.6.7.8 300.1.1.1 0001.02.3.255 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 5500005555555559", "+1 (988) 555-2485, +45 12 34 56 78 90 +1 2", "x" * 20000 + "@" + "y" * 100, "1" * 30000, "1 2 " * 3000, "a@" * 3000 + "b.c",
    "+1" + "(" * 50, "😀" * 50 + "10.0.0.1", "tel:+4512345678.", "A" * 10 + "@b.c" * 4,
]


def test_base_entities(spark):
    rng = np.random.default_rng(5)
    more = ["".join(rng.choice(list("a1@.+ -()é😀9"), 60)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(TEXTS + more)), "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in pii.find_personal_data(df).select("doc_id", pii.span_text(F.col("base")).alias("s")).collect()}
    for k, t in enumerate(TEXTS + more):
        assert got[k] == ",".join(base(t)), (k, t and t[:80])


def test_terms_that_reveal(spark):
    rows = [(k, f"report {k} number{k} about Zorblatt the great ann@x.org thing{k} was seen") for k in range(6)] + [(k, f"plain words about the great sea number {k} was seen") for k in range(6, 200)]
    df = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, spans string")
    found = pii.find_personal_data(df, support=3, disclosure=0.8, removal=0.99, z=0)
    got = {r["doc_id"]: r for r in found.collect()}
    named = lambda k: {s["value"] for s in got[k]["spans"] if s["kind"] in ("term", "gone")}
    assert named(0) == {"report", "Zorblatt"} and not named(50)
    assert [s["value"] for s in got[0]["base"]] == ["ann@x.org"]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(found).collect()}
    assert "ann@" not in clean[0] and "[EMAIL]" in clean[0] and "Zorblatt" not in clean[0] and clean[60] == rows[60][1]
    assert pii.find_personal_data(df.limit(0)).count() == 0


def test_terms_of_an_entity_seen_once(spark, monkeypatch):
    monkeypatch.setattr(pii, "HOT", 5)
    far = " ".join(["plain words about the great sea"] * 40)
    rows = [(0, f"Zorblatt came first, {far} ann@x.org"), (1, f"Zorblatt came first, {far} ann@x.org"), (2, f"nobody came, {far} bob@y.org")]
    rows += [(k, f"{far} came number {k}") for k in range(3, 200)] + [(200, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = pii.find_personal_data(df, support=1, z=0)
    got = {r["doc_id"]: r for r in found.collect()}
    named = lambda k: {s["value"] for s in got[k]["spans"] if s["kind"] in ("term", "gone")}
    assert named(0) == named(1) == {"Zorblatt", "first"} and named(2) == {"nobody"} and not named(50)
    assert len(got) == 202 and [s["value"] for s in got[0]["base"]] == ["ann@x.org"]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(found).collect()}
    assert clean[0].startswith(" came ,") and clean[60] == rows[60][1] and clean[200] is None
    assert pii.find_personal_data(df.limit(0)).count() == 0


def test_precision_on_planted_attributes(spark):
    """Words that go with a person's address, or with a rare mail domain, are found; words that come together by chance aren't."""
    rng = np.random.default_rng(7)
    words = [f"word{k}" for k in range(400)]
    rows, planted = [], {}
    for k in range(2000):
        text = list(rng.choice(words, 30)) + [f"once{k}"]
        if k < 60:
            person = k // 6
            text += [f"p{person}@mail.example.com", f"nickname{person}", f"street{person}"]
            planted[k] = {f"nickname{person}", f"street{person}"}
        elif k < 140:
            text += [f"someone{k}@rare.example.org", "zephyrproject"]
            planted[k] = {"zephyrproject"}
        elif k < 1200:
            text += [f"user{k}@common.example.net", f"pair{k % 530}"]
        rows.append((k, " ".join(text)))
    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    added = {(r["doc_id"], s["value"]) for r in got for s in r["spans"] if s["kind"] in ("term", "gone")}
    want = {(k, w) for k, ws in planted.items() for w in ws}
    outside = {k: set(t.split()) for k, t in rows}
    assert added == {(k, w) for k, ws in revealing(dict(rows)).items() for w, _ in ws if w in outside[k]}
    assert len(added & want) >= 0.95 * len(want) and len(added & want) >= 0.95 * len(added)


def test_a_text_with_20000_entities(spark):
    """An address list, and a text that shares some of it: matches and entities aren't multiplied with each other or with words."""
    text = " ".join(f"name{k} user{k}@host{k}.example.org" for k in range(20_000))
    rows = [(0, text), (1, "name7 wrote user7@host7.example.org"), *((k, f"plain text {k}") for k in range(2, 60))]
    began = time.time()
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - began < 60 and len(got[0]["base"]) == 20_000 and got[0]["base"][19_999]["end"] == len(text)


def test_factorisation_machine_identity():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=quality.FEATURES).astype(np.float32), rng.normal(size=(quality.FEATURES, quality.FACTORS)).astype(np.float32))
    p, x = np.array([3, 9, 200, 7000]), np.array([0.5, 1.0, 2.0, 0.1], np.float32)
    pairs = sum(float(m.v[p[i]] @ m.v[p[j]]) * x[i] * x[j] for i in range(4) for j in range(i))
    assert m.margins([(p, x)])[0] == pytest.approx(0.3 + float(m.w[p] @ x) + pairs, rel=1e-4)


def test_quality_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "n_chars")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    machine = quality.train(docs, labels, ~quality.held_out(), ("n_chars",))
    got = quality.score(docs, machine).join(labels, "doc_id").where(quality.held_out())
    assert got.where("predicted = label").count() >= 0.97 * got.count()
    odd = spark.createDataFrame([(1, None, None), (2, "", 0), (3, "x" * 200000, 5), (None, "plain words", -3)], "doc_id long, text string, n_chars long")
    assert all(0 <= r["score"] <= 1 for r in quality.score(odd, machine).collect())
    assert [r["score"] for r in quality.score(odd, None).collect()] == [1.0] * 4
    assert quality.train(docs, labels.limit(0), F.lit(True)) is None
    assert quality.score(odd.limit(0), machine).count() == 0


def phrases(text, reference):
    """Longest phrases of a text that are substrings of a reference, one by one."""
    n, at = 0, 0
    while at < len(text):
        z = at + 1
        while z <= len(text) and text[at:z] in reference:
            z += 1
        at = max(at + 1, z - 1)
        n += 1
    return n


def test_cross_parsing_like_plain_version():
    refs = (("aa", "the cat sat on the mat and then the dog came"), ("bb", "le chat est sur la table et puis le chien vient"))
    p = language.Parser(refs)
    for text in ("the dog sat", "le chien est la", "zzz qqq", "x", "the chat on la mat z", "tttt eee"):
        costs, letters = p.costs([text])
        squeezed = [re.sub(r"[^a-z]+", " ", r) for _, r in refs]
        want = [phrases(re.sub(r"[^a-z]+", " ", text), r) * w for r, w in zip(squeezed, p.weight, strict=True)]
        assert letters[0] and costs[0].tolist() == pytest.approx(want), text


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    refs = language.learn(docs, ~quality.held_out())
    got = language.identify(docs, refs).where(quality.held_out())
    assert got.where("lang_pred = lang").count() >= 0.98 * got.count()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "the"), (5, "the and of " * 20000), (None, "😀")], "doc_id long, text string")
    rows = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(odd, refs).collect()}
    assert all(rows[k] == ("und", 0.0) for k in (1, 2, 3, None)) and rows[5][0] == "en"
    assert {r["lang_pred"] for r in language.identify(odd, ()).collect()} == {"und"}
    assert language.identify(odd.limit(0), refs).count() == 0


def test_letters_of_large_scripts_keep_apart(spark):
    """Three languages whose letters are all rare ones: each is told by which of them it has, not by their number."""
    rng = np.random.default_rng(2)
    scripts = {"aa": [chr(0x4E00 + k) for k in range(700)], "bb": [chr(0x5E00 + k) for k in range(700)], "cc": [chr(0xAC00 + k) for k in range(700)]}
    words = {lang: ["".join(rng.choice(letters, 3)) for _ in range(300)] for lang, letters in scripts.items()}
    rows = [(k, lang, " ".join(rng.choice(words[lang], 60))) for k, lang in enumerate(["aa", "bb", "cc"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    refs = language.learn(docs, F.col("doc_id") < 30)
    p = language.Parser(refs)
    assert p.size <= 256 and p.width > 1 and len(np.unique(p.table)) > 1000
    got = language.identify(docs, refs).where("doc_id >= 30").collect()
    assert all(r["lang_pred"] == r["lang"] for r in got)
