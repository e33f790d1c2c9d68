import hashlib
import os
import random
import subprocess
import sys

from ledgerlake.llm import decontaminate as dc

ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "short item"), (10, "short item"), (3, None), (4, " ,; "), (5, "été l'hiver 2024"), (6, "rep rep rep rep rep rep rep rep rep rep rep rep")]
TEXTS = [
    None,
    "",
    "  ",
    "nothing here",
    "x ONE, two-three four;five six seven eight nine ten. eleven y",
    "a short\titem b SHORT ITEM",
    "shortitem short items",
    "Sí: été L'HIVER 2024! Été",
    "rep " * 30,
    "one two three four five six seven eight nine",
    "zero " * 3000 + "two three four five six seven eight nine ten eleven twelve",
]


def test_like_brute_force(spark):
    docs = spark.createDataFrame([(k, t, "old") for k, t in enumerate(TEXTS)] + [(4, TEXTS[4], "old")], "doc_id long, text string, n_hit string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = dc.find_contamination(docs, items).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        n, hit, ids, _ = dc.reference(TEXTS[r["doc_id"]], ITEMS)
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"], r["text"]) == (n, hit, ids, hit > 0, TEXTS[r["doc_id"]])
    spans = next(r["spans"] for r in got if r["doc_id"] == 7)
    assert [TEXTS[7][s["start"] : s["end"]] for s in spans] == ["été L'HIVER 2024"]


def test_several_automata_agree(spark, monkeypatch):
    """With columns of all working names, and items that overlap in a text."""
    overlap = " ".join(f"v{k}" for k in range(16))
    docs = spark.createDataFrame([(k, t, 1, 2, "x", "y", k) for k, t in enumerate([*TEXTS, overlap + " end"])], "doc_id long, text string, hit int, row_id long, __text string, own_0 string, items long")
    items = spark.createDataFrame([*ITEMS, (7, " ".join(overlap.split()[:11])), (8, " ".join(overlap.split()[5:]))], "item_id long, text string")
    one = dc.find_contamination(docs, items)
    assert one.columns == ["doc_id", "text", "hit", "row_id", "__text", "own_0", "n_words", "n_hit", "n_items", "items", "spans", "contaminated"]
    one = one.collect()
    monkeypatch.setattr(dc, "BLOCK_BYTES", 20)
    many = dc.find_contamination(docs, items).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))
    last = next(r for r in many if r["doc_id"] == len(TEXTS))
    assert [(s["start"], s["end"]) for s in last["spans"]] == [(0, len(overlap))] and last["items"] == ["7", "8"]


def test_no_items_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    r = dc.find_contamination(docs, none).withColumn("d", dc.item_digest("items")).first()
    assert (r["n_words"], r["n_hit"], r["contaminated"], r["d"]) == (2, 0, False, hashlib.sha256(b"").hexdigest())
    assert dc.find_contamination(docs.limit(0), none).count() == 0
    assert dc.drop_contaminated(docs, docs.select(docs.doc_id.alias("item_id"), "text")).count() == 0


def test_index_equals_plain_comparison():
    """Few words, so that windows repeat within and across items, and runs are met that are no window."""
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    for window in (1, 2, 3, 4, 5, 10):
        items = tuple((str(k), text(rng.choice((0, 1, window - 1, window, window + 1, 2 * window + 3)))) for k in range(12))
        found = dc.index(tuple((k, t.encode()) for k, t in items), window)
        for doc in [text(rng.randrange(60)) for _ in range(60)] + ["", items[3][1] + " z " + items[5][1]]:
            n, hit, ks = dc.scan(doc.encode(), found, window)
            assert (n, len(hit), sorted(items[k][0] for k in ks)) == dc.reference(doc, list(items), window)[:3]


def test_a_large_benchmark_fits_in_a_worker():
    """Two megabytes of items: their index takes under 62 bytes a byte of text, so one of 8 MB under 500 MB."""
    made = """
import random, resource
from ledgerlake.llm import decontaminate as dc
rng = random.Random(1)
words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9))) for _ in range(100_000)]
items = tuple((str(k), " ".join(rng.choices(words, k=60)).encode()) for k in range(5200))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
found = dc.index(items, 10)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 / sum(len(t) for _, t in items), dc.scan(items[9][1], found, 10)[2])
"""
    ran = subprocess.run([sys.executable, "-c", made], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)})
    size, found = ran.stdout.split(maxsplit=1)
    assert float(size) < 62 and found.strip() == "{9}"
