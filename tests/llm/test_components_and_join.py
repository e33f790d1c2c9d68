import numpy as np
import pytest

from ledgerlake.llm import ngram_join as nj
from ledgerlake.llm.components import connected_components


def plain(texts: dict[int, str | None], k: int, percent: int) -> dict[int, tuple[int, int]]:
    """Shingles as tuples, all pairs, links followed."""
    sets = {}
    for i, t in texts.items():
        w = "".join(c.lower() if c.isascii() else c for c in t or "").replace("\x0b", " ").replace("\x0c", " ")
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
        sets[i] = {tuple(w)} if 0 < len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    name = {i: i for i in texts}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                name[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed: int, n: int) -> dict[int, str | None]:
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [list(rng.choice(vocab, size)) for size in (5, 12, 40, 90, 160, 300)]
    out: dict[int, str | None] = {0: None, 1: "", 2: " \n\t", 3: "One two", 4: "one TWO", 5: "One\ttwo three", 6: "É two", 7: "é two"}
    for i in range(8, n):
        words = list(base[rng.integers(len(base))]) if rng.random() < 0.8 else list(rng.choice(vocab, rng.integers(1, 200)))
        for _ in range(rng.integers(0, 1 + len(words) // 8)):
            words[rng.integers(len(words))] = str(rng.choice(vocab))
        out[i] = " ".join(words)
    return out


@pytest.mark.parametrize("k,percent,seed", [(3, 90, 1), (5, 80, 2), (2, 60, 3), (3, 100, 4)])
def test_join_is_exact(spark, k, percent, seed):
    texts = corpus(seed, 260)
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, component_id string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.near_components(docs, k, percent).collect()}
    assert got == plain(texts, k, percent)


def test_repeated_rows_null_ids_and_nothing(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (3, "other text entirely here")]
    got = nj.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 3)]
    kept = nj.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 1, 1, 3]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert nj.near_components(empty).count() == 0


def test_keys_meet_for_all_linked_sizes():
    rng = np.random.default_rng(0)
    for percent in (80, 90):
        for n in (9, 10, 20, 33, 60, 150, 400, 1500):
            for _ in range(12):
                a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
                cut = int(len(a) * (100 - percent) / 100)
                b = np.sort(a[: len(a) - cut] if rng.random() < 0.5 else np.r_[a[cut // 2 :], rng.integers(0, 1 << 63, cut // 3).astype(np.uint64)])
                if nj.linked(a, b, percent) and len(np.setxor1d(a, b)):
                    few = min(e for x in (a, b) for _, _, e in nj.bands(len(x), percent))
                    same = np.intersect1d(np.concatenate(nj.sketch_keys(a, percent)), np.concatenate(nj.sketch_keys(b, percent))).size
                    assert same >= few > 0
                    assert int(np.bitwise_count((nj.folded(a) ^ nj.folded(b)).view(np.uint64)).sum()) <= len(np.setxor1d(a, b))


def test_near_duplicates_with_repeated_and_null_ids(spark):
    one, two, three = ("the same words of the first text again and again", "quite another text that nobody else has here", "a third text which stands under no number at all")
    rows = [(1, one), (1, one), (2, one), (2, two), (None, one), (None, three), (None, three), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(str, nj.one_of_each_component(df, 3, 90).collect()))
    assert got == sorted(map(str, spark.createDataFrame([(1, one), (2, two), (None, three), (5, None), (6, "")], df.schema).collect()))


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5), (7, 7)]
    name = {}

    def root(i):
        name.setdefault(i, i)
        while name[i] != i:
            i = name[i]
        return i

    for a, b in pairs:
        x, y = root(a), root(b)
        name[max(x, y)] = min(x, y)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame([*pairs, (None, 4)], "a long, b long")).collect()}
    assert got == {i: root(i) for i in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
