import numpy as np

from ledgerlake.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_like_brute_force_and_recall(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 50)  # several blocks for a cell
    rng = np.random.default_rng(1)
    v = rng.normal(size=(700, 32)).astype(np.float32)
    v[300:400] = v[0] + rng.normal(size=(100, 32)) * 0.08
    v[400:430] = v[1]
    v[430:470] = v[2] * 3
    ids = rng.permutation(700)
    df = spark.createDataFrame([(int(i), x.tolist(), 0) for i, x in zip(ids, v, strict=True)], SCHEMA)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in ed.near_vectors(df).collect()}
    want = ed.brute_force({int(i): x.astype(float) for i, x in zip(ids, v, strict=True)})
    found, there = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert found >= 0.99 * there
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0, 0.0]), (9, []), (2, [2.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    got = sorted(((r["vec_id"] or 0), r["n_links"], r["component_id"]) for r in ed.near_vectors(df).collect())
    assert [g for g in got if g[0]] == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9)]
    assert ed.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_traversal_is_in_order():
    a, b = np.array([0.3, 0.0, 0.1]), np.array([0.2, 0.0])
    cells = list(ed.multi_sequence(a, b, 0.25))
    cost = [a[i] ** 2 + b[j] ** 2 for i, j in cells]
    assert cost == sorted(cost) and set(cells) == {(i, j) for i in range(3) for j in range(2) if a[i] ** 2 + b[j] ** 2 <= 0.0625}


def test_forest_connects():
    rng = np.random.default_rng(2)
    hit = rng.random((20, 30)) < 0.06
    links = ed.forest(hit)
    assert all(hit[r, c] for r, c in links) and len(links) < 50

    def parts(pairs):
        name = {}
        for r, c in pairs:
            x, y = ("r", int(r)), ("c", int(c))
            one, two = name.setdefault(x, {x}), name.setdefault(y, {y})
            if one is not two:
                one |= two
                for z in two:
                    name[z] = one
        return {frozenset(s) for s in name.values()}

    assert parts(links) == parts(np.argwhere(hit))


def test_a_fine_grid_finds_pairs_at_the_threshold(spark):
    """A grid of 24 x 24 cells, and links of cosine 0.95 to 0.96 only: most lie across a cell's border."""
    rng = np.random.default_rng(4)
    base = ed.unit(rng.normal(size=(600, 32)))
    step = ed.unit(rng.normal(size=(600, 32)))
    step = ed.unit(step - (step * base).sum(1, keepdims=True) * base)
    cosine = rng.uniform(0.9505, 0.96, (600, 1))
    v = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * step])
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in ed.near_vectors(df, centroids=24).collect()}
    want = ed.brute_force(dict(enumerate(v)))
    there = sum(n for n, _ in want.values())
    assert there >= 1200 and all(got[i] <= want[i][0] for i in want)
    assert sum(got.values()) >= 0.98 * there


def test_vectors_without_an_id(spark):
    rows = [(1, [1.0, 0.0]), (2**60 + 1, [1.0, 0.001]), (2**60 + 2, [0.0, 1.0]), (None, [1.0, 0.0]), (None, [0.0, 1.0]), (None, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((tuple(r) for r in ed.near_vectors(frame).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (2**60 + 1, 1, 1, False), (2**60 + 2, 0, 2**60 + 2, True), *[(None, 0, None, None)] * 3], key=str)
    assert [tuple(r) for r in ed.near_vectors(frame.where("vec_id is null")).collect()] == [(None, 0, None, None)] * 3
