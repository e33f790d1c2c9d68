"""Near-duplicate embeddings through an inverted multi-index.

Vectors are scaled to length 1 and halved; each half has its own codebook, and a
pair of centroids names a cell of the product grid. A query visits cells in
ascending order of how far it would have to move to get there (multi-sequence
traversal of the two sorted lists), until the cells left could hold linked
vectors only beyond the target recall. Visited cells are joined with their
members, in blocks of bounded size, and every candidate is verified by the
cosine in double precision.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stash
from .components import connected_components

#: Vectors that the codebooks are fitted on at most, those of least hash.
TRAINING_ROWS = 16_384
#: Centroids of one half at most; they grow with the square root of the vectors, so that a cell's members stay few.
CENTROIDS = 1_024
#: Members, and queries, of one block.
BLOCK = 1_024


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def fit_codebook(points: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k-means; empty clusters keep their centroid."""
    rng = np.random.default_rng(seed)
    centers = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        nearest = ((centers**2).sum(1) - 2 * points @ centers.T).argmin(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, points)
        n = np.bincount(nearest, minlength=len(centers))
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def distances(half: np.ndarray, centers: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """How far each row would have to move to be nearest to each centroid: 0 for its own."""
    d2 = (half**2).sum(1)[:, None] - 2 * half @ centers.T + (centers**2).sum(1)
    own = d2.argmin(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        moved = (d2 - d2[np.arange(len(d2)), own][:, None]) / (2 * gaps[own])
    moved[np.arange(len(d2)), own] = 0
    return np.maximum(moved, 0)


def multi_sequence(first: np.ndarray, second: np.ndarray, reach: float) -> Iterator[tuple[int, int]]:
    """Cells by ascending ``first[i]**2 + second[j]**2``, as far as ``reach**2``."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = (first[a] ** 2).tolist(), (second[b] ** 2).tolist()
    heap, pushed = [(x[0] + y[0], 0, 0)], {(0, 0)}
    while heap:
        d, i, j = heapq.heappop(heap)
        if d > reach**2:
            return
        yield int(a[i]), int(b[j])
        for p in ((i + 1, j), (i, j + 1)):
            if p[0] < len(x) and p[1] < len(y) and p not in pushed:
                pushed.add(p)
                heapq.heappush(heap, (x[p[0]] + y[p[1]], *p))


def reach_for(recall: float, cosine: float, dimension: int) -> float:
    """The distance in a cell boundary's direction that linked vectors keep within, at the target recall.

    Vectors that link are at most ``sqrt(2 - 2 cosine)`` apart; of a difference in
    no special direction, one coordinate has a share with standard deviation
    ``1 / sqrt(dimension)``.
    """
    return NormalDist().inv_cdf((1 + recall) / 2) * math.sqrt((2 - 2 * cosine) / dimension)


def forest(hit: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what a block's links connect: (row, column) pairs, fewer than rows and columns together."""
    n, m = hit.shape
    out, rows, columns = [], np.zeros(n, bool), np.zeros(m, bool)
    for r in np.flatnonzero(hit.any(1)):
        if rows[r]:
            continue
        rows[r], queue = True, [int(r)]
        while queue:
            q = queue.pop()
            for c in np.flatnonzero(hit[q] & ~columns):
                columns[c] = True
                out.append((q, int(c)))
                for p in np.flatnonzero(hit[:, c] & ~rows):
                    rows[p] = True
                    out.append((int(p), int(c)))
                    queue.append(int(p))
    return out


def _clean(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector, good``, a row for each id."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = v.groupBy("vec_id").agg(F.min("v").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists("v", lambda x: x != 0)
    return rows.withColumn("good", F.coalesce(~bad & ~zero, F.lit(False)))


def near_vectors(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.995, training_rows: int = TRAINING_ROWS, centroids: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for ``vectors(vec_id, embedding)``.

    A row for each vec_id (of rows that repeat one, the least vector counts).
    Vectors that are null, empty, zero or hold null or non-finite components, and
    those whose length is not the table's most common one, link with nothing. Rows
    without a vec_id link with nothing, and each is returned, with no component.
    Equal vectors link with each other and are compared with others once.
    ``n_links`` counts vectors, not classes of equal ones. Other columns are not read.
    ``centroids`` of a half: by the number of vectors unless given.
    """
    rows = stash(_clean(vectors.where("vec_id is not null")), "vectors")
    nameless = vectors.where("vec_id is null").select(F.lit(None).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(None).cast("boolean").alias("kept"))
    spark = rows.sparkSession
    good = rows.where("good")
    size = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    alone = ["vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")]
    if size is None:
        return rows.select(*alone).unionByName(nameless)
    good, d = good.where(F.size("v") == size["d"]), size["d"]
    # Components are sent to the blocks as they are stored; cosines are of doubles.
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    classes = stash(good.groupBy("v").agg(F.min("vec_id").alias("root"), F.count("*").alias("copies")), "vector-classes")
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("root"), "root").limit(training_rows).select("root", "v").collect()
    points = unit(np.array([r["v"] for r in sorted(sample, key=lambda r: r["root"])]))
    half = max(1, d // 2)
    k = centroids or int(min(CENTROIDS, max(1, math.isqrt(n) // 8)))
    books = [fit_codebook(points[:, :half], k), fit_codebook(points[:, half:], k if d > 1 else 1)]
    gaps = [np.sqrt(np.maximum(((b[:, None] - b[None]) ** 2).sum(2), 1e-18)) for b in books]
    reach, width = reach_for(recall, cosine, d), len(books[1])

    def cells(batches):
        for b in batches:
            if not len(b):
                continue
            v = unit(np.array(b["v"].tolist()))
            x, y = distances(v[:, :half], books[0], gaps[0]), distances(v[:, half:], books[1], gaps[1])
            own = x.argmin(1) * width + y.argmin(1)
            visits = [[i * width + j for i, j in multi_sequence(p, q, reach)] for p, q in zip(x, y, strict=True)]
            yield pd.DataFrame({"vec_id": b["root"], "copies": b["copies"], "v": [np.asarray(r, kind).tobytes() for r in b["v"]], "cell": own.astype(np.int32), "visits": visits})

    placed = stash(classes.repartition(spark.sparkContext.defaultParallelism * 4, "root").mapInPandas(cells, "vec_id long, copies long, v binary, cell int, visits array<int>"), "cells")
    # One row for each cell of the grid at most: bounded by CENTROIDS squared.
    blocks = small(stash(placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "cell-blocks"))
    members = placed.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), "vec_id", "copies", "v")
    visits = placed.select("vec_id", "v", F.explode("visits").alias("cell")).join(blocks, "cell")
    asked = visits.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    asked = visits.join(small(stash(asked, "cell-parts")), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", "v")
    parts = asked.select("cell", "block", "part").distinct()
    # New names, as both sides of the cogroup come from one table.
    members = members.join(parts, ["cell", "block"]).toDF("m_cell", "m_block", "vec_id", "copies", "v", "m_part")

    def verify(m: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        kinds = {"vec_id": "int64", "n": "int64", "other": "int64"}
        if not len(m) or not len(q):
            return pd.DataFrame({c: [] for c in kinds}).astype(kinds)
        a, b = (unit(np.frombuffer(b"".join(x["v"]), kind).astype(float).reshape(len(x), d)) for x in (q, m))
        ids, others = q["vec_id"].to_numpy(), m["vec_id"].to_numpy()
        hit = (a @ b.T >= cosine) & (ids[:, None] != others[None])
        n = hit @ m["copies"].to_numpy()
        some = np.flatnonzero(n)
        links = forest(hit)
        counts = pd.DataFrame({"vec_id": ids[some], "n": n[some], "other": ids[some]})
        return pd.concat([counts, pd.DataFrame({"vec_id": ids[[r for r, _ in links]], "n": 0, "other": others[[c for _, c in links]]})]).astype(kinds)

    key = ["cell", "block", "part"]
    found = members.groupBy("m_cell", "m_block", "m_part").cogroup(asked.groupBy(*key)).applyInPandas(verify, "vec_id long, n long, other long")
    found = stash(found, "vector-links")
    comps = connected_components(found.where("n = 0").select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    counts = found.where("n > 0").groupBy(F.col("vec_id").alias("root")).agg(F.sum("n").alias("n"))
    whole = stash(classes.select("root", "v", "copies").join(counts, "root", "left").join(comps.withColumnRenamed("id", "root"), "root", "left"), "vector-components")
    # root and component are the smallest ids of their class and of its component's classes.
    of = good.select("vec_id", "v").join(whole, "v").select("vec_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "root").alias("component_id"))
    of = of.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    rest = rows.where(~F.col("good") | (F.size("v") != d)).select(*alone)
    return of.unionByName(rest).unionByName(nameless)


def brute_force(vectors: dict[int, np.ndarray], cosine: float = 0.95) -> dict[int, tuple[int, int]]:
    """``{vec_id: (n_links, component_id)}`` from all pairs; for tests and for measuring recall."""
    ids = sorted(vectors)
    v = unit(np.array([vectors[i] for i in ids]))
    hit = v @ v.T >= cosine
    np.fill_diagonal(hit, False)
    name = {i: i for i in range(len(ids))}
    for i in range(len(ids)):
        if name[i] != i:
            continue
        queue = [i]
        while queue:
            for j in np.flatnonzero(hit[queue.pop()]):
                if name[j] == j and j > i:
                    name[j] = i
                    queue.append(j)
    return {ids[i]: (int(hit[i].sum()), ids[name[i]]) for i in range(len(ids))}
