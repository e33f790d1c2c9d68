"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its hashed words (log counts, scaled to length 1), buckets
of structure statistics, and buckets of numeric metadata columns. The machine
scores ``w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``; the pairs are summed
in linear time as half of ``(sum v x)^2 - sum (v x)^2`` for each factor.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import partial

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped_by_others, map_batches

WORDS, STATS = 1 << 14, 1 << 10
FEATURES = WORDS + STATS
FACTORS = 8
#: Labelled rows that a classifier is fitted on at most, those of least hash.
TRAINING_ROWS = 6_000
MEMO = 400_000
_places: dict[str, int] = {}
dropped_by_others(_places.clear)


def _place(word: str) -> int:
    k = _places.get(word)
    if k is None:
        k = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % WORDS
        if len(_places) < MEMO:
            _places[word] = k
    return k


def _stats(text: str, words: list[str], counts: Counter) -> list[tuple[str, float]]:
    """Structure statistics, each from about 0 to 10."""
    n, w = max(1, len(text)), max(1, len(words))
    raw = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(KIND[np.frombuffer(raw, np.uint8)], minlength=6) if raw else np.zeros(6)
    lines = text.split("\n")
    letters = max(1, int(kinds[1] + kinds[2] + kinds[5]))
    return [
        ("words", np.log2(w) / 1.5),
        ("upper", 10 * kinds[2] / letters),
        ("digit", 20 * kinds[3] / n),
        ("mark", 20 * kinds[4] / n),
        ("space", 20 * kinds[0] / n),
        ("wide", 10 * kinds[5] / max(1, len(raw))),
        ("word length", min(10, sum(map(len, words)) / w)),
        ("distinct", 10 * len(counts) / w),
        ("distinct by size", 10 * np.log2(1 + len(counts)) / np.log2(1 + w)),
        ("top word", 10 * (counts.most_common(1)[0][1] / w if counts else 0)),
        ("lines", np.log2(len(lines))),
        ("line length", np.log2(1 + n / len(lines))),
        ("repeated lines", 10 * (1 - len(set(lines)) / len(lines))),
        ("same again", 10 * sum(a == b for a, b in zip(words, words[1:], strict=False)) / w),
    ]


#: Bytes by kind: 0 white space, 1 a-z, 2 A-Z, 3 digits, 4 other ASCII, 5 the rest.
KIND = np.array([0 if b in b" \t\n\r\x0b\x0c" else 1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b < 128 else 5 for b in range(256)])


def featurise(text: str | None, numbers: dict[str, float | None]) -> tuple[np.ndarray, np.ndarray]:
    """Places and values; a null text is an empty one."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    places = [_place(w) for w in counts]
    values = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    values /= max(1e-6, float(np.sqrt((values**2).sum())))
    more, weight = [], []

    def put(name: str, k: int, v: float) -> None:
        more.append(WORDS + xxhash.xxh3_64_intdigest(f"{name}/{k}".encode()) % STATS)
        weight.append(v)

    stats = _stats(text, words, counts) + [(name, np.log2(1 + max(0.0, float(v))) / 1.7) for name, v in numbers.items() if v is not None and np.isfinite(v)]
    for name, x in stats:  # two neighbouring buckets share the weight, so that a score is smooth in the statistic
        x = min(10.0, max(0.0, float(x)))
        put(name, int(x), 1 - (x - int(x)))
        put(name, int(x) + 1, x - int(x))
    for name, v in numbers.items():
        if v is None or not np.isfinite(v):
            put(name, -1, 1.0)
    return np.array(places + more, np.int32), np.concatenate([values, np.array(weight, np.float32) * np.float32(0.5)])


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray
    metadata: tuple[str, ...] = ()

    def margins(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Every row has features, so each has its own range of the flat arrays."""
        if not rows:
            return np.empty(0)
        starts = np.cumsum([0, *(len(p) for p, _ in rows[:-1])])
        p, x = np.concatenate([p for p, _ in rows]), np.concatenate([x for _, x in rows])
        vx = self.v[p] * x[:, None]
        pairs = np.add.reduceat(vx, starts) ** 2 - np.add.reduceat(vx**2, starts)
        return self.w0 + np.add.reduceat(self.w[p] * x, starts) + 0.5 * pairs.sum(1)

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows), -30, 30)))


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.15, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Logistic loss by Adagrad over small batches; the same rows in the same order give the same machine."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(FEATURES, np.float32), rng.normal(0, 0.02, (FEATURES, FACTORS)).astype(np.float32))
    gw, gv, g0 = np.full(FEATURES, 1e-2, np.float32), np.full((FEATURES, FACTORS), 1e-2, np.float32), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 48):
            pick = order[at : at + 48]
            batch = [rows[k] for k in pick]
            sizes = [len(p) for p, _ in batch]
            starts = np.cumsum([0, *sizes[:-1]])
            p, x = np.concatenate([p for p, _ in batch]), np.concatenate([x for _, x in batch])
            v = m.v[p]
            vx = v * x[:, None]
            total = np.add.reduceat(vx, starts)
            margin = m.w0 + np.add.reduceat(m.w[p] * x, starts) + 0.5 * (total**2 - np.add.reduceat(vx**2, starts)).sum(1)
            err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[pick]) / len(pick)
            e = np.repeat(err, sizes).astype(np.float32)
            places, back = np.unique(p, return_inverse=True)
            dw = np.bincount(back, weights=e * x, minlength=len(places)).astype(np.float32)
            dv_rows = e[:, None] * x[:, None] * (np.repeat(total, sizes, axis=0) - vx)
            dv = np.stack([np.bincount(back, weights=dv_rows[:, f], minlength=len(places)) for f in range(FACTORS)], 1).astype(np.float32)
            dw, dv = dw + decay * m.w[places], dv + decay * m.v[places]
            gw[places] += dw**2
            gv[places] += dv**2
            m.w[places] -= rate * dw / np.sqrt(gw[places])
            m.v[places] -= 0.3 * rate * dv / np.sqrt(gv[places])
            g0 += float(err.sum()) ** 2
            m.w0 -= rate * float(err.sum()) / g0**0.5
    return m


def train(docs: DataFrame, labels: DataFrame, usable: Column, metadata: tuple[str, ...] = (), max_rows: int = TRAINING_ROWS) -> Machine | None:
    """Fit on at most ``max_rows`` rows of ``labels(doc_id, label)`` for which ``usable`` holds; None if there are none.

    Null labels are left out; a doc_id with several labels has the least one.
    """
    ids = labels.where(usable & F.col("label").isNotNull()).groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *[F.col(c).cast("double").alias(c) for c in metadata]).join(F.broadcast(ids), "doc_id")

    def fn(batches):
        for b in batches:
            got = [featurise(t, {c: b[c][k] for c in metadata}) for k, t in enumerate(b["text"])]
            yield {"doc_id": b["doc_id"], "label": b["label"], "places": [p.tobytes() for p, _ in got], "values": [x.tobytes() for _, x in got]}

    found = map_batches(rows, "doc_id long, label int, places binary, values binary", fn).collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"], bytes(r["places"])))
    m = fit_machine([(np.frombuffer(r["places"], np.int32), np.frombuffer(r["values"], np.float32)) for r in found], np.array([r["label"] for r in found], np.float32))
    m.metadata = metadata
    return m


def score(docs: DataFrame, machine: Machine | None, threshold: float = 0.7) -> DataFrame:
    """Every row of ``docs`` with ``score`` from 0 to 1 and ``predicted`` (1 from ``threshold`` on).

    Null and empty texts are scored by their structure. With no machine nothing
    speaks against a text, and the score is 1. Own columns of those names are replaced.
    """
    docs = docs.drop("score", "predicted")
    if machine is None:
        return docs.withColumn("score", F.lit(1.0)).withColumn("predicted", F.lit(1))
    keep = [c for c in docs.columns if c != "text"]
    kinds = dict(docs.dtypes)
    numbers = [F.col(c).cast("double").alias(f"__{c}") for c in machine.metadata]

    def fn(batches, machine):
        for b in batches:
            rows = [featurise(t, {c: b[f"__{c}"][k] for c in machine.metadata}) for k, t in enumerate(b["text"])]
            yield {**b, "score": machine.score(rows).astype(float)}

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string, " + "".join(f"`__{c}` double, " for c in machine.metadata) + "score double"
    out = map_batches(docs.select(*keep, F.col("text").cast("string").alias("text"), *numbers), schema, partial(fn, machine=machine))
    return out.select(*docs.columns, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that no label is learnt from: crc32 of the id's text modulo 4 is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
