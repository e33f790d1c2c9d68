"""Best-two-fit packing of token pieces into sequences of fixed capacity.

Pieces of one length are interchangeable, so packing is decided on the number
of pieces of each length: a table with at most ``capacity`` rows, whatever the
corpus. Its result, kinds of bins and how often each is used, is joined back to
the pieces by their rank among those of their length.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Own, map_batches, stash
from .tokens import encoder

#: Pieces that one task ranks at a time, about.
RANKED = 50_000


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """``(times, lengths)`` for each kind of bin.

    Bins open with the largest piece left and are filled greedily with the
    largest that fits. Then, as long as it makes the bin fuller, its smallest
    piece gives way to two unpacked ones whose sum is nearer to the expanded gap.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    lengths, kinds = np.arange(capacity + 1), []
    while left.any():
        free, gap, bin_ = left.copy(), capacity, []
        while gap:
            fit = np.flatnonzero(free[1 : gap + 1])
            if not len(fit):
                break
            size = int(fit[-1]) + 1
            free[size] -= 1
            gap -= size
            bin_.append(size)
        while gap and len(bin_) > 1:
            small, room = bin_[-1], gap + bin_[-1]
            below = np.maximum.accumulate(np.where(free > 0, lengths, 0))
            a = np.flatnonzero(free[1 : room + 1]) + 1
            if not len(a):
                break
            b = below[np.minimum(a, room - a)]
            twice = (b == a) & (free[a] < 2)
            b[twice] = below[a[twice] - 1]
            total = np.where(b > 0, a + b, 0)
            k = int(total.argmax())
            if total[k] <= small:
                break
            bin_[-1:] = [int(a[k]), int(b[k])]
            free[small] += 1
            free[a[k]] -= 1
            free[b[k]] -= 1
            gap = room - int(total[k])
            bin_.sort(reverse=True)
        size, need = np.unique(bin_, return_counts=True)
        times = int((left[size] // need).min())
        left[size] -= times * need
        kinds.append((times, bin_))
    return kinds


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids``: a document's ids and end id, cut only if longer than ``capacity``.

    The first piece takes what is over, the rest are full. Null texts are the
    end id alone; each row is a document of its own.
    """
    end = np.array([end_id], "<u4").tobytes()

    def fn(batches):
        enc = encoder(vocabulary)
        for b in batches:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc_id, raw in zip(b["doc_id"], enc.encode_many(b["text"]), strict=True):
                raw += end
                n = len(raw) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for name, v in (("doc_id", doc_id), ("piece", k), ("start", a), ("length", z - a), ("ids_crc32", zlib.crc32(raw[4 * a : 4 * z])), ("ids", raw[4 * a : 4 * z])):
                        out[name].append(v)
            yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary", fn)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; needs ``doc_id, piece, start, length`` with lengths from 1 to ``capacity``.

    No pieces: no rows. Repeated rows are pieces of their own. ``pieces`` is read
    several times: give a stashed table. Columns named like results are replaced.
    """
    spark = pieces.sparkSession
    given = Own(pieces.drop("sequence_id", "offset"), "doc_id", "piece", "start", "length", "ids_crc32")
    pieces = given.df
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, taken, first = [], dict.fromkeys(counts, 0), 0
    for times, bin_ in best_two_fit(counts, capacity):
        at = 0
        for size in sorted(set(bin_), reverse=True):
            m = bin_.count(size)
            slots.append((size, taken[size], taken[size] + times * m, m, first, at))
            taken[size] += times * m
            at += m * size
        first += times
    places = spark.createDataFrame(slots, "length long, lo long, hi long, m long, first long, at long")
    n = sum(counts.values()) // RANKED + 1
    own = [F.col(c) for c in ("doc_id", "piece", "start") if c in pieces.columns]
    dealt = pieces.withColumn("__b", F.pmod(F.xxhash64(*own), F.lit(n)))
    before = dealt.groupBy("length", "__b").agg(F.count("*").alias("n"))
    before = before.select("length", "__b", (F.sum("n").over(Window.partitionBy("length").orderBy("__b")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "__b").orderBy(*own, *[F.col(c) for c in ("ids_crc32",) if c in pieces.columns])
    ranked = dealt.withColumn("__k", F.row_number().over(order)).join(before, ["length", "__b"]).withColumn("__k", F.col("__k") - 1 + F.col("before"))
    # At most a few rows for each length and kind of bin: bounded by the capacity, not by the corpus.
    got = ranked.join(F.broadcast(places), "length").where("__k >= lo and __k < hi")
    return given.back(got, (F.col("first") + F.floor((F.col("__k") - F.col("lo")) / F.col("m"))).cast("long").alias("sequence_id"), (F.col("at") + F.pmod(F.col("__k") - F.col("lo"), F.col("m")) * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Cut, then pack; the pieces are stashed, so that texts are encoded once."""
    pieces = token_pieces(docs, vocabulary, capacity, end_id)
    return pack(stash(pieces if with_ids else pieces.drop("ids"), "pieces"), capacity)
