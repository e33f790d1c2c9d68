"""Removal of every byte covered by a long string that also starts anywhere else.

Where repeats can be is found by anchors: each window of ``length`` bytes selects
the 40-byte gram of least hash in it (the rightmost of equals). Equal windows
select the same gram at the same offset, so windows are compared only among
occurrences of one gram. The stretch of windows that select an occurrence is its
segment; occurrences with equal segments repeat as a whole, and only distinct
segments of a gram that has several are compared in detail.

That is done column-wise: segments are aligned at their grams, and from right to
left one symbol of every segment is inserted each round. The order of the
suffixes (a positional Burrows-Wheeler order of the collection) and the common
prefixes of neighbours are updated by one stable sort and by range minima, and a
suffix whose prefix is common with a neighbour's for ``length`` bytes repeats.

Blocks of segments have a bounded size, so each round's columns stay in memory. A
gram with more segments than a block holds is settled by counting the hashes of
its windows instead, which Spark combines before it shuffles them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, small, stash

#: A multiple of 8; long enough that a gram seldom recurs outside repeats.
GRAM = 40
#: Segments in one block, about, and at most for one gram.
BLOCK, HOT = 8_000, 30_000
#: Bytes of a text that are looked at together; blocks overlap, so no window is missed.
PART = 1 << 23
MASK = np.uint64(0xFFFFFF)
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    words = np.lib.stride_tricks.as_strided(raw, (len(raw) - 7, 8), (1, 1)).copy().view("<u8").ravel()
    n = len(raw) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for at in range(0, GRAM, 8):
        h = (h + words[at : at + n]) * M1
        h ^= h >> np.uint64(29)
    h *= M2
    return h ^ (h >> np.uint64(32))


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``gram hash, position, first start, last start`` of each selected gram: the windows that select it start there."""
    found = []
    for base in range(0, max(1, len(text) - length + 1), PART):
        raw = np.frombuffer(text, np.uint8)[base : base + PART + length - 1]
        if len(raw) < length:
            continue
        h = _gram_hashes(raw)
        key = (h & ~MASK) | (MASK - np.arange(len(h), dtype=np.uint64))
        width, size = 1, length - GRAM + 1
        while 2 * width <= size:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < size:
            key = np.minimum(key[: len(key) - (size - width)], key[size - width :])
        at = (MASK - (key & MASK)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:] - 1, len(at) - 1]
        found.append((h[at[first]].view(np.int64), at[first] + base, first + base, last + base))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 4


def repeated_starts(groups: np.ndarray, segments: list[bytes], offsets: np.ndarray, length: int) -> np.ndarray:
    """For each segment and start in it, whether the window there also starts in another segment of its group.

    ``offsets``: from a segment's start to its gram. Column ``c`` holds the byte at
    ``c - widest offset`` from the gram.
    """
    sizes = np.array([len(s) for s in segments])
    left = int(offsets.max())
    width = left + int((sizes - offsets).max())
    grid = np.full((width, len(segments)), 256, np.int64)
    starts = left - offsets
    flat = np.frombuffer(b"".join(segments), np.uint8)
    of = np.repeat(np.arange(len(segments)), sizes)
    grid[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[of], of] = flat
    group = np.unique(groups, return_inverse=True)[1].astype(np.int64) * 257
    order = np.argsort(group, kind="stable")
    common = np.zeros(len(order), np.int64)
    out = np.zeros((len(segments), int(sizes.max()) - length + 1), bool)
    for column in range(width - 1, -1, -1):
        key = (group + grid[column])[order]
        move = np.argsort(key, kind="stable")
        key, symbol = key[move], grid[column][order[move]]
        same = np.flatnonzero((key[1:] == key[:-1]) & (symbol[1:] < 256)) + 1
        new = np.zeros_like(common)
        if len(same):
            p, q = move[same - 1] + 1, move[same] + 1
            by = np.argsort(p, kind="stable")
            ends = np.minimum(q[by], len(common))
            pairs = np.stack([p[by], ends], 1).ravel()
            padded = np.append(common, 0)
            new[same[by]] = 1 + np.minimum.reduceat(padded, pairs)[::2]
        order, common = order[move], new
        long = common >= length
        if long.any():
            hit = np.flatnonzero(long)
            docs = np.unique(np.concatenate([order[hit], order[hit - 1]]))
            at = column - starts[docs]
            good = (at >= 0) & (at <= sizes[docs] - length)
            out[docs[good], at[good]] = True
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return [(int(a), int(z) - 1) for a, z in edges.reshape(-1, 2)]


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with the same id and text are copies of one document: one key, but each counts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64("doc_id", text).alias("key"), text.cast("binary").alias("text"))


def repeated_ranges(docs: DataFrame, length: int = 200) -> DataFrame:
    """``key, first, last``: starts of windows of ``length`` bytes that start anywhere else too."""
    texts = docs.where(F.octet_length("text") >= length).select("key", "text")

    def grams(batches):
        for b in batches:
            found = [anchors(t, length)[0] for t in b["text"]]
            yield {"gram": np.concatenate(found) if found else np.empty(0, np.int64)}

    counts = map_batches(texts.select("text"), "gram long", grams).groupBy("gram").agg(F.count("*").alias("n"))
    shared = stash(counts.where("n > 1").select("gram"), "grams")

    def segments(batches):
        for b in batches:
            out = {k: [] for k in ("gram", "seg", "key", "first", "last", "at")}
            for key, t in zip(b["key"], b["text"], strict=True):
                gram, at, first, last = anchors(t, length)
                out["gram"] += gram.tolist()
                out["seg"] += [hashlib.blake2b(t[a : z + length], digest_size=16).digest() for a, z in zip(first.tolist(), last.tolist(), strict=True)]
                out["key"] += [key] * len(gram)
                out["first"] += first.tolist()
                out["last"] += last.tolist()
                out["at"] += at.tolist()
            yield out

    # Equal segments also have their gram at the same offset: it is the least one of the segment's own windows.
    held = map_batches(texts, "gram long, seg binary, key long, first long, last long, at long", segments)
    held = stash(held.join(small(shared, limit=2_000_000), "gram", "left_semi"), "segments")
    kinds = held.groupBy("gram", "seg").agg(F.count("*").alias("n"), F.min(F.struct("key", "first", "last", "at")).alias("one"))
    kinds = stash(kinds, "segment-kinds")
    whole = held.join(kinds.where("n > 1").select("gram", "seg"), ["gram", "seg"], "left_semi").select("key", "first", "last")
    several = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1")
    total = several.agg(F.sum("kinds")).first()[0] or 0
    parts = kinds.join(several, "gram").select("gram", "kinds", "n", F.col("one.key").alias("key"), F.col("one.first").alias("first"), F.col("one.last").alias("last"), F.col("one.at").alias("at"))
    asked = parts.groupBy("key").agg(F.collect_list(F.struct("gram", "kinds", "n", "first", "last", "at")).alias("asked"))

    def cut(batches):
        for b in batches:
            out = {k: [] for k in ("gram", "hot", "n", "key", "first", "offset", "bytes")}
            for key, t, wanted in zip(b["key"], b["text"], b["asked"], strict=True):
                for w in wanted:
                    for k, v in (("gram", w["gram"]), ("hot", w["kinds"] > HOT), ("n", w["n"]), ("key", key), ("first", w["first"]), ("offset", w["at"] - w["first"]), ("bytes", t[w["first"] : w["last"] + length])):
                        out[k].append(v)
            yield out

    pieces = map_batches(texts.join(asked, "key").select("key", "text", "asked"), "gram long, hot boolean, n long, key long, first long, offset long, bytes binary", cut)
    pieces = stash(pieces.dropDuplicates(["gram", "key", "first"]), "pieces")

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        flags = repeated_starts(b["gram"].to_numpy(), b["bytes"].tolist(), b["offset"].to_numpy(), length)
        rows = [(key, first + a, first + z) for key, first, n, f in zip(b["key"], b["first"], b["n"], flags, strict=True) if n == 1 for a, z in _runs(f)]
        return pd.DataFrame(rows, columns=["key", "first", "last"]).astype("int64")

    blocks = F.pmod(F.xxhash64("gram"), F.lit(total // BLOCK + 1))
    cold = pieces.where("not hot").withColumn("block", blocks).groupBy("block").applyInPandas(compare, "key long, first long, last long")

    def windows(batches):
        for b in batches:
            out = {k: [] for k in ("window", "n", "key", "start")}
            for n, key, first, t in zip(b["n"], b["key"], b["first"], b["bytes"], strict=True):
                for a in range(len(t) - length + 1):
                    for k, v in (("window", hashlib.blake2b(t[a : a + length], digest_size=16).digest()), ("n", n), ("key", key), ("start", first + a)):
                        out[k].append(v)
            yield out

    each = map_batches(pieces.where("hot"), "window binary, n long, key long, start long", windows)
    often = each.groupBy("window").agg(F.count("*").alias("c")).where("c > 1").select("window")
    hot = each.where("n = 1").join(often, "window", "left_semi").select("key", F.col("start").alias("first"), F.col("start").alias("last"))
    return whole.unionByName(cold).unionByName(hot)


def drop_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` as ``doc_id, n_bytes, n_removed, n_spans, kept`` (bytes).

    Texts are UTF-8 bytes, null ones empty. A byte goes if a ``length``-byte string
    that covers it also starts anywhere else: in another row, a repeated row, or
    elsewhere in its own; no string crosses rows. Shorter texts stay whole. Other
    columns are not read.
    """
    if length < GRAM + 8:
        raise ValueError(f"length is at least {GRAM + 8}")
    docs = _keyed(docs)
    ranges = stash(repeated_ranges(docs, length), "ranges")
    ranges = ranges.distinct().groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("ranges"))

    def fn(batches):
        for b in batches:
            out = {k: [] for k in ("n_removed", "n_spans", "kept")}
            for t, ranges in zip(b["text"], b["ranges"], strict=True):
                spans: list[list[int]] = []
                for r in ranges or []:
                    if spans and r["first"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r["last"] + length)
                    else:
                        spans.append([r["first"], r["last"] + length])
                cuts = [0, *(x for s in spans for x in s), len(t)]
                out["n_removed"].append(sum(z - a for a, z in spans))
                out["n_spans"].append(len(spans))
                out["kept"].append(b"".join(t[a:z] for a, z in zip(cuts[::2], cuts[1::2], strict=True)))
            yield {"doc_id": b["doc_id"], "n_bytes": [len(t) for t in b["text"]]} | out

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs.join(ranges, "key", "left").select("doc_id", "text", "ranges"), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary", fn)


def brute_force(texts: list[bytes], length: int = 200) -> list[tuple[int, int, bytes]]:
    """``n_removed, n_spans, kept`` of each text, from a count of all its windows; for tests."""
    from collections import Counter

    seen = Counter(t[a : a + length] for t in texts for a in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for a in range(len(t) - length + 1):
            if seen[t[a : a + length]] > 1:
                gone[a : a + length] = b"\1" * length
        out.append((sum(gone), sum(1 for k, x in enumerate(gone) if x and (not k or not gone[k - 1])), bytes(x for x, g in zip(t, gone, strict=True) if not g)))
    return out
