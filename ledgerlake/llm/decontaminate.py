"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Texts become ASCII-lower-cased words, and those of the benchmark numbers. The
automaton holds, of every item, runs of words that lie so close that each window of
``window`` words holds one whole: a few nodes a word, however long windows are. A
document is scanned once; around each run that it has, its windows are looked up among
the items' by hash and compared word by word. Hits are mapped back to words and
to offsets in the original text.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Own, dropped_by_others, map_batches

#: Bytes: A-Z to a-z, 0-9 and a-z and all of non-ASCII stay, the rest becomes a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Bytes of item texts in one automaton, which take some 40 times as much memory; a larger benchmark is scanned for in several passes.
BLOCK_BYTES = 8_000_000


@dataclass
class Index:
    """The windows of a benchmark's items, and the automaton that finds where a text may have one."""

    #: Each word as two characters, of two alphabets: a node of the automaton has few children however many words there are.
    codes: dict[bytes, str]
    #: Runs of words' codes; each match tells how many characters it has.
    runs: ahocorasick.Automaton
    #: Words between the starts of two runs of an item.
    stride: int
    #: The items' words one after the other, and for each size of windows their sorted hashes, where they start, and their items.
    words: np.ndarray
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _hashes(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of word numbers."""
    h = np.full(len(rows), 0x9E3779B97F4A7C15, np.uint64)
    for column in rows.T:
        h = (h ^ column.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def _numbers(codes: str) -> np.ndarray:
    """Words' codes as numbers."""
    pairs = np.frombuffer(codes.encode("utf-32-le"), "<u4").reshape(-1, 2)
    return (pairs[:, 0] << np.uint32(16)) | pairs[:, 1]


@lru_cache(maxsize=2)
def index(items: tuple[tuple[int, bytes], ...], window: int) -> Index:
    split = [text.translate(NORMAL).split() for _, text in items]
    number = {w: k for k, w in enumerate(dict.fromkeys(w for words in split for w in words))}
    base = math.isqrt(len(number)) + 1
    # From 1 and from 0x1000 on; a word that no item has is two zeros.
    codes = {w: chr(1 + k // base) + chr(0x1000 + k % base) for w, k in number.items()}
    parts = ["".join(map(codes.__getitem__, words)) for words in split]
    starts = np.concatenate([[0], np.cumsum([len(p) // 2 for p in parts])]).tolist()
    words = _numbers("".join(parts))
    stride = max(1, window // 2)
    length = window - stride + 1
    runs = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    at: dict[int, list[tuple[int, int]]] = {}
    for k, part in enumerate(parts):
        n = len(part) // 2
        if n >= window:
            for i in range(0, n - length + 1, stride):
                runs.add_word(part[2 * i : 2 * (i + length)])
        elif n:
            runs.add_word(part)
        if n:
            at.setdefault(min(n, window), []).append((k, n))
    if len(runs):
        runs.make_automaton()
    windows = {}
    for size, owners in at.items():
        where = np.concatenate([np.arange(starts[k], starts[k] + n - size + 1) for k, n in owners])
        owner = np.repeat([k for k, _ in owners], [n - size + 1 for _, n in owners])
        h = _hashes(words[where[:, None] + np.arange(size)])
        order = np.lexsort((owner, h))
        h, where, owner = h[order], where[order].astype(np.int64), owner[order].astype(np.int32)
        # An item's equal windows are one.
        same = np.zeros(len(h), bool)
        near = np.flatnonzero((h[1:] == h[:-1]) & (owner[1:] == owner[:-1]))
        reach = np.arange(size)
        same[near + 1] = (words[where[near + 1, None] + reach] == words[where[near, None] + reach]).all(1)
        windows[size] = (h[~same], where[~same], owner[~same])
    return Index(codes, runs, stride, words, windows)


dropped_by_others(index.cache_clear)


def scan(text: bytes, found: Index, window: int) -> tuple[int, list[int], set[int]]:
    """Words of a text, the hit ones' numbers, and the items with an occurring window."""
    plain = text.translate(NORMAL).split()
    codes = "".join(map(found.codes.get, plain, repeat("\0\0"))) if len(found.runs) else ""
    starts: dict[int, set[int]] = {}
    longest = window - found.stride + 1
    for end, size in found.runs.iter(codes) if codes else ():
        length, first = size // 2, (end + 1 - size) // 2
        if window in found.windows and length == longest:
            starts.setdefault(window, set()).update(range(max(0, first - found.stride + 1), min(first, len(plain) - window) + 1))
        if length in found.windows:
            starts.setdefault(length, set()).add(first)
    if not starts:
        return len(plain), [], set()
    own, hit, items = _numbers(codes), set(), set()
    for size, places in starts.items():
        at = np.array(sorted(places), np.int64)
        rows = own[at[:, None] + np.arange(size)]
        h = _hashes(rows)
        hashes, where, owner = found.windows[size]
        low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        for k in np.flatnonzero(high > low):
            same = (found.words[where[low[k] : high[k], None] + np.arange(size)] == rows[k]).all(1)
            if same.any():
                hit.update(range(at[k], at[k] + size))
                items.update(owner[low[k] : high[k]][same].tolist())
    return len(plain), sorted(map(int, hit)), items


def spans(text: bytes, hit: list[int]) -> list[dict[str, int]]:
    """Maximal runs of hit words as character offsets in the original text."""
    places, out = [m.span() for m in WORD.finditer(text)], []
    for k in hit:
        a, b = places[k]
        if out and out[-1][2] == k - 1:
            out[-1][1:] = [b, k]
        else:
            out.append([a, b, k])
    # Characters before each byte: those that begin there or earlier.
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(before[a]), "end": int(before[b])} for a, b, _ in out]


def blocks(benchmark: DataFrame) -> list[tuple[tuple[str, bytes], ...]]:
    """The benchmark's items in blocks of at most ``BLOCK_BYTES`` (or one item)."""
    out, size = [[]], 0
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    for r in rows.distinct().orderBy("item_id", "text").toLocalIterator():
        if out[-1] and size + len(r["text"]) > BLOCK_BYTES:
            out.append([])
            size = 0
        size += len(r["text"])
        out[-1].append((r["item_id"], bytes(r["text"])))
    return [tuple(x) for x in out]


FOUND = "n_words long, hit array<int>, items array<string>, spans array<struct<start:int,end:int>>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Every row of ``docs`` with ``n_words, n_hit, n_items, items, spans, contaminated``; its own columns stay.

    Null and empty texts have no words and no hits; very long ones are scanned whole;
    null item texts are no items; items of fewer than ``window`` words are one window;
    repeated rows and ids are judged row by row. An item id that occurs twice is one
    item. ``docs`` columns named like results are replaced. The benchmark goes to
    every task: it is taken to be of a size that one machine reads.
    """
    own = Own(docs.drop("n_words", "n_hit", "n_items", "items", "spans", "contaminated"), "text")
    rows = own.df.withColumn("text", F.col("text").cast("binary"))
    given = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes)
    parts = blocks(benchmark)

    def run(items: tuple[tuple[str, bytes], ...], last: bool):
        def fn(batches):
            found = index(items, window)
            for b in batches:
                none = [()] * len(b["text"])
                out = {"n_words": [], "hit": [], "items": [], "spans": []}
                for text, hits, names in zip(b["text"], b.get("hit", none), b.get("items", none), strict=True):
                    n, hit, ks = scan(text or b"", found, window)
                    hit = sorted({*hits, *hit}) if hits else hit
                    out["n_words"].append(n)
                    out["hit"].append(hit)
                    out["items"].append(sorted({*names, *(items[k][0] for k in ks)}))
                    out["spans"].append(spans(text or b"", hit) if hit and last else [])
                yield b | out

        return fn

    # One automaton but for a very large benchmark: then a chain of passes, each adding to what a row has; no shuffle.
    for k, part in enumerate(parts):
        rows = map_batches(rows, f"{given}, {FOUND}", run(part, k == len(parts) - 1))
    counted = [F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans", (F.size("hit") > 0).alias("contaminated")]
    return own.back(rows.withColumn("text", F.col("text").cast("string")), "n_words", *counted)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with their own columns."""
    return find_contamination(docs, benchmark, window).where(~F.col("contaminated")).select(*docs.columns)


def item_digest(items) -> F.Column:
    """Lowercase hex SHA-256 of item ids in string order, comma-joined."""
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)


def reference(text: str | None, items: list[tuple[object, str | None]], window: int = 10) -> tuple[int, int, list[str], str]:
    """The same by plain comparison of word lists; for tests."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    doc, hit, seen = words(text), set(), set()
    for item, t in items:
        w = words(t)
        for at in range(max(1, len(w) - window + 1) if w else 0):
            part = w[at : at + window]
            for k in range(len(doc) - len(part) + 1):
                if doc[k : k + len(part)] == part:
                    hit.update(range(k, k + len(part)))
                    seen.add(str(item))
    ids = sorted(seen)
    return len(doc), len(hit), ids, hashlib.sha256(",".join(ids).encode()).hexdigest()
