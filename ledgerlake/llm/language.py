"""Language identification by cross-parsing entropy.

For each language, a suffix automaton of labelled text answers how far a text can
be read as a substring of it. A text is cut into longest such phrases; the fewer
phrases, weighted by the logarithm of the reference's length, the lower the
cross-entropy, and the lowest language wins.

Letters are lower-cased and become symbols, all else is a space. Every letter that
a reference has is told from all others: the most frequent have a symbol each, and
further ones (of scripts with many) a few digits each. Letters that no reference
has match nothing. Texts are parsed
whole, in segments of ``SEGMENT`` characters that all advance together: one
table look-up moves every segment of a batch by one character.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped_by_others, map_batches

SEGMENT = 512
#: Letters that have a symbol of their own; rarer ones of the references are written as numbers in ``DIGITS`` further symbols.
LETTERS, DIGITS = 100, 20
#: Bounds of what is learnt for each language: rows, and characters of them.
ROWS_EACH, CHARS_EACH = 80, 40_000
SPACE, OTHER, END = 0, 1, 2


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """OTHER for each letter, SPACE for the rest, by code point."""
    return np.array([OTHER if unicodedata.category(chr(c))[0] == "L" else SPACE for c in range(0x110000)], np.uint8)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


class SuffixAutomaton:
    """All substrings of a sequence of numbers; ``step[state]`` maps a number to the next state."""

    def __init__(self, sequence: list[int]) -> None:
        self.step: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in sequence:
            cur = len(self.step)
            self.step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.step[p]:
                self.step[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.step[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.step)
                    self.step.append(dict(self.step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.step[p].get(c) == q:
                        self.step[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur


class Parser:
    """Automata of several languages as one table: entry = next state + phrases begun anew << 24."""

    def __init__(self, references: tuple[tuple[str, str], ...]) -> None:
        self.languages = [lang for lang, _ in references]
        table = letter_table().copy()
        points = [_points(text) for _, text in references]
        seen, counts = np.unique(np.concatenate([*points, np.empty(0, np.uint32)]), return_counts=True)
        letters = [int(c) for c in seen[np.argsort(-counts, kind="stable")] if table[c] == OTHER]
        table = table.astype(np.int32)
        for k, c in enumerate(letters):
            table[c] = END + 1 + k
        own, rare = min(LETTERS, len(letters)), max(0, len(letters) - LETTERS)
        self.first_rare, self.width = END + 1 + own, 1
        while DIGITS**self.width < rare:
            self.width += 1
        self.table, self.size = table, END + 1 + own + (DIGITS if rare else 0)
        tables, self.roots, self.weight, base = [], [], [], 0
        for p in points:
            codes = self._symbols(p)
            auto = SuffixAutomaton(codes.tolist())
            n, root = len(auto.step), auto.step[0]
            fresh = np.array([base + root[c] + (1 << 24) if c in root else base + (2 << 24) for c in range(self.size)], np.int32)
            fresh[END] = base + (1 << 24)
            t = np.tile(fresh, (n, 1))
            t[0] -= 1 << 24
            for s, step in enumerate(auto.step):
                for c, to in step.items():
                    t[s, c] = base + to
            tables.append(t)
            self.roots.append(base)
            self.weight.append(np.log2(2 + len(codes)))
            base += n
        if base >= 1 << 24:
            raise ValueError("the references are too long")
        self.next = np.concatenate(tables).ravel() if tables else np.empty(0, np.int32)

    def _symbols(self, points: np.ndarray) -> np.ndarray:
        """A text's symbols, one space for a run of them."""
        if not len(points):
            return np.empty(0, np.uint8)
        codes = self.table[points]
        codes = codes[~((codes == SPACE) & (np.r_[OTHER, codes[:-1]] == SPACE))]
        rare = codes >= self.first_rare
        if not rare.any():
            return codes.astype(np.uint8)
        sizes = np.where(rare, self.width, 1)
        out, at = np.repeat(codes, sizes), np.cumsum(sizes) - sizes
        for k in range(self.width):
            out[at[rare] + k] = self.first_rare + (codes[rare] - self.first_rare) // DIGITS**k % DIGITS
        return out.astype(np.uint8)

    def costs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Weighted phrases by text and language, and whether a text has a letter."""
        codes = [self._symbols(_points(t)) if t else np.empty(0, np.uint8) for t in texts]
        letters = np.array([bool((c != SPACE).any()) for c in codes], bool)
        parts = [-(-len(c) // SEGMENT) for c in codes]
        lanes = sum(parts)
        if not lanes or not self.languages:
            return np.zeros((len(texts), len(self.languages))), letters
        grid = np.full((lanes, SEGMENT + 1), END, np.uint8)
        at = 0
        for c, n in zip(codes, parts, strict=True):
            for k in range(n):
                seg = c[k * SEGMENT : (k + 1) * SEGMENT]
                grid[at, : len(seg)] = seg
                at += 1
        fill = (grid != END).sum(1)
        order = np.argsort(-fill, kind="stable")  # full lanes first: the rest drop out as they end
        grid, live = np.ascontiguousarray(grid[order].T), lanes - np.searchsorted(np.sort(fill), np.arange(SEGMENT + 1), side="left")
        state = np.repeat(np.array(self.roots, np.int32)[:, None], lanes, 1)
        phrases = np.zeros(state.shape, np.int32)
        for t in range(SEGMENT + 1):
            n = live[t]
            if not n:
                break
            got = self.next.take(state[:, :n] * self.size + grid[t, :n])
            phrases[:, :n] += got >> 24
            state[:, :n] = got & 0xFFFFFF
        back = np.empty_like(phrases)
        back[:, order] = phrases
        whole = np.add.reduceat(np.concatenate([back, np.zeros((len(back), 1), np.int32)], 1), np.cumsum([0, *parts[:-1]]), axis=1)
        whole[:, np.array(parts) == 0] = 0
        return whole.T * np.array(self.weight), letters


@lru_cache(maxsize=2)
def parser(references: tuple[tuple[str, str], ...]) -> Parser:
    """Built once in each worker process, from the few texts that were learnt."""
    return Parser(references)


dropped_by_others(parser.cache_clear)


def learn(docs: DataFrame, usable: Column, rows_each: int = ROWS_EACH, chars_each: int = CHARS_EACH) -> tuple[tuple[str, str], ...]:
    """``(language, reference)`` from rows with a text and a language for which ``usable`` holds.

    At most ``rows_each`` rows of least hash and ``chars_each`` characters for each
    language; all languages get as many characters where there are enough.
    """
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", F.col("text").cast("string").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.length("text"))
    found: dict[str, list[str]] = {}
    rows = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= rows_each)
    # No more of a text than is used goes to the driver.
    for r in rows.withColumn("text", F.substring("text", 1, chars_each)).orderBy("lang", "k").toLocalIterator():
        own = found.setdefault(r["lang"], [])
        if sum(map(len, own)) < chars_each:
            own.append(r["text"])
    return tuple((lang, "\n".join(texts)[:chars_each]) for lang, texts in sorted(found.items()) if any(map(str.strip, texts)))


def identify(docs: DataFrame, references: tuple[tuple[str, str], ...]) -> DataFrame:
    """Every row of ``docs`` with ``lang_pred`` and ``score``: the runner-up's share of the two best costs, 0.5 to 1.

    ``und`` and 0 for a null text, one without a letter, or if nothing was learnt;
    equal costs go to the first language by name. Own columns of those names are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    keep, kinds = [c for c in docs.columns if c != "text"], dict(docs.dtypes)

    def fn(batches):
        p = parser(references)
        for b in batches:
            costs, letters = p.costs(b["text"])
            lang, score = [], []
            for c, some in zip(costs, letters, strict=True):
                if not some or not len(c):
                    lang.append("und")
                    score.append(0.0)
                    continue
                k, best = int(c.argmin()), float(c.min())
                rest = float(np.delete(c, k).min(initial=np.inf))
                lang.append(p.languages[k])
                score.append(1.0 if rest == np.inf or best + rest == 0 else rest / (best + rest))
            yield {**b, "lang_pred": lang, "score": score}

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string, lang_pred string, score double"
    return map_batches(docs.select(*keep, F.col("text").cast("string").alias("text")), schema, fn).select(*docs.columns, "lang_pred", "score")
