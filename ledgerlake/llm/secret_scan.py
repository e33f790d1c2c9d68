"""Secrets in texts: fixed patterns, and strings that what surrounds them doesn't explain.

A candidate is a long run of key-like characters that comes right after a sensitive
word. Its novelty is the number of bytes that it adds to its surroundings when both
are compressed with zstandard, primed with a dictionary of the identifiers that are
most frequent in the whole corpus: a name, a path or a repeated placeholder is mostly
matches and adds little, a key adds as many bytes as it has. Candidates that add a
share of ``share`` of their own bytes or more are reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Own, map_batches

KINDS = ("assign", "access", "hex", "novel")
#: The base kinds' patterns and what a match must have (fixed values).
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18}
#: Words after which a secret may follow, in either case.
SENSITIVE = re.compile(
    r"(?i)password|passwd|passphrase|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|client[ _-]?key|bearer|credentials?|authorization|signature|session[ _-]?id|connection[ _-]?string",
    re.ASCII,
)
#: A text in lower case without any of these has no sensitive word.
HINTS = ("pass", "pwd", "secret", "token", "key", "bearer", "credential", "authorization", "signature", "session", "connection")
RUN = r"A-Za-z0-9+/_.~-"
CANDIDATE = re.compile(rf"(?<![{RUN}])[{RUN}]{{12,}}={{0,2}}")
#: Code points between a sensitive word and the start of its candidate, and on either side of a candidate that count as its surroundings.
GAP, AROUND = 24, 256
LEVEL = 3
#: Identifiers of the dictionary: their pattern, and how many and how many bytes there are at most.
IDENTIFIER = r"[A-Za-z_]{4,24}"
IDENTIFIERS, DICTIONARY_BYTES = 4096, 32_768
SPAN = "array<struct<start:int,end:int,kind:string,value:string>>"


def learn_dictionary(docs: DataFrame, identifiers: int = IDENTIFIERS, size: int = DICTIONARY_BYTES) -> bytes:
    """The corpus's most frequent identifiers, the most frequent last; every occurrence in ``docs(text)`` is counted.

    Of those that come equally often, the first in byte order. At most ``identifiers``
    of them and ``size`` bytes go through the driver.
    """
    found = docs.select(F.explode(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))).alias("word"))
    top = found.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(identifiers)
    words, left = [], size
    for r in top.collect():
        left -= len(r["word"]) + 1
        if left < 0:
            break
        words.append(r["word"])
    return " ".join(reversed(words)).encode()


@lru_cache(maxsize=2)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    primed = None
    if len(dictionary) >= 8:
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)


def added_bytes(before: str, candidate: str, after: str, dictionary: bytes) -> int:
    """Compressed bytes of a candidate within its surroundings, less those of the surroundings alone."""
    size = lambda text: len(_compressor(dictionary).compress(text.encode("utf-8", "surrogatepass")))
    return size(before + candidate + after) - size(before + after)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, rank of the kind, end)`` of the base patterns, in order."""
    found = []
    if ":" in text or "=" in text:
        lower = text.lower()
        if any(w in lower for w in ("passw", "secret", "token", "api")):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """The first key-like run after each sensitive word, if it starts soon, and has letters and digits or letters of both cases within."""
    lower = text.lower()
    if not any(w in lower for w in HINTS):
        return []
    found = {}
    for word in SENSITIVE.finditer(text):
        seen = CANDIDATE.search(text, word.end(), word.end() + GAP + 12)
        run = seen and CANDIDATE.match(text, seen.start())
        if run and run.start() not in found:
            end = run.start() + len(run[0].rstrip("."))
            value = text[run.start() : end]
            mixed = re.search("[a-z]", value) and re.search("(?<=.)[A-Z]", value)
            if re.search("[A-Za-z]", value) and (re.search("[0-9]", value) or mixed):
                found[run.start()] = end
    return list(found.items())


def novel_spans(text: str, base: list[tuple[int, int, int]], dictionary: bytes, share: float) -> list[tuple[int, int, int]]:
    """Candidates apart from ``base`` that add ``share`` of their bytes or more."""
    out = []
    for start, end in candidates(text):
        if any(a < end and start < z for a, _, z in base):
            continue
        value = text[start:end]
        if added_bytes(text[max(0, start - AROUND) : start], value, text[end : end + AROUND], dictionary) >= share * len(value):
            out.append((start, len(KINDS) - 1, end))
    return out


def find_secrets(docs: DataFrame, dictionary: bytes, share: float = 0.8) -> DataFrame:
    """Every row of ``docs(text, ...)`` with ``spans``, by start, then kind as in ``KINDS``; its own columns stay.

    Positions are code points, ends exclusive. ``novel`` spans don't overlap others.
    Null and empty texts have none; a text is scanned whole, in time linear in its
    length, but for the surroundings of a candidate, which are a fixed number of code
    points. Rows that repeat get the same spans. A column named ``spans`` is replaced.
    """
    given = Own(docs.drop("spans"), "text")

    def scan(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            spans = []
            for text in b["text"]:
                base = base_spans(text) if text else []
                every = sorted(base + novel_spans(text, base, dictionary, share)) if text else []
                spans.append([{"start": a, "end": z, "kind": KINDS[k], "value": text[a:z]} for a, k, z in every])
            yield b | {"spans": spans}

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.df.schema)
    return given.back(map_batches(given.df, f"{kinds}, spans {SPAN}", scan), "spans")


def span_text(spans: Column | str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def of_kind(spans: Column | str, *kinds: str) -> Column:
    return F.filter(spans, lambda x: x["kind"].isin(*kinds))


def redact(found: DataFrame) -> DataFrame:
    """``found`` with each reported string in its text replaced by ``[KIND]``; of spans that overlap, the later ones' rest goes too."""
    def add(acc: Column, x: Column) -> Column:
        gap = F.substring("text", acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        mark = F.when(x["start"] < acc["at"], "").otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.struct(F.greatest(x["end"], acc["at"]).alias("at"), F.concat(acc["out"], gap, mark).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.char_length("text")))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return found.withColumn("text", F.when(F.size("spans") > 0, F.aggregate("spans", begin, add, rest)).otherwise(F.col("text")))
