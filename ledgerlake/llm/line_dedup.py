"""Line deduplication by a log-template tree.

A line's variable fields (numbers, hex ids, addresses) are masked; it then goes to
the leaf of a tree of fixed depth that its token count and leading tokens name.
In a leaf, a token that few documents have at its position is a variable field
too: the line's template has a wildcard there, if enough of its tokens stay.
Templates that recur in enough documents are dropped from all of them but the
first (the smallest doc_id). So are single lines, and a long line as it stands,
fields and all, from its second document on. Lines too short for a template
count as they stand; every line that isn't blank is in.

Leaves, positions and templates are counted by Spark with combined counts, so a
leaf or a line that a third of all documents share costs no single task more.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Own, map_batches, small, stash, unstash

#: A token with one of these is variable wherever it stands.
FIELD = re.compile(r"[\d@]|://")
#: Lines of fewer tokens have no template: they are counted unmasked, as they stand.
LEAST_TOKENS = 3
#: Lines of as many tokens are long: one that recurs word for word is no chance.
LONG_TOKENS = 10
#: Letters of scripts without spaces (Chinese, Japanese, Thai, Lao, Khmer, Burmese); two count as a token.
UNSPACED = re.compile("[\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
DEPTH = 3
WILD = "<*>"


def masked(line: str) -> list[str]:
    return [WILD if FIELD.search(t) else t for t in line.split()] if FIELD.search(line) else line.split()


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def hashed(tokens: list[str]) -> int:
    return _signed(xxhash.xxh3_64_intdigest(" ".join(tokens).encode("utf-8", "surrogatepass")))


def leaf_of(tokens: list[str], depth: int = DEPTH) -> int:
    return hashed([str(len(tokens)), *tokens[:depth]])


def is_long(line: str, tokens: list[str]) -> bool:
    return len(tokens) >= LONG_TOKENS or (not line.isascii() and len(tokens) + len(UNSPACED.findall(line)) // 2 >= LONG_TOKENS)


def lines_of(text: str | None) -> list[tuple[int, list[str], list[str] | None]]:
    """Numbers and masked tokens of the lines that aren't blank, and the exact tokens of long ones."""
    out = []
    for k, line in enumerate((text or "").split("\n")):
        exact = line.split()
        if exact:
            out.append((k, masked(line) if len(exact) >= LEAST_TOKENS else exact, exact if is_long(line, exact) else None))
    return out


def keys_of(tokens: list[str], exact: list[str] | None) -> dict[int, tuple[int | None, bool]]:
    """The keys (hashes) that a line is counted under, with leaf and whether it is an exact long line.

    A long line with variable fields has two: masked, and as it stands (without a leaf).
    """
    if len(tokens) < LEAST_TOKENS:
        return {hashed(tokens): (None, exact is not None)}
    whole = exact is not None and WILD not in tokens
    keys: dict[int, tuple[int | None, bool]] = {hashed(tokens): (leaf_of(tokens), whole)}
    if exact is not None and not whole:
        # No token holds a newline, so no masked line has this key.
        keys[hashed(["\n", *exact])] = (None, True)
    return keys


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, line, long``: the distinct keys of a document's lines."""

    def fn(batches):
        for b in batches:
            out = {"doc_id": [], "leaf": [], "line": [], "long": []}
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                own = {key: x for _, *line in lines_of(text) for key, x in keys_of(*line).items()}
                out["doc_id"] += [doc_id] * len(own)
                out["leaf"] += [leaf for leaf, _ in own.values()]
                out["line"] += own
                out["long"] += [long for _, long in own.values()]
            yield out

    return map_batches(docs, "doc_id long, leaf long, line long, long boolean", fn)


def recurring_lines(docs: DataFrame, min_docs: int = 5, similarity: float = 0.6, long_docs: int = 2) -> tuple[DataFrame, DataFrame]:
    """``line, first``: keys that recur, themselves or their template, in ``min_docs`` documents (exact long lines: ``long_docs``), and the first of these; and all ``doc_id, leaf, line, long``."""
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = stash(_lines(docs), "lines")
    counts = stash(lines.groupBy("leaf", "line", "long").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")), "line-counts")
    alone = counts.where(F.col("n") >= F.when(F.col("long"), long_docs).otherwise(min_docs)).select("line", "first")
    leaves = counts.where("leaf is not null").groupBy("leaf").agg(F.sum("n").alias("all")).where(F.col("all") >= min_docs).select("leaf")
    hot = stash(counts.join(leaves, "leaf"), "hot-lines")
    wanted = small(hot.select("line", F.col("first").alias("doc_id"), "leaf", "n"))

    def tokens(batches):
        for b in batches:
            out = {"doc_id": [], "line": [], "tokens": []}
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                own = {hashed(t): t for _, t, _ in lines_of(text) if len(t) >= LEAST_TOKENS}
                out["doc_id"] += [doc_id] * len(own)
                out["line"] += own
                out["tokens"] += own.values()
            yield out

    # Each hot line's tokens come from the first document that has it.
    firsts = hot.select(F.col("first").alias("doc_id")).distinct()
    some = docs.join(small(firsts), "doc_id", "left_semi")
    texts = map_batches(some, "doc_id long, line long, tokens array<string>", tokens).join(wanted, ["doc_id", "line"]).dropDuplicates(["line"])
    texts = stash(texts.select("leaf", "line", "n", "tokens"), "hot-tokens")
    places = texts.select("leaf", "line", "n", F.posexplode("tokens").alias("at", "token"))
    steady = places.groupBy("leaf", "at", "token").agg(F.sum("n").alias("have")).where((F.col("have") >= min_docs) & (F.col("token") != WILD)).drop("have")
    kept = places.join(steady.withColumn("steady", F.lit(True)), ["leaf", "at", "token"], "left")
    share = F.count("steady") / F.count("*")
    shape = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.when(F.col("steady"), F.col("token")).otherwise(WILD).alias("token")))), lambda x: x["token"]), " ")
    made = kept.groupBy("leaf", "line").agg(F.when(share >= similarity, F.xxhash64(F.first("leaf"), shape)).alias("template"))
    made = stash(made.where("template is not null").select("line", "template"), "templates")
    held = lines.select("doc_id", "line").join(small(made), "line").select("template", "doc_id").distinct()
    again = held.groupBy("template").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where(F.col("n") >= min_docs)
    found = made.join(again.select("template", "first"), "template").select("line", "first").unionByName(alone)
    # A template's first document is no later than its line's; where they differ, no document of the line is the first.
    found = stash(found.groupBy("line").agg(F.min("first").alias("first")), "recurring")
    unstash(counts, hot, texts, made)
    return found, lines


def drop_recurring_lines(docs: DataFrame, min_docs: int = 5, similarity: float = 0.6, long_docs: int = 2) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` without recurring lines and those of recurring templates, and ``n_lines``, ``n_dropped``.

    Lines end with a newline; blank ones stay, and so does everything in a template's first document. Lines of ten tokens and more go from
    the second document on (``long_docs``) if they recur word for word; those of one
    or two from ``min_docs`` on, as they stand. Two letters of a script without
    spaces are as long as a token. Null texts stay null with 0 lines;
    rows with a null doc_id stay whole and count for nothing; rows that repeat a
    doc_id count as one document. Own columns named like results are replaced.
    """
    own = Own(docs.drop("n_lines", "n_dropped"), "doc_id", "text")
    docs = own.df
    found, lines = recurring_lines(docs, min_docs, similarity, long_docs)
    gone = lines.select("doc_id", "line").join(small(found), "line").where(F.col("doc_id") != F.col("first"))
    gone = gone.groupBy("doc_id").agg(F.collect_set("line").alias("__gone"))
    kinds = dict(docs.dtypes)
    keep = [c for c in docs.columns if c != "text"]

    def fn(batches):
        for b in batches:
            out = {"text": [], "n_lines": [], "n_dropped": []}
            for text, drop in zip(b["text"], b["__gone"], strict=True):
                lines = [] if text is None else text.split("\n")
                left = lines
                if drop:
                    drop = set(drop)
                    bad = {k for k, *line in lines_of(text) if not drop.isdisjoint(keys_of(*line))}
                    left = [x for k, x in enumerate(lines) if k not in bad]
                out["text"].append(None if text is None else "\n".join(left) if left is not lines else text)
                out["n_lines"].append(len(lines))
                out["n_dropped"].append(len(lines) - len(left))
            yield {c: b[c] for c in keep} | out

    gone = gone.withColumnRenamed("doc_id", "__doc")
    joined = docs.withColumn("text", F.col("text").cast("string")).join(gone, F.col("doc_id").cast("long") == F.col("__doc"), "left")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string, n_lines long, n_dropped long"
    return own.back(map_batches(joined.select(*docs.columns, "__gone"), schema, fn), "n_lines", "n_dropped")


def brute_force(docs: dict[int, str | None], min_docs: int = 5, similarity: float = 0.6, long_docs: int = 2) -> dict[int, str | None]:
    """The same on one machine, for tests."""
    from collections import Counter, defaultdict

    lines, owners, whole = {}, defaultdict(set), defaultdict(set)
    for doc_id, text in docs.items():
        for _, t, exact in lines_of(text):
            lines[" ".join(t)] = t
            owners[" ".join(t)].add(doc_id)
            if exact is not None:
                whole[" ".join(exact)].add(doc_id)
    leaves, total = defaultdict(Counter), Counter()
    for key, t in lines.items():
        total[leaf_of(t)] += len(owners[key])
        for at, token in enumerate(t):
            leaves[leaf_of(t)][at, token] += len(owners[key])
    template, held = {}, defaultdict(set)
    for key, t in lines.items():
        steady = [token if token != WILD and leaves[leaf_of(t)][at, token] >= min_docs else WILD for at, token in enumerate(t)]
        good = total[leaf_of(t)] >= min_docs and len(t) >= LEAST_TOKENS and sum(x != WILD for x in steady) / len(t) >= similarity
        template[key] = (leaf_of(t), " ".join(steady)) if good else (None, key)
        held[template[key]] |= owners[key]
    again = lambda found, doc_id, least: len(found) >= least and min(found) != doc_id
    out = {}
    for doc_id, text in docs.items():
        bad = {k for k, t, _ in lines_of(text) if again(held[template[" ".join(t)]], doc_id, min_docs)}
        bad |= {k for k, _, exact in lines_of(text) if exact is not None and again(whole[" ".join(exact)], doc_id, long_docs)}
        out[doc_id] = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in bad)
    return out
