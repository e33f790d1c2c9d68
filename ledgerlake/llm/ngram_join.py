"""Similarity join of documents on word shingles by parity sketches.

A document's set of shingle hashes is folded into a parity sketch: each hash flips
one bit of a wide bit string. Elements in both sets cancel, so the Hamming
distance of two sketches is at most the size of the symmetric difference. The bit
string is cut into pieces, and a piece is kept as the XOR of its flipped bits'
64-bit codes: as many pieces differ as elements do, at most. Two sets that link
differ in at most ``d`` elements, by their sizes; of ``P`` pieces at least
``P - d`` are then equal, and an equi-join on (size band, piece number, piece)
finds every link. A set takes part in the bands that a smaller partner can be in.

Four bounds keep the join small, and none of them loses a link:

* a piece that no other set has can't be equal, so a set with more than ``d`` such
  pieces in each of its bands is done (most of a corpus is);
* an element that no other remaining set has is in no intersection, which bounds
  the overlap of a set with a partner of any given size;
* of the pieces left, the rarest ``d - own + 1`` hold an equal one, ``own`` being
  the pieces that no other set has; only these are joined, so pieces of boilerplate drop out;
* whole sketches, folded to 512 bits, are compared by their Hamming distance in the
  join's condition.

What is left is compared by its whole sets. Equal sets form a class, and classes
are compared only if they are in different components: first with the least
peculiar member of the largest component that shares a piece with them, and then
those still apart with all others of their piece. So a group of copies costs
about as many comparisons as it has members.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Own, map_batches, small, stash, unstash
from .components import connected_components

#: Lower end of a band of sizes over its upper end.
BAND = 0.62
#: Pieces of a sketch for each difference that a band allows: the more, the fewer sets remain and the more keys there are.
PIECES = 1.2
#: Rounds in which classes are compared with one member of a piece's largest component.
STARS = 2
#: Words of a folded sketch.
FOLDED = 8
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * M1
    x = (x ^ (x >> np.uint64(33))) * M2
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; a text of fewer words is one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h, size = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), min(k, len(words))
    acc = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        acc *= M1
        acc += h[j : len(h) - size + 1 + j]
    return np.unique(_mix(acc))


def digest_of(found: np.ndarray) -> bytes:
    """128 bits of a set; sets with the same ones are taken to be equal."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def most_differences(n: int, m: int, percent: int) -> int:
    """The elements in which linked sets of these sizes differ at most."""
    return n + m - 2 * -(-percent * (n + m) // (100 + percent))


@lru_cache(maxsize=1 << 16)
def bands(n: int, percent: int) -> tuple[tuple[int, int, int], ...]:
    """``(band, pieces, equal)`` for each band that a set of ``n`` looks for partners in; linked sets have ``equal`` equal pieces at least.

    None where only equal sets link.
    """
    out, lo, k = [], 1, 0
    while lo <= n:
        hi = max(lo, int(lo / BAND))
        d = most_differences(hi, hi * 100 // percent, percent)
        if hi * 100 >= n * percent and d > 0:
            pieces = int(np.ceil(PIECES * (d + 1)))
            # The smaller of two linked sets names the band: in its own one a set may be that, below it is the larger one.
            own = max(most_differences(n, m, percent) for m in ((n * 100 // percent, n * 100 // percent - 1) if n <= hi else (hi, hi - 1)))
            out.append((k, pieces, pieces - min(d, own)))
        lo, k = hi + 1, k + 1
    return tuple(out)


def _pieces(found: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and XORs of the pieces that hold something; ``found`` is sorted, and pieces are ranges of it."""
    at = ((found >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[starts], np.bitwise_xor.reduceat(_mix(found + np.uint64(1)), starts)


def sketch_keys(found: np.ndarray, percent: int) -> list[np.ndarray]:
    """The join keys of a set, for each of its bands: one for every piece, empty ones included."""
    out = []
    for band, pieces, _ in bands(len(found), percent):
        at, code = _pieces(found, pieces)
        codes = np.zeros(pieces, np.uint64)
        codes[at.astype(np.int64)] = code
        out.append(_mix(codes ^ _mix(np.arange(pieces, dtype=np.uint64) + np.uint64(band << 40))).view(np.int64))
    return out


def folded(found: np.ndarray) -> np.ndarray:
    """The parity sketch of a set in ``64 * FOLDED`` bits."""
    odd = np.bincount((_mix(found) & np.uint64(64 * FOLDED - 1)).astype(np.int64), minlength=64 * FOLDED) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    same = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * same >= percent * (len(a) + len(b) - same) > 0


SKETCH = [f"s{i}" for i in range(FOLDED)]
#: What is known of a remaining class.
CLASS = ["c", "n", "own", *SKETCH]


def _may_link(percent: int) -> Column:
    """Whether two classes, the second with names ending in ``_2``, can link by their sizes, own elements and sketches."""
    n, m = F.col("n"), F.col("n_2")
    overlap = F.ceil((n + m) * percent / (100 + percent) - 1e-9)
    bits = sum((F.bit_count(F.col(s).bitwiseXOR(F.col(f"{s}_2"))) for s in SKETCH), F.lit(0))
    sizes = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    return sizes & (n - F.col("own") >= overlap) & (m - F.col("own_2") >= overlap) & (bits <= n + m - 2 * overlap)


def _described(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc_id, t, row, n, digest, equal, keys`` for each row: its text's hash, a number of its own, its set's size, digest and keys by band."""

    def describe(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for b in batches:
            sets = [shingles(t, words) for t in b["text"]]
            yield {
                "doc_id": b["doc_id"], "t": b["t"], "row": list(range(row, row + len(sets))), "n": [len(s) for s in sets], "digest": [digest_of(s) for s in sets],
                "equal": [[e for _, _, e in bands(len(s), percent)] for s in sets], "keys": [sketch_keys(s, percent) for s in sets],
            }
            row += len(sets)

    schema = "doc_id long, t long, row long, n long, digest binary, equal array<int>, keys array<array<long>>"
    return stash(map_batches(docs, schema, describe), "sets")


def _remaining(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Classes that may link with another, with their sets, and the pieces to join them on: ``CLASS, elements`` and ``key, c``."""
    # A class and a band as one number. Both sides are shuffled at every size: keys are many, and hot ones are split by adaptive joins.
    keys = classes.select("row", F.posexplode("keys").alias("band", "keys")).select((F.col("row") * 16 + F.col("band")).alias("entry"), F.explode("keys").alias("key"))
    shared = stash(keys.groupBy("key").agg(F.count("*").alias("sets")).where("sets > 1").select("key"), "shared-keys")
    held = keys.join(shared.hint("merge"), "key").select("key", F.shiftright("entry", 4).alias("c"), (F.col("entry") % 16).cast("int").alias("band"))
    held = stash(held, "shared-pieces")
    equal = classes.select(F.col("row").alias("c"), F.posexplode("equal").alias("band", "equal"))
    some = held.groupBy("c", "band").agg(F.count("*").alias("held")).join(equal, ["c", "band"]).where("held >= equal")
    some = stash(some.select("c", "band", (F.col("held") - F.col("equal") + 1).alias("first")), "entries")

    texts = classes.join(small(some.select(F.col("c").alias("row")).distinct()), "row").select(F.col("row").alias("c"), F.col("doc_id").alias("id"), "t")
    texts = docs.join(small(texts), (docs["t"] == texts["t"]) & docs["doc_id"].eqNullSafe(texts["id"])).select("c", "text")

    def sets(batches):
        for b in batches:
            found = [shingles(t, words) for t in b["text"]]
            sketches = np.array([folded(s) for s in found], np.int64).reshape(-1, FOLDED)
            yield {"c": b["c"], "n": [len(s) for s in found], "elements": [s.view(np.int64) for s in found]} | {s: sketches[:, i] for i, s in enumerate(SKETCH)}

    schema = "c long, n long, elements array<long>, " + ", ".join(f"{s} long" for s in SKETCH)
    found = stash(map_batches(texts.dropDuplicates(["c"]), schema, sets), "remaining")
    lone = found.select("c", F.explode("elements").alias("e")).groupBy("e").agg(F.count("*").alias("k"), F.min("c").alias("c")).where("k = 1")
    lone = lone.groupBy("c").agg(F.count("*").alias("own"))
    left = found.join(lone, "c", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    left = stash(left.where(F.col("n") - F.col("own") >= F.ceil(F.col("n") * percent / 100 - 1e-9)), "left")

    from pyspark.sql import Window

    pieces = held.join(small(some), ["c", "band"]).join(small(left.select("c")), "c")
    pieces = stash(pieces.select("key", "c", "band", "first"), "pieces")
    rarity = pieces.groupBy("key").agg(F.count("*").alias("sets"))
    order = Window.partitionBy("c", "band").orderBy("sets", "key")
    first = pieces.join(small(rarity), "key").withColumn("k", F.row_number().over(order)).where("k <= first and sets > 1")
    first = stash(first.select("key", "c"), "first-pieces")
    unstash(shared, held, some, found, pieces)
    return left, first


def _links(left: DataFrame, pieces: DataFrame, percent: int) -> DataFrame:
    """``component`` of each class (``id``) that links with another."""
    members = stash(pieces.join(small(left.select(*CLASS)), "c"), "members")
    other = [F.col(x).alias(f"{x}_2") for x in (*CLASS, "component")]

    def named(comps: DataFrame | None) -> DataFrame:
        if comps is None:
            return members.withColumn("component", F.col("c"))
        return members.join(small(comps.select(F.col("id").alias("c"), "component")), "c", "left").withColumn("component", F.coalesce("component", "c"))

    def leads(rows: DataFrame) -> DataFrame:
        """Of each piece's largest component, the member with the fewest elements of its own."""
        each = rows.groupBy("key", "component").agg(F.count("*").alias("size"), F.min(F.struct("own", *[x for x in CLASS if x != "own"])).alias("best"))
        most = each.groupBy("key").agg(F.max(F.struct("size", "component", "best")).alias("top"), F.count("*").alias("components")).where("components > 1")
        return most.select("key", F.col("top.component").alias("component"), *[F.col(f"top.best.{x}").alias(x) for x in CLASS])

    def compared(pairs: DataFrame) -> DataFrame:
        pairs = stash(pairs.distinct(), "pairs")
        sets = left.select("c", "elements")
        both = pairs.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a")
        same = F.size(F.array_intersect("x", "y"))
        good = both.where(same * 100 >= (F.size("x") + F.size("y") - same) * percent).select("a", "b")
        good = stash(good, "links")
        unstash(pairs)
        return good

    links = comps = None
    for last in [False] * STARS + [True]:
        rows = named(comps)
        top = stash(leads(rows), "leads")
        if top.isEmpty():
            break
        if not last:
            pairs = rows.join(small(top.select("key", *other)), "key").where((F.col("component") != F.col("component_2")) & _may_link(percent))
        else:
            # Those outside a piece's largest component with all others of the piece; that component's members are in one already.
            largest = small(top.select("key", F.col("component").alias("largest")))
            sides = rows.join(largest, "key")
            apart = F.col("component") != F.col("component_2")
            once = (F.col("component_2") == F.col("largest_2")) | (F.col("c") < F.col("c_2"))
            pairs = sides.where("component <> largest").join(sides.select("key", F.col("largest").alias("largest_2"), *other), "key").where(apart & once & _may_link(percent))
        found = compared(pairs.select(F.least("c", "c_2").alias("a"), F.greatest("c", "c_2").alias("b")))
        links = found if links is None else links.unionByName(found)
        comps = stash(connected_components(links), "components")
        unstash(top)
    unstash(members)
    return comps


def _members(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc_id, t, row, n, component`` for each row of ``docs(doc_id, text, t)``; a component is named by a row of it."""
    if not 1 <= percent <= 100:
        raise ValueError("percent is from 1 to 100")
    rows = _described(docs, words, percent)
    some = rows.where("n > 0")
    copies = stash(some.groupBy("digest").agg(F.min("row").alias("c"), F.count("*").alias("copies")).where("copies > 1").select("digest", "c"), "copies")
    of = some.join(small(copies), "digest", "left").withColumn("c", F.coalesce("c", "row"))
    left, pieces = _remaining(docs, of.where("c = row"), words, percent)
    comps = _links(left, pieces, percent)
    of = of.select("doc_id", "t", "row", "n", "c")
    if comps is not None:
        of = of.join(small(comps.select(F.col("id").alias("c"), "component")), "c", "left").withColumn("c", F.coalesce("component", "c"))
    out = of.select("doc_id", "t", "row", "n", F.col("c").alias("component")).unionByName(rows.where("n = 0").select("doc_id", "t", "row", "n", F.col("row").alias("component")))
    out = stash(out, "near")
    unstash(rows, copies, left, pieces)
    return out


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"))


def near_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``.

    Sets link if 100 * intersection >= percent * union; a component is all that
    links reach, named by its smallest doc_id. Null, empty and blank texts have
    no set and are alone; rows that repeat a doc_id are all kept; a null doc_id
    is never a name unless nothing else is there. Other columns are not read.
    """
    found = _members(_hashed(docs), words, percent)
    names = found.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("root"), F.count("*").alias("rows")).where("rows > 1")
    out = found.join(small(stash(names.select("component", "root"), "names")), "component", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows of every component but those of its smallest doc_id, by doc_id alone: its repeated rows stay, and so do null ids."""
    found = near_components(docs, words, percent)
    gone = stash(found.where("component_id <> doc_id").select("doc_id").distinct(), "dropped")
    return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)


def one_of_each_component(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of every component, of its smallest doc_id (a null one comes last).

    Rows count as one by doc_id and text, not by doc_id alone: a doc_id with another,
    unlinked text keeps it. Texts without a word are in no component and stay.
    """
    found = _members(_hashed(docs), words, percent).where("n > 0")
    # Components of one row are the most: only the others are named.
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t")).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    shared = found.join(small(stash(first.select("component", "first"), "first")), "component")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t") == F.col("first.t"))
    shared = shared.groupBy("doc_id", "t").agg(F.count("*").alias("copies"), F.first(stays).alias("stays"))
    shared = stash(shared.select(F.col("doc_id").alias("__id"), F.col("t").alias("__hash"), "copies", "stays").where("not stays or copies > 1"), "dropped")
    own = Own(docs, "doc_id", "text")
    text, told = F.xxhash64(F.col("text").cast("binary")), small(shared.select("__id", "__hash", F.struct("stays").alias("__told")))
    rows = own.df.join(told, (text == F.col("__hash")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left")
    once = rows.where("__told.stays").dropDuplicates(["__id", "__hash"])
    return own.back(rows.where("__told is null").unionByName(once))
