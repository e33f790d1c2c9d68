"""Personal data, found and sanitised with DataFrame functions only.

Base entities (e-mail and IP addresses, card and phone numbers) come from fixed
patterns. Beyond them, terms that give an entity away are found by what the
corpus tells. What is protected are entities and the groups that they are of (a mail
domain, a network, a card's issuer, an area code), but for those that say little, as
many texts have them. With the distinct texts that hold a term and those of
these that hold an entity too, the least share that the latter are likely to have
(the lower bound of Wilson's interval) tells how much the term says of the entity: as a
share of the entity's information content, that is the term's disclosure. Terms from
``disclosure`` on are generalised in texts with that entity, and from ``removal`` on
removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Own, small, stash

KINDS = ("email", "ip", "card", "phone")
#: The kinds' patterns, with possessive repeats and anchors that start a match only where
#: a run of its first characters starts, or where the last match ended: the leftmost matches
#: are the same, and a long run is read once.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no valid match.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": "+"}
WORD = r"[\p{L}\p{N}]+"
#: Keys counted oftener are joined by broadcast, so that no task gets all rows of one.
HOT = 1000
SPANS = "array<struct<start:int,end:int,value:string>>"
#: Matches that are gathered at a time: a long text's are gathered in two steps, so that no list is copied for each of them.
CHUNK = 256
#: Bits of information that an entity or group must have to be protected: of the texts, one in eight holds it at most.
INFORMATION = 3
RANKED = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def located(text: Column, pattern: str, terms: Column | None = None) -> Column:
    """``array<struct<start, end, value>>`` of the leftmost matches that don't overlap, in code points; with ``terms``, those that are one in lower case."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def add(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.char_length(x["0"])
        z = a + F.char_length(x["1"])
        out = F.concat(acc["out"], F.array(F.struct(a.alias("start"), z.alias("end"), x["1"].alias("value"))))
        return F.struct(z.alias("at"), (out if terms is None else F.when(F.array_contains(terms, F.lower(x["1"])), out).otherwise(acc["out"])).alias("out"))

    def add_all(acc: Column, chunk: Column) -> Column:
        got = F.aggregate(chunk, F.struct(acc["at"].alias("at"), F.array().cast(SPANS).alias("out")), add)
        return F.struct(got["at"].alias("at"), F.concat(acc["out"], F.array(got["out"])).alias("out"))

    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("0"), found.alias("1"))
    none = lambda kind: F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def gather(pairs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor(F.size(pairs) / CHUNK).cast("int")), lambda k: F.slice(pairs, k * CHUNK + 1, F.lit(CHUNK)))
        return F.aggregate(chunks, none(f"array<{SPANS}>"), add_all, lambda acc: F.flatten(acc["out"]))

    # As a lambda's argument, the list of matches is made once; named in place it would be made for every chunk.
    many = F.get(F.transform(F.array(pairs), gather), F.lit(0))
    return F.when(F.size(found) <= CHUNK, F.aggregate(pairs, none(SPANS), add, lambda acc: acc["out"])).otherwise(many)


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.char_length(digits)
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(digits)).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _found(text: Column, rank: int, kind: str) -> Column:
    """One kind's valid matches, where the text can have any."""
    maybe = text.contains(HINTS[kind]) if len(HINTS[kind]) == 1 else text.rlike(HINTS[kind])
    found = F.filter(located(text, PATTERNS[kind]), lambda x: _valid(kind, x["value"]))
    full = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))
    return F.when(maybe, full).otherwise(F.array().cast(RANKED))


def entities(text: Column) -> Column:
    """All base entities of a text by start, then kind as listed; none of a null text."""
    found = [_found(text, rank, kind) for rank, kind in enumerate(KINDS)]
    return F.when(text.isNotNull(), F.array_sort(F.concat(*found))).otherwise(F.array().cast(RANKED))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _terms(text: Column) -> Column:
    """The distinct lower-cased words of three letters and more of a text."""
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))
    return F.filter(words, lambda w: (F.char_length(w) >= 3) & w.rlike(r"\p{L}"))


def _with_counts(rows: DataFrame, counts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` with the columns of ``counts``; keys that come often are broadcast, so that none fills a task."""
    got = rows.join(small(counts.where(F.col(n) > HOT)), keys, "left")
    rest = got.where(F.col(n).isNull()).select(*rows.columns).join(counts.where(F.col(n) <= HOT), keys)
    return got.where(F.col(n).isNotNull()).select(*rest.columns).unionByName(rest)


def _names(entities: Column) -> Column:
    """The distinct entities of a text, and the groups that they are of."""
    value, kind = lambda e: F.lower(e["value"]), lambda e: e["kind"]
    digits = lambda e: F.regexp_replace(e["value"], "[^0-9+]", "")
    group = lambda e: F.when(kind(e) == "email", F.substring_index(value(e), "@", -1)).when(kind(e) == "ip", F.substring_index(e["value"], ".", 3)).when(kind(e) == "card", F.substring(digits(e), 1, 6)).otherwise(F.substring(digits(e), 1, 6))
    own = F.transform(entities, lambda e: F.concat_ws(":", kind(e), value(e)))
    return F.array_distinct(F.concat(own, F.transform(entities, lambda e: F.concat_ws("/", kind(e), group(e)))))


def _lower_bound(hits: Column, trials: Column, z: float) -> Column:
    """The lower bound of Wilson's interval for a share of which ``hits`` of ``trials`` were seen."""
    share, zz = hits / trials, z * z
    return (share + zz / (2 * trials) - z * F.sqrt(share * (1 - share) / trials + zz / (4 * trials * trials))) / (1 + zz / trials)


def _revealing_terms(docs: DataFrame, support: int, disclosure: float, removal: float, z: float) -> DataFrame | None:
    """``__key, __terms, __gone``: for each text with an entity, the terms to generalise and to remove; None if there are none.

    All counts are of distinct texts: those with a term, with an entity, with both, and
    all. Entities and groups that are in the same texts have the same counts with
    every term, so they are judged as one: a long list of addresses is a few.
    """
    docs = docs.where("text is not null")
    held = docs.where(F.size("__base") > 0).select("__key", _names(F.col("__base")).alias("names"), _terms(F.col("text")).alias("terms"))
    held = stash(held.dropDuplicates(["__key"]), "held")
    if held.isEmpty():
        return None
    copies = stash(docs.groupBy("__key").agg(F.count("*").alias("copies")), "copies")
    total = float(copies.count())
    words = docs.select("__key", _terms(F.col("text")).alias("terms")).join(small(copies.where("copies > 1")), "__key", "left")
    words = words.select(F.explode("terms").alias("term"), (1 / F.coalesce("copies", F.lit(1))).alias("part"))
    seen = words.groupBy("term").agg(F.round(F.sum("part")).cast("long").alias("n_term"))
    seen = stash(seen.where(F.col("n_term") >= support), "terms-seen")
    name = held.select("__key", F.explode("names").alias("name"))
    # Which texts hold an entity, as two sums of the texts' hashes that don't depend on order.
    texts = [F.bit_xor(F.xxhash64("__key", F.lit(k))).alias(f"in{k}") for k in (0, 1)]
    each = name.groupBy("name").agg(F.count("*").alias("n_entity"), *texts)
    each = stash(each.where((F.col("n_entity") >= support) & (F.log2(F.lit(total) / F.col("n_entity")) >= INFORMATION)), "entities-seen")
    # A term in more documents than this can't reach the disclosure, even if it is in all of the entity's.
    most = F.pow("n_entity", F.lit(disclosure)) * total ** (1 - disclosure) * 1.000001
    known = _with_counts(name, each, ["name"], "n_entity").withColumn("most", most)
    known = stash(known.groupBy("__key").agg(F.collect_set(F.struct("in0", "in1", "n_entity", "most")).alias("known"), F.max("most").alias("bound")), "known")
    placed = held.join(known.select("__key", "bound"), "__key").select("__key", "bound", F.explode("terms").alias("term"))
    placed = _with_counts(placed, seen, ["term"], "n_term").where("n_term <= bound").select("__key", "term", "n_term")
    pairs = placed.join(known.select("__key", "known"), "__key").select("__key", "term", "n_term", F.explode("known").alias("k")).where("n_term <= k.most")
    pairs = stash(pairs.select("__key", "term", "n_term", "k.in0", "k.in1", "k.n_entity"), "pairs")
    both = pairs.groupBy("in0", "in1", "term", "n_term", "n_entity").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= support)
    information = F.log2(total / F.col("n_entity"))
    told = _lower_bound(F.col("n_both"), F.greatest("n_term", "n_both"), z)
    told = both.withColumn("share", 1 + F.log2(told) / information).where(F.col("share") >= disclosure)
    told = stash(told.select("in0", "in1", "term", "n_both", "share"), "revealing")
    marked = _with_counts(pairs.select("__key", "in0", "in1", "term"), told, ["in0", "in1", "term"], "n_both")
    return marked.groupBy("__key").agg(F.collect_set("term").alias("__terms"), F.collect_set(F.when(F.col("share") >= removal, F.col("term"))).alias("__gone"))


def find_personal_data(docs: DataFrame, support: int = 2, disclosure: float = 0.8, removal: float = 0.95, z: float = 1.64) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` with ``base`` and ``spans``; its own columns stay.

    Both are arrays of ``start, end, kind, value`` in code points; ``spans`` holds
    ``base`` and the revealing terms, of kind ``term`` (to generalise) or ``gone``
    (to remove), that don't overlap it. Terms are words of three letters or more; shorter
    ones are never judged. Null and empty texts have none. Rows that repeat a document
    get the same spans. A very long text costs as its matches, and as its terms times
    the sets of texts that its entities are in. A term needs ``support`` distinct texts
    with an entity, and so does the entity; ``z`` is how many standard errors its share
    of the term's texts is taken to be lower than seen. Own columns named like results are replaced.
    """
    given = Own(docs.drop("base", "spans"), "doc_id", "text")
    docs = given.df.withColumn("__base", entities(F.col("text")))
    keyed = docs.withColumn("__key", F.unhex(F.md5("text")))
    terms = _revealing_terms(keyed, support, disclosure, removal, z)
    kept = F.transform("__base", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["value"].alias("value")))
    if terms is None:
        return given.back(docs, kept.alias("base"), kept.alias("spans"))
    terms = stash(terms, "terms")
    # Only documents with an entity can have terms; the others' texts stay where they are.
    some = keyed.where(F.size("__base") > 0).join(terms, "__key", "left")
    none = F.lit(None).cast("array<string>")
    both = keyed.where(F.size("__base") == 0).withColumns({"__terms": none, "__gone": none}).unionByName(some)
    hits = F.filter(located(F.col("text"), WORD, F.col("__terms")), lambda w: ~F.exists("__base", lambda e: (e["start"] < w["end"]) & (w["start"] < e["end"])))
    hits = F.transform(hits, lambda w: F.struct(w["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), w["end"].alias("end"), F.when(F.array_contains("__gone", F.lower(w["value"])), "gone").otherwise("term").alias("kind"), w["value"].alias("value")))
    every = F.when(F.col("__terms").isNotNull(), F.array_sort(F.concat("__base", hits))).otherwise(F.col("__base"))
    every = F.transform(every, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["value"].alias("value")))
    return given.back(both, kept.alias("base"), every.alias("spans"))


def sanitise(found: DataFrame) -> DataFrame:
    """``found`` with its text rewritten: entities and terms become ``[KIND]``, removed ones nothing.

    Of spans that overlap, the first stays and the later one's rest is kept out too.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("text")

    def add(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        mark = F.when((x["kind"] == "gone") | (x["start"] < acc["at"]), "").otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.struct(F.greatest(x["end"], acc["at"]).alias("at"), F.concat(acc["out"], gap, mark).alias("out"))

    end = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text)))
    return found.withColumn("text", F.when(F.size("spans") > 0, F.aggregate("spans", start, add, end)).otherwise(text))


def count_kind(spans: Column | str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def digest(spans: Column) -> Column:
    return F.sha2(span_text(spans), 256)
