"""Groups of spelling variants by anagram hashing.

A word's key is the sum of its letters' fifth powers: the same for all orders of the
letters, and different by a fixed value where a letter is added, removed or exchanged.
Two words of one length differ by an exchange where their keys less a letter each are
equal; a word is another with a letter added where its key less that letter is the
other's. So each word stands under its key less each of its letters, and under its key
itself, and words are joined that stand under the same one. As a single change
leaves the word's first or second half as it is, the half is part of what is joined
on: anagrams of all kinds don't meet. What meets is compared letter by letter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, unstash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a word (fixed values).
LETTERS = r"A-Za-zÀ-ÿ"
#: Keys are kept modulo a prime, so that no word's sum overflows.
PRIME = 2**61 - 1


def value_of(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    return code * code * code * code * code


def letters_of(word: Column) -> Column:
    """A word's letters, in time linear in its length, as a split at nothing isn't."""
    return F.regexp_extract_all(word, F.lit("."), F.lit(0))


def anagram_key(word: Column) -> Column:
    """The sum of the letters' fifth powers, modulo ``PRIME``."""
    return F.aggregate(letters_of(word), F.lit(0).cast("long"), lambda acc, c: (acc + value_of(c)) % PRIME)


def words_of(docs: DataFrame, least: int = 7) -> DataFrame:
    """``word``: every run of letters of ``docs(doc_id, text)`` in lower case, one letter less where its draw says so, of ``least`` letters or more.

    The draw is the CRC-32 of the row's id (nothing if null), a colon and the run; where 31 divides it,
    the letter at the draw modulo the length goes.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least},}}+"), F.lit(0))).alias("run"))
    run = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    runs = runs.select("id", run.alias("run"))
    drawn = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("draw"))
    at = (F.col("draw") % F.char_length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("draw") % 31 == 0, less).otherwise(F.col("run"))
    return drawn.select(word.alias("word")).where(F.char_length("word") >= least)


def _half(word: Column, less: Column) -> Column:
    """Letters before the middle: for a word less a letter, of what is left."""
    return F.floor((F.char_length(word) - less.cast("int")) / 2).cast("int")


def _one_change(a: Column, b: Column) -> Column:
    """Whether ``b`` is ``a`` with one letter exchanged or added; in linear time for long words, where an edit distance isn't."""
    differs = F.transform(F.arrays_zip(letters_of(a).alias("a"), letters_of(b).alias("b")), lambda x: ~x["a"].eqNullSafe(x["b"]))
    at = F.array_position(differs, True).cast("int")
    rest = F.substring(b, at + 1, F.char_length(b))
    same = F.when(F.char_length(a) == F.char_length(b), F.substring(a, at + 1, F.char_length(a)) == rest).otherwise((F.char_length(a) + 1 == F.char_length(b)) & (F.substring(a, at, F.char_length(a)) == rest))
    return F.when(F.greatest(F.char_length(a), F.char_length(b)) <= 64, F.levenshtein(a, b, 1) == 1).otherwise((at > 0) & same)


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, b, n_a, n_b``: each pair of ``words(word, n)``, once, that differ by one letter added, removed or exchanged; ``a`` is the shorter or the first."""
    letters = letters_of(F.col("word"))
    word = words.select("word", "n", F.char_length("word").alias("len"), anagram_key(F.col("word")).alias("key"), F.array_distinct(letters).alias("letters"))
    less = word.select("word", "n", "len", "key", F.explode("letters").alias("letter"))
    key = (F.col("key") - value_of(F.col("letter")) + F.lit(PRIME)) % PRIME
    half = _half(F.col("word"), F.lit(True))
    # A word less a letter: the halves around the middle, without the letter there.
    less = less.select("word", "n", "letter", "len", key.alias("key"), half.alias("half"), (half + 2).alias("next"))
    # A word as it is, to meet words with a letter more.
    half = _half(F.col("word"), F.lit(False))
    whole = word.select("word", "n", F.lit(None).cast("string").alias("letter"), (F.col("len") + 1).alias("len"), "key", half.alias("half"), (half + 1).alias("next"))
    first, second = F.substring("word", F.lit(1), F.col("half")), F.substring("word", F.col("next"), F.col("len"))
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("second"), F.xxhash64("key", "len", F.lit(k), part).alias("meet")) for k, part in ((False, first), (True, second))]))
    rows = less.unionByName(whole).select("word", "n", "letter", sides.alias("side")).select("word", "n", "letter", "side.second", "side.meet")
    a, b = rows.alias("a"), rows.alias("b")
    col = lambda x, c: F.col(f"{x}.{c}")
    added = col("a", "letter").isNull()
    exchange = (col("a", "letter") != col("b", "letter")) & (col("a", "word") < col("b", "word"))
    # Those whose first halves are equal meet there; a second meeting, by the second halves, doesn't count.
    start = lambda x, less: F.substring(col(x, "word"), F.lit(1), _half(col(x, "word"), less))
    once = ~col("a", "second") | (start("a", ~added) != start("b", F.lit(True)))
    met = (col("a", "meet") == col("b", "meet")) & (col("a", "second") == col("b", "second")) & col("b", "letter").isNotNull() & (exchange | added) & once & _one_change(col("a", "word"), col("b", "word"))
    return a.join(b, met).select(col("a", "word").alias("a"), col("b", "word").alias("b"), col("a", "n").alias("n_a"), col("b", "n").alias("n_b"))


def forms(words: DataFrame, times: int = 10) -> DataFrame:
    """``words(word, n)`` with ``n_near`` and the near word of largest n (the first of equals) as ``form, form_n``, if that is ``times`` n or more."""
    pairs = near_pairs(words)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("m"))))
    each = pairs.select(both.alias("p")).select("p.*")
    # The least of (-m, near) is the largest m with the first word.
    best = each.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best"))
    got = words.join(best, "word", "left")
    m = -F.col("best.less")
    taken = F.coalesce(m >= F.lit(times) * F.col("n"), F.lit(False))
    return got.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, m).alias("form_n"))


def with_roots(formed: DataFrame) -> DataFrame:
    """``formed(word, form, ...)`` with ``root``: the last word that forms lead to, the word itself if it has none.

    Each round, a word points to where the word that it points to does; as each form
    comes many times as often, ways are short and rounds few.
    """
    link = stash(formed.where("form is not null").select("word", F.col("form").alias("root")), "links")
    while True:
        onward = link.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stash(link.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        unstash(link)
        link = step
        if step.where("moved").isEmpty():
            break
    return formed.join(link.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, least: int = 7, occurrences: int = 2, times: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs(doc_id, text)`` with ``occurrences`` or more.

    Two words are near if one code point added, removed or exchanged makes one the
    other. A word's form is its near word of largest n (of equals, the first), if that
    has ``times`` its occurrences; root is what forms lead to, the word itself if
    nothing. Null and empty texts have no words; repeated rows count each; other
    columns aren't read. Runs of any length are whole words.
    """
    counted = words_of(docs.select("doc_id", "text"), least).groupBy("word").agg(F.count("*").alias("n"))
    words = stash(counted.where(F.col("n") >= occurrences), "words")
    formed = stash(forms(words, times), "forms")
    unstash(words)
    return with_roots(formed).select("word", "form", "root", "n", "n_near", "form_n")
