"""Sessions and the folder that a job's machines share: local sessions, tables written between steps, sizes."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join may be broadcast, where its rows are of fixed small width.
BROADCAST_ROWS = 400_000
#: Bits that a sieve has for each key, words of 64 bits in a row of it, and keys up to which one is made (40 MB).
SIEVE_BITS, SIEVE_WORDS, SIEVE_KEYS = 16, 4096, 20_000_000


def importable(spark: SparkSession) -> SparkSession:
    """Let workers on this machine import the package; on a cluster it is installed or shipped with the job."""
    root = str(Path(__file__).resolve().parents[1])
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, path) if x)
    return spark


def local(cpus: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("ledgerlake").config("spark.driver.memory", memory)
    base = {"spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": str(cpus if cpus != "*" else 8)}
    return builder.config(map=base | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only a local session, as in tests, may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"{tempfile.gettempdir()}/checkpoints/ledgerlake"
    return found.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerlake-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def unstash(*frames: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_stash_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, broadcast if a count shows that it is within ``limit`` rows; else Spark shuffles it."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def sifted(rows: DataFrame, keys: DataFrame, on: list[str], n: int) -> DataFrame:
    """``rows`` with ``__may``: true for all rows whose ``on`` is among the ``n`` rows of ``keys``, and for some one in sixteen of the others.

    A bit for each key, at the place that its hash gives, is broadcast, so rows that
    certainly meet no key needn't be shuffled to find that out. Of too many keys no
    sieve is made, and any row may meet one.
    """
    if n > SIEVE_KEYS:
        return rows.withColumn("__may", F.lit(True))
    pages = max(1, -(-n * SIEVE_BITS // (64 * SIEVE_WORDS)))
    words = pages * SIEVE_WORDS
    slot = F.pmod(F.xxhash64(*[F.col(c).cast(dict(keys.dtypes)[c]) for c in on]), F.lit(64 * words)).alias("__slot")
    set_bits = keys.select(slot).select(F.shiftright("__slot", 6).alias("word"), F.expr("shiftleft(1L, cast(__slot & 63 as int))").alias("bits"))
    all_words = rows.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    each = set_bits.unionByName(all_words).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    bits = F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"])
    sieve = each.groupBy(F.floor(F.col("word") / SIEVE_WORDS).alias("__page")).agg(bits.alias("__bits"))
    got = rows.select("*", slot).withColumn("__page", F.floor(F.col("__slot") / (64 * SIEVE_WORDS))).join(F.broadcast(sieve), "__page")
    word = F.get("__bits", (F.shiftright("__slot", 6) % SIEVE_WORDS).cast("int"))
    return got.select(*rows.columns, (F.getbit(word, (F.col("__slot") % 64).cast("int")) == 1).alias("__may"))


def meeting(rows: DataFrame, keys: DataFrame, on: list[str], n: int | None = None) -> DataFrame:
    """``rows`` joined with ``keys``; where keys are too many to broadcast, only rows that may meet one are shuffled."""
    n = keys.count() if n is None else n
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), on)
    return sifted(rows, keys, on, n).where("__may").drop("__may").join(keys, on)


def attached(rows: DataFrame, facts: DataFrame, on: list[str], n: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``facts``, null where there are none: a left join, for which only rows that may have facts are shuffled."""
    n = facts.count() if n is None else n
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(facts), on, "left")
    marked = sifted(rows, facts, on, n)
    near = marked.where("__may").drop("__may").join(facts, on, "left")
    kinds = dict(facts.dtypes)
    far = marked.where("not __may").select(*near.columns[: len(rows.columns)], *[F.lit(None).cast(kinds[c]).alias(c) for c in facts.columns if c not in on])
    return far.unionByName(near)
