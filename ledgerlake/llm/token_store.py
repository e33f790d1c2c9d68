"""Token ids as blocks of byte or bit planes, each plane compressed with zstandard, with a chunk index.

A store is a Parquet table in the shared folder, so Spark's writers and readers
commit, retry and place its files. A row is one chunk of ``block`` ids: its part
(file order), its number and first position in the part, the compressed planes,
and the index of the documents that overlap it. Documents lie in ascending
``doc_id`` order (nulls first) over the parts, and within a part one after the
other; a document may run over several chunks.
"""

from __future__ import annotations

import zlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, shared_dir, small
from .tokens import encoder

BLOCK = 65_536
CHUNK = "part int, chunk long, first long, n_ids int, layout string, planes array<binary>, docs array<struct<doc_id:long,row:long,at:long,n:long>>"


def shuffle_planes(ids: np.ndarray, layout: str, level: int = 3) -> list[bytes]:
    """Plane 0 holds every id's lowest byte (or bit); planes above the highest one in use are left out."""
    top, pack = int(ids.max(initial=0)), zstandard.ZstdCompressor(level=level).compress
    if layout == "byte":
        planes = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T[: max(1, (top.bit_length() + 7) // 8)]
        return [pack(np.ascontiguousarray(p).tobytes()) for p in planes]
    return [pack(np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1).tobytes()) for k in range(max(1, top.bit_length()))]


def unshuffle_planes(planes: list[bytes], n: int, layout: str) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor().decompress
    if layout == "byte":
        out = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            out[:, k] = np.frombuffer(unpack(p), np.uint8)
        return out.view("<u4").ravel()
    out = np.zeros(n, "<u4")
    for k, p in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(unpack(p), np.uint8), count=n).astype("<u4") << np.uint32(k)
    return out


def write_token_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, block: int = BLOCK, layout: str = "byte") -> None:
    """Encode ``docs(doc_id, text)``, end each with ``end_id`` and write a store to ``path``.

    Null texts are empty (the end id alone). Rows that repeat a doc_id are
    documents of their own, in text order. No rows: a store without chunks.
    """

    def fn(batches):
        from pyspark import TaskContext

        part, end, enc = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes(), encoder(vocabulary)
        held, size, first, chunk, row, at, docs_here = [], 0, 0, 0, 0, 0, []

        def cut(raw: bytes) -> dict[str, list]:
            ids = np.frombuffer(raw, "<u4")
            over = [d for d in docs_here if d["at"] < first + len(ids)]
            return {"part": [part], "chunk": [chunk], "first": [first], "n_ids": [len(ids)], "layout": [layout], "planes": [shuffle_planes(ids, layout)], "docs": [over]}

        for b in batches:
            for doc_id, raw in zip(b["doc_id"], enc.encode_many(b["text"]), strict=True):
                raw += end
                docs_here.append({"doc_id": doc_id, "row": row, "at": at, "n": len(raw) // 4})
                row, at = row + 1, at + len(raw) // 4
                held.append(raw)
                size += len(raw)
                if size >= 4 * block:
                    data, used = b"".join(held), 0
                    while len(data) - used >= 4 * block:
                        yield cut(data[used : used + 4 * block])
                        used, first, chunk = used + 4 * block, first + block, chunk + 1
                        docs_here = [d for d in docs_here if d["at"] + d["n"] > first]
                    held, size = [data[used:]], len(data) - used
        if size:
            yield cut(b"".join(held))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    map_batches(rows, CHUNK, fn).write.option("compression", "none").parquet(path)


def read_token_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """A store's documents: ``doc_id, start`` (ids of all documents before it), ``n_tokens, ids_crc32`` and, on request, ``ids``."""
    chunks = spark.read.schema(CHUNK).parquet(path)
    totals = chunks.groupBy("part").agg(F.max(F.col("first") + F.col("n_ids")).alias("ids"))
    before = totals.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))

    def fn(batches):
        for b in batches:
            out = {k: [] for k in ("part", "row", "doc_id", "at", "n", "crc", "place", "piece")}
            for part, first, n, layout, planes, docs in zip(b["part"], b["first"], b["n_ids"], b["layout"], b["planes"], b["docs"], strict=True):
                raw = unshuffle_planes(planes, n, layout).tobytes()
                for d in docs:
                    a, z = max(d["at"], first), min(d["at"] + d["n"], first + n)
                    whole, ids = z - a == d["n"], raw[4 * (a - first) : 4 * (z - first)]
                    for k, v in (("part", part), ("row", d["row"]), ("doc_id", d["doc_id"]), ("at", d["at"]), ("n", d["n"]), ("crc", zlib.crc32(ids) if whole else None), ("place", a), ("piece", None if whole and not with_ids else ids)):
                        out[k].append(v)
            yield out

    pieces = map_batches(chunks, "part int, row long, doc_id long, at long, n long, crc long, place long, piece binary", fn, rows=16)
    held = F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("place", "piece")))
    docs = pieces.groupBy("part", "row").agg(F.first("doc_id").alias("doc_id"), F.first("at").alias("at"), F.first("n").alias("n_tokens"), F.max("crc").alias("crc"), F.array_sort(held).alias("held"))
    joined = F.aggregate("held", F.lit(b""), lambda a, x: F.concat(a, x["piece"]))
    docs = docs.join(small(before), "part").withColumn("ids", joined if with_ids else F.when(F.col("crc").isNull(), joined))
    out = docs.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", F.coalesce("crc", F.crc32("ids")).alias("ids_crc32"), "ids")
    return out if with_ids else out.drop("ids")


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """What a reader needs to find ids: each chunk's part, number, first position, size and plane sizes."""
    return spark.read.schema(CHUNK).parquet(path).select("part", "chunk", "first", "n_ids", "layout", F.transform("planes", F.octet_length).alias("plane_bytes"), F.size("docs").alias("n_docs"))


def new_store(spark: SparkSession) -> str:
    import uuid

    return f"{shared_dir(spark)}/ledgerlake-token-ids-{uuid.uuid4().hex}"
