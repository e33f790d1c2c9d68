"""Publications: immutable versions of a set of tables, and the pointer that names the current one.

Tables are Parquet, a folder for each publication. Nothing is current until the
pointer's row is written, which is the last step; a job that dies before leaves
rows that no reader looks at.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``rows`` has each table's number of rows, ``configuration`` the fingerprint of the text that it was built by.
PUBLICATIONS = "publication_id long, recipe string, label string, built_at timestamp, configuration string, rows map<string,long>"
MOVES = "move long, from_id long, to_id long, moved_at timestamp"
#: After a restore ids go on at the next multiple of this (fixed value).
BOUNDARY = 1_000_000
#: Seconds after which a move whose file has no content was left by a job that died.
ABANDONED = 600


class NothingPublished(LookupError):
    pass


class PublicationUnavailable(LookupError):
    pass


class PointerMoved(RuntimeError):
    """Somebody else moved the pointer since this job last read it; what it wrote isn't current."""


def pointer(moves: DataFrame, *by: str) -> DataFrame:
    """``current, previous`` of a log of pointer moves: the last move's ends."""
    last = F.max_by(F.struct("to_id", "from_id"), "move").alias("m")
    rows = moves.groupBy(*by).agg(last)
    return rows.select(*by, F.col("m.to_id").alias("current"), F.col("m.from_id").alias("previous")).where("current is not null")


def stale(publications: DataFrame, moves: DataFrame) -> DataFrame:
    """Publications that are neither current, nor previous, nor labelled."""
    kept = pointer(moves).select(F.explode(F.array("current", "previous")).alias("publication_id"))
    return publications.where("label is null").join(kept, "publication_id", "left_anti")


@dataclass
class Catalog:
    spark: SparkSession
    root: str

    def _log(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    @property
    def publications(self) -> DataFrame:
        return self._log("publications", PUBLICATIONS)

    def readable(self) -> DataFrame:
        """Publications that can still be opened: those that retention hasn't deleted, with whether they are current."""
        gone = self._log("deleted", "publication_id long")
        last = self._last()
        now = F.lit(last["to_id"] if last else None).cast("long")
        return self.publications.join(gone, "publication_id", "left_anti").withColumn("is_current", F.coalesce(F.col("publication_id") == now, F.lit(False)))

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    @property
    def moves(self) -> DataFrame:
        """Moves that are made; one whose file is still without content isn't."""
        path, fs = self._path("pointer_moves")
        if not fs.exists(path):
            return self.spark.createDataFrame([], MOVES)
        return self.spark.read.schema(MOVES).json(str(path))

    def _last(self):
        return self.moves.orderBy(F.desc("move")).limit(1).first()

    def current(self) -> int:
        last = self._last()
        if last is None:
            raise NothingPublished
        return last["to_id"]

    def _move(self, to: int, last) -> None:
        """Point to ``to`` if the pointer is still where ``last`` left it: a move's file is named by its number, and can be made once.

        A file without content after ``ABANDONED`` seconds was left by a job that
        died; its number is passed over.
        """
        folder, fs = self._path("pointer_moves")
        fs.mkdirs(folder)
        now, number = time.time(), last["move"] + 1 if last else 1
        while True:
            path, _ = self._path("pointer_moves", f"{number:012d}.json")
            if not fs.exists(path):
                break
            status = fs.getFileStatus(path)
            if status.getLen() or now - status.getModificationTime() / 1000 < ABANDONED:
                raise PointerMoved(f"move {number} is made")
            number += 1
        try:
            out = fs.create(path, False)
        except Py4JJavaError as error:
            raise PointerMoved(f"move {number} is made") from error
        row = {"move": number, "from_id": last["to_id"] if last else None, "to_id": to, "moved_at": datetime.now(UTC).isoformat(timespec="seconds")}
        out.write(bytearray(json.dumps(row).encode()))
        out.close()

    def publish(self, tables: dict[str, DataFrame], recipe: str, label: str | None = None, partitions: dict[str, list[str]] | None = None, configuration: str | None = None) -> int | None:
        """Write a new publication and point to it; None, and nothing written, if the current one has the same recipe.

        ``partitions``: columns by which a table's files are dealt out. A publisher
        takes its id by making a folder that nobody else can make, so two that run at
        once get two ids; the one that is done later finds that the pointer has moved
        (``PointerMoved``), as what it was built on isn't current any more.
        ``configuration`` is stored once, by its fingerprint.
        """
        last = self._last()
        if last is not None and not self.publications.where((F.col("publication_id") == last["to_id"]) & (F.col("recipe") == recipe)).isEmpty():
            return None
        top = self.publications.agg(F.max("publication_id")).first()[0]
        new = max(top or 0, self._boundary()) + 1
        while not self._taken(new):
            new += 1
        rows = {}
        for name, df in tables.items():
            by, path = (partitions or {}).get(name, []), f"{self.root}/{name}/publication_id={new}"
            if by:
                df = df.repartition(*by)
            df.write.partitionBy(*by).parquet(path)
            rows[name] = self.spark.read.parquet(path).count()  # from the files' footers
        kept = None if configuration is None else self._keep(configuration)
        made = self.spark.createDataFrame([(new, recipe, label, kept, rows)], "publication_id long, recipe string, label string, configuration string, rows map<string,long>").withColumn("built_at", F.current_timestamp())
        made.coalesce(1).write.mode("append").parquet(f"{self.root}/publications")
        self._move(new, last)
        return new

    def _keep(self, configuration: str) -> str:
        """Store a configuration's text under its hash, unless it is there."""
        name = hashlib.sha256(configuration.encode()).hexdigest()
        path, fs = self._path("configurations", name)
        if not fs.exists(path):
            part, _ = self._path("configurations", f".{name}-{uuid.uuid4().hex}")
            out = fs.create(part, False)
            out.write(bytearray(configuration.encode()))
            out.close()
            fs.rename(part, path)
        return name

    def configuration(self, publication_id: int) -> str | None:
        """The text that a publication was built by, if it was given."""
        row = self.publications.where(F.col("publication_id") == publication_id).first()
        if row is None:
            raise PublicationUnavailable(publication_id)
        if row["configuration"] is None:
            return None
        path, _ = self._path("configurations", row["configuration"])
        return bytes(self.spark.read.format("binaryFile").load(str(path)).first()["content"]).decode()

    def _taken(self, publication_id: int) -> bool:
        """Whether this publisher got the id: a file that exists isn't made again."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/taken/{publication_id}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.createNewFile(path)

    def _boundary(self) -> int:
        found = self._log("recovery_boundaries", "boundary long").agg(F.max("boundary")).first()[0]
        return (found or 1) - 1

    def restore_boundary(self) -> int:
        """After a restore: ids continue at the next multiple of ``BOUNDARY``, so none is used twice."""
        top = self.publications.agg(F.max("publication_id")).first()[0] or 0
        at = (top // BOUNDARY + 1) * BOUNDARY
        self.spark.createDataFrame([(at,)], "boundary long").coalesce(1).write.mode("append").parquet(f"{self.root}/recovery_boundaries")
        return at

    def read(self, name: str, publication_id: int | None = None) -> DataFrame:
        """One publication's table; readers bind one id and see no other."""
        k = self.current() if publication_id is None else publication_id
        if self.publications.where(F.col("publication_id") == k).isEmpty():
            raise PublicationUnavailable(k)
        path = f"{self.root}/{name}/publication_id={k}"
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            raise PublicationUnavailable(k)
        return self.spark.read.parquet(path)

    def undo(self) -> int:
        """Point back to where the last move came from."""
        last = self._last()
        if last is None or last["from_id"] is None:
            raise NothingPublished
        self._move(last["from_id"], last)
        return last["from_id"]

    def stale(self) -> list[int]:
        """Publications that are neither current, nor previous, nor labelled."""
        return sorted(r[0] for r in stale(self.readable(), self.moves).select("publication_id").collect())

    def retain(self, tables: list[str]) -> list[int]:
        """Delete the stale publications' folders; their rows in the log stay, and ``deleted`` names them first."""
        gone = self.stale()
        if gone:
            self.spark.createDataFrame([(k,) for k in gone], "publication_id long").coalesce(1).write.mode("append").parquet(f"{self.root}/deleted")
        for k in gone:
            for name in tables:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/publication_id={k}")
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        return gone


def fingerprint(df: DataFrame, *by: str) -> DataFrame:
    """``rows, fingerprint``, for each of ``by``: a hash of the rows that doesn't depend on their order, nor on columns' order."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])), 256)
    half = lambda a: F.conv(F.substring("h", a, 15), 16, 10).cast("decimal(20,0)")
    sums = df.select(*by, row.alias("h")).groupBy(*by).agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(half(a)), F.lit(0)).cast("string").alias(f"s{a}") for a in (1, 16, 31, 46)])
    return sums.select(*by, "rows", F.sha2(F.concat_ws("|", "rows", "s1", "s16", "s31", "s46"), 256).alias("fingerprint"))
