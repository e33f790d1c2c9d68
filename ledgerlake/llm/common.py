"""What the corpus operators share: table access, shared scratch tables, sizes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, importable, shared_dir, small, stash, unstash

__all__ = ["BROADCAST_ROWS", "Own", "dropped_by_others", "map_batches", "shared_dir", "small", "stash", "table", "unstash"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


class Own:
    """A table's columns under names that no operator uses, but for those that it reads; ``back`` names them as they were."""

    def __init__(self, df: DataFrame, *read: str) -> None:
        self.columns = df.columns
        self.names = {c: c if c in read else f"own_{k}" for k, c in enumerate(df.columns)}
        self.df = df.toDF(*self.names.values())

    def back(self, df: DataFrame, *made: str | Column) -> DataFrame:
        return df.select(*[F.col(self.names[c]).alias(c) for c in self.columns], *made)


#: What workers keep from batch to batch, as functions that drop it, and the module whose tasks a worker ran last.
_DROPS: list[Callable[[], None]] = []
_last = [""]


def dropped_by_others(drop: Callable[[], None]) -> None:
    """Have ``drop`` called where a worker process starts on another operator's tasks: memos of several don't add up."""
    _DROPS.append(drop)


def _starts(fn: Callable) -> None:
    module = getattr(fn, "func", fn).__module__
    if _last[0] != module:
        for drop in _DROPS:
            drop()
        _last[0] = module


def map_batches(
    df: DataFrame, schema: str, fn: Callable[[Iterator[dict[str, list]]], Iterable[dict[str, list]]], rows: int = 512
) -> DataFrame:
    """``mapInArrow`` with columns as Python lists, at most ``rows`` rows at a time, so that a batch of long texts stays small."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _starts(fn)

        def lists() -> Iterator[dict[str, list]]:
            for b in batches:
                for at in range(0, b.num_rows, rows):
                    part = b.slice(at, rows)
                    yield {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}

        for out in fn(lists()):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
