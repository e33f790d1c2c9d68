"""Handles from an index of ids against handles among all ids."""

import random
import re
import zlib

from ledgerlake.operators import finding
from ledgerlake.plans.handle_index import HandleIndex


def plain(ids, least):
    prefixes = lambda x: [x[:n] for n in range(least, len(x) + 1)] or [x]
    return {x: next((p for p in prefixes(x) if not any(y != x and y.startswith(p) for y in ids)), x) for x in ids}


def test_handles_of_hits(spark, tmp_path):
    rng = random.Random(5)
    ids = {"".join(rng.choice("ab") for _ in range(rng.randint(2, 12))) for _ in range(300)}
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "transaction_id string")
    want = plain(ids, 4)
    index = HandleIndex(spark, str(tmp_path / "ids"), least=4, buckets=7)
    assert index.handles(frame(["abab"])).count() == 0
    ordered = sorted(ids)
    index.add(frame([*ordered[:200], ordered[0], None]))
    index.add(frame(ordered[150:]))
    index.add(frame(ordered))
    index.add(frame([]))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "ids")).select("id").collect()) == ordered
    hits = [*ordered[::9], ordered[0], "not-kept", None]
    for got in (index.handles(frame(hits)), finding.handles_of(frame(hits), frame(ordered), least=4)):
        assert sorted(map(tuple, got.collect())) == [(x, want[x]) for x in ordered[::9]]


def test_only_folders_of_hits_are_read(spark, tmp_path):
    ids = spark.range(5000).selectExpr("sha2(string(id), 256) AS transaction_id")
    index = HandleIndex(spark, str(tmp_path / "ids"), buckets=64)
    index.add(ids)
    one = ids.orderBy("transaction_id").limit(1)
    bucket = zlib.crc32(one.first()[0][:8].encode()) % 64
    near = index.near(one)
    assert re.search(rf"PartitionFilters: \[[^]]*\(bucket#\d+ = {bucket}\)\]", near._jdf.queryExecution().executedPlan().toString())
    assert near.collect() == one.collect()
