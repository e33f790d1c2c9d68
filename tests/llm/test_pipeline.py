from collections import defaultdict

import corpus_pipeline as cp
from ledgerlake.llm import decontaminate, line_dedup

SF = "/root/testdata/sf0.001"


def test_stages_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    ids, columns = {r["doc_id"]: r["text"] for r in docs.collect()}, docs.columns
    for k, (_, stage) in enumerate(cp.STAGES[:4]):
        out = stage(spark, docs, SF)
        assert out.columns == columns
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        assert set(got) <= set(ids) and got
        if k == 1:
            want = line_dedup.brute_force(ids)
            assert got == {i: t for i, t in want.items() if t == ids[i] or (t or "").strip()}
        elif k == 3:
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(got) == {i for i, t in ids.items() if decontaminate.reference(t, items)[1] == 0}
        ids = got
        docs = spark.createDataFrame(out.collect(), out.schema)
    packed, bins = cp.STAGES[4][1](spark, docs, SF).collect(), defaultdict(int)
    for r in packed:
        bins[r["sequence_id"]] += r["length"]
    assert {r["doc_id"] for r in packed} == set(ids) and max(bins.values()) <= 2048


def test_run(spark):
    assert cp.run(spark, SF).count() > 0
    assert cp.ORACLE_SQL is None
