"""The pipeline's stages against plain versions of their rules, each on its own input."""

import corpus_pipeline as C
from pyspark.sql import functions as F

from .test_documents import DATA, brute_classes, brute_hits, brute_substrings, check_packing


def test_stages(spark, tmp_path):
    docs, steps = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in C.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        steps.append((name, docs, spark.read.parquet(str(tmp_path / name))))
        docs = steps[-1][2]
    assert [s[0] for s in steps] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "packing"]
    text = lambda d: {r.doc_id: r.text for r in d.collect()}
    for _, before, after in steps[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    a, b = text(steps[0][1]), text(steps[0][2])
    assert b == {i: t for i, t in a.items() if any(c.isalpha() for c in t or "")}
    a, b = b, text(steps[1][2])
    classes = brute_classes(sorted(a.items()))
    assert b == {i: t for i, t in a.items() if classes[i] == i} and len(b) < len(a)
    a, b = b, text(steps[2][2])
    want = {i: (n, gone) for i, n, gone, _ in brute_substrings(sorted(a.items()), 50)}
    assert {i: len(t.split()) for i, t in b.items()} == {i: n - gone for i, (n, gone) in want.items()}
    assert all(b[i] == a[i] for i, (_, gone) in want.items() if not gone)
    assert steps[2][2].where(F.col("n_chars") != F.length("text")).count() == steps[2][1].where(F.col("n_chars") != F.length("text")).count()
    a, b = b, text(steps[3][2])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert b == {i: t for i, t in a.items() if not brute_hits(t, items)[-1]}
    packed = [r.asDict() for r in steps[4][2].collect()]
    assert {r["doc_id"] for r in packed} == set(b) and check_packing(packed, 4096) == -(-sum(r["length"] for r in packed) // 4096)


def test_run_equals_its_stages(spark):
    got = C.run(spark, DATA)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 100
