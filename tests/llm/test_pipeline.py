"""The five stages, one after another, on a small table."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_pass_documents_on(spark, docs, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "pii", "mixing", "packing"]
    before, counts = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == docs.columns
        counts.append(out.count())
        before = out
    assert counts[0] < docs.count() and counts[1] < counts[0] and counts[2] == counts[1]
    mixed = Counter(r.doc_id for r in spark.read.parquet(str(tmp_path / "mixing")).collect())
    packed = Counter(r.doc_id for r in before.filter("piece = 0").collect())
    assert mixed == packed


def test_run_equals_the_stages(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    a = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "length", "ids_crc32")
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"again-{name}"))
        now = spark.read.parquet(str(tmp_path / f"again-{name}"))
    assert Counter(map(tuple, a.collect())) == Counter(tuple(r) for r in now.select("doc_id", "piece", "length", "ids_crc32").collect())


def test_stages_keep_clashing_columns(spark, docs, empty, tmp_path):
    odd = docs.limit(60).withColumns({"__id": F.lit(1), "__key": F.lit(2), "a.b": F.lit("x"), "row": F.lit(3), "draw": F.lit(4), "kept": F.lit(True), "language": F.lit("y")})
    none = empty
    for name, stage in corpus_pipeline.STAGES[:-1]:
        odd_out, none = stage(spark, odd, str(tmp_path)), stage(spark, none, str(tmp_path))
        assert odd_out.columns == odd.columns and none.columns == empty.columns and none.count() == 0
        rows = odd_out.select("__id", "__key", "`a.b`", "row", "draw", "kept", "language").distinct().collect()
        assert [tuple(r) for r in rows] == [(1, 2, "x", 3, 4, True, "y")], name


def test_stages_leave_no_tables_of_earlier_ones(spark, docs, tmp_path):
    from pathlib import Path

    from terravote.llm import common

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    corpus_pipeline.run(spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    left = {name: paths for name, paths in common._tables.items() if paths and name.split()[0] in corpus_pipeline.NAMES}
    # What the last stage reads, the result of the one before, and its own tables.
    assert set(left) == {"packing tables", "mixing result"}
    assert all(Path(p.removeprefix("file:")).exists() for paths in left.values() for p in paths)
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
