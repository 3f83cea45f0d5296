"""The pipeline's stages on a small fixture."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from tests.llm.test_corpus import DOCS, corpus, groups_of, shingles


def test_stages_follow_each_other(spark, tmp_path):
    spark.createDataFrame(corpus(), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(27, 1), (30, 0), (33, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        seen.append(name)
        if name != "packing":
            assert docs.columns == columns
        if name == "toxicity":
            assert set(after) <= set(before)
        if name == "near_duplicates":
            label = dict(zip(((r.doc_id, r.text) for r in before), groups_of(before), strict=True))
            assert set(Counter(label[(r.doc_id, r.text)] for r in after if shingles(r.text)).values()) == {1}
        if name == "personal_data":
            assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
        if name == "mixing":
            words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows)
            assert abs(words(after) - 1.5 * words(before)) <= 40
    assert seen == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == Counter(
        tuple(r)[:5] for r in after
    )


def test_stages_stand_any_column_names_and_an_empty_table(spark, tmp_path):
    clashing = ["_toxicity", "_key", "_again", "_spans", "_text", "_size", "_taken", "_copy"]
    docs = spark.createDataFrame([(*r, *range(8)) for r in corpus()[:40]], DOCS + "".join(f", {c} int" for c in clashing))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(27, 1), (30, 0), (33, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == docs.columns and {tuple(r)[-8:] for r in after.collect()} == {tuple(range(8))}
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0
