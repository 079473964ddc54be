"""The pipeline on tables with null ids, without documents, without labels and without a benchmark."""

from __future__ import annotations

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BODY = ["one two three four five six seven eight nine ten " + " ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "bravo", "carol", "delta")]


def folder(spark, tmp_path, docs, labels, items):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("case", ["null ids", "no documents", "no labels"])
def test_pipeline_edges(spark, tmp_path, case):
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(BODY)] + [(None, BODY[0] + " tail", "en", None, 9), (None, None, None, None, None), (7, "", "en", "s", 0)]
    labels = [(0, 1, 0), (1, 1, 0), (2, 1, 0), (None, 0, 1)]
    at = folder(spark, tmp_path, [] if case == "no documents" else docs, [] if case == "no labels" else labels, [(1, " ".join(BODY[3].split()[12:40]))])
    rows = corpus_pipeline.run(spark, at).collect()
    if case == "no documents":
        assert rows == []
    else:
        ids = [r["doc_id"] for r in rows]
        assert 3 not in ids and {1, 2} <= set(ids) and 7 not in ids  # contaminated, clean, empty
        assert all(r["taken"] > 0 and r["text"] for r in rows)
