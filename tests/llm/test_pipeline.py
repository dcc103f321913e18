"""The pipeline's stages on a small table: what goes, what stays, and the columns in between."""

import corpus_pipeline
from scorelens.llm import packing


def test_stages(spark, tmp_path):
    prose = "The quiet river ran past the old stone house while rain fell on the cold windows and nobody in the village spoke {}."
    rows = [(k, prose.format(w) + f"\nOnly document number {w} has this line of words.", "en", "s", 0)
            for k, w in enumerate(["slowly", "aloud", "softly in the evening hours", "again before the long winter came"])]
    rows += [(10, "too short", "en", "s", 0), (11, None, None, None, None), (12, rows[0][1], "en", "s", 0),
             (13, "Another tale of ships and harbours told by men who had never seen the sea nor heard of it but token = abcdefgh12345", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns, name
    got = {r["doc_id"]: r for r in left.collect()}
    assert 10 not in got and 11 not in got and {0, 13} <= set(got)
    assert "[SECRET]" in got[13]["text"] and all(r["n_chars"] == len(r["text"]) for r in got.values())
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in final.collect()} == set(got)
    assert final.count() == packing.pieces(left).count()


def test_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
