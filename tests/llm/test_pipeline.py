import corpus_pipeline
from tidewright.llm.common import stored


def test_stages(spark, documents, tmp_path):
    rows = [(i, f"Dies ist der Text Nummer {i} und er hat noch mehr Wörter {i * 7} als genug.\nKopf der Seite", "de", "a") if i % 2 else (i, f"This is the text number {i} and it has more words {i * 7} than needed.\nPage header", "en", "b") for i in range(80)]
    rows += [(200, rows[0][1], "en", "b"), (201, None, None, "a"), (202, "123 456", "en", "b")]
    documents(rows, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = seen[name] = stored(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns or name == "packing"
    ids = {k: {r["doc_id"] for r in df.collect()} for k, df in seen.items()}
    assert ids["language_id"] == {*range(80), 200}
    assert not any("header" in r["text"] or "Kopf" in r["text"] for r in seen["line_dedup"].collect())
    assert 0 in ids["simhash_near_dedup"] and 200 not in ids["simhash_near_dedup"]
    assert ids["mixing"] <= ids["simhash_near_dedup"] and ids["packing"] == ids["mixing"]
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, seen["packing"].collect()))


def test_stages_with_odd_rows_and_further_columns(spark, documents, tmp_path):
    """Clashing names, nulls in any column, a long text, repeated rows, and no rows at all."""
    rows = [(i, f"This is the text number {i} and it has more words {i * 7} than needed.\nPage header", None if i % 9 == 0 else "en", None if i % 7 == 0 else "b") for i in range(60)]
    rows += [(100, None, None, None), (101, "", "en", "b"), (102, "long words " * 30_000, "en", "b"), (5, rows[5][1], "en", "b"), (None, rows[6][1], "en", "b")]
    names = {"kind": "score", "a": "lang_pred", "row": "__copies", "n": "__s"}
    for table, empty in ((documents(rows), False), (documents([]), True)):
        docs = table.withColumnsRenamed(names)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, str(tmp_path)))
            assert docs.columns == columns or name == "packing"
            assert docs.isEmpty() == empty
