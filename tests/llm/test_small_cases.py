"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

from doctree_spark.llm import decontamination, fingerprints, licenses, mixing, near_dedup, quality, secrets, suffix_model, token_counts, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "one two three four five six seven eight nine ten " * 2000
ROWS = [
    (1, "a b c d e f g h", "en", "s1", 15), (1, "a b c d e f g h", "en", "s1", 15), (2, None, None, None, None), (3, "", "en", "s2", 0),
    (4, LONG, "en", "s1", len(LONG)), (None, "x y z", None, "s2", 5), (5, "Released under the MIT License.", "en", "", 31), (6, " \n\t ", "en", "s2", 4),
]
EXTRA = {"size": 7, "score": "x", "n_tokens": 1, "spans": 2, "kept": "", "row": 0, "copies": 9, "node": 1, "target": 0}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).withColumns({k: F.lit(v) for k, v in EXTRA.items()})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


def test_licenses(docs, none):
    rows = licenses.scan_licenses(docs).collect()
    assert [(r.doc_id, r.license, r.start, r.end, r.different, r.missing, r.added, r.confirmed) for r in rows] == [(5, "MIT", 0, 30, 0, [], [], True)]
    assert licenses.scan_licenses(none).count() == 0


def test_fingerprints(docs, none):
    got = {r.doc_id: r.sketch for r in fingerprints.fingerprint(docs).collect()}
    assert got[2] == got[3] == got[6] == [] and len(got[None]) == 1 and len(got[4]) > 0
    assert fingerprints.fingerprint(docs).count() == len(ROWS)
    assert fingerprints.fingerprint(none).count() == 0
    assert fingerprints.with_next(none.withColumn("__text", F.col("text")), "doc_id")[0].count() == 0


def test_quality(spark, docs, none):
    rated = spark.createDataFrame([(1, 0), (1, 2), (4, 2), (5, 1), (None, 1), (3, None)], "doc_id long, grade int")
    model = quality.train(docs, rated, 3)
    rows = quality.score(docs, model, 3).collect()
    assert len(rows) == len(ROWS) and all(r.tail[0] >= r.tail[1] for r in rows)
    assert quality.train(none, rated, 3) is None and quality.train(docs, rated.limit(0), 3) is None
    assert quality.select_documents(docs, None, 2, 0.5).count() == len(ROWS)
    assert quality.score(docs, None, 3).filter("score IS NOT NULL").count() == 0
    assert quality.score(none, model, 3).count() == 0
    assert quality.select_documents(docs, model, 2, 0.0).collect() == docs.collect()


def test_mixing(docs, none):
    sized = docs.withColumn("words", F.when(F.col("doc_id") != 2, F.length("text")))
    mixed = mixing.mix(sized, "source", "words", "doc_id")
    assert mixed.count() == len(ROWS) and mixed.filter("copies > 2 OR copies < 0").count() == 0
    assert mixing.with_copies(mixed).columns == sized.columns
    assert mixing.mix(none.withColumn("words", F.lit(1)), "source", "words", "doc_id").count() == 0


def test_warc(spark, docs, none, tmp_path):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") == 3, None).otherwise("http://[bad/\r\nx").alias("url"), F.col("text").alias("html"), "size")
    warc.write_archives(warc.warc_records(pages), str(tmp_path / "a"))
    rows = warc.merge_runs(warc.read_runs(spark, str(tmp_path / "a"))).collect()
    assert sorted((-1 if r.page_id is None else r.page_id, r.record_type, r.refers_to) for r in rows) == [(-1, "response", None), (1, "response", None), (1, "response", None), (2, "response", None), (3, "revisit", 2), (4, "response", None), (5, "response", None), (6, "response", None)]
    assert {r.payload_bytes for r in rows if r.page_id == 4} == {len(LONG)}
    warc.write_archives(warc.warc_records(pages.limit(0)), str(tmp_path / "b"))
    assert warc.merge_runs(warc.read_runs(spark, str(tmp_path / "b"))).count() == 0
    small = warc.warc_records(pages, min_bytes=1).filter(F.col("record").contains("WARC-Type: revisit"))
    assert small.count() == 0


def test_secrets(docs, none):
    assert secrets.scan_secrets(docs).filter(F.size("spans") > 0).count() == 0
    assert secrets.redact_secrets(docs).collect() == docs.collect()
    assert secrets.scan_secrets(none).count() == secrets.redact_secrets(none).count() == 0


def test_token_counts(docs, none):
    path = vocabulary()
    rows = token_counts.count_tokens(docs, path).collect()
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in rows[2:5]] == [(0, 0, False), (0, 0, False), (len(LONG), 20000, True)]
    assert token_counts.count_tokens(none, path).count() == 0


def test_near_dedup(docs, none):
    rows = near_dedup.link(docs).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id) == [(1, 4, 1, True), (1, 4, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 10, 4, True), (5, 1, 5, True), (6, 0, 6, True)]
    assert near_dedup.link(none).count() == 0
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 1
    more = docs.unionByName(docs.filter("doc_id IS NULL")).unionByName(docs.filter("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    assert near_dedup.deduplicated(more).filter("doc_id IS NULL").count() == 1
    assert near_dedup.deduplicated(none).count() == 0


def test_suffix_model(docs, none):
    flagged = docs.withColumn("out", F.coalesce(F.col("doc_id") == 4, F.lit(False)))
    rows = suffix_model.score(flagged, "out").collect()
    assert len(rows) == len(ROWS) and all(r.score < 0 and r.base_score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 6)} == {1}
    assert suffix_model.score(none.withColumn("out", F.lit(False)), "out").count() == 0
    assert suffix_model.score(docs.withColumn("out", F.lit(True)), "out").filter("n_known > 0 OR train_tokens > 0").count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, "a b c d e f g h"), (2, None), (3, ""), (None, "x y z"), (1, "a b c d e f g h")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, items).collect()} == {(1, 1), (None, None)}
    assert decontamination.find_leaks(docs, items.limit(0)).count() == decontamination.find_leaks(none, items).count() == 0
    clean = decontamination.drop_leaks(docs, items)
    assert clean.columns == docs.columns and clean.count() == len(ROWS) - 3
    assert decontamination.drop_leaks(none, items).count() == 0 and decontamination.drop_leaks(docs, items.limit(0)).count() == len(ROWS)


def test_pipeline_stages_keep_columns(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [*ROWS, *((k, f"w{k} some other text that says nothing of use {k * 7} and ends", "en", f"s{k % 3}", 50) for k in range(10, 30))]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(10, 30)] + [(11, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert pipeline.run(spark, str(tmp_path)).columns == docs.columns
