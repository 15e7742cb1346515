"""Lookups, merges, comparisons, saved models: edge cases with nulls, ties, repeated rows, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom import session
from paperloom.operators import candidates, corpus, evaluate, models, regex_fields
from paperloom.sources import readers, writers


def test_distinct_rows_equals_distinct(spark):
    rows = [(i % 7, None if i % 5 == 0 else f"text {i % 11}", "") for i in range(200)] + [(1000 + i, "once", None) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, `raw.text` string, _h string")
    for limit in (1000, 3):  # below and beyond the number of shared hashes
        got = session.distinct_rows(df, limit)
        assert sorted(map(str, got.collect())) == sorted(map(str, df.distinct().collect()))
    assert session.distinct_rows(df.limit(0)).count() == 0


def test_release_deletes_what_was_written(spark):
    df = session.materialize(spark.range(5))
    assert df.count() == 5
    where = df._written_to
    session.release(df, spark.range(1))
    with pytest.raises(Exception):
        spark.read.parquet(where).count()


def test_text_by_key_or_by_name(spark):
    raw = spark.createDataFrame(
        [("d1", "scan_17_b.png", "one"), ("d1", "scan_17_b.png", "one"), ("d2", "17.png", "two"), ("d3", None, "three"), (None, "x.png", "four"), ("d5", "a.b.png", None)], "doc_id string, file_name string, raw_text string"
    )
    results = spark.createDataFrame([("d1", 1), ("17", 2), ("scan 17", 3), ("7", 4), (None, 5), ("", 6), ("d5", 7), ("a.b", 8)], "doc_id string, n int")
    got = {r.n: (r.raw_text, r.found_by) for r in readers.with_text(results, raw).collect()}
    assert got[1] == ("one", "key") and got[2] == ("two", "name") and got[3] == ("one", "name")
    assert got[4] == got[5] == got[6] == (None, None) and got[7] == (None, "key") and got[8] == (None, "name")
    assert readers.with_text(results.limit(0), raw).count() == 0 and readers.with_text(results, raw.limit(0)).count() == 8


def test_archive_members(spark):
    members = spark.createDataFrame([("a", 5), ("b", 2), ("c", 9), ("b", 7), (None, 1)], "path string, position long")
    wanted = spark.createDataFrame([("a", "form"), ("b", "form"), ("b", "form"), ("z", "email")], "path string, class_name string")
    assert {tuple(r) for r in readers.archive_members(members, wanted).select("path", "position", "class_index").collect()} == {("b", 2, 0), ("a", 5, 1)}


def test_merge_of_rankings(spark):
    base = spark.createDataFrame([("a", "1.00", "x"), ("b", None, "y"), ("c", "3.00", None)], "doc_id string, total_amount string, invoice_number string")
    top = spark.createDataFrame([("a", "9.00", 0.8), ("b", None, 0.1)], "doc_id string, value string, score double")
    got = {r.doc_id: (r.total_amount, r.invoice_number, r.total_amount_score) for r in candidates.merge_top1(base, {"total_amount": top}).collect()}
    assert got == {"a": ("9.00", "x", 0.8), "b": (None, "y", 0.1), "c": ("3.00", None, None)}


def test_comparisons(spark):
    before = spark.createDataFrame([("a", "f", 1), ("b", "f", 0), ("c", "f", 1), ("d", "f", 1)], "doc_id string, field string, correct int")
    after = spark.createDataFrame([("a", "f", 0), ("b", "f", 1), ("c", "f", 1), ("e", "f", 0)], "doc_id string, field string, correct int")
    assert {(r.doc_id, r.change) for r in evaluate.deltas(before, after).collect()} == {("a", -1), ("b", 1)}
    x = spark.createDataFrame([("a", "1", None), ("b", None, "q"), ("c", "3", "r")], "doc_id string, f string, g string")
    y = spark.createDataFrame([("a", "2", None), ("b", "5", None), ("z", "3", "r")], "doc_id string, f string, g string")
    effect = {r.field: r for r in evaluate.override_effect(x, y, ["f", "g"]).collect()}
    assert (effect["f"].docs, effect["f"].gained, effect["f"].lost, effect["f"].changed) == (2, 1, 0, 1) and effect["g"].lost == 1
    assert {(r.doc_id, r.field) for r in evaluate.not_inherited(x, y, ["f", "g"]).collect()} == {("a", "f"), ("b", "g")}
    assert evaluate.override_effect(x.limit(0), y, ["f"]).count() == 0
    lines = spark.createDataFrame([("train", "a", 1), ("train", "a", 0), ("train", "b", 0), (None, "c", 1)], "_split string, doc_id string, y_f int")
    assert {tuple(r) for r in evaluate.label_counts(lines, ["f"]).collect()} == {("train", "f", 2, 3, 1), (None, "f", 1, 1, 1)}


def test_labelling_batches(spark, tmp_path):
    cands = spark.createDataFrame([(f"d{i:02}", "f", f"v{i}") for i in range(7)], "doc_id string, field string, candidate_text string")
    texts = spark.createDataFrame([("d00", "first\nline"), ("d01", None), ("d02", "")], "doc_id string, raw_text string")
    got = {r.doc_id: r for r in corpus.batch_lines(cands, texts, 3).collect()}
    assert got["d00"].line.endswith("context=first line") and got["d01"].line.endswith("context=") and {r.chunk for r in got.values()} == {0, 1, 2}
    assert corpus.labelling_sample(cands, 4).count() == 4 and corpus.labelling_sample(cands, 99).count() == 7
    writers.labelling_batches(corpus.batch_lines(cands, texts, 3), str(tmp_path / "b"))
    assert spark.read.text(str(tmp_path / "b")).count() == 7


@pytest.fixture(scope="module")
def classified(spark):
    rng = random.Random(1)
    words = {"email": "dear regards subject meeting please", "form": "please fill check box signature", "invoice": "total amount due invoice bill"}
    rows = [(f"d{i:03}", label, "train" if i % 4 else "val", " ".join(rng.choice(words[label].split() + "the a of number".split()) for _ in range(12))) for i, label in enumerate(list(words) * 24)]
    return models.prepare(spark.createDataFrame(rows, "doc_id string, label string, _split string, clean_text string"), 60)


def test_all_ten_configurations(classified):
    train, held, names, _ = classified
    rows = {r.model: r.accuracy for r in models.compare(train, held, names, k=8, svm_iterations=20).collect()}
    assert len(rows) == 10 and min(rows.values()) > 0.6, rows


def test_models_are_saved_and_read(spark, classified, tmp_path):
    train, held, names, features = classified
    model = models.classifiers(train.count())["LogisticRegression"].fit(train)
    models.save_model(model, str(tmp_path / "m"))
    back = models.load_model(str(tmp_path / "m"))
    one, two = (sorted(map(tuple, models.predict(m, held, names).select("doc_id", "predicted_class").collect())) for m in (model, back))
    assert one == two
    models.save_features(features, str(tmp_path / "f"))
    again = models.load_features(spark, str(tmp_path / "f"))
    assert again.idf == features.idf and again.counter.vocabulary == features.counter.vocabulary


def test_ranker_uses_the_shape_of_candidates(spark):
    """Two classes of candidates that nothing but their shape tells apart."""
    base = {c: F.lit(0.0) for c in candidates.NUMERIC + candidates.OWN["total_amount"]}
    rows = spark.createDataFrame([(f"d{i}", "00.00" if i % 2 else "0,000.00", "s", float(i % 2), "v") for i in range(40)], "doc_id string, candidate_shape string, candidate_source string, label double, candidate_text string")
    df = rows.withColumns(base)
    got = candidates.score(candidates.train_ranker(df, "total_amount"), df, "total_amount").select("label", "probability_positive").collect()
    assert all((r.probability_positive > 0.5) == (r.label == 1) for r in got)


def test_version_matrix_equals_versions_by_themselves(spark):
    text = "Invoice No: AB-1234 Date: 5 March 2020\nBill To: Anna Berg\nTotal Due: $1,250.00\nDue date: 4/4/2020"
    df = spark.createDataFrame([("a", text), ("b", None), ("c", "")], "doc_id string, raw_text string")
    got = {(r.version, r.doc_id): tuple(r)[2:] for r in regex_fields.version_matrix(df).collect()}
    assert len(got) == 18
    for v in regex_fields.VERSIONS:
        for r in regex_fields.extract_fields(df, v).select("doc_id", *regex_fields.FIELDS).collect():
            assert got[v, r.doc_id] == tuple(r)[1:]


def test_missing_engine_is_an_error(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.png").write_bytes(b"x")
    files = readers.files(spark, str(tmp_path))
    assert readers.extract_text(files.filter("kind = 'text'")).first().raw_text == "hello"
    with pytest.raises(Exception, match="no engine for image"):
        readers.extract_text(files).collect()
