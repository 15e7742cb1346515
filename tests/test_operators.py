import datetime

import pytest
from pyspark.sql import functions as F

from paperloom.operators import baseline, candidates, classify, corpus, evaluate, layout, regex_fields, template
from paperloom.sources import readers, writers

DOC = """Acme Research Laboratories Inc.
12 Long Road
STATEMENT
Invoice No. AB-12345   Date: March 3, 1999
Bill To: Jane Roe
Net 30 days
9 widgets 5.00 45.00
Total amount due $1,345.00
"""


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, raw_text string")


def test_baseline_fields(spark):
    r = baseline.extract_fields(docs(spark, DOC)).first()
    assert (r.invoice_number, r.invoice_date, r.issuer_name, r.total_amount, r.payment_terms) == (
        "AB-12345", "1999-03-03", "Acme Research Laboratories Inc.", "1345.00", "Net 30 days",
    )


@pytest.mark.parametrize("extractor", [baseline.extract_fields, template.extract_fields, regex_fields.extract_fields])
def test_nothing_from_nothing(spark, extractor):
    got = extractor(docs(spark, None, "", "   \n\f ")).select(*baseline.FIELDS).collect()
    assert all(v is None for r in got for v in r)
    assert extractor(docs(spark).limit(0)).count() == 0


def test_v5_fields(spark):
    r = regex_fields.extract_fields(docs(spark, DOC)).first()
    assert (r.invoice_number, r.invoice_date, r.due_date, r.recipient_name, r.total_amount) == ("AB-12345", "1999-03-03", "Net 30 days", "Jane Roe", "1345.00")


def test_versions_3_and_4_agree_on_text(spark):
    rows = regex_fields.version_matrix(docs(spark, DOC), versions=["v3", "v4"]).drop("version").collect()
    assert rows[0] == rows[1]


def test_last_labelled_amount_by_position(spark):
    text = "Total: $10.00\nsubtotal 5.00\nAmount due: 77.00\n$99.00"
    assert regex_fields.extract_fields(docs(spark, text)).first().total_amount == "77.00"


def test_classifier_defaults(spark):
    r = classify.keyword_classify(docs(spark, None)).first()
    assert r.predicted_class == "form" and r.confidence == {"email": 0.25, "form": 0.25, "invoice": 0.25, "receipt": 0.25}


def test_classifier_keeps_other_columns(spark):
    df = docs(spark, DOC).withColumn("score", F.lit(1)).withColumn("count", F.lit("x"))
    r = classify.extraction_gate(df).first()
    assert r.run_extraction and r["score"] == 1 and r["count"] == "x"


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, None, "y"), (4, None, "z")], "id int, k string, v string")
    assert sorted(r.id for r in corpus.keep_first(df, "k", "id").collect()) == [1, 3]
    assert sorted(r.id for r in corpus.keep_last(df, "k", "id").collect()) == [2, 4]


def test_split_sizes_and_hot_class(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 900, "hot").when(F.col("id") < 990, "cold").alias("label"))
    n = {(r.label, r._split): r["count"] for r in corpus.stratified_split(df).groupBy("label", "_split").count().collect()}
    assert (n["hot", "train"], n["hot", "val"], n["hot", "test"]) == (630, 135, 135)
    assert n[None, "train"] == 7
    assert corpus.stratified_split(df).select("doc_id").distinct().count() == 1000


def test_running_index_counts_up(spark):
    df = spark.range(500).select(F.format_string("n%03d", "id").alias("name"), F.lit("c").alias("g"))
    got = corpus.running_index(df, ["g"], ["name"], F.substring("name", 1, 2)).orderBy("name").collect()
    assert [r["rank"] for r in got] == list(range(500))


def test_label_lines_and_overwrite(spark):
    lines = spark.createDataFrame([("doc_id=a | field=f | candidate_text=x | y | label=1",), ("noise",), (None,)], "value string")
    got = corpus.parse_label_lines(lines).collect()
    assert [tuple(r) for r in got] == [("a", "f", "x | y", 1)]
    cands = spark.createDataFrame([("a", "f", "x | y", 0), ("b", "f", "q", None)], "doc_id string, field string, candidate_text string, label int")
    assert {r.doc_id: r.label for r in corpus.overwrite_labels(cands, corpus.parse_label_lines(lines)).collect()} == {"a": 1, "b": None}


def test_absent_documents_count_as_wrong(spark):
    gold = spark.createDataFrame([("a", "Acme", None), ("b", "Beta", "7")], "doc_id string, recipient_name string, invoice_number string")
    pred = spark.createDataFrame([("a", "ACME Inc", None)], "doc_id string, recipient_name string, invoice_number string")
    d = {(r.doc_id, r.field): r.correct for r in evaluate.detail(gold, pred, "m", ["recipient_name", "invoice_number"]).collect()}
    assert d == {("a", "recipient_name"): 1, ("b", "recipient_name"): 0, ("b", "invoice_number"): 0}


def test_metrics_of_empty_class(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "a")], "label string, predicted_class string")
    m = {r["class"]: r for r in evaluate.class_metrics(evaluate.confusion(df, ["a", "b", "c"])).collect()}
    assert (m["a"].precision, m["a"].recall, m["b"].recall, m["c"].f1) == (1.0, 0.5, 0.0, 0.0)


WORDS = "file_stem string, text string, left_px int, top_px int, width int, height int, conf double, block_num int, par_num int, line_num int, word_num int"


def words(spark, *rows):
    return spark.createDataFrame(list(rows), WORDS)


def test_words_lines_and_gaps(spark):
    w = layout.words(
        words(
            spark,
            ("d", "Vendor:", 10, 100, 60, 10, 90.0, 1, 1, 1, 1), ("d", "Vendor:", 10, 100, 60, 10, 90.0, 1, 1, 1, 1), ("d", "Acme", 400, 102, 40, 10, None, 1, 1, 1, 2),
            ("d", "Trading", 445, 101, 50, 10, 80.0, 1, 1, 1, 3), ("d", None, 1, 1, 1, 1, 1.0, 1, 1, 1, 4), ("d", " ", 1, 1, 1, 1, 1.0, 1, 1, 1, 5),
        )
    )
    line = layout.to_lines(w).first()
    assert (line.text, line.left, line.right, line.top) == ("Vendor: Acme Trading", 10, 495, 100)
    assert [r.text for r in layout.gap_split(w).orderBy("line_idx").collect()] == ["Vendor:", "Acme Trading"]
    assert layout.band_issuer(layout.gap_split(w)).first().issuer_name == "Acme Trading"


def test_layout_of_no_words(spark):
    zoned = layout.zones(layout.to_lines(layout.words(spark.createDataFrame([], WORDS))))
    assert layout.issuer(zoned).count() == layout.total(zoned).count() == 0


def test_candidates(spark):
    d = docs(spark, DOC, None)
    assert ("d0", "1345.00") in {(r.doc_id, r.candidate_text) for r in candidates.totals(d).collect()}
    assert "AB-12345" in {r.candidate_text for r in candidates.numbers(d).collect()}
    f = candidates.features(candidates.totals(d), candidates.exploded_lines(d), "total_amount")
    candidates.check_features(f, "total_amount")
    with pytest.raises(ValueError):
        candidates.check_features(f.drop("line_rel_pos"), "total_amount")


def test_ranker_finds_totals(spark):
    d = docs(spark, *[f"Acme Inc {i}\nItem 3 {i + 20}.50\nTotal amount due {i * 3 + 100}.00\n" for i in range(40)])
    f = candidates.features(candidates.totals(d), candidates.exploded_lines(d), "total_amount")
    f = f.withColumn("label", (F.col("candidate_source") == "money_total_line").cast("int"))
    part = corpus.group_split(f)
    model = candidates.train_ranker(part.filter("_part = 'train'"), "total_amount")
    top = candidates.top1(candidates.score(model, part.filter("_part = 'test'"), "total_amount")).collect()
    assert top and all(r.value == f"{int(r.doc_id[1:]) * 3 + 100}.00" for r in top)


def test_sources(spark, tmp_path):
    box = spark.createDataFrame([("f", 0, "1,2,3,4,5,6,7,8,TOTAL, 5"), ("f", 1, "bad line"), ("f", 2, "1,2,3,4,5,6,7,8,PAID")], "file_name string, line_idx int, line string")
    assert readers.box_file_text(box).first().raw_text == "TOTAL, 5 PAID"
    meta = readers.label_metadata(spark.createDataFrame([("a/b.tif 11",), ("c.tif 4",), ("x",), ("d.tif q",)], "value string")).collect()
    assert [(r.path, r.class_name) for r in meta] == [("images/a/b.tif", "invoice")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello\nworld")
    (tmp_path / "in" / "b.png").write_bytes(b"png")
    files = readers.files(spark, str(tmp_path / "in"))
    assert {(r.file_name, r.kind) for r in files.select("file_name", "kind").collect()} == {("a.txt", "text"), ("b.png", "image")}
    assert readers.extract_text(files).first().raw_text == "hello\nworld"
    readers.register_engine("image", lambda b: f"{len(b)} bytes")
    try:
        assert {r.raw_text for r in readers.extract_text(files).collect()} == {"hello\nworld", "3 bytes"}
    finally:
        readers.ENGINES.clear()
    truth = readers.ground_truth(spark.createDataFrame([('{"a.pdf": {"total_amount": "5", "due_date": null}}',)], "value string"))
    res = spark.createDataFrame([("a_2.pdf", "total_amount")], "file_name string, field string")
    assert readers.with_truth(res, truth).first().gold == "5"


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("d1", 'line one\nsays "x", y', None)], "doc_id string, raw_text string, label string")
    writers.csv(df, str(tmp_path / "c"))
    assert readers.csv(spark, str(tmp_path / "c"), df.schema).collect() == df.collect()
    writers.report(df.groupBy("doc_id").count(), str(tmp_path / "r.md"), "Counts")
    assert "| d1 | 1 |" in (tmp_path / "r.md").read_text()
    writers.json_records(df, str(tmp_path / "j"), ["label"])
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def test_run_result_of_empty_text(spark):
    df = classify.extraction_gate(docs(spark, None).withColumn("file_name", F.lit("f"))).withColumn("extracted_fields", F.lit(None).cast("struct<a:string>"))
    assert '"error":"no text"' in writers.run_result(df).first().result


def test_streams(spark, tmp_path):
    from paperloom.streaming import documents, events

    rows = [(i, datetime.datetime(2024, 1, 1, i % 5, 3), 1, "a", 1.5) for i in range(20)]
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    ev.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    q = events.hourly_counts_stream(stream).writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("hourly").collect()} == {tuple(r) for r in events.hourly_counts(ev).collect()}

    d = docs(spark, DOC, None, "From: a\nTo: b\nSubject: x")
    d.write.parquet(str(tmp_path / "docs"))
    source = documents.read_documents(spark, str(tmp_path / "docs"), d.schema)
    documents.write_results(documents.gated(source), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {tuple(r) for r in out.select("doc_id", "predicted_class").collect()} == {tuple(r) for r in documents.gated(d).select("doc_id", "predicted_class").collect()}


def test_fields_from_rows(spark):
    from paperloom.operators import regex_fields, rows

    r = spark.createDataFrame(
        [
            ("d", 0, 10, 5, "Acme Trading Company"), ("d", 1, 40, 5, "Invoice No: AB-7781"), ("d", 2, 60, 5, "Invoice Date"), ("d", 3, 80, 5, "March 3, 1999"),
            ("d", 4, 100, 5, "Due Date 4/5/1999 or 6/7/1999"), ("d", 5, 120, 5, "Bill To: Jane Roe"), ("d", 6, 900, 5, "Total amount due $1,345.00"),
        ],
        "file_stem string, line_idx int, top int, left int, text string",
    )
    assert rows.number(r).first().invoice_number == "AB-7781"
    assert rows.invoice_date(r).first().invoice_date == "1999-03-03"
    assert rows.due_date(r).first().due_date == "1999-06-07"
    assert rows.recipient(r).first().recipient_name == "Jane Roe"
    assert rows.issuer(r).first().issuer_name == "Acme Trading Company"
    df = regex_fields.extract_fields(spark.createDataFrame([("d", "hello there"), ("e", None)], "file_stem string, raw_text string"))
    got = {x.file_stem: x for x in rows.rescue(df, r).collect()}
    assert (got["d"].invoice_number, got["d"].total_amount, got["d"].recipient_name) == ("AB-7781", "1345.00", "Jane Roe")
    assert got["e"].invoice_number is None and got["e"].issuer_name is None
    assert rows.recipient(r.limit(0)).count() == 0


def test_rows_without_an_amount(spark):
    """A document without amounts has no total (a null in %.2f isn't written out), so its text can be completed too."""
    from paperloom.operators import regex_fields, rows

    r = spark.createDataFrame(
        [("a", 0, 0, 5, "Total due now"), ("a", 1, 50, 5, "no figures"), ("b", 0, 0, 5, "Total 12.50"), ("c", 0, 0, 5, "nothing here")],
        "file_stem string, line_idx int, top int, left int, text string",
    )
    assert [tuple(x) for x in layout.rows_total(r).collect()] == [("b", "12.50")]
    df = spark.createDataFrame([("a", "Total amount due $45.00"), ("b", "Total amount due $3.00"), ("c", "hello there")], "file_stem string, raw_text string")
    got = {x.file_stem: x.total_amount for x in rows.rescue(regex_fields.extract_fields(df), r).collect()}
    assert got == {"a": "45.00", "b": "12.50", "c": None}


def test_classes_are_predicted_once(spark):
    """Filters on the class don't move into the scan, where each use of a score would search the text again."""
    df = docs(spark, "Invoice no 7", "Invoice no 8", "From: a", None).withColumn("label", F.expr("CASE doc_id WHEN 'd0' THEN 'invoice' WHEN 'd1' THEN 'email' WHEN 'd2' THEN 'form' END"))
    scored = classify.keyword_classify(df)
    searches = lambda x: x._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")
    once = searches(scored.select("predicted_class"))
    wrong = evaluate.misclassified(scored.select("doc_id", "label", "predicted_class"))
    assert {tuple(r) for r in wrong.collect()} == {("d1", "email", "invoice"), ("d2", "form", "email")} and searches(wrong) == once
    pairs = evaluate.confusion_pairs(scored)
    assert [tuple(r) for r in pairs.collect()] == [("email", "invoice", 1), ("form", "email", 1)] and searches(pairs) == once


def test_required_literals(spark):
    from paperloom.functions.text import count_of
    from paperloom.operators import patterns, rules

    assert rules.required(r"\b(from|to|cc|bcc)\s*:") == ["bcc", "cc", "from", "to"] and rules.required(r"_{3,}|\[[\s]*\]") == ["[", "___"]
    assert rules.required(r"\b(qty|quantity)\b") == ["ty", "uantity"] and rules.required(r"\d{2}:?") == rules.required("(?i)bill") == rules.required(r"(a|\d)b?") == rules.required(r"\p{L}x") == []
    every = [x for k in patterns.KEYWORDS.values() for x in k]
    bits = ["to :", "re:", "a@b.de", "please\u00a0sign", "check one", "part 7", "____", "[ ]", "invoice #", "net 30", "store #", "qty", "quantity", "tax", "12/12/99 10:10", "tobcc", "İnvoice", "social security"]
    df = docs(spark, *bits, " ".join(bits), "", None)
    r = df.select(*[(count_of(F.col("raw_text"), p) * w - rules.weighted_count(F.col("raw_text"), [(p, w)])).alias(f"d{i}") for i, (p, w) in enumerate(every)]).collect()
    assert all(v == 0 for x in r for v in x)


def test_tfidf_by_hand(spark):
    from math import log

    from paperloom.operators import models

    df = spark.createDataFrame([("a", "x", "red red blue"), ("b", "x", "blue sky"), ("c", "y", "green sky")], "doc_id string, label string, clean_text string")
    g = models.grams(df)
    assert g.filter("doc_id = 'a'").first().grams == ["red", "red", "blue", "red red", "red blue"]
    feats = models.fit_features(g, min_df=1.0, max_df=1.0)
    i = feats.counter.vocabulary.index("red")
    assert abs(feats.idf[i] - (log(4 / 2) + 1)) < 1e-9
    v = feats.transform(g).filter("doc_id = 'a'").first().features
    assert abs(sum(x * x for x in v.toArray()) - 1) < 1e-9


def test_line_ranker_pieces(spark):
    from paperloom.operators import lines

    df = spark.createDataFrame([("Total: $1.871,86 or 12.00",), ("Invoice # AB-99",), ("Bill to:  Acme |",), (None,)], "t string")
    c = F.col("t")
    got = df.select(lines.amount_of(c), lines.number_of(c), lines.party_of(c)).collect()
    assert got[0][0] == "12.00" and got[1][1] == "AB-99" and got[2][2] == "Acme"
    assert tuple(got[3]) == (None, None, None)
    z = spark.createDataFrame([("d", 1, 1, 1, "Acme Inc", 0.1, 0.1)], "file_stem string, block_num int, par_num int, line_num int, text string, x_rel double, y_rel double")
    gold = spark.createDataFrame([("d", "Acme", None, None)], "file_stem string, recipient_name string, invoice_number string, total_amount string")
    r = lines.label_lines(z, gold, "file_stem").first()
    assert (r.y_recipient_name, r.y_total_amount) == (1, 0)


def test_lexicon_flags_of_all_names(spark, tmp_path):
    import re

    from paperloom.functions import text as X
    from paperloom.plans import registry

    names = ["Société Générale Group", "Labsé", "élabs", "Acme\xa0Ltd.", "LTD\xa0Ünal", "Straße Road", "Drü", "Иванов Center", "Аcme Inc", "ΔInc", "Purchase Order Ωmega", "Total é", "Plain Services", "", " ", "a\nInc"]
    spark.createDataFrame([(n,) for n in names * 2 + [None]], "issuer_name string").write.parquet(f"{tmp_path}/invoice_extractions_ml.parquet")
    got = sorted(tuple(r) for r in registry.QUERIES["lexicon_flags_all"](spark, str(tmp_path)).collect())
    assert got == sorted((n, *(int(bool(re.search(p, n, re.I))) for p in (X.ORG_SUFFIX, X.ADDRESS_WORD, X.LABEL_WORD))) for n in names)


def test_line_ranker_query_trains_on_the_operators_vocabulary(spark, monkeypatch):
    from paperloom.operators import lines
    from paperloom.plans import registry

    models, train = [], lines.train
    monkeypatch.setattr(lines, "train", lambda *a, **k: models.append(train(*a, **k)) or models[-1])
    registry.QUERIES["line_ranker_top1"](spark, "/root/testdata/sf0.001")
    assert [m.stages[0].getOrDefault("vocabSize") for m in models] == [40_000]


def test_models_are_compared_on_validation_only(spark, monkeypatch):
    from paperloom.operators import models
    from paperloom.plans import registry

    seen, compare = [], models.compare
    monkeypatch.setattr(models, "compare", lambda train, held, *a: seen.append({r[0] for r in held.select("_split").distinct().collect()}) or compare(train, held, *a))
    assert registry.QUERIES["model_comparison"](spark, "/root/testdata/sf0.001").filter("best").count() == 1
    assert seen == [{"val"}]
