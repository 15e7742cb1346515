"""TF-IDF terms, document classifiers, rankers. Fitted models are checked by rows and by quality in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import candidates, corpus, lines, models
from paperloom.plans import sql as S
from paperloom.plans.base import raw
from paperloom.plans.corpus_queries import labelled
from paperloom.plans.registry import query
from paperloom.session import materialize, table

_TOKENS = "regexp_extract_all(lower(coalesce(raw_text, '')), '[a-z0-9]{2,}')"
_GRAMS = f"SELECT doc_id, label, list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM (SELECT doc_id, label, {_TOKENS} AS w FROM {S.RAW} WHERE label IS NOT NULL)"
_TFIDF = (
    f"WITH docs AS ({_GRAMS}), sizes AS (SELECT label, count(*) AS docs FROM docs GROUP BY 1), n AS (SELECT count(*) AS n FROM docs), "
    "tf AS (SELECT doc_id, label, term, count(*) AS tf FROM (SELECT doc_id, label, unnest(g) AS term FROM docs) GROUP BY ALL), "
    "kept AS (SELECT term, ln((n + 1.0) / (df + 1)) + 1 AS idf FROM (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY 1), n WHERE df >= 2 AND df <= 0.9 * n ORDER BY cf DESC, term LIMIT 5000), "
    "raw AS (SELECT doc_id, label, term, (1 + ln(tf)) * idf AS w FROM tf JOIN kept USING (term)), norm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY 1), "
    "m AS (SELECT label, term, round(sum(w / norm) / any_value(docs), 6) AS mean_tfidf FROM raw JOIN norm USING (doc_id) JOIN sizes USING (label) GROUP BY label, term) "
    "SELECT class, term, round(mean_tfidf, 4) AS mean_tfidf, CAST(r AS INT) AS rank FROM (SELECT label AS class, term, mean_tfidf, row_number() OVER (PARTITION BY label ORDER BY mean_tfidf DESC, term) AS r FROM m) WHERE r <= 10"
)


def _plain(df):
    return df.withColumn("clean_text", F.regexp_replace(F.lower(F.coalesce("raw_text", F.lit(""))), "[^a-z0-9]", " "))


@query(_TFIDF)
def tfidf_top_terms(spark, d):
    return models.top_terms(models.grams(_plain(raw(spark, d)))).withColumn("mean_tfidf", F.round("mean_tfidf", 4))


def _prepared(spark, d):
    df = corpus.stratified_split(corpus.non_empty(corpus.with_clean_text(raw(spark, d))))
    # Features are read by each pass of a fit: computed once.
    df = materialize(df.select("doc_id", "label", "_split", "clean_text"))
    return models.prepare(df)


@query()
def lr_classify(spark, d):
    """Class and confidence of each held-out document by logistic regression."""
    train, held, names, _ = _prepared(spark, d)
    model = models.classifiers(train.count())["LogisticRegression"].fit(train)
    return models.predict(model, held, names).select("doc_id", "_split", F.col("label_name").alias("label"), "predicted_class", "confidence")


@query()
def nb_classify(spark, d):
    train, held, names, _ = _prepared(spark, d)
    model = models.classifiers(train.count())["MultinomialNB"].fit(train)
    return models.predict(model, held, names).select("doc_id", "_split", F.col("label_name").alias("label"), "predicted_class", "confidence")


@query()
def model_comparison(spark, d):
    """Accuracy and F1 of logistic regression and naive Bayes on the validation split, with the best marked."""
    train, held, names, _ = _prepared(spark, d)
    results = materialize(models.compare(train, held.filter("_split = 'val'"), names, ["LogisticRegression", "MultinomialNB"]).drop("train_time_s"))
    best = models.select_best(results).select("model", F.lit(True).alias("best"))
    return results.join(F.broadcast(best), "model", "left").withColumn("best", F.coalesce("best", F.lit(False)))


@query()
def ranker_top1(spark, d):
    """The most probable total of each held-out gold invoice, by a ranker trained on the others."""
    lab = labelled(spark, d)
    docs = raw(spark, d).join(lab.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "raw_text")
    feats = candidates.features(candidates.totals(docs), candidates.exploded_lines(docs), "total_amount")
    rows = feats.join(lab.select("doc_id", "candidate_text", "label"), ["doc_id", "candidate_text"])
    rows = materialize(corpus.group_split(rows))
    model = candidates.train_ranker(rows.filter("_part = 'train'"), "total_amount")
    return candidates.top1(candidates.score(model, rows.filter("_part = 'test'").drop("label"), "total_amount"))


@query()
def line_ranker_top1(spark, d):
    """The most probable total line of each held-out document with words."""
    from paperloom.operators import layout
    from paperloom.plans.base import with_stem

    zoned = layout.zones(layout.to_lines(layout.words(table(spark, d, "ocr_word_boxes"))))
    gold = with_stem(table(spark, d, "gold_dataset").select("file_name", *lines.FIELDS).distinct()).drop("file_name")
    rows = lines.with_features(lines.label_lines(zoned, gold, "file_stem"))
    rows = materialize(corpus.group_split(rows, "file_stem"))
    model = lines.train(rows.filter("_part = 'train'"), "total_amount")
    best = lines.best_lines(model, rows.filter("_part = 'test'"), "file_stem")
    return best.withColumn("total_amount", lines.amount_of(F.col("text")))
