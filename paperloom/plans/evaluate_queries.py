"""Evaluation of extracted fields against gold data."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions.match import match_string
from paperloom.operators import evaluate
from paperloom.plans import sql as S
from paperloom.plans.base import invoices
from paperloom.plans.registry import query
from paperloom.session import table

FIELDS = ["recipient_name", "invoice_number", "total_amount"]


def gold(spark, d):
    return table(spark, d, "gold_dataset").distinct()


def predictions(spark, d):
    """The latest run of each document; of equal times the row that sorts last."""
    t = table(spark, d, "invoice_extractions_ml").distinct()
    order = F.struct("run_ts", *[F.coalesce(c, F.lit("")) for c in FIELDS])
    return t.groupBy("doc_id").agg(F.max(order).alias("o"), F.max_by(F.struct(*FIELDS), order).alias("r")).select("doc_id", "r.*")


def details(spark, d):
    return evaluate.detail(gold(spark, d), predictions(spark, d), "ml", FIELDS)


_PRED = (
    "SELECT doc_id, r.recipient_name, r.invoice_number, r.total_amount FROM (SELECT doc_id, arg_max({'recipient_name': recipient_name, 'invoice_number': invoice_number, 'total_amount': total_amount}, "
    "{'t': run_ts, 'a': coalesce(recipient_name, ''), 'b': coalesce(invoice_number, ''), 'c': coalesce(total_amount, '')}) AS r FROM (SELECT DISTINCT * FROM invoice_extractions_ml) GROUP BY doc_id)"
)
_KEY = r"lower(regexp_replace(regexp_replace(coalesce({0}, ''), '[\s\p{{Z}}]+', ' ', 'g'), '^\s+|\s+$', '', 'g'))"
_G, _P = _KEY.format("g"), _KEY.format("p")
_NUM = r"TRY_CAST(regexp_replace({0}, '[^0-9.]', '', 'g') AS DOUBLE)"
_CORRECT = (
    f"CASE field WHEN 'recipient_name' THEN {_G} <> '' AND {_P} <> '' AND (contains({_G}, {_P}) OR contains({_P}, {_G})) "
    f"WHEN 'invoice_number' THEN ltrim({_G}, '0') <> '' AND ltrim({_G}, '0') = ltrim({_P}, '0') "
    f"ELSE coalesce(abs({_NUM.format('g')} - {_NUM.format('p')}) <= greatest(0.01, 0.01 * abs({_NUM.format('g')})), false) END"
)
_DETAIL = (
    "SELECT 'ml' AS method, doc_id, field, g AS gold, p AS predicted, CAST(" + _CORRECT + " AS INT) AS correct FROM ("
    + " UNION ALL ".join(
        f"SELECT g.doc_id, '{f}' AS field, g.{f} AS g, p.{f} AS p FROM (SELECT DISTINCT * FROM gold_dataset) g LEFT JOIN ({_PRED}) p ON p.doc_id = g.doc_id WHERE g.{f} IS NOT NULL" for f in FIELDS
    )
    + ")"
)


@query(_DETAIL)
def match_detail(spark, d):
    """Recipients match plainly here; accents are folded in ``match_detail_folded``."""
    df = details(spark, d)
    plain = match_string(F.col("gold"), F.col("predicted"), accents=False).cast("int")
    return df.withColumn("correct", F.when(F.col("field") == "recipient_name", plain).otherwise(F.col("correct")))


_ACCENTS = "àáâãäåāăçćčèéêëēėęìíîïīıñńňòóôõöøōőśšşùúûüūůűýÿźżžł", "aaaaaaaaccceeeeeeeiiiiiinnnooooooooosssuuuuuuuyyzzzl"
_FOLDED = "regexp_replace(translate({0}, '" + "', '".join(_ACCENTS) + "'), '[^\\x00-\\x7f]', '', 'g')"
_GF, _PF = _FOLDED.format(_G), _FOLDED.format(_P)
_FOLD_DETAIL = _DETAIL.replace(f"(contains({_G}, {_P}) OR contains({_P}, {_G}))", f"(contains({_G}, {_P}) OR contains({_P}, {_G}) OR contains({_GF}, {_PF}) OR contains({_PF}, {_GF}))")


@query(_FOLD_DETAIL)
def match_detail_folded(spark, d):
    return details(spark, d)


_SUMMARY = (
    f"SELECT method, field, count(*) AS gold_docs, CAST(sum(correct) AS BIGINT) AS correct, round(sum(correct) / count(*), 4) AS accuracy, count(predicted) AS predicted, "
    f"CAST(sum(CAST(coalesce(predicted, '') = '' AS INT)) AS BIGINT) AS missed FROM ({_DETAIL}) GROUP BY method, field"
)


@query(_SUMMARY)
def match_summary(spark, d):
    return evaluate.summary(match_detail(spark, d))


@query(
    f"SELECT method, {', '.join(f"max(CASE WHEN field = '{f}' THEN accuracy END) AS {f}" for f in FIELDS)}, round(avg(accuracy), 4) AS mean_accuracy FROM ({_SUMMARY}) GROUP BY method"
)
def match_pivot(spark, d):
    return evaluate.pivot(match_summary(spark, d), FIELDS)


@query(
    f"SELECT method, coalesce(field, 'OVERALL') AS field, CAST(sum(correct) AS BIGINT) AS correct, count(*) AS total, round(sum(correct) / count(*), 4) AS accuracy FROM ({_DETAIL}) GROUP BY GROUPING SETS ((method, field), (method))"
)
def overall_accuracy(spark, d):
    return evaluate.overall(match_detail(spark, d))


@query("SELECT field, count(v) AS found, count(*) AS total, round(count(v) * 100.0 / count(*), 1) AS pct FROM ("
       + " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS v FROM ({_PRED})" for f in FIELDS) + ") GROUP BY field")
def field_coverage(spark, d):
    return evaluate.coverage(predictions(spark, d), FIELDS)


@query()
def method_comparison(spark, d):
    """Summary of every method against gold."""
    from paperloom.operators import baseline, regex_fields, template

    g = gold(spark, d)
    docs = invoices(spark, d).join(g.select("doc_id").distinct(), "doc_id", "left_semi")
    methods = {"baseline": baseline.extract_fields, "template": template.extract_fields, "v4": lambda x: regex_fields.extract_fields(x, "v4"), "v5": regex_fields.extract_fields}
    out = evaluate.summary(details(spark, d))
    for name, f in methods.items():
        out = out.unionByName(evaluate.summary(evaluate.detail(g, f(docs).select("doc_id", *FIELDS), name, FIELDS)))
    return out


@query()
def version_regressions(spark, d):
    """Fields right in version 4 and wrong in version 5."""
    from paperloom.operators import regex_fields

    g = gold(spark, d)
    docs = invoices(spark, d).join(g.select("doc_id").distinct(), "doc_id", "left_semi")
    one = lambda v: evaluate.detail(g, regex_fields.extract_fields(docs, v).select("doc_id", *FIELDS), v, FIELDS)
    return evaluate.regressions(one("v4"), one("v5"))


_PAIR_CASES = [
    ("Acme Inc", "acme inc", "0012", "12", "2020-01-02", "02/01/2020", "1000", "1005"), ("Peña", "pena sa", "A-1", "a-1", "2023-20-03", "03/20/2023", "1000", "1020"),
    (None, "x", None, "1", None, "2020-01-01", None, "0"), ("", "x", "0", "0", "2020-01-02", "2021-01-02", "0.00", "0.00"),
]
_PAIR_EXPECTED = [(True, True, True, True), (True, True, True, False), (False, False, False, False), (False, False, False, True)]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {a}, {b}, {c}, {e})" for i, (a, b, c, e) in enumerate(_PAIR_EXPECTED)) + ") t(i, string, number, date, amount)")
def matchers(spark, d):
    from paperloom.functions import match as M

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(_PAIR_CASES)], "i int, a string, b string, c string, d string, e string, f string, g string, h string")
    c = F.col
    return df.select("i", M.match_string(c("a"), c("b")).alias("string"), M.match_number(c("c"), c("d")).alias("number"), M.match_date(c("e"), c("f")).alias("date"), M.match_amount(c("g"), c("h")).alias("amount"))
