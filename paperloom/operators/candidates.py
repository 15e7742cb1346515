"""Candidate values of a field, their features, and the ranking of candidates.

Lines are exploded with their neighbours from the array they stand in, so context needs no window and no join. Features
are declared columns; numeric and categorical ones are listed, never inferred.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import amounts
from paperloom.functions import text as X
from paperloom.operators import baseline as B
from paperloom.operators import patterns as P
from paperloom.operators.rules import any_of

# Fixed values.
_LABELS = r"(?:\bbill\s*to\b|\bsold\s*to\b|\bship(?:ped)?\s*to\b|^to\s*:?\s*$|\battn\b|\battention\b)"
_BAD_RECIPIENT = [
    r"^\s*(remit to|client copy|explanation|reference|purchase order|po number|invoice|date|terms|amount|total)\b",
    r"^\s*(attention|attn)\s*:?\s*$",
    r"^\s*(accounting|issued|number|final)\s*$",
    r"\b(net\s+\d+|cash\s+\d+\s+days|due upon receipt)\b",
    r"^\s*\W*\s*$",
]
_BAD_NUMBER = ["date", "amount", "number", "purchase", "final", "issued", "invoice", "reference", "total"]
_TOTAL_LINE = r"\b(total|amount due|balance due|net amount|this bill total)\b"


def bad_recipient(c: Column) -> Column:
    return (F.length(c) < 4) | (X.token_count(c) > 10) | (X.digits(c) > 6) | any_of(c, _BAD_RECIPIENT)


def bad_number(c: Column) -> Column:
    return (
        F.lower(c).isin(_BAD_NUMBER)
        | ~F.length(c).between(4, 24)
        | ~c.rlike(r"\d")
        | c.rlike(r"^\d{4}$")
        | c.rlike(r"^[A-Z]?\d{3,4}$")
        | c.rlike(r"(?U)[^\w\-/]")
    )


def exploded_lines(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """One row a line: line_idx, line, prev_line, next_line, n_lines and the document's own features."""
    df = df.withColumn("_ls", X.lines(F.col(text)))
    df = df.withColumns(
        {
            "invoice_like_score": B.invoice_like(F.col(text)),
            "ocr_quality_score": B.ocr_quality(F.col(text)),
            "doc_num_chars": F.length(X.empty(F.col(text))),
            "doc_num_lines": F.size("_ls"),
        }
    )
    ls = F.col("_ls")
    rows = F.transform(
        ls, lambda x, i: F.struct(i.alias("line_idx"), x.alias("line"), X.empty(F.get(ls, i - 1)).alias("prev_line"), X.empty(F.get(ls, i + 1)).alias("next_line"))
    )
    return df.select(*[c for c in df.columns if c != "_ls"], F.explode(rows).alias("_l")).select("*", "_l.*").drop("_l", text)


def recipients(df: DataFrame, text: str = "raw_text", key: str = "doc_id") -> DataFrame:
    """(key, candidate_source, line_idx, candidate_text): lines after labels, early organisations, attention lines."""
    ls = X.lines(F.col(text))
    df = df.select(key, ls.alias("ls"))
    ls = F.col("ls")
    stop = r"\b(invoice|date|terms|amount|total|qty|quantity|description)\b"

    def block(x: Column, i: Column) -> Column:
        following = F.transform(F.slice(ls, i + 2, 5), lambda y, j: F.struct((i + 1 + j).alias("i"), y.alias("t")))
        first_stop = F.coalesce(F.array_min(F.transform(F.filter(following, lambda y: X.has(y["t"], stop)), lambda y: y["i"])), F.lit(1 << 30))
        return F.when(X.has(x, _LABELS), F.filter(following, lambda y: y["i"] < first_stop)).otherwise(F.array().cast("array<struct<i:int,t:string>>"))

    numbered = F.transform(ls, lambda x, i: F.struct(i.alias("i"), x.alias("t")))
    early = F.filter(
        F.slice(numbered, 1, 25),
        lambda x: X.token_count(x["t"]).between(2, 10) & (X.digits(x["t"]) <= 6) & (X.has(x["t"], X.ORG_SUFFIX) | X.has(x["t"], r"\b(to|client|customer)\b")),
    )
    attention = F.filter(F.slice(numbered, 1, 30), lambda x: X.has(x["t"], r"\b(attn|attention)\b"))
    sources = [("after_label", F.flatten(F.transform(ls, block))), ("early_org_line", early), ("attention_line", attention)]
    each = F.concat(*[_tag(arr, name, k) for k, (name, arr) in enumerate(sources)])
    cands = df.select(key, F.explode(each).alias("c")).select(key, "c.*").filter(~bad_recipient(F.col("candidate_text")))
    # Within a source the order of generation decides, which _pos holds.
    order = F.struct("_source_order", "_pos")
    row = F.struct("candidate_source", "line_idx", "candidate_text")
    return cands.groupBy(key, F.lower("candidate_text").alias("_t")).agg(F.min_by(row, order).alias("r")).select(key, "r.*")


def _tag(arr: Column, name: str, k: int) -> Column:
    return F.transform(
        arr,
        lambda x, j: F.struct(
            F.lit(name).alias("candidate_source"), F.lit(k).alias("_source_order"), x["i"].alias("line_idx"), j.alias("_pos"), x["t"].alias("candidate_text")
        ),
    )


def numbers(df: DataFrame, text: str = "raw_text", key: str = "doc_id") -> DataFrame:
    """(key, candidate_source, line_idx, candidate_text): labelled codes, then code-like tokens of labelled lines."""
    rows = exploded_lines(df.select(key, text), text).filter("line_idx < 40").select(key, "line_idx", "line")
    line = F.col("line")
    labelled = F.concat(*[F.regexp_extract_all(line, F.lit(f"(?iU){p}"), F.lit(1)) for p in P.BASELINE_NUMBER])
    tokens = F.when(
        X.has(line, r"\b(invoice|reference|file|document|doc)\b"),
        F.filter(F.regexp_extract_all(line, F.lit(r"(?iU)\b([A-Z0-9][A-Z0-9\-/]{3,24})\b"), F.lit(1)), B.valid_number),
    ).otherwise(F.array().cast("array<string>"))
    tag = lambda arr, name, k: F.transform(arr, lambda x, j: F.struct(F.lit(name).alias("candidate_source"), (F.lit(k * 1000) + j).alias("_pos"), X.strip(x).alias("candidate_text")))
    each = F.concat(tag(labelled, "labeled", 0), tag(tokens, "invoiceish_line_token", 1))
    cands = rows.select(key, "line_idx", F.explode(each).alias("c")).select(key, "line_idx", "c.*").filter(~bad_number(F.col("candidate_text")))
    row = F.struct("candidate_source", "line_idx", "candidate_text")
    return cands.groupBy(key, F.lower("candidate_text").alias("_t")).agg(F.min_by(row, F.struct("line_idx", "_pos")).alias("r")).select(key, "r.*")


def totals(df: DataFrame, text: str = "raw_text", key: str = "doc_id") -> DataFrame:
    """(key, candidate_source, line_idx, candidate_text): amounts with cents, or any on total lines."""
    rows = exploded_lines(df.select(key, text), text).select(key, "line_idx", "line")
    low = F.lower("line")
    totalish = X.has(low, _TOTAL_LINE)
    source = F.when(X.has(low, P.STRONG_TOTAL), "money_total_line").when(X.has(low, r"\btotal\b"), "money_totalish_line").otherwise("money_anywhere")
    raw = F.regexp_extract_all("line", F.lit(P.AMOUNT), F.lit(1))
    each = rows.withColumns({"candidate_source": source, "_t": totalish}).select(key, "line_idx", "candidate_source", "_t", F.posexplode(raw).alias("_pos", "_raw"))
    each = each.withColumn("candidate_text", amounts.normalise(F.col("_raw"))).filter("candidate_text IS NOT NULL")
    each = each.filter(F.col("_t") | ((F.col("candidate_text").cast("double") >= 10) & F.col("_raw").contains(".")))
    row = F.struct("candidate_source", "line_idx", "candidate_text")
    return each.groupBy(key, "candidate_text").agg(F.min_by(row, F.struct("line_idx", "_pos")).alias("r")).select(key, "r.*")


NUMERIC = [
    "line_idx", "line_rel_pos", "line_token_count", "candidate_len", "candidate_token_count", "candidate_digit_count", "candidate_alpha_count",
    "candidate_digit_ratio", "candidate_uppercase_ratio", "candidate_has_org_suffix", "candidate_has_address_word", "candidate_has_label_word",
    "line_has_colon", "line_is_upper", "line_digit_ratio", "line_has_dollar", "line_has_org_suffix", "line_has_address_word", "line_has_label_word",
    "is_top_10_lines", "is_top_20_lines", "is_bottom_half", "is_bottom_quarter", *X.CONTEXT_FLAGS, "invoice_like_score", "ocr_quality_score",
    "doc_num_lines", "doc_num_chars",
]
CATEGORICAL = ["candidate_source", "candidate_shape"]
RARE = 1e-3  # categories of a smaller share of the labelled rows are one


def features(cands: DataFrame, lines: DataFrame, field: str, key: str = "doc_id") -> DataFrame:
    """Candidates with the common features and those of the field. ``lines``: ``exploded_lines`` of the same documents."""
    df = cands.join(lines, [key, "line_idx"]).withColumn("field", F.lit(field))
    c, line, i, n = F.col("candidate_text"), F.col("line"), F.col("line_idx"), F.col("doc_num_lines")
    df = df.withColumns(
        {
            "line_rel_pos": X.rel_pos(i, n),
            "line_token_count": X.token_count(line),
            "candidate_len": F.length(c),
            "candidate_token_count": X.token_count(c),
            "candidate_digit_count": X.digits(c),
            "candidate_alpha_count": X.letters(c),
            "candidate_digit_ratio": X.digit_ratio(c),
            "candidate_uppercase_ratio": X.uppercase_ratio(c),
            "candidate_has_org_suffix": X.flag(c, X.ORG_SUFFIX),
            "candidate_has_address_word": X.flag(c, X.ADDRESS_WORD),
            "candidate_has_label_word": X.flag(c, X.LABEL_WORD),
            "candidate_shape": X.word_shape(c),
            "line_has_colon": line.contains(":").cast("int"),
            "line_is_upper": X.is_upper(line).cast("int"),
            "line_digit_ratio": X.digit_ratio(line),
            "line_has_dollar": line.contains("$").cast("int"),
            "line_has_org_suffix": X.flag(line, X.ORG_SUFFIX),
            "line_has_address_word": X.flag(line, X.ADDRESS_WORD),
            "line_has_label_word": X.flag(line, X.LABEL_WORD),
            "is_top_10_lines": (i < 10).cast("int"),
            "is_top_20_lines": (i < 20).cast("int"),
            "is_bottom_half": (i >= F.greatest(F.lit(1), F.floor(n / 2))).cast("int"),
            "is_bottom_quarter": (i >= F.greatest(F.lit(1), F.floor(0.75 * n))).cast("int"),
            **X.context_flags(line, F.col("prev_line"), F.col("next_line")),
        }
    )
    own = {
        "recipient_name": {
            "recipient_like_person_prefix": X.flag(c, r"^(mr|mrs|ms|dr)\.?\b"),
            "recipient_like_attention": X.flag(c, r"\b(attn|attention)\b"),
            "recipient_looks_address_only": ((F.col("candidate_has_address_word") == 1) & (F.col("candidate_has_org_suffix") == 0)).cast("int"),
            "recipient_digit_heavy": (X.digits(c) >= 5).cast("int"),
        },
        "invoice_number": {
            "inv_has_digit": X.flag(c, r"\d"),
            "inv_has_dash": c.contains("-").cast("int"),
            "inv_has_slash": c.contains("/").cast("int"),
            "inv_all_capsish": (F.upper(c) == c).cast("int"),
            "inv_valid_by_rules": F.coalesce(B.valid_number(c), F.lit(False)).cast("int"),
            "inv_short_code": c.rlike(r"^[A-Z]?\d{3,4}$").cast("int"),
        },
        "total_amount": {
            "amt_value": F.coalesce(c.try_cast("double"), F.lit(-1.0)),
            "amt_ge_100": (c.try_cast("double") >= 100).cast("int"),
            "amt_ge_1000": (c.try_cast("double") >= 1000).cast("int"),
            "amt_line_has_total": X.flag(line, r"\btotal\b"),
            "amt_line_has_amount_due": X.flag(line, P.STRONG_TOTAL),
            "amt_line_dot_leader_heavy": (X.count_of(line, r"\.") > 8).cast("int"),
        },
    }[field]
    return df.withColumns(own).drop("line", "prev_line", "next_line")


OWN = {
    "recipient_name": ["recipient_like_person_prefix", "recipient_like_attention", "recipient_looks_address_only", "recipient_digit_heavy"],
    "invoice_number": ["inv_has_digit", "inv_has_dash", "inv_has_slash", "inv_all_capsish", "inv_valid_by_rules", "inv_short_code"],
    "total_amount": ["amt_value", "amt_ge_100", "amt_ge_1000", "amt_line_has_total", "amt_line_has_amount_due", "amt_line_dot_leader_heavy"],
}


def check_features(df: DataFrame, field: str) -> None:
    """A scorer without the columns it was trained on would predict nothing; fail loudly instead."""
    missing = [c for c in NUMERIC + CATEGORICAL + OWN[field] if c not in df.columns]
    if missing:
        raise ValueError(f"features of {field} are missing: {missing}")


def _prepared(df: DataFrame, field: str) -> DataFrame:
    numeric = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in NUMERIC + OWN[field]}
    return df.withColumns({**numeric, **{c: F.coalesce(c, F.lit("__MISSING__")) for c in CATEGORICAL}})


def train_ranker(labelled: DataFrame, field: str) -> PipelineModel:
    """Logistic regression with balanced class weights on rows with a label; shapes seen rarely share a category."""
    check_features(labelled, field)
    df = _prepared(labelled.filter("label IS NOT NULL"), field).withColumn("label", F.col("label").cast("double"))
    counts = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    total = sum(counts.values())
    weight = F.lit(1.0)
    for k, n in counts.items():
        weight = F.when(F.col("label") == k, total / (len(counts) * n)).otherwise(weight)
    coded, hot_columns = [f"_i_{c}" for c in CATEGORICAL], [f"_h_{c}" for c in CATEGORICAL]
    # A share of the rows, so that the categories kept don't grow with the data; the rest are one category.
    common = {c: {r[0] for r in df.groupBy(c).count().filter(F.col("count") >= max(2, RARE * total)).collect()} for c in CATEGORICAL}
    rows = df.withColumns({c: F.when(F.col(c).isin(list(common[c])), F.col(c)) for c in CATEGORICAL if common[c]}).withColumn("_w", weight)
    index = StringIndexer(inputCols=CATEGORICAL, outputCols=coded, handleInvalid="keep", stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCols=coded, outputCols=hot_columns, handleInvalid="keep")
    gather = VectorAssembler(inputCols=[*NUMERIC, *OWN[field], *hot_columns], outputCol="features", handleInvalid="keep")
    lr = LogisticRegression(maxIter=200, regParam=1.0 / max(total, 1), standardization=True, weightCol="_w")
    return Pipeline(stages=[index, hot, gather, lr]).fit(rows)


def score(model: PipelineModel, df: DataFrame, field: str) -> DataFrame:
    """Adds ``probability_positive``."""
    check_features(df, field)
    out = model.transform(_prepared(df, field))
    return out.withColumn("probability_positive", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction", *[f"{p}{c}" for p in ("_i_", "_h_") for c in CATEGORICAL])


def top1(scored: DataFrame, threshold: float = 0.3, key: str = "doc_id", probability: str = "probability_positive", order: str = "line_idx") -> DataFrame:
    """(key, value, score): the most probable candidate of a document, the first on ties, if it reaches the threshold."""
    k = F.struct((-F.col(probability)).alias("p"), F.col(order), F.col("candidate_text"))
    best = scored.groupBy(key).agg(F.min_by("candidate_text", k).alias("value"), F.max(probability).alias("score"))
    return best.withColumn("value", F.when(F.col("score") >= threshold, F.col("value")))


def merge_top1(base: DataFrame, ranked: dict[str, DataFrame], key: str = "doc_id") -> DataFrame:
    """The baseline's result with the fields of rankers: a ranked value, where there is one, replaces the baseline's.

    Adds ``<field>_score``; documents without candidates keep the baseline's value.
    """
    out = base
    for field, top in ranked.items():
        best = top.select(key, F.col("value").alias("_v"), F.col("score").alias(f"{field}_score"))
        out = out.join(best, key, "left").withColumn(field, F.coalesce("_v", field)).drop("_v")
    return out
