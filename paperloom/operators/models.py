"""Document classifiers on TF-IDF: features, ten model configurations, training, selection.

TF-IDF is word 1-2-grams, sublinear, smoothed as ln((n+1)/(df+1)) + 1, of unit length, fitted on the training split.
The vocabulary is bounded by a parameter. Everything is a pipeline of distributed stages.
"""

from __future__ import annotations

import time
from math import log

import numpy as np
import pandas as pd

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA, CountVectorizer, CountVectorizerModel, ElementwiseProduct, Normalizer, RegexTokenizer, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.mllib.linalg import Vectors as OldVectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.operators import evaluate
from paperloom.session import materialize

VOCABULARY = 5000


def grams(df: DataFrame, text: str = "clean_text") -> DataFrame:
    """Adds ``grams``: words of two characters and more, and pairs of neighbours."""
    tokens = RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"(?U)\b\w\w+\b", gaps=False).transform(df)
    pairs = F.zip_with(F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(0))), F.slice("_w", 2, F.greatest(F.size("_w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return tokens.withColumn("grams", F.concat("_w", pairs)).drop("_w")


def char_grams(df: DataFrame, text: str, least: int = 3, most: int = 5) -> DataFrame:
    """Adds ``grams``: all substrings of ``least`` to ``most`` characters."""
    t = F.lower(F.col(text))
    parts = [
        F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
        for n in range(least, most + 1)
    ]
    return df.withColumn("grams", F.concat(*parts))


class Features:
    """Fitted vocabulary and frequencies."""

    def __init__(self, counter, idf: list[float]):
        self.counter, self.idf = counter, idf

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``features``."""
        df = self.counter.transform(df)
        tf = array_to_vector(F.transform(vector_to_array("counts"), lambda c: F.when(c > 0, 1 + F.log(c)).otherwise(0.0)))
        df = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="_tf", outputCol="_tfidf").transform(df.withColumn("_tf", tf))
        return Normalizer(inputCol="_tfidf", outputCol="features", p=2.0).transform(df).drop("counts", "_tf", "_tfidf")


def fit_features(train: DataFrame, size: int = VOCABULARY, min_df: float = 2.0, max_df: float = 0.9) -> Features:
    """From documents with ``grams``."""
    counter = CountVectorizer(inputCol="grams", outputCol="counts", vocabSize=size, minDF=min_df, maxDF=max_df).fit(train)
    # Document frequencies of the bounded vocabulary only.
    n = train.count()
    known = train.sparkSession.createDataFrame([(t,) for t in counter.vocabulary], "term string")
    found = train.select(F.explode(F.array_distinct("grams")).alias("term")).join(F.broadcast(known), "term", "left_semi")
    df = dict(found.groupBy("term").agg(F.count("*").alias("n")).collect())
    return Features(counter, [log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in counter.vocabulary])


def _reduce_pca(k: int):
    return PCA(k=k, inputCol="features", outputCol="reduced")


class Svd:
    """Truncated singular value decomposition."""

    def __init__(self, k: int):
        self.k = k

    def fit(self, df: DataFrame) -> "Svd":
        rows = df.select("features").rdd.map(lambda r: OldVectors.fromML(r[0]))
        v = RowMatrix(rows).computeSVD(self.k, computeU=False).V
        self.components = DenseMatrix(v.numRows, v.numCols, v.toArray().ravel(order="F"))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.components.toArray())

        @F.pandas_udf("array<double>")
        def project(rows: pd.Series) -> pd.Series:
            return pd.Series(list(np.stack(rows.to_numpy()) @ shared.value)) if len(rows) else rows

        return df.withColumn("reduced", array_to_vector(project(vector_to_array("features"))))


def classifiers(n: int, seed: int = 42, svm_iterations: int = 2000) -> dict:
    """Estimators by name, for ``n`` training rows."""
    lr = lambda col: LogisticRegression(family="multinomial", featuresCol=col, regParam=1.0 / max(n, 1), standardization=False, maxIter=1000)
    rf = lambda col: RandomForestClassifier(featuresCol=col, numTrees=100, seed=seed)
    svm = lambda col: OneVsRest(featuresCol=col, classifier=LinearSVC(featuresCol=col, regParam=1.0 / max(n, 1), maxIter=svm_iterations, tol=1e-4))
    nb = NaiveBayes(featuresCol="features", modelType="multinomial", smoothing=1.0)
    plain = {"LogisticRegression": lr("features"), "RandomForest": rf("features"), "LinearSVM": svm("features"), "MultinomialNB": nb}
    return {**plain, **{f"{m}-{r}": f("reduced") for r in ("PCA", "SVD") for m, f in (("LR", lr), ("RF", rf), ("SVM", svm))}}


def prepare(df: DataFrame, size: int = VOCABULARY) -> tuple[DataFrame, DataFrame, list[str], Features]:
    """Training and other rows with ``features`` and ``label_index``; class names; features. Needs clean_text, label, _split."""
    df = grams(df.filter("label IS NOT NULL"))
    train = df.filter("_split = 'train'")
    feats = fit_features(train, size)
    index = StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="skip").fit(train)
    out = index.transform(feats.transform(df)).withColumnRenamed("label", "label_name").withColumn("label", F.col("label_index"))
    return out.filter("_split = 'train'"), out.filter("_split <> 'train'"), index.labels, feats


def predict(model, df: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``predicted_class`` and, where the model has probabilities, ``confidence`` (four places)."""
    out = model.transform(df)
    labels = F.array(*[F.lit(x) for x in names])
    out = out.withColumn("predicted_class", F.get(labels, F.col("prediction").cast("int")))
    if "probability" in out.columns:
        p = vector_to_array("probability")
        return out.withColumn("confidence", F.map_from_arrays(labels, F.transform(p, lambda x: F.round(x, 4))))
    return out.withColumn("confidence", F.create_map("predicted_class", F.lit(1.0)))


def compare(train: DataFrame, held: DataFrame, names: list[str], only: list[str] | None = None, k: int = 150, svm_iterations: int = 2000) -> DataFrame:
    """(model, accuracy, macro_f1, weighted_f1, train_time_s): every configuration on the held rows."""
    spark = train.sparkSession
    n = train.count()
    # Not more components than there are features or documents.
    width = len(train.select(vector_to_array("features")).first()[0]) if n else 0
    k = min(k, width - 1, n - 1)
    reducers = {}
    out = None
    for name, estimator in classifiers(n, svm_iterations=svm_iterations).items():
        if only and name not in only:
            continue
        a, b = train, held
        if "-" in name:
            r = name.split("-")[1]
            if r not in reducers:
                reducers[r] = (_reduce_pca(k) if r == "PCA" else Svd(k)).fit(train)
            a, b = reducers[r].transform(train), reducers[r].transform(held)
        began = time.time()
        model = estimator.fit(a)
        took = time.time() - began
        scored = predict(model, b, names).select(F.col("label_name").alias("label"), "predicted_class")
        row = evaluate.averages(evaluate.confusion(scored, names)).withColumns({"model": F.lit(name), "train_time_s": F.lit(round(took, 3))})
        out = row if out is None else out.unionByName(row)
    return out if out is not None else spark.createDataFrame([], "model string")


def select_best(results: DataFrame) -> DataFrame:
    """The model with the greatest macro F1, by name on ties."""
    return results.orderBy(F.desc("macro_f1"), "model").limit(1)


def cross_validate(df: DataFrame, estimator, names: list[str], folds: int = 5, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """(fold, accuracy): folds by hash of the key."""
    fold = F.conv(F.substring(F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string"))), 1, 6), 16, 10).cast("long") % folds
    df = df.withColumn("_fold", fold)
    out = None
    for i in range(folds):
        model = estimator.fit(df.filter(F.col("_fold") != i))
        scored = predict(model, df.filter(F.col("_fold") == i), names)
        row = scored.agg(F.lit(i).alias("fold"), F.round(F.avg((F.col("label_name") == F.col("predicted_class")).cast("int")), 4).alias("accuracy"))
        out = row if out is None else out.unionByName(row)
    return out


def top_terms(df: DataFrame, per_class: int = 10, min_df: int = 2, max_df: float = 0.9, size: int = VOCABULARY, grouped: str = "label") -> DataFrame:
    """(class, term, mean_tfidf, rank): terms with the greatest mean TF-IDF in each class, relationally.

    Terms are kept by document frequency and bounded by total count; ties go by term.
    """
    # Written once: exploding an array that is still an expression computes it several times.
    docs = materialize(df.select("doc_id", grouped, "grams").filter(F.col(grouped).isNotNull()))
    sizes = docs.groupBy(grouped).agg(F.count("*").alias("docs"))
    n = sizes.agg(F.sum("docs")).first()[0] or 0
    # Read for the frequencies, the norms and the means: counted once. Documents are dealt out whole, so that their
    # grams are counted where they are and not shuffled one by one; in a stated number of parts, which adaptive
    # execution would make too few of, as it sees the arrays' size and not the work of exploding them.
    parts = max(docs.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism)
    tf = materialize(docs.repartition(parts, "doc_id").select("doc_id", grouped, F.explode("grams").alias("term")).groupBy("doc_id", grouped, "term").agg(F.count("*").alias("tf")))
    frequency = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    kept = frequency.orderBy(F.desc("cf"), "term").limit(size).withColumn("idf", F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1)
    raw = tf.join(F.broadcast(kept.select("term", "idf")), "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    by_class = raw.join(norm, "doc_id").groupBy(grouped, "term").agg(F.sum(F.col("w") / F.col("norm")).alias("s"))
    means = by_class.join(F.broadcast(sizes), grouped).withColumn("mean_tfidf", F.round(F.col("s") / F.col("docs"), 6))
    rank = F.row_number().over(Window.partitionBy(grouped).orderBy(F.desc("mean_tfidf"), "term"))
    return means.withColumn("rank", rank).filter(F.col("rank") <= per_class).select(F.col(grouped).alias("class"), "term", "mean_tfidf", "rank")


# Saving ------------------------------------------------------------------------------------------------------------


def save_features(features: Features, path: str) -> None:
    """The vocabulary with its frequencies below ``path``."""
    features.counter.write().overwrite().save(f"{path}/counter")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(i, float(x)) for i, x in enumerate(features.idf)], "i int, idf double").write.mode("overwrite").parquet(f"{path}/idf")


def load_features(spark: SparkSession, path: str) -> Features:
    idf = [r.idf for r in spark.read.parquet(f"{path}/idf").orderBy("i").collect()]  # bounded by the vocabulary
    return Features(CountVectorizerModel.load(f"{path}/counter"), idf)


def save_model(model, path: str) -> None:
    """A fitted classifier or ranker; a pipeline of one where it is no pipeline."""
    (model if isinstance(model, PipelineModel) else PipelineModel([model])).write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
