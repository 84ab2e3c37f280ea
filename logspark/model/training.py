"""Training: n-gram vocabularies, IDF, balanced logistic regression over grouped folds, export as JSON."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector, SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import features, normalize_extended
from ..functions.normalize import EXTENDED
from .evaluate import confusion
from .scoring import LineModel
from .tokens import char_ngrams, word_ngrams


def idf(rows: DataFrame, tokens: str, vocabulary: Sequence[str]) -> list[float]:
    """ln((1 + n) / (1 + df)) + 1 for each entry of the vocabulary."""
    n = rows.count()
    vocab = rows.sparkSession.createDataFrame([(g, i) for i, g in enumerate(vocabulary)], "g string, i int")
    df = rows.select(F.explode(F.array_distinct(tokens)).alias("g")).join(F.broadcast(vocab), "g").groupBy("i").count()  # the vocabulary's size is a parameter
    found = {r["i"]: r["count"] for r in df.collect()}
    return [math.log((1 + n) / (1 + found.get(i, 0))) + 1 for i in range(len(vocabulary))]


def _weighted(column: str, weights: list[float], sublinear: bool):
    """Counts as a normalised TF-IDF vector."""

    @F.udf(VectorUDT())
    def f(v: SparseVector):
        import numpy as np

        tf = 1 + np.log(v.values) if sublinear else v.values
        x = tf * np.array(weights)[v.indices]
        return SparseVector(v.size, v.indices, x / (np.sqrt(x @ x) or 1.0))

    return f(column)


def _joined(*columns: str):
    @F.udf(VectorUDT())
    def f(*vectors):
        import numpy as np

        indices, values, at = [], [], 0
        for v in vectors:
            i = np.arange(len(v)) if isinstance(v, DenseVector) else v.indices
            indices.append(i + at)
            values.append(v.values)
            at += len(v)
        return SparseVector(at, np.concatenate(indices), np.concatenate(values))

    return f(*columns)


def train_model(labelled: DataFrame, word_features: int = 5000, char_features: int = 5000, grid: dict[str, Sequence] | None = None, folds: int = 5, hold_out: Sequence[str] = ()) -> tuple[LineModel, DataFrame]:
    """A model from rows (system, raw_line, label) and the grid's scores (F1 of LOOK by parameters).

    Systems, not rows, are dealt to folds, so no system is in training and validation at once. The grid may name C,
    class_weight (balanced or none), word_features and char_features; what it leaves out keeps its default. Rows of the
    systems in ``hold_out`` take no part at all, so that the model can be evaluated on them.
    """
    if grid and not set(grid) <= {"C", "class_weight", "word_features", "char_features"}:
        raise ValueError("the grid searches C, class_weight, word_features and char_features")
    axes = {"C": (1.0,), "class_weight": ("balanced",), "word_features": (word_features,), "char_features": (char_features,)} | (grid or {})
    if not set(axes["class_weight"]) <= {"balanced", "none"}:
        raise ValueError("class_weight is balanced or none")
    if hold_out:
        labelled = labelled.where(F.col("system").isNull() | ~F.col("system").isin(*hold_out))
    rows = labelled.select("system", F.col("raw_line").alias("raw"), (F.col("label") == "SKIP").cast("double").alias("y"))
    rows = rows.withColumn("w", word_ngrams(normalize_extended(F.col("raw")))).withColumn("c", char_ngrams(F.col("raw")))
    rows = rows.withColumn("h", array_to_vector(F.array(*features.line_features(F.col("raw")))))
    systems = rows.select(F.col("system").alias("_s")).distinct().withColumn("fold", (F.row_number().over(W.orderBy("_s")) - 1) % folds)  # a row a system
    rows = rows.join(systems, F.col("system").eqNullSafe(F.col("_s"))).drop("_s").cache()
    # Vocabularies go by frequency, so a smaller one is the beginning of a larger one.
    most = {"w": max(axes["word_features"]), "c": max(axes["char_features"])}
    vocab = {k: CountVectorizer(inputCol=k, outputCol=k + "v", vocabSize=n).fit(rows).vocabulary for k, n in most.items()}
    weights = {k: idf(rows, k, v) for k, v in vocab.items()}
    size = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    total = sum(size.values())
    balance = F.lit(1.0)
    for y, n in size.items():
        balance = F.when(F.col("y") == y, total / (len(size) * n)).otherwise(balance)

    def vectors(words: int, chars: int) -> DataFrame:
        data = rows
        for k, n in (("w", words), ("c", chars)):
            data = CountVectorizerModel.from_vocabulary(vocab[k][:n], inputCol=k, outputCol=k + "n").transform(data)
            data = data.withColumn(k + "x", _weighted(k + "n", weights[k][:n], k == "w"))
        return data.select(_joined("wx", "cx", "h").alias("x"), "y", "fold", balance.alias("balanced"), F.lit(1.0).alias("none")).cache()

    def regression(c: float, weight: str) -> LogisticRegression:
        return LogisticRegression(featuresCol="x", labelCol="y", weightCol=weight, standardization=False, regParam=1 / (c * total), maxIter=200)

    scores = []
    for words, chars in product(axes["word_features"], axes["char_features"]) if grid else ():
        data = vectors(words, chars)
        for k in range(folds):
            train, part = data.where(F.col("fold") != k), data.where(F.col("fold") == k)
            if part.isEmpty() or train.select("y").distinct().count() < 2:
                continue
            for c, weight in product(axes["C"], axes["class_weight"]):
                got = regression(c, weight).fit(train).transform(part)
                f1 = confusion(got.select((F.col("y") == 0).alias("truth"), (F.col("prediction") == 0).alias("predicted"))).first()["f1"]
                scores.append((float(c), weight, words, chars, k, float(f1)))
        data.unpersist()
    spark = labelled.sparkSession
    table = spark.createDataFrame(scores, "C double, class_weight string, word_features int, char_features int, fold int, f1 double")
    means: dict[tuple, float] = {}
    for *point, _, f1 in scores:
        means[tuple(point)] = means.get(tuple(point), 0.0) + f1
    c, weight, words, chars = max(means, key=means.get) if means else tuple(v[0] for v in axes.values())
    vocab = {"w": vocab["w"][:words], "c": vocab["c"][:chars]}
    weights = {k: weights[k][: len(v)] for k, v in vocab.items()}
    data = vectors(words, chars)
    fitted = regression(c, weight).fit(data)
    patterns = [{"pattern": p, "replacement": r, "case_insensitive": i} for p, r, i in EXTENDED]
    part = lambda k, low, high: {"vocab": {g: i for i, g in enumerate(vocab[k])}, "idf": weights[k], "ngram_range": [low, high], "sublinear_tf": k == "w"}
    document = {
        "word_tfidf": part("w", 1, 3), "char_tfidf": part("c", 3, 6), "normalize_patterns": patterns,
        "handcrafted": {"level_pattern": features.LEVEL, "stack_trace_pattern": features.STACK, "negative_pattern": features.NEGATIVE, "path_pattern": features.PATH, "hex_pattern": features.HEX, "repeated_punct_pattern": features.REPEATED, "key_value_pattern": features.KEY_VALUE},
        "classifier": {
            "coef": [float(x) for x in fitted.coefficients.toArray()], "intercept": float(fitted.intercept), "classes": ["LOOK", "SKIP"],
            "n_word_features": len(vocab["w"]), "n_char_features": len(vocab["c"]), "n_handcrafted_features": len(features.NAMES),
        },
    }
    rows.unpersist()
    data.unpersist()
    return LineModel(document), table
