"""The scoring function of a model in JSON form."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features, python_forms
from ..session import ship
from .tokens import python_char_ngrams, python_word_ngrams


@dataclass
class LineModel:
    """word_tfidf, char_tfidf (vocab, idf, ngram_range), normalize_patterns, handcrafted, classifier (coef, intercept, classes)."""

    document: dict

    def __post_init__(self):
        c = self.document["classifier"]
        want = c["n_word_features"] + c["n_char_features"] + c["n_handcrafted_features"]
        if len(c["coef"]) != want:
            raise ValueError(f"model has {len(c['coef'])} coefficients for {want} features")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LineModel:
        return cls(json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())))

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.document, f)

    @cached_property
    def _parts(self):
        d, c = self.document, self.document["classifier"]
        coef = np.array(c["coef"], float)
        n, m = c["n_word_features"], c["n_char_features"]
        return d["word_tfidf"], coef[:n], d["char_tfidf"], coef[n : n + m], coef[n + m :], float(c["intercept"])

    @staticmethod
    def _dot(grams: list[str], part: dict, coef: np.ndarray) -> float:
        counts: dict[int, int] = {}
        vocab = part["vocab"]
        for g in grams:
            i = vocab.get(g)
            if i is not None:
                counts[i] = counts.get(i, 0) + 1
        if not counts:
            return 0.0
        at = np.fromiter(counts, int)
        tf = np.fromiter(counts.values(), float)
        if part.get("sublinear_tf"):
            tf = 1 + np.log(tf)
        x = tf * np.array(part["idf"])[at] if not isinstance(part["idf"], np.ndarray) else tf * part["idf"][at]
        return float(x @ coef[at] / (np.sqrt(x @ x) or 1.0))

    def text_score(self, raw: str) -> float:
        word, word_coef, char, char_coef, _, _ = self._parts
        for part in (word, char):
            part["idf"] = np.asarray(part["idf"], float)
        score = self._dot(python_word_ngrams(python_forms.normalize_extended(raw), *word["ngram_range"]), word, word_coef)
        return score + self._dot(python_char_ngrams(raw, *char["ngram_range"]), char, char_coef)

    def probability(self, raw: str, handcrafted: list[float]) -> float:
        """P(LOOK) = 1 / (1 + e**score); the coefficients are those of SKIP."""
        *_, hand, intercept = self._parts
        return 1 / (1 + math.exp(self.text_score(raw) + float(np.dot(hand, handcrafted)) + intercept))


def score_lines(lines: DataFrame, model: LineModel, text: str = "raw") -> DataFrame:
    """``lines`` with p_look. Hand-made features and the logistic are columns; n-grams, if the model has any, an Arrow UDF."""
    spark = lines.sparkSession
    *_, hand, intercept = model._parts
    score = F.lit(intercept)
    for column, weight in zip(features.line_features(F.col(text)), hand, strict=True):
        if weight:
            score = score + column * F.lit(float(weight))
    c = model.document["classifier"]
    if c["n_word_features"] + c["n_char_features"]:
        ship(spark)
        shared = spark.sparkContext.broadcast(model)  # a vocabulary of fixed size

        @F.pandas_udf("double")
        def text_score(s: pd.Series) -> pd.Series:
            return s.map(shared.value.text_score, na_action="ignore")

        score = score + text_score(F.col(text))
    return lines.withColumn("p_look", 1 / (1 + F.exp(score)))
