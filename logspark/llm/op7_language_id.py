"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character n-grams (orders 1 to 4) of the lower-cased text,
with tf = share among the text's n-grams of that order set, times idf. As tf is
linear in the counts, a text's logits are sums of table entries over its
n-grams: prediction needs no per-text vocabulary and covers whole texts.

Training learns from rows outside the held-out fold only (crc32 of the doc_id
as text, modulo 4, is not 2). Document frequencies are counted over all of
them, distributed. The weights are fitted by follow-the-regularised-leader
(FTRL-proximal: per-coordinate rates, L1 and L2 penalties) on a sample of about
``per_language`` labelled rows of each language (of the ``max_languages`` most
frequent), and a temperature on a fifth of that sample, not used for the fit.

Text that is null or has no letter is "und" with score 0; so is all text if no
row is labelled. Rows with a null doc_id are in no fold: not held out, nor
learned from. Equal scores go to the language first in order. Repeated rows are
predicted alike; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches, table, with_defaults

BITS, ORDERS, SCALE = 18, (1, 2, 3, 4), 100.0
PER_LANGUAGE, MAX_LANGUAGES = 800, 256
LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of lower-cased texts, one after the other."""
    raw = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=offsets[1:])
    return (np.concatenate(raw) if raw else np.zeros(0, "<u4")), offsets


def ngram_buckets(points: np.ndarray, order: int) -> np.ndarray:
    """Hash bucket of the n-gram that starts at each position (those across texts included)."""
    n = max(0, len(points) - order + 1)
    h = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for i in range(order):
        h = (h ^ points[i : i + n]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
    return (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)


def counts_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text and their shares, scaled."""
    points, _ = codes([text])
    found = np.concatenate([ngram_buckets(points, n) for n in ORDERS])
    if not len(found):
        return np.zeros(0, np.int64), np.zeros(0)
    bucket, n = np.unique(found, return_counts=True)
    return bucket.astype(np.int64), n * (SCALE / len(found))


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # (buckets, languages): idf times weight
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> np.ndarray:
        points, offsets = codes(texts)
        total = np.zeros((len(texts), len(self.languages)))
        n_all = np.zeros(len(texts))
        for order in ORDERS:
            bucket = ngram_buckets(points, order)
            # A text's n-grams of this order start before its last order - 1 characters.
            low = np.minimum(offsets[:-1], len(bucket))
            high = np.maximum(low, np.minimum(offsets[1:] - order + 1, len(bucket)))
            n_all += high - low
            for j in range(len(self.languages)):
                sums = np.zeros(len(bucket) + 1)
                np.cumsum(self.table[:, j][bucket], out=sums[1:], dtype=np.float64)
                total[:, j] += sums[high] - sums[low]
        return self.bias + total * (SCALE / np.maximum(n_all, 1))[:, None]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        p = softmax(self.logits(texts) / self.temperature)
        best = p.argmax(1)
        return [self.languages[b] for b in best], p[np.arange(len(best)), best]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, seed: int = 1):
    """Weights (buckets, k) and bias by FTRL-proximal on sparse rows; the bias is an unpenalised coordinate."""
    size = (1 << BITS) + 1
    z, n = np.zeros((size, k)), np.zeros((size, k))
    penalty1, penalty2 = np.full((size, 1), l1), np.full((size, 1), l2)
    penalty1[-1] = penalty2[-1] = 0

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= penalty1[i], 0, -(zi - np.sign(zi) * penalty1[i]) / ((beta + np.sqrt(n[i])) / alpha + penalty2[i]))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            i, x = rows[r]
            i, x = np.append(i, size - 1), np.append(x, 1.0)
            w = weights(i)
            g = softmax(x @ w)
            g[y[r]] -= 1
            g = x[:, None] * g
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(size))
    return w[:-1], w[-1]


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over its logarithm."""

    def loss(t):
        return -np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents of ``train`` (text) each bucket occurs, and the number of documents."""

    def run(batches):
        df, n = np.zeros(1 << BITS, np.int64), 0
        mark = np.zeros(1 << BITS, bool)
        for part in slices(batches):
            points, offsets = codes([t or "" for t in part.column(0).to_pylist()])
            found = [ngram_buckets(points, o) for o in ORDERS]
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                mark[:] = False
                for order, f in zip(ORDERS, found, strict=True):
                    mark[f[a : max(a, b - order + 1)]] = True
                df += mark
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(df[at], n), pa.int64())], ["bucket", "n"])

    counted = train.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros((1 << BITS) + 1, np.int64)
    df[counted["bucket"].to_numpy()] = counted["n"].to_numpy()  # bucket -1 has the number of documents
    return df[:-1], int(df[-1])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> LanguageModel | None:
    """A model from the rows of ``docs`` (doc_id, text, lang) that are not held out; None if none is labelled."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not counted:
        return None
    share = F.lit(0.0)
    for r in counted:
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, per_language / r["count"]))).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < share).select("doc_id", "text", "lang").collect()
    sample = sorted((r for r in sample if LETTER.search(r["text"])), key=lambda r: (r["doc_id"], r["text"]))
    languages = sorted({r["lang"] for r in sample})
    if not languages:
        return None
    df, n = document_frequencies(rows.select("text"))
    idf = np.log((1 + n) / (1 + df)) + 1
    y = np.array([languages.index(r["lang"]) for r in sample])
    features = [counts_of(r["text"]) for r in sample]
    features = [(i, x * idf[i]) for i, x in features]
    calibrate = np.arange(len(sample)) % 5 == 4
    fit = np.flatnonzero(~calibrate)
    w, bias = fit_ftrl([features[i] for i in fit], y[fit], len(languages))
    model = LanguageModel(languages, np.asfortranarray((w * idf[:, None]).astype(np.float32)), bias, 1.0)
    if calibrate.any() and len(languages) > 1:
        held = np.flatnonzero(calibrate)
        model.temperature = best_temperature(np.array([bias + features[i][1] @ w[features[i][0]] for i in held]), y[held])
    return model


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 2**BITS entries a language, whatever the input

    def run(batches):
        model = shared.value
        for part in slices(batches):
            texts = [t or "" for t in part.column(1).to_pylist()]
            found = [bool(LETTER.search(t)) and model is not None for t in texts]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            if any(found):
                best, p = model.predict(texts)
                lang = [b if ok else "und" for b, ok in zip(best, found, strict=True)]
                score = np.where(found, p, 0.0)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def identify_languages(docs: DataFrame, **params) -> DataFrame:
    docs = with_defaults(docs, doc_id="bigint", text="string", lang="string")
    return predict(docs, train(docs, **params))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))
