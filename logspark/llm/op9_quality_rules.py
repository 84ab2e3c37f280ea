"""Quality rules with risk-controlled thresholds.

Base statistics of every whole text come from numpy on the raw bytes. Further
rules compare a score with a cutoff that is selected per stratum (language) on
labelled holdout rows: going from the mildest to the strictest candidate, a
cutoff is taken while the exact binomial (Clopper-Pearson) upper bound on the
share of good documents it would reject stays within ``risk``. Each stratum
and score tests its candidates in that fixed order (which needs no further
correction), and the error probability ``delta`` is divided by the number of
stratum-score pairs (Bonferroni). The risk is divided by the number of scores,
so that all rules together reject at most ``risk`` of the good documents of a
stratum, with probability 1 - delta. A stratum with too few labels rejects nothing.

Null text counts as empty and fails the base rule. Null languages form a
stratum of their own. Rows that repeat are judged alike; labels that are null
or contradict each other count as labelled good if any of them says so.
Unlabelled tables give the base rule alone. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, slices, small_batches, table, text_bytes
from .wordcodes import windows, words

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_MARK = np.zeros(256, np.int64)
_MARK[list(b"!?#*$%&|<>")] = 1
_CHARACTER = np.ones(256, np.int64)
_CHARACTER[0x80:0xC0] = 0

#: Scores of the rules: a document is rejected where its score is above the cutoff.
SCORES = {
    "symbols_per_char": "n_marks / greatest(word_chars, 1)",
    "upper_per_char": "n_upper / greatest(word_chars, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "long_words": "word_chars / greatest(n_words, 1)",
    "short_words": "-word_chars / greatest(n_words, 1)",
}


def _repeats(window: np.ndarray, n_words: int, k: int) -> int:
    """Words inside windows whose hash occurs twice or more."""
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(window), np.int64)
    twice[order[1:][same]] = 1
    twice[order[:-1][same]] = 1
    cover = np.zeros(n_words + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + k, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def _duplicate_lines(text: bytes) -> int:
    lines = Counter(text.split(b"\n"))
    return sum(n - 1 for line, n in lines.items() if n > 1 and line.strip())


def text_stats(column: pa.Array, k: int = 8) -> dict[str, np.ndarray]:
    """The statistics of one slice of texts."""
    data, offsets = text_bytes(column)
    starts, ends, hashes, first = words(data, offsets)
    n = len(column)
    out = {c: np.zeros(n, np.int64) for c in STATS}
    out["n_words"] = np.diff(first)
    total = lambda per_byte: np.diff(np.concatenate(([0], np.cumsum(per_byte)))[offsets])
    solid = np.zeros(len(data) + 1, np.int64)
    np.add.at(solid, starts, 1)
    np.add.at(solid, ends, -1)
    out["word_chars"] = total(_CHARACTER[data] * (np.cumsum(solid[:-1]) > 0))
    out["n_symbols"], out["n_upper"], out["n_marks"] = total(_SYMBOL[data]), total(_UPPER[data]), total(_MARK[data])
    window = windows(hashes, k)
    raw = data.tobytes()
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b - a > k:
            out["n_repeat_words"][i] = _repeats(window[a : b - k + 1], b - a, k)
        out["n_dup_lines"][i] = _duplicate_lines(raw[offsets[i] : offsets[i + 1]])
    return out


def measure(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` but the text, by position, and the statistics as a struct ``_q``."""
    small_batches(docs.sparkSession)
    schema = "doc_id bigint, lang string, " + ", ".join(f"{c} bigint" for c in STATS)

    def run(batches):
        for part in slices(batches):
            stats = text_stats(part.column(2))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(stats[c], pa.int64()) for c in STATS]], ["doc_id", "lang", *STATS])

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    found = docs.select(F.col("doc_id").cast("bigint"), lang.cast("string").alias("lang"), F.col("text").cast("string")).mapInArrow(run, schema)
    return with_base(found)


def with_base(measured: DataFrame) -> DataFrame:
    return measured.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the p at which k or fewer of n have probability ``delta``; by bisection on the exact sum."""
    if k >= n:
        return 1.0

    i = np.arange(1, k + 1)
    choose = np.concatenate(([0.0], np.cumsum(np.log((n - i + 1) / i))))
    i = np.arange(k + 1)

    def below(p: float) -> float:
        return float(np.exp(choose + i * math.log(p) + (n - i) * math.log1p(-p)).sum())

    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) > delta else (low, middle)
    return high


def largest_rejections(n: int, risk: float, delta: float) -> int:
    """The largest k whose upper bound is within the risk; -1 if even none would not do."""
    if n == 0 or upper_bound(0, n, delta) > risk:
        return -1
    low, high = 0, n
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if upper_bound(middle, n, delta) <= risk else (low, middle - 1)
    return low


def fit_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05, steps: int = 200) -> dict[tuple[str | None, str], float]:
    """Cutoff per (stratum, score). The driver gets one row per stratum, score and grid step.

    Candidates are a fixed grid in log scale; what lies above each is counted over all labelled rows.
    """
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").alias("quality")).where("quality = 1")
    rows = measured.where(~F.col("base_failed")).join(good, "doc_id", "left_semi")
    stacked = ", ".join(f"'{name}', cast({expression} as double)" for name, expression in SCORES.items())
    scored = rows.selectExpr("lang", f"stack({len(SCORES)}, {stacked}) as (score, x)")
    # 1/steps of a unit up to 1, and of four octaves beyond: one monotone step number for every score.
    octaves = F.log2(F.abs("x")) * steps / 4
    step = F.when(F.abs("x") <= 1, F.ceil(F.col("x") * steps)).when(F.col("x") > 1, steps + F.ceil(octaves)).otherwise(-steps - F.floor(octaves))
    counted = scored.groupBy("lang", "score", step.cast("int").alias("step")).agg(F.count("*").alias("n")).collect()
    tables: dict[tuple[str | None, str], dict[int, int]] = {}
    for r in counted:
        tables.setdefault((r["lang"], r["score"]), {})[r["step"]] = r["n"]
    cutoffs = {}
    for key, histogram in tables.items():
        allowed = largest_rejections(sum(histogram.values()), risk / len(SCORES), delta / len(tables))
        if allowed < 0:
            continue
        rejected, at = 0, max(histogram)
        for s in sorted(histogram, reverse=True):  # mildest first; a step is (s - 1, s]
            if rejected + histogram[s] > allowed:
                at = s
                break
            rejected += histogram[s]
        cutoffs[key] = at / steps if abs(at) <= steps else math.copysign(2 ** ((abs(at) - steps) * 4 / steps), at)
    return cutoffs


def judge(measured: DataFrame, cutoffs: dict[tuple[str | None, str], float]) -> DataFrame:
    """Adds ``kept`` and ``failed_rules``."""
    failed = []
    for (lang, score), cutoff in sorted(cutoffs.items(), key=str):
        at = F.col("lang").eqNullSafe(F.lit(lang))
        failed.append(F.when(at & (F.expr(SCORES[score]) > cutoff + 1e-9), F.lit(score)))
    rules = F.filter(F.array(*failed), lambda x: x.isNotNull()) if failed else F.array().cast("array<string>")
    return measured.withColumn("failed_rules", rules).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def apply_rules(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    measured = save(measure(docs), "quality")
    return judge(measured, fit_cutoffs(measured, labels, **params))


def keep_good(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    The statistics are computed again beside each text, which costs less than joining them to the texts.
    """
    cutoffs = fit_cutoffs(save(measure(docs), "quality"), labels, **params)
    names = docs.columns
    at, lang = names.index("text"), names.index("lang") if "lang" in names else None
    plain = docs.toDF(*[f"_d{i}" for i in range(len(names))])
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in plain.schema]

    def run(batches):
        for part in slices(batches, f"_d{at}"):
            stats = text_stats(part.column(at))
            yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(stats[c], pa.int64()) for c in STATS]], [*part.schema.names, *STATS])

    measured = plain.mapInArrow(run, ", ".join([*kinds, *[f"{c} bigint" for c in STATS]]))
    measured = with_base(measured.withColumn("lang", F.lit(None).cast("string") if lang is None else F.col(f"_d{lang}")))
    return judge(measured, cutoffs).where("kept").select(*[F.col(f"_d{i}").alias(c) for i, c in enumerate(names)])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *STATS[:5], "base_failed", "kept")
