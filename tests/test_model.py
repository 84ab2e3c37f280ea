from collections import Counter

import pytest
from pyspark.sql import functions as F

from logspark.functions.features import line_features
from logspark.model import LineModel, confusion, sample_unmarked, score_lines, train_model
from logspark.model.tokens import char_ngrams, python_char_ngrams, python_word_ngrams, word_ngrams

LINES = ["hello big world", "ERROR: disk full!", "", "a bc  def", "Café x_y 12"]


def test_ngrams_equal_python(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "i int, x string")
    for r in df.select("i", word_ngrams(F.col("x")).alias("w"), char_ngrams(F.col("x")).alias("c")).collect():
        assert Counter(r["w"]) == Counter(python_word_ngrams(LINES[r["i"]]))
        assert Counter(r["c"]) == Counter(python_char_ngrams(LINES[r["i"]]))


def test_train_score_roundtrip(spark, tmp_path):
    rows = [(f"s{i % 3}", i, f"request {i} served in {i} ms", "SKIP", "") for i in range(30)] + [(f"s{i % 3}", 100 + i, f"ERROR disk {i} failed: timeout", "LOOK", "") for i in range(15)]
    labelled = spark.createDataFrame(rows, "system string, line_number bigint, raw_line string, label string, reason string")
    model, grid = train_model(labelled, 50, 50, {"C": [1.0]}, folds=3)
    assert grid.count() == 3 and min(r["f1"] for r in grid.collect()) > 0.9
    path = str(tmp_path / "model.json")
    model.save(path)
    scored = score_lines(labelled.withColumnRenamed("raw_line", "raw"), LineModel.load(spark, path))
    got = scored.select("raw", "label", "p_look", *line_features(F.col("raw"))).collect()
    assert all((r["p_look"] >= 0.5) == (r["label"] == "LOOK") for r in got)
    assert all(abs(r["p_look"] - model.probability(r["raw"], list(r[3:]))) < 1e-9 for r in got)


def test_train_grid_and_hold_out(spark):
    rows = [(f"s{i % 2}", i, f"request {i} served", "SKIP", "") for i in range(12)] + [(f"s{i % 2}", 100 + i, f"ERROR disk {i} failed", "LOOK", "") for i in range(6)]
    rows += [("other", 200 + i, f"zebra {i}", "LOOK", "") for i in range(4)]
    labelled = spark.createDataFrame(rows, "system string, line_number bigint, raw_line string, label string, reason string")
    model, scores = train_model(labelled, 20, 20, {"class_weight": ["balanced", "none"], "word_features": [5, 20]}, folds=2, hold_out=["other"])
    got = scores.collect()
    assert Counter((r["class_weight"], r["word_features"]) for r in got) == {(w, n): 2 for w in ("balanced", "none") for n in (5, 20)}
    words = model.document["word_tfidf"]
    assert len(words["vocab"]) == len(words["idf"]) == model.document["classifier"]["n_word_features"] and "zebra" not in words["vocab"]
    assert len(words["vocab"]) in (5, 20)
    for wrong in ({"depth": [1]}, {"class_weight": ["even"]}):
        with pytest.raises(ValueError):
            train_model(labelled, grid=wrong)


def test_confusion_and_sample(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, False), (False, True)], "truth boolean, predicted boolean")
    assert confusion(df).first()[:] == (1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5)
    assert confusion(df.where("false")).first()["f1"] == 0
    lines = spark.createDataFrame([("f", i, "plain", 0.9) for i in range(30)] + [("f", 99, "an error", 0.9)], "file_path string, line_number bigint, raw string, p_look double")
    assert sample_unmarked(lines).count() == 20


def test_document_frequencies_as_numbers(spark, monkeypatch):
    """Rows are batches, not a row for each gram, and their counts are those of strings."""
    from collections import Counter

    from logspark.model import counting
    from logspark.model.tokens import python_char_ngrams, python_word_ngrams

    texts = ["", " ", "a", "ab ab abab", "the cat the cat sat", "the cat sat", "größe 漢字かな漢字 𝒳𝒴𝒵𝒳𝒴𝒵", "x" * 50, None] * 3 + ["the cat sat down"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    monkeypatch.setattr(counting, "CHUNK", 7)
    monkeypatch.setattr(counting, "ROWS", 3)
    want = Counter(g for t in texts if t for g in set(python_char_ngrams(t)))
    batches = [p.array([list(dict.fromkeys(t.lower().split())) if t else [] for t in texts], p.list_(p.string())) for p in [__import__("pyarrow")]]
    got = Counter()
    for b in counting._char_counts(batches[0]):
        for r in b.to_pylist():
            got[r["gram"]] += r["n"]
    assert got == want
    chars = counting.char_document_frequencies(df, df.t)
    assert "Generate" not in chars._jdf.queryExecution().optimizedPlan().toString()
    assert {r["gram"]: r["df"] for r in chars.collect()} == want
    want = {g: n for g, n in Counter(g for t in texts if t for g in set(python_word_ngrams(t))).items() if n >= 4}
    assert {r["gram"]: r["df"] for r in counting.word_document_frequencies(df, df.t, 4).collect()} == want
    monkeypatch.setattr(counting, "BITS", 1)
    assert {r["gram"]: r["df"] for r in counting.word_document_frequencies(df, df.t, 4).collect()} == want


def test_word_counts_in_the_row(spark):
    """Words are counted without a shuffle of theirs; rows of one key, or of none, are one document."""
    from logspark.model.counting import word_counts

    df = spark.createDataFrame([(1, "to be or not to be"), (2, "not so"), (2, "so be it"), (None, "be be"), (None, "or"), (3, None), (4, "a")], "k bigint, t string")
    counted, found = word_counts(df, "k", df.t, 2)
    assert sorted(map(tuple, counted.collect()), key=str) == sorted([(1, "be", 2), (1, "not", 1), (1, "or", 1), (1, "to", 2), (2, "be", 1), (2, "it", 1), (2, "not", 1), (2, "so", 2), (None, "be", 2), (None, "or", 1)], key=str)
    assert {r["gram"]: r["df"] for r in found.collect()} == {"be": 3, "not": 2, "or": 2}
    plan = counted.join(found, "gram")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [k" in plan and "gram" not in "".join(x for x in plan.splitlines() if "Aggregate" in x)
