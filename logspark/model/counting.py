"""Document frequencies of n-grams: grams are numbered and counted as numbers in Arrow batches, not as strings in rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .tokens import word_ngrams, words

#: Bits of a word's number: three of them make a number of 63 bits. With more words than that, grams are counted as strings.
BITS = 21
#: Numbers that are sorted at a time, as far as whole lines and documents allow; rows of a batch given away.
CHUNK, ROWS = 1 << 21, 100_000
#: Words with their frequencies, or repeated keys, that go to every task; more are joined by a shuffle.
HELD = 1_000_000
_indexes: dict = {}


def _lists(column: pa.Array) -> tuple[np.ndarray, list, np.ndarray]:
    """Of a column of lists of words: lengths, distinct words, and the place among them of every word in turn."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = column.flatten().dictionary_encode()
    return lengths, words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each of the sorted keys begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _char_counts(column: pa.Array) -> Iterator[pa.RecordBatch]:
    """gram and n: lines of the column that hold each n-gram of three to six characters. No words or grams are kept from one column to the next.

    Grams of the distinct words are made once: the characters of three are one number, a longer gram is the pair of the numbers of its
    first and its last three. The union over a line's words is that of their numbers.
    """
    lengths, distinct, codes = _lists(column)
    if not len(codes):
        return
    points = np.frombuffer("".join([f" {w} " for w in distinct]).encode("utf-32-le"), np.uint32)
    wide = np.concatenate([points, np.zeros(2, np.uint32)]).astype(np.int64)
    threes = np.unique((wide[:-2] << 42) | (wide[1:-1] << 21) | wide[2:], return_inverse=True)[1].astype(np.int64)
    sizes = np.fromiter(map(len, distinct), np.int64, len(distinct)) + 2
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))  # characters of the word from there on
    ends = np.cumsum(lengths)
    for n in range(3, 7):
        at = np.flatnonzero(left >= n)
        if not len(at):
            return
        _, where, grams = np.unique((threes[at] << 31) | threes[at + n - 3], return_index=True, return_inverse=True)
        in_word = np.maximum(sizes - n + 1, 0)
        begins, many = (np.cumsum(in_word) - in_word)[codes], in_word[codes]
        total = np.concatenate([[0], np.cumsum(many)])  # grams before each word
        counts = np.zeros(len(where), np.int64)
        first = 0
        while first < len(lengths):  # as many whole lines as fit into a chunk
            begin = ends[first] - lengths[first]
            last = max(first + 1, int(np.searchsorted(total[ends], total[begin] + CHUNK, "right")))
            here = slice(begin, ends[last - 1])
            m = many[here]
            line = np.repeat(np.repeat(np.arange(last - first), lengths[first:last]), m)
            keys = (line << 32) | grams[np.arange(m.sum()) + np.repeat(begins[here] - (total[here] - total[begin]), m)]
            keys.sort()
            counts += np.bincount(keys[_runs(keys)] & 0xFFFFFFFF, minlength=len(where))
            first = last
        for i in range(0, len(where), ROWS):
            text = points[at[where[i : i + ROWS]][:, None] + np.arange(n)].tobytes().decode("utf-32-le")
            yield pa.RecordBatch.from_arrays([pa.array([text[j : j + n] for j in range(0, len(text), n)], pa.string()), pa.array(counts[i : i + ROWS])], ["gram", "n"])


def char_document_frequencies(texts: DataFrame, text: Column) -> DataFrame:
    """gram, df: in how many rows each of the grams of ``char_ngrams`` (three to six characters) is."""
    ship(texts.sparkSession)

    def count(batches):
        for batch in batches:
            yield from _char_counts(batch.column(0))

    of = texts.select(F.array_distinct(F.split(F.lower(text), r"(?U)\s+")).alias("w"))
    return of.mapInArrow(count, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("df"))


def _index(shared) -> dict[str, int]:
    """Numbers of the words from 1, made once in a worker."""
    if shared.id not in _indexes:
        _indexes.clear()
        _indexes[shared.id] = {w: i for i, w in enumerate(shared.words.value.to_pylist(), 1)}
    return _indexes[shared.id]


class _Words:
    def __init__(self, spark, words: pa.Array):
        self.words = spark.sparkContext.broadcast(words)
        self.id = f"{spark.sparkContext.applicationId}-{id(self)}"


def _word_keys(batches, index: dict[str, int], high: int):
    """Numbers of the grams of two words or more, those of known words alone: one for each document that a gram is in, then summed up chunk by chunk."""

    def summed(kept):
        keys = np.concatenate(kept)
        keys.sort()
        at = _runs(keys)
        n = np.diff(np.append(at, len(keys)))
        for i in range(0, len(at), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at[i : i + ROWS]]), pa.array(n[i : i + ROWS])], ["key", "n"])

    kept, size = [], 0
    for batch in batches:
        lengths, distinct, codes = _lists(batch.column(0))
        ids = np.array([index.get(w, 0) for w in distinct], np.int64)[codes] if len(distinct) else np.zeros(0, np.int64)
        grams, levels = ids, []
        for n in range(2, high + 1):  # the grams before, and the word behind them; 0 stands for none
            grams, behind = grams[:-1], ids[n - 1 :]
            grams = np.where((grams > 0) & (behind > 0), (grams << BITS) | behind, 0)
            levels.append((n, grams))
        end = np.cumsum(lengths)
        for b, e in zip((end - lengths).tolist(), end.tolist()):
            keys = np.concatenate([g[b : max(b, e - n + 1)] for n, g in levels])
            keys.sort()
            keys = keys[_runs(keys)]
            keys = keys[1:] if len(keys) and keys[0] == 0 else keys
            kept.append(keys)
            size += len(keys)
            if size > CHUNK:
                yield from summed(kept)
                kept, size = [], 0
    if size:
        yield from summed(kept)


def _frequent(batches, known: pa.Array, least: int):
    """gram and df, out of all the summed-up numbers of a partition."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    keys, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    del parts
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    at = _runs(keys)
    df = np.add.reduceat(n, at)
    keys, df = keys[at][df >= least], df[df >= least]
    for i in range(0, len(keys), ROWS):
        grams, some = None, keys[i : i + ROWS]
        for shift in range(BITS * (62 // BITS), -1, -BITS):
            number = (some >> shift) & ((1 << BITS) - 1)
            word = known.take(pa.array(number - 1, mask=number == 0))
            grams = word if grams is None else pc.binary_join_element_wise(grams, word, " ", null_handling="skip")
        yield pa.RecordBatch.from_arrays([grams, pa.array(df[i : i + ROWS])], ["gram", "df"])


def word_document_frequencies(docs: DataFrame, text: Column, least: int) -> DataFrame:
    """gram, df: in how many rows each gram of one to three words is, for those in ``least`` or more.

    A gram is in no more rows than each of its words, so that grams of rarer words are left out before they are made. Others are
    numbers that hold the numbers of their words, equal only for equal grams.
    """
    spark = docs.sparkSession
    single = docs.select(F.explode(F.array_distinct(words(text))).alias("gram")).groupBy("gram").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    found = single.limit(1 << BITS).toArrow()
    if found.num_rows >= (1 << BITS) - 1:
        grams = docs.select(F.explode(F.array_distinct(word_ngrams(text))).alias("gram"))
        return grams.groupBy("gram").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    ship(spark)
    known = found.column("gram").combine_chunks().cast(pa.string())
    shared = _Words(spark, known)
    parts = 1 + 3 * (pc.sum(found.column("df")).as_py() or 0) // (2 * CHUNK)
    keys = docs.select(words(text).alias("w")).mapInArrow(lambda batches: _word_keys(batches, _index(shared), 3), "key bigint, n bigint")
    longer = keys.repartition(parts, "key").mapInArrow(lambda batches: _frequent(batches, shared.words.value, least), "gram string, df bigint")
    return spark.createDataFrame(found).unionByName(longer)


def _held(table: DataFrame) -> tuple[DataFrame, int]:
    """A table, computed once and made a broadcast side if it has at most ``HELD`` rows, and how many it has, or more than that."""
    found = table.limit(HELD + 1).toArrow()
    if found.num_rows > HELD:
        return table, found.num_rows
    return F.broadcast(table.sparkSession.createDataFrame(found, table.schema)), found.num_rows


def word_counts(docs: DataFrame, key: str, text: Column, least: int) -> tuple[DataFrame, DataFrame]:
    """(key, gram, n: how often a document has each of its words), and (gram, df: documents with the word) for those in ``least`` or more.

    A document's words are counted in its row, so that they are not shuffled to be counted, nor to meet their frequencies. Only rows
    that share their key are first brought together, as one document.
    """
    rows = docs.select(F.col(key), text.alias("_text"))
    again = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(key).alias("_again"))
    again, n = _held(again)
    if n:
        same = F.col(key).eqNullSafe(F.col("_again"))
        several = rows.join(again, same, "left_semi").groupBy(key).agg(F.flatten(F.collect_list(words(F.col("_text")))).alias("w"))
        every = rows.join(again, same, "left_anti").select(key, words(F.col("_text")).alias("w")).unionByName(several)
    else:
        every = rows.select(key, words(F.col("_text")).alias("w"))
    df = every.select(F.explode(F.array_distinct("w")).alias("gram")).groupBy("gram").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    df, _ = _held(df)
    # Of the sorted words: where each begins, and where the next one does.
    ordered = every.select(key, F.sort_array("w").alias("_s")).where("size(_s) > 0")
    begins = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", F.greatest(i - 1, F.lit(0)))))
    ordered = ordered.withColumn("_b", begins)
    counts = F.transform("_b", lambda b, k: F.struct(F.get("_s", b).alias("gram"), (F.coalesce(F.get("_b", k + 1), F.size("_s")) - b).cast("bigint").alias("n")))
    return ordered.select(key, F.inline(counts)), df
