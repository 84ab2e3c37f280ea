"""Packing along a space-filling curve.

Each document becomes token ids (closed by an end id) and a hashed vector:
signed buckets of its ids, projected to three dimensions by a fixed random
matrix; both steps are one table lookup per id. The vector's place on a Hilbert
curve is the sort key. Documents are range-sorted by (key, doc_id), which deals
equal texts out over tasks, and each range is cut into full sequences in that
order, so neighbours share sequences and only the last one of a range is padded.

Tokenisation goes word by word through a bounded cache of encoded words. That is
exact where a text holds only characters for which the tokenizer's normaliser
acts on each word alone; any other text is encoded whole.

Null text counts as empty and gives the end id alone. Repeated rows are packed
like any other. Documents longer than a sequence are cut. Empty tables give an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import save, slices, small_batches, table, with_defaults

SEQUENCE = 4096
END_ID = 2
VOCABULARY = 1 << 16
BUCKETS, DIMENSIONS, BITS = 256, 3, 16
CACHE_WORDS = 1_000_000
#: A range gets about this many tokens: one padded sequence in hundreds.
TOKENS_PER_RANGE = 1 << 21
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


@lru_cache(maxsize=4)
def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder(dict):
    """Ids of texts as little-endian unsigned 16-bit bytes."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # The same model for single words of letters, which need no normalising or splitting.
        self.letters = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=model["end_of_word_suffix"], cache_capacity=0))
        self.letters.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.limit = cache_words
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Texts of Latin letters, digits, full stops and commas alone are the common case.
        self.unusual = regex.compile(r"[^\t\n\r .,0-9A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]")
        # Latin text without control or format characters, and without the capital I with dot.
        self.unsafe = regex.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-\u012f\u0131-\u024f]")
        self.joined = regex.compile(r"[^\s\p{L}\p{N}][.,]|[.,][^\s\p{L}\p{N}]")

    def __missing__(self, word: str) -> bytes:
        by = self.letters if word.isalpha() else self.tokenizer
        self[word] = ids = np.array(by.encode(word, add_special_tokens=False).ids, "<u2").tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        plain = not self.unusual.search(text)
        if not plain and (self.unsafe.search(text) or any(s in text for s in self.special)) or not unicodedata.is_normalized("NFC", text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        text = text.lower()
        joined = any(m in text for m in ("..", ",,", ".,", ",.")) or not plain and self.joined.search(text)
        if not joined:  # each full stop and comma is a token of its own
            text = text.replace(".", " . ").replace(",", " , ")
        if len(self) > self.limit:
            self.clear()
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@lru_cache(maxsize=1)
def projection() -> np.ndarray:
    """Per token id: the sign of its hashed bucket times that bucket's random direction."""
    ids = np.arange(VOCABULARY, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    directions = np.random.default_rng(7).standard_normal((BUCKETS, DIMENSIONS))
    sign = 1.0 - 2.0 * ((ids >> np.uint64(40)) & np.uint64(1)).astype(float)
    return (directions[(ids >> np.uint64(48)).astype(int) % BUCKETS] * sign[:, None]).astype(np.float32)


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of integer points (n, d) below 2**bits, by Skilling's transform."""
    x = points.astype(np.uint64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p, bit = np.uint64(q - 1), np.uint64(q)
        for i in range(d):
            on = (x[i] & bit) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(on, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & np.uint64(q)) != 0, t ^ np.uint64(q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key.astype(np.int64)


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents given as id arrays."""
    to = projection()
    sums = np.array([to[i].sum(0) / np.sqrt(len(i)) if len(i) else np.zeros(DIMENSIONS) for i in ids]).reshape(-1, DIMENSIONS)
    cells = (np.arctan(sums / 4) / np.pi + 0.5) * (1 << BITS)
    return hilbert_key(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64))


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, key, n, ids (16-bit little-endian) of every document."""
    small_batches(docs.sparkSession)

    def run(batches):
        code = encoder(path)
        end = np.array([END_ID], "<u2").tobytes()
        for part in slices(batches):
            packed = [b + end for b in (code.encode(t or "") for t in part.column(1).to_pylist())]
            key = curve_keys([np.frombuffer(b, "<u2") for b in packed])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(key, pa.int64()), pa.array([len(b) // 2 for b in packed], pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "key", "n", "ids"])

    return with_defaults(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, key bigint, n bigint, ids binary")


def pack(tokens: DataFrame, sequence: int = SEQUENCE, tokens_per_range: int = TOKENS_PER_RANGE) -> DataFrame:
    """Pieces of the documents in ``tokens``, which must be a stored table (its sort keys are sampled)."""
    total = tokens.groupBy().sum("n").first()[0] or 0
    ranges = max(1, round(total / tokens_per_range))
    ordered = tokens.repartitionByRange(ranges, "key", "doc_id", "n").sortWithinPartitions("key", "doc_id", "n", "ids")

    def run(batches):
        at = 0  # ids of this range so far
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer(ids.as_buffer(), "<u2").astype("<u4")
                start, n = 0, len(data)
                while start < n:
                    room = min(sequence - at % sequence, n - start)
                    out.append((doc, start, room, zlib.crc32(data[start : start + room]), n, base + at // sequence, at % sequence))
                    start, at = start + room, at + room
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 7, PIECES.replace(" bigint", "").split(", "))

    return ordered.select("doc_id", "ids").mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    return pack(save(tokenize(docs, path or tokenizer_file("word_bpe_49k.json")), "tokens"), sequence)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
