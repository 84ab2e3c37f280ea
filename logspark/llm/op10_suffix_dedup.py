"""Removal of long repeated strings by suffix arrays.

Removes each byte that a string of ``length`` bytes (400) covers which also
starts anywhere else, in the same document or another. Exact up to 64-bit hashes:

1. Each string of that length has a minimizer: of its 32-byte grams the one
   with the least hash, leftmost first. Equal strings have it at the same
   distance from their start. That distance falls into one of four classes;
   strings of a class all contain one stretch around the minimizer, of which
   the hash is the key. Equal strings thus meet under one key.
2. Keys that occur at one place only hold no repeats. For the others, each
   place yields its region: all its strings of that class. Equal regions are
   merged before they go to their key's task, however many places they have;
   the places wait for the verdict on their region.
3. Under one key, what all regions share becomes one symbol and what no other
   region shares on either side is cut off; what is left is sorted by a suffix
   array (linear grouping, see suffix_array.py), and strings that neighbours in
   it begin alike are repeats.
4. Covered bytes are merged per text and cut out.

Documents of equal text are one node until the end: if longer than a string,
all of it is a repeat. Null counts as empty. Repeated rows are equal texts.
Texts count whatever their doc_id, a null one or one shared by several texts.
Texts shorter than a string are kept whole. Empty tables give empty results;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_saved, release, save, slices, small_batches, table, text_bytes, with_defaults
from .suffix_array import suffix_array
from .wordcodes import mix, powers

LENGTH, GRAM, CLASSES = 400, 32, 4
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not len(_tables) or len(_tables["up"]) < n:
        n = max(n, 1 << 17)
        _tables.update(up=powers(n, _BASE), down=powers(n, _INVERSE))
    return _tables["up"], _tables["down"]


class Hashed:
    """Hashes of any stretches of one text, from prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def anchors(data: np.ndarray, length: int = LENGTH):
    """(key, minimizer position, first start, last start) for each minimizer and class of one text."""
    hashed, n = Hashed(data), len(data)
    width = length - GRAM + 1
    at = np.arange(n - GRAM + 1)
    order = (hashed(at, at + GRAM) >> np.uint64(30) << np.uint64(30)) | at.astype(np.uint64)
    # Sliding minimum by running minima within blocks, from both sides.
    rows = -(-len(order) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(order)] = order
    padded = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    least = np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts])
    place = (least & np.uint64((1 << 30) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    place, low, high = place[new], new, np.concatenate([new[1:], [starts]]) - 1
    step = -(-width // CLASSES)
    out = []
    for c in range(CLASSES):  # distances from start to minimizer: step * c to step * c + step - 1
        first, last = np.maximum(low, place - (step * c + step - 1)), np.minimum(high, place - step * c)
        ok = first <= last
        p, first, last = place[ok], first[ok], last[ok]
        # Every string of the class holds what lies between its last start and its first end.
        key = hashed(p - step * c, np.minimum(p - (step * c + step - 1) + length, n)) ^ mix(np.full(len(p), c + 1, np.uint64))
        out.append((key, p, first, last))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)), hashed


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def longest_shared(parts: list[bytes]) -> np.ndarray:
    """For each string the longest prefix that another one shares."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = np.zeros(len(parts), np.int64)
    for x, y in zip(order[:-1], order[1:], strict=True):
        n = common_prefix(parts[x], parts[y])
        out[x], out[y] = max(out[x], n), max(out[y], n)
    return out


def repeated_starts(regions: list[bytes], at: list[int], length: int = LENGTH) -> list[tuple[int, int] | list[int]]:
    """For each of some distinct regions, aligned at ``at``, the starts (in the region) of strings that another has, too."""
    m = len(regions)
    found: list = [[] for _ in range(m)]
    right, left = [r[a:] for r, a in zip(regions, at, strict=True)], [r[:a][::-1] for r, a in zip(regions, at, strict=True)]
    right_n, left_n = longest_shared(right), longest_shared(left)
    live = [i for i in range(m) if left_n[i] + right_n[i] >= length]
    if len(live) < 2:
        return found
    edge = lambda parts: common_prefix(min(parts), max(parts))
    all_right = min(edge([right[i] for i in live]), *(int(right_n[i]) for i in live))
    all_left = min(edge([left[i] for i in live]), *(int(left_n[i]) for i in live))
    weight = all_left + all_right
    cut: dict[tuple[bytes, bytes], list[int]] = {}
    for i in live:
        cut.setdefault((left[i][all_left : left_n[i]][::-1], right[i][all_right : right_n[i]]), []).append(i)
    text: list[int] = []
    places = []
    for before, after in cut:  # bytes are 3 and up; 2 is what all share, 1 ends a region, 0 the text
        places.append(len(text))
        text += [b + 3 for b in before] + [2] + [b + 3 for b in after] + [1]
    text.append(0)
    sa = suffix_array(text)
    rank = np.empty(len(sa), np.int64)
    rank[sa] = np.arange(len(sa))
    packed = np.array(text, "<u2").tobytes()
    for start, ((before, after), members) in zip(places, cut.items(), strict=True):
        q, end = len(before), start + len(before) + 1 + len(after)
        starts = []
        for k in range(q):  # strings that begin before what all share
            need = length - (q - k) - weight
            if need > len(after):
                continue
            n = q - k + 1 + max(0, need)
            mine = packed[2 * (start + k) : 2 * (start + k + n)]
            r = rank[start + k]
            for u in (sa[r - 1], sa[r + 1] if r + 1 < len(sa) else -1):
                if u >= 0 and packed[2 * u : 2 * (u + n)] == mine:
                    starts.append(k - q - all_left)
                    break
        r, most = rank[start + q], 0
        for u in (sa[r - 1], sa[r + 1] if r + 1 < len(sa) else -1):
            if u >= 0 and text[u] == 2:
                n = 1
                while start + q + n < end and text[u + n] == text[start + q + n]:
                    n += 1
                most = max(most, n)
        if len(members) > 1:  # cut to the same string: all of it is shared
            starts = list(range(-q - all_left, right_n[members[0]] - length + 1))
        elif most:
            starts += range(-all_left, min(0, most - 1 + all_right - length) + 1)
        for i in members:
            found[i] = [at[i] + s for s in starts]
    return found


def spans(starts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Merged byte ranges that strings at sorted ``starts`` cover."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.concatenate([[True], np.diff(starts) > length]))
    last = np.concatenate([new[1:], [len(starts)]]) - 1
    return [(int(starts[a]), int(starts[b]) + length) for a, b in zip(new, last, strict=True)]


def anchor_keys(texts: DataFrame) -> DataFrame:
    """key, node, pos of every minimizer and class; a task emits a node once."""

    def run(batches):
        seen: set[int] = set()
        for part in slices(batches):
            data, offsets = text_bytes(part.column(1))
            keys, nodes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, node in enumerate(part.column(0).to_pylist()):
                if node in seen or offsets[i + 1] - offsets[i] < LENGTH:
                    continue
                seen.add(node)
                (key, p, _, _), _ = anchors(data[offsets[i] : offsets[i + 1]])
                keys.append(key)
                places.append(p)
                nodes.append(np.full(len(p), node, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(places))], ["key", "node", "pos"])

    return texts.mapInArrow(run, "key bigint, node bigint, pos bigint")


def repeated_keys(rows: DataFrame) -> DataFrame:
    """Distinct (node, key) of the keys at two places or more."""

    def run(batches):
        kept = None
        for batch in batches:
            now = np.stack([batch.column(i).to_numpy() for i in range(3)])
            if kept is not None:
                now = np.concatenate([kept, now], 1)
            if not now.shape[1]:
                continue
            new = np.ones(now.shape[1], bool)
            new[1:] = (now[:, 1:] != now[:, :-1]).any(0)
            now = now[:, new]
            cut = int(np.searchsorted(now[0], now[0, -1]))
            kept = now[:, cut:]
            yield repeated(now[:, :cut])
        if kept is not None:
            yield repeated(kept)

    def repeated(now):
        same = now[0, 1:] == now[0, :-1]
        ok = np.zeros(now.shape[1], bool)
        ok[1:] |= same
        ok[:-1] |= same
        return pa.RecordBatch.from_arrays([pa.array(now[1, ok], pa.int64()), pa.array(now[0, ok], pa.int64())], ["node", "key"])

    return rows.repartition("key").sortWithinPartitions("key", "node", "pos").mapInArrow(run, "node bigint, key bigint").distinct()


def regions_of(texts: DataFrame) -> DataFrame:
    """key, region hash, node, first start, number of starts, minimizer's offset and bytes (null where the task sent them before)."""
    names = ["key", "region", "node", "first", "n", "at", "bytes"]

    def run(batches):
        sent: set[tuple[int, int]] = set()
        for part in slices(batches):
            data, offsets = text_bytes(part.column(1))
            for i, (node, wanted) in enumerate(zip(part.column(0).to_pylist(), part.column(2), strict=True)):
                text = data[offsets[i] : offsets[i + 1]]
                (key, p, first, last), hashed = anchors(text)
                ok = np.isin(key.view(np.int64), wanted.values.to_numpy())
                key, p, first, last = key[ok].view(np.int64), p[ok], first[ok], last[ok]
                region = (hashed(first, last + LENGTH) ^ mix((p - first).astype(np.uint64) + np.uint64(1))).view(np.int64)
                raw = text.tobytes()
                held = []
                for k, r, a, b in zip(key.tolist(), region.tolist(), first.tolist(), last.tolist(), strict=True):
                    new = (k, r) not in sent
                    if new:
                        sent.add((k, r))
                        if len(sent) > 500_000:
                            sent.clear()
                    held.append(raw[a : b + LENGTH] if new else None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(region), pa.array(np.full(len(key), node, np.int64)), pa.array(first), pa.array(last - first + 1), pa.array(p - first), pa.array(held, pa.binary())], names
                )

    return texts.mapInArrow(run, "key bigint, region bigint, node bigint, first bigint, n bigint, at bigint, bytes binary")


def covered(regions: DataFrame) -> DataFrame:
    """node, a, b: byte ranges that repeated strings cover. ``regions``: a stored table of :func:`regions_of`."""
    kinds = regions.groupBy("key", "region").agg(F.count("*").alias("places"), F.first("n").alias("n"), F.first("at").alias("at"), F.first("bytes", ignorenulls=True).alias("bytes"))

    def decide(group: list[tuple]) -> list[tuple[int, int, int, int]]:
        found = [[] for _ in group]
        if len(group) > 1:
            found = repeated_starts([r[5] for r in group], [r[4] for r in group])
        out = []
        for (key, region, places, n, _, _), starts in zip(group, found, strict=True):
            starts = np.arange(n) if places > 1 else np.unique([s for s in starts if 0 <= s < n]).astype(np.int64)
            out += [(key, region, a, b) for a, b in spans(starts)]
        return out

    def run(batches):
        group: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                if group and row[0] != group[0][0]:
                    out += decide(group)
                    group = []
                group.append(row)
            yield ranges(out)
        if group:
            yield ranges(decide(group))

    def ranges(out):
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "region", "a", "b"])

    kinds = kinds.select("key", "region", "places", "n", "at", "bytes").repartition("key").sortWithinPartitions("key", "region")
    found = save(kinds.mapInArrow(run, "key bigint, region bigint, a bigint, b bigint"), "decided")
    release(regions.sparkSession)
    places = regions.select("key", "region", "node", "first").join(found, ["key", "region"])
    return places.select("node", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, text (what is kept, as bytes) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = with_defaults(docs, doc_id="bigint", text="string").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("node", F.xxhash64("text"))
    members = save(texts.select("doc_id", "node", F.octet_length("text").alias("size")), "members")
    release(spark)
    keys = save(repeated_keys(anchor_keys(texts.select("node", "text"))), "keys")
    release(spark)
    wanted = keys.groupBy("node").agg(F.collect_list("key").alias("keys"))
    one = members.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min("size").alias("size"))
    chosen = wanted.join(one, "node").select(F.col("doc_id").alias("_doc"), F.col("node").alias("_node"), "keys")
    source = texts.select("doc_id", "node", "text").join(chosen, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).dropDuplicates(["node"])
    regions = save(regions_of(source.select("node", "text", "keys")), "regions")
    drop_saved(keys)
    release(spark)
    found = save(covered(regions), "ranges")
    drop_saved(regions)
    release(spark)
    per_node = found.groupBy("node").agg(F.collect_set(F.struct("a", "b")).alias("s"))
    copied = one.where((F.col("copies") > 1) & (F.col("size") >= LENGTH)).select("node", F.array(F.struct(F.lit(0).cast("bigint").alias("a"), F.col("size").cast("bigint").alias("b"))).alias("s"))
    spans_ = save(per_node.join(copied.select("node"), "node", "left_anti").unionByName(copied), "spans")
    for old in (members, found):
        drop_saved(old)
    release(spark)
    joined = texts.join(spans_, "node", "left").select("doc_id", "text", F.col("s.a").alias("a"), F.col("s.b").alias("b"))

    def run(batches):
        for part in slices(batches):
            out = []
            data, offsets = text_bytes(part.column(1))
            raw = data.tobytes()
            for i, (doc, a, b) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                text = raw[offsets[i] : offsets[i + 1]]
                kept, at, removed, n = [], 0, 0, 0
                for x, y in sorted(zip(a or [], b or [], strict=True)):
                    if x > at or not n:
                        kept.append(text[at:x])
                        n += 1
                        removed += y - x
                        at = y
                    elif y > at:
                        removed += y - at
                        at = y
                kept.append(text[at:])
                rest = b"".join(kept)
                out.append((doc, len(text), removed, n, hashlib.sha256(rest).hexdigest(), rest))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, text binary")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.expr("make_valid_utf8(cast(text as string))").alias("text")  # a cut may go through a character
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", kept)
