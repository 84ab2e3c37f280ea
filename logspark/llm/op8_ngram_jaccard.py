"""N-gram Jaccard self-join by an R-tree over count vectors.

A document is the set of its distinct 5-word shingles; two link when
100 * |A & B| >= 75 * |A | B|. The join is exact up to 64-bit hashes:

1. Texts with equal word sequences form one node; each task emits a node once.
2. Blocks: every node emits the prefix of its set (the first n - ceil(3n/4) + 1
   shingles in one global order); linked nodes share a prefix shingle, so they
   meet in its block. The order puts shingles that a sample of documents shows
   to be frequent last, so common passages make no large blocks. It decides
   speed only, never results. Blocks with the same members are joined once.
3. In a block, shingles hashed into groups give each node a point of group
   counts. An R-tree keeps the coordinate maxima below each of its nodes; the
   sum of coordinate minima bounds the overlap, and branches that cannot reach
   3/7 of the two sizes are skipped.
4. Surviving pairs are verified on the full sets. The first round takes, in a
   few blocks, each point with its block's medoid and with its best partner; after the links found
   are merged, the second takes all surviving pairs between different
   components, so every remaining link is found, while groups of near copies
   never become all pairs. In a block larger than a chunk the rows outside the
   leading component meet every chunk; the others only theirs.

A text with fewer than five words is one shingle; without words (or null) it is
an empty set and links with nothing, not even an equal text. Repeated rows are
equal texts. Rows with a null doc_id link like others; the component_id is null
where no row of the component has an id. Different texts under one doc_id are
nodes of their own. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import drop_saved, lists, release, save, slices, small_batches, table, text_bytes, with_defaults
from .graph import components_any_style as components
from .wordcodes import mix, windows, words

WORDS = 5
SAMPLE_DOCS, HOT_SHARE = 5_000, 0.004
#: Documents with a shingle, from which on it is frequent in tables of any size; how often the sample then has it; frequent shingles at most.
HOT_DOCS, HOT_SEEN, HOT_MOST = 200, 8, 200_000
CHUNK, LEAF, QUERIES = 4096, 32, 512
#: Blocks of each smallest member that the first round joins; the second joins all that still hold several components.
FIRST_BLOCKS = 4


def shingle_sets(column: pa.Array, k: int = WORDS):
    """Per text: (hash of the word sequence, sorted distinct shingle hashes)."""
    data, offsets = text_bytes(column)
    _, _, hashes, first = words(data, offsets, lower=True)
    window = windows(hashes, k)
    place = (np.arange(len(hashes), dtype=np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    for i in range(len(column)):
        a, b = first[i], first[i + 1]
        if a == b:
            yield 0, np.zeros(0, np.uint64)
            continue
        whole = mix(np.array([np.sum(mix(hashes[a:b] + place[: b - a]), dtype=np.uint64) + np.uint64(b - a)]))
        yield whole[0], np.unique(window[a : b - k + 1]) if b - a >= k else whole


def groups_of(n: int) -> int:
    """Number of groups for a set of n: about one shingle each, 64 at least."""
    g = 64
    while g < n:
        g *= 2
    return g


def count_vector(shingles: np.ndarray) -> np.ndarray:
    g = groups_of(len(shingles))
    return np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (g - 1), minlength=g)


def pack_counts(v: np.ndarray) -> bytes:
    """Half a byte a count where all are small enough, one or eight bytes otherwise."""
    if v.max() < 16:
        return (v[::2] | v[1::2] << 4).astype(np.uint8).tobytes()
    return v.astype(np.uint8 if v.max() < 256 else "<i8").tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    g = groups_of(n)
    if len(data) * 2 == g:
        packed = np.frombuffer(data, np.uint8)
        out = np.empty(g, np.uint8)
        out[::2], out[1::2] = packed & 15, packed >> 4
        return out
    return np.frombuffer(data, np.uint8 if len(data) == g else "<i8")


def fold(v: np.ndarray, g: int) -> np.ndarray:
    """Counts in ``g`` groups out of counts in a multiple of ``g``."""
    return v.reshape(-1, g).sum(0, dtype=np.int64)


class CountTree:
    """R-tree over count vectors of one length, bulk-loaded by halving the widest coordinate."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, leaf: int = LEAF):
        self.counts, self.sizes = counts, sizes
        self.root = self._build(np.arange(len(sizes)), leaf)

    def _build(self, rows: np.ndarray, leaf: int):
        box = (self.counts[rows].max(0), self.sizes[rows].min(), self.sizes[rows].max())
        if len(rows) <= leaf:
            return (*box, rows, None)
        spread = self.counts[rows].var(0)
        axis = int(spread.argmax())
        values = self.counts[rows, axis] if spread[axis] * 4 > self.sizes[rows].var() / max(1, self.counts.shape[1]) else self.sizes[rows]
        order = rows[np.argsort(values, kind="stable")]
        half = len(order) // 2
        return (*box, None, (self._build(order[:half], leaf), self._build(order[half:], leaf)))

    def search(self, counts: np.ndarray, sizes: np.ndarray):
        """Yields (queries, rows, bounds) of leaves whose bound lets them hold links of those queries."""
        stack = [(self.root, np.arange(len(sizes)))]
        while stack:
            (high, least, most, rows, below), q = stack.pop()
            q = q[(4 * least <= 4 * sizes[q]) & (4 * most >= 3 * sizes[q])]  # partners are not larger, nor under 3/4
            if len(q):
                q = q[7 * np.minimum(counts[q], high).sum(1) >= 3 * (sizes[q] + least)]
            if not len(q):
                continue
            if rows is None:
                stack += [(b, q) for b in below]
                continue
            for at in range(0, len(q), 64):
                part = q[at : at + 64]
                yield part, rows, np.minimum(counts[part, None, :], self.counts[None, rows, :]).sum(2)


def passing(sizes_a: np.ndarray, sizes_b: np.ndarray, bound: np.ndarray) -> np.ndarray:
    a, b = sizes_a[:, None], sizes_b[None, :]
    return (7 * bound >= 3 * (a + b)) & (4 * np.minimum(a, b) >= 3 * np.maximum(a, b))


def block_pairs(nodes: np.ndarray, sizes: np.ndarray, vectors: list[np.ndarray], labels: np.ndarray | None = None) -> np.ndarray:
    """Candidates (node, other, score) of one block, as 64-bit integers.

    With ``labels`` all pairs between different labels; else each point's best partner (score: per mille of the sizes, at
    most 500) and its leader, the medoid that most of the block could link to (score: 1000 and how many).
    """
    m = len(nodes)
    length = np.array([len(v) for v in vectors])
    best = np.zeros(m)
    partner = np.full(m, -1)
    out = []
    for g in np.unique(length):
        own = np.flatnonzero(length == g)
        asking = np.flatnonzero((length == g) | (length == 2 * g))
        tree = CountTree(np.array([vectors[i] for i in own], np.int32).reshape(len(own), g), sizes[own])
        for at in range(0, len(asking), QUERIES):
            some = asking[at : at + QUERIES]
            for q, rows, bound in tree.search(np.array([fold(vectors[i], g) for i in some], np.int32), sizes[some]):
                a, b = some[q], own[rows]
                ok = passing(sizes[a], sizes[b], bound)
                ok &= (sizes[a][:, None] > sizes[b][None, :]) | ((sizes[a][:, None] == sizes[b][None, :]) & (a[:, None] > b[None, :]))
                if labels is not None:
                    ok &= labels[a][:, None] != labels[b][None, :]
                    x, y = np.nonzero(ok)
                    out.append(np.stack([nodes[a[x]], nodes[b[y]], np.zeros(len(x), np.int64)], 1))
                elif ok.any():
                    score = np.where(ok, bound / (sizes[a][:, None] + sizes[b][None, :]), 0)
                    for mine, theirs, s in ((a, b, score), (b, a, score.T)):
                        top = s.argmax(1)
                        value = s[np.arange(len(mine)), top]
                        better = value > best[mine]
                        best[mine[better]], partner[mine[better]] = value[better], theirs[top[better]]
    if labels is None:
        have = np.flatnonzero(partner >= 0)
        out.append(np.stack([nodes[have], nodes[partner[have]], (best[have] * 1000).astype(np.int64)], 1))
        if m > 3 and len(have):
            out.append(leader_pairs(nodes, sizes, vectors, int(length.min())))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def leader_pairs(nodes: np.ndarray, sizes: np.ndarray, vectors: list[np.ndarray], g: int, probes: int = 64) -> np.ndarray:
    """Every point with the one point that most of an even selection could link to."""
    counts = np.array([fold(v, g) for v in vectors], np.int32)
    probe = np.unique(np.linspace(0, len(nodes) - 1, probes).astype(int))
    linked = lambda i: passing(sizes[i : i + 1], sizes, np.minimum(counts[i], counts).sum(1)[None])[0]
    votes = sum(linked(i).astype(int) for i in probe)
    leader = int(votes.argmax())
    ok = np.flatnonzero(linked(leader))
    ok = ok[ok != leader]
    return np.stack([nodes[ok], np.full(len(ok), nodes[leader]), np.full(len(ok), 1000 + votes[leader])], 1)


def hot_shingles(docs: DataFrame, n_docs: int) -> np.ndarray:
    """Shingles that a sample shows to be in some ``HOT_DOCS`` documents, or in ``HOT_SHARE`` of all if that is fewer; the ``HOT_MOST`` most frequent.

    With a share alone, blocks would grow with the table and their pairs with its square. The sample grows with the table
    (a document in 25), so that it has such shingles often enough to tell.
    """
    step = max(1, min(n_docs // SAMPLE_DOCS, HOT_DOCS // HOT_SEEN))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(step)) == 0)

    def run(batches):
        for part in slices(batches):
            found = [s for _, s in shingle_sets(part.column(1))]
            key, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n, pa.int64())], ["key", "n"])

    counted = sample.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    least = max(HOT_SEEN, min(HOT_SHARE * n_docs, HOT_DOCS) / step)
    top = counted.where(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(HOT_MOST).select("key")
    return np.sort(top.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def prefix(shingles: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The first n - ceil(3n/4) + 1 shingles; the frequent ones come last in the order."""
    length = len(shingles) - -(-3 * len(shingles) // 4) + 1
    if len(hot):
        at = np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)
        is_hot = hot[at] == shingles
        if is_hot.any():
            shingles = np.concatenate([shingles[~is_hot], shingles[is_hot]])
    return shingles[:length]


def describe(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """doc_id, node, n, and the prefix keys and count vector (empty and null if this task has emitted the node before)."""
    hot_keys = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        seen: set[int] = set()
        for part in slices(batches):
            nodes, sizes, keys, vectors = [], [], [], []
            for node, shingles in shingle_sets(part.column(1)):
                nodes.append(node)
                sizes.append(len(shingles))
                new = len(shingles) and node not in seen
                seen.add(node)
                keys.append(prefix(shingles, hot_keys.value) if new else shingles[:0])
                vectors.append(pack_counts(count_vector(shingles)) if new else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()),
                 lists(np.concatenate(keys).view(np.int64), np.array([len(k) for k in keys]), pa.int64()), pa.array(vectors, pa.binary())], ["doc_id", "node", "n", "keys", "vector"])

    return docs.mapInArrow(run, "doc_id bigint, node bigint, n bigint, keys array<bigint>, vector binary")


def shared_keys(keys: DataFrame) -> DataFrame:
    """Distinct (key, node) of those keys that two or more nodes have."""

    def run(batches):
        kept = None  # the last key's rows may go on in the next batch
        for batch in batches:
            key, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if kept is not None:
                key, node = np.concatenate([kept[0], key]), np.concatenate([kept[1], node])
            if not len(key):
                continue
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node = key[new], node[new]
            cut = int(np.searchsorted(key, key[-1])) if not (key[:-1] > key[1:]).any() else len(key)
            kept = (key[cut:], node[cut:])
            yield shared(key[:cut], node[:cut])
        if kept is not None:
            yield shared(*kept)

    def shared(key, node):
        same = key[1:] == key[:-1]
        ok = np.zeros(len(key), bool)
        ok[1:] |= same
        ok[:-1] |= same
        return pa.RecordBatch.from_arrays([pa.array(key[ok], pa.int64()), pa.array(node[ok], pa.int64())], ["key", "node"])

    return keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key bigint, node bigint")


def full_sets(docs: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """node and sorted shingles of the nodes in ``pairs``, from the text of one document of each."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    chosen = members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(nodes, "node", "left_semi").select("doc_id").where("doc_id is not null").distinct()

    def run(batches):
        for part in slices(batches):
            found = [(node, s) for node, s in shingle_sets(part.column(1)) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([n for n, _ in found], np.uint64).view(np.int64)), pa.array([s.astype("<u8").tobytes() for _, s in found], pa.binary())], ["node", "shingles"])

    schema = "node bigint, shingles binary"
    sets = docs.join(chosen, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, schema)
    # A node may have rows without an id only: those rows all come, each node once.
    nameless = docs.where("doc_id is null").select("doc_id", "text").mapInArrow(run, schema).dropDuplicates(["node"])
    sets = save(sets.unionByName(nameless), "sets")
    release(docs.sparkSession)
    return sets


def candidates(blocks: DataFrame, labelled: bool) -> DataFrame:
    """Distinct (node, other, score) of all blocks, see :func:`block_pairs`; ``blocks``: key, chunk, node, n, vector and, if labelled, label."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        sent: set[tuple[int, int]] = set()

        def emit(table_: pa.Table):
            key, chunk = table_.column("key").to_numpy(), table_.column("chunk").to_numpy()
            ends = np.flatnonzero(np.concatenate([(key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1]), [True]])) + 1
            node, n = table_.column("node").to_numpy(), table_.column("n").to_numpy()
            label = table_.column("label").to_numpy() if labelled else None
            vectors = [unpack_counts(v.as_buffer(), size) for v, size in zip(table_.column("vector"), n, strict=True)]
            at, out = 0, []
            for end in ends:
                if end - at > 1:
                    out.append(block_pairs(node[at:end], n[at:end], vectors[at:end], label[at:end] if labelled else None))
                at = end
            found = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)
            if labelled:  # blocks share pairs; those that this task has sent need not go again
                new = [p not in sent for p in map(tuple, found[:, :2].tolist())]
                found = found[new]
                if len(sent) > 500_000:
                    sent.clear()
                sent.update(map(tuple, found[:, :2].tolist()))
            return pa.RecordBatch.from_arrays([pa.array(found[:, i]) for i in range(3)], ["node", "other", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            key, chunk = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            last = np.flatnonzero((key != key[-1]) | (chunk != chunk[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut or (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) != (key[-1], chunk[-1]):
                yield emit(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
                held = [batch.slice(cut)]
        if held:
            yield emit(pa.Table.from_batches(held))

    columns = ["key", "chunk", "node", "n", "vector", *["label"] * labelled]
    return blocks.select(*columns).repartition("key", "chunk").sortWithinPartitions("key", "chunk").mapInArrow(run, "node bigint, other bigint, score bigint").where("node <> other")


def as_pairs(found: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b."""
    return found.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def by_chance(p: int, q: int) -> int:
    """More common values than chance gives two sets of that many 32-bit hashes: far beyond the expected number."""
    return 16 + (4 * p * q >> 32)


def compare(pairs: DataFrame, sets: DataFrame, kind: str) -> DataFrame:
    """a, b and the verdict: 0 no link, 1 a link even if some common values of half hashes were chance, 2 otherwise."""

    def run(batches):
        for batch in batches:
            verdict = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), kind), np.frombuffer(y.as_buffer(), kind)
                both = np.concatenate([p, q])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                links = [100 * c >= 75 * (len(p) + len(q) - c) for c in (common, common - (by_chance(len(p), len(q)) if kind == "<u4" else 0))]
                verdict.append(1 if links[1] else 2 if links[0] else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(verdict, pa.int32())], ["a", "b", "verdict"])

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint, verdict int")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with ``linked``, by the full sets.

    Half of each hash is compared first: its common values are never too few, so what fails is no link; what passes by
    more than a few values that chance could add is one; the rest is compared by the whole hashes.
    """

    def halve(batches):
        for batch in batches:
            half = [(np.frombuffer(x.as_buffer(), "<u8") >> np.uint64(32)).astype("<u4").tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(half, pa.binary())], ["node", "shingles"])

    first = save(compare(pairs, sets.select("node", "shingles").mapInArrow(halve, "node bigint, shingles binary"), "<u4"), "compared")
    release(pairs.sparkSession)
    second = compare(first.where("verdict = 2").select("a", "b"), sets, "<u8")
    return first.where("verdict <> 2").unionByName(second).select("a", "b", (F.col("verdict") == 1).alias("linked"))


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, node of every row of ``docs``."""
    small_batches(docs.sparkSession)
    docs = with_defaults(docs, doc_id="bigint", text="string")
    hot = hot_shingles(docs, docs.count())
    described = save(describe(docs, hot), "prefixes")
    members = save(described.select("doc_id", "node", "n"), "members")
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")  # rows of two numbers
    shared = save(shared_keys(described.select(F.explode("keys").alias("key"), "node")), "shared")
    small_batches(docs.sparkSession)
    fresh = described.where("vector is not null").join(shared.select("node").distinct(), "node", "left_semi")
    vectors = save(fresh.groupBy("node", "n").agg(F.first("vector").alias("vector")), "vectors")
    drop_saved(described)
    release(docs.sparkSession)

    signature = shared.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("first"), F.max("node").alias("last"), F.bit_xor(F.xxhash64("node")).alias("x"))
    blocks = signature.groupBy("m", "first", "last", "x").agg(F.min("key").alias("key"))
    blocks = save(blocks, "signatures")
    rows = save(shared.join(blocks, "key").select("key", "m", "node"), "blocks")
    release(docs.sparkSession)
    chunks = F.greatest(F.lit(1), F.ceil(F.col("m") / CHUNK)).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(5)), chunks).cast("int")
    few = blocks.withColumn("r", F.row_number().over(W.partitionBy("first").orderBy(F.desc("m"), "key"))).where(F.col("r") <= FIRST_BLOCKS).select("key")
    found = save(candidates(rows.join(few, "key", "left_semi").select("key", "node", mine.alias("chunk")).join(vectors, "node"), False), "candidates")
    best = save(found.groupBy("node", (F.col("score") >= 1000).alias("leader")).agg(F.max_by("other", F.struct("score", "other")).alias("other")), "best")
    release(docs.sparkSession)
    sets = full_sets(docs, members, as_pairs(best))
    tried = save(verify(as_pairs(best.where("leader")), sets), "verified")
    first = components(tried.where("linked"))
    # Best partners only where the leaders have not joined them.
    label = lambda c: first.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    apart = as_pairs(best.where("not leader")).join(label("a"), "a", "left").join(label("b"), "b", "left")
    apart = apart.where(F.coalesce("a_in", "a") != F.coalesce("b_in", "b")).select("a", "b").join(tried, ["a", "b"], "left_anti")
    tried = tried.unionByName(save(verify(apart, sets), "verified"))
    drop_saved(sets)
    release(docs.sparkSession)
    links = tried.where("linked").select("a", "b")
    first = components(links)

    labelled = rows.join(first, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    open_blocks = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    leading = labelled.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("top")).select("key", F.col("top.label").alias("leading"))
    placed = labelled.join(open_blocks.join(leading, "key"), "key").withColumn("outside", F.col("label") != F.col("leading"))
    everywhere = F.when(F.col("outside"), F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(mine))
    second = as_pairs(candidates(placed.select("key", "node", "label", F.explode(everywhere).alias("chunk")).join(vectors, "node"), True))
    second = save(second.join(tried, ["a", "b"], "left_anti"), "candidates")
    release(docs.sparkSession)
    more = save(verify(second, full_sets(docs, members, second)).where("linked").select("a", "b"), "links")
    release(docs.sparkSession)
    joined = components(links.unionByName(more))

    smallest = members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("low"))
    owner = smallest.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = owner.groupBy("component").agg(F.min("low").alias("component_id"))
    named = owner.join(lowest, "component").select("node", "component_id")
    return members.join(named, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "node"
    )


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
