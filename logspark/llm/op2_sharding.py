"""Sharding by minimax contiguous partition.

Documents with equal texts form an atomic group. Groups are ordered by text
hash, and neighbours in that order are gathered into at most ``2**bits``
atomic runs (a run holds whole groups), so that the sizes to cut are few at any
scale while a shard still consists of more than a thousand runs. A binary
search over the capacity, each time checked greedily, finds the smallest
feasible one; the shards are cut within it, as near to equal shares as it allows. A group that alone is larger than a
fair share of what remains takes a shard of its own before the search, which
keeps the others even.

Law: ``bytes``. A row's size is its UTF-8 length plus 16. Null text counts 16
and forms one group; empty text forms another. Repeated rows are kept, each
with its own slot. An empty table gives an empty result. Extra columns are
ignored. Only DataFrame functions run on the data; the driver sees at most
``2**bits`` run sizes and as many large groups as there are shards.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import hash128, save, table, with_defaults

ROW_BYTES = 16
ROWS_PER_BLOCK = 50_000


def feasible_cuts(ends: list[int], shards: int, capacity: int) -> list[int] | None:
    """Greedy check: the run indices at which each shard ends, or None if ``shards`` don't suffice."""
    cuts, at, done = [], 0, 0
    for _ in range(shards):
        at = bisect_right(ends, done + capacity)
        cuts.append(at)
        if at == len(ends):
            return cuts + [at] * (shards - len(cuts))
        done = ends[at - 1] if at else 0
    return None


def minimax_cuts(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """Smallest capacity for which the ordered sizes fit into ``shards`` contiguous pieces, and the cuts."""
    if not sizes:
        return 0, [0] * shards
    ends = list(accumulate(sizes))
    low, high = max(max(sizes), -(-ends[-1] // shards)), ends[-1]
    while low < high:
        middle = (low + high) // 2
        if feasible_cuts(ends, shards, middle) is None:
            low = middle + 1
        else:
            high = middle
    return low, even_cuts(ends, shards, low)


def even_cuts(ends: list[int], shards: int, capacity: int) -> list[int]:
    """Of all cuts within the capacity, those nearest to equal shares.

    ``earliest`` comes from the greedy check run from the right: cutting there or
    later leaves what the remaining shards can hold.
    """
    total, starts = ends[-1], [0, *ends]
    earliest, at = [0] * (shards + 1), len(ends)
    for k in range(shards, -1, -1):
        earliest[k] = at
        at = bisect_left(starts, starts[at] - capacity)
    cuts, last = [], 0
    for k in range(1, shards + 1):
        reach = bisect_right(ends, starts[last] + capacity)
        share = bisect_left(starts, total * k / shards)
        if share and total * k / shards - starts[share - 1] < starts[share] - total * k / shards:
            share -= 1
        last = min(max(share, earliest[k], last), reach)
        cuts.append(last)
    return cuts


def assign_shards(docs: DataFrame, shards: int = 40, bits: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    d = with_defaults(docs, doc_id="bigint", text="string")
    k1, k2 = hash128(F.coalesce(F.concat(F.lit("t"), "text"), F.lit("n")))
    rows = save(d.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
        k1.alias("k1"),
        k2.alias("k2"),
        (F.shiftrightunsigned(k1, 64 - bits)).cast("int").alias("run"),
    ), "sizes")  # the texts are read once; all that follows works on these few bytes a row
    groups = rows.groupBy("k1", "k2").agg(F.sum("size").alias("w"), F.min("run").alias("run"))
    # Runs and large groups come from one pass: at most `shards` groups reach a fair share of all bytes.
    runs = {r["run"]: (r["w"], r["n"]) for r in rows.groupBy("run").agg(F.sum("size").alias("w"), F.count("*").alias("n")).collect()}
    total, count, left = sum(w for w, _ in runs.values()), sum(n for _, n in runs.values()), shards
    alone: list[tuple[int, int]] = []
    for g in groups.where(F.col("w") >= max(1, total // shards)).orderBy(F.desc("w"), "k1", "k2").limit(shards).collect():
        if left > 1 and g["w"] * left >= total:
            alone.append((g["k1"], g["k2"]))
            runs[g["run"]] = (runs[g["run"]][0] - g["w"], runs[g["run"]][1])
            total, left = total - g["w"], left - 1
    order = sorted(runs)
    _, cuts = minimax_cuts([runs[r][0] for r in order], left)
    bounds = [order[c] if c < len(order) else 1 << bits for c in cuts[:-1]]
    shard = F.lit(len(alone))
    if bounds:
        shard = shard + F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("run")))
    for i, (a, b) in reversed(list(enumerate(alone))):
        shard = F.when((F.col("k1") == a) & (F.col("k2") == b), F.lit(i)).otherwise(shard)
    # Slots: blocks by hash of the id, gapless by the blocks' running counts; no shard is one task.
    blocks = max(1, -(-count // (shards * ROWS_PER_BLOCK))) * 4
    placed = rows.select(
        "doc_id", "size", "text_crc32", shard.cast("int").alias("shard"),
        F.pmod(F.xxhash64("doc_id", "k1"), F.lit(blocks)).cast("int").alias("block"),
    )
    before = placed.groupBy("shard", "block").agg(F.count("*").alias("n")).select(
        "shard", "block",
        F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    ranked = placed.withColumn("r", F.row_number().over(W.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32")))
    return ranked.join(before, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("r") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))
