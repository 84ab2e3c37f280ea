"""Mixing sources to target weights by hierarchical budgeting.

The sources form a tree (domain, language, source). A token budget runs down
it: each node divides its budget among its children by weight; a child whose
documents cannot fill its share (all epochs counted) gets what it has, and the
shortage goes to its siblings by weight. Only what all siblings together cannot
take is left to the siblings of their parent, and so on up.

A leaf's documents are repeated in epochs, each in its own seeded order, and
the leaf's part is the longest prefix of that endless sequence within its
budget: some whole epochs and a prefix of the next. The prefix is found by
token sums over 4096 ranges of the order hash and then within the one range
where it ends, so no leaf is ever sorted whole, and selection is a filter on
each row: texts are never shuffled.

A token is a run of characters other than space and 0x09-0x0D. Documents
without tokens (null texts too) are never selected. Null levels form nodes of
their own; weights not given are 1. Rows with equal doc_id in a leaf are in or
out together. Empty tables or a budget of 0 select nothing. The driver holds
the tree, a row per leaf; more than ``max_leaves`` leaves is an error.
Columns named domain, epoch, n_tokens are replaced if ``docs`` has them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import save, table

RANGE_BITS = 12
#: Targets of the query: English twice any other language, all else even.
WEIGHTS: dict[tuple, float] = {("*", "en"): 2.0}
Tree = dict[tuple, int]


def domain_of(source: Column) -> Column:
    """Five numbered sources make a domain; the rest is "other"."""
    number = F.regexp_extract(source, r"(\d{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("domain"), F.floor(F.expr("try_cast(regexp_extract(source, '(\\\\d{1,9})$', 1) as int)") / 5).cast("string"))).otherwise("other")


def weight_of(path: tuple, weights: Mapping[tuple, float]) -> float:
    """The weight given for a path, else for the same path under any ("*") ancestors, else 1."""
    return weights.get(path, weights.get(("*",) * (len(path) - 1) + path[-1:], 1.0))


def allocate(capacity: Tree, budget: int, weights: Mapping[tuple, float]) -> Tree:
    """Budget per leaf path; ``capacity`` has the tokens that each leaf can give at most."""
    if not capacity:
        return {}
    depth = len(next(iter(capacity)))
    room: dict[tuple, int] = {}
    for path, n in capacity.items():
        for d in range(depth + 1):
            room[path[:d]] = room.get(path[:d], 0) + n
    children: dict[tuple, list[tuple]] = {}
    for path in sorted(room, key=lambda p: [(x is None, str(x)) for x in p]):
        if path:
            children.setdefault(path[:-1], []).append(path)
    given: dict[tuple, int] = {(): min(budget, room[()])}
    for d in range(depth):
        for node in [p for p in given if len(p) == d]:
            left, open_ = given[node], children[node]
            while True:
                total = sum(weight_of(c, weights) for c in open_)
                share = {c: left * weight_of(c, weights) / total if total else 0 for c in open_}
                short = [c for c in open_ if room[c] <= share[c]]
                if not short:
                    break
                for c in short:
                    given[c] = room[c]
                    left -= room[c]
                open_ = [c for c in open_ if c not in short]
            whole = {c: int(share[c]) for c in open_}
            # Rounding leaves less than a token a sibling: it goes to those with the largest fractions, all of which have room.
            for c in sorted(open_, key=lambda c: whole[c] - share[c])[: max(0, left - sum(whole.values())) if open_ else 0]:
                whole[c] += 1
            given |= whole
    return {p: given[p] for p in capacity}


def mix_sources(docs: DataFrame, weights: Mapping[tuple, float] | None = None, budget: int | None = None, max_epochs: int = 4, seed: int = 1, max_leaves: int = 100_000, domain: Column | None = None) -> DataFrame:
    """Selected rows of ``docs`` with domain, epoch and n_tokens; the default budget is the tokens there are."""
    spark = docs.sparkSession
    weights = WEIGHTS if weights is None else weights
    columns = [c for c in docs.columns if c not in ("domain", "epoch", "n_tokens")]
    for c in ("lang", "source"):
        if c not in columns:
            docs = docs.withColumn(c, F.lit(None).cast("string"))
    rows = docs.withColumn("domain", domain_of(F.col("source")) if domain is None else domain)
    rows = rows.withColumn("n_tokens", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint"))
    levels = ["domain", "lang", "source"]
    counted = save(rows.where("n_tokens > 0").select("doc_id", "n_tokens", *levels), "tokens")
    leaves = counted.groupBy(*levels).agg(F.sum("n_tokens").alias("t")).limit(max_leaves + 1).collect()
    if len(leaves) > max_leaves:
        raise ValueError(f"more than {max_leaves} leaves")
    have = {tuple(r[c] for c in levels): r["t"] for r in leaves}
    quota = allocate({p: n * max_epochs for p, n in have.items()}, sum(have.values()) if budget is None else budget, weights)
    plan = spark.createDataFrame(
        [(*p, quota[p] // have[p], quota[p] % have[p]) for p in sorted(have, key=str)],
        ", ".join(f"_{c} string" for c in levels) + ", _whole int, _rest bigint",
    )
    here = F.lit(True)
    for c in levels:
        here &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    order = F.xxhash64(F.lit(seed), F.col("_whole"), F.col("doc_id"))
    span = F.shiftrightunsigned(order.bitwiseXOR(F.lit(-(1 << 63))), 64 - RANGE_BITS)
    placed = counted.join(F.broadcast(plan), here).where("_rest > 0").withColumn("_h", order).withColumn("_span", span)
    keys = [f"_{c}" for c in levels]
    sums = placed.groupBy(*keys, "_rest", "_span").agg(F.sum("n_tokens").alias("t"))
    running = sums.withColumn("_until", F.sum("t").over(W.partitionBy(*keys).orderBy("_span")))
    ends = running.where(F.col("_until") > F.col("_rest")).groupBy(*keys).agg(F.min(F.struct("_span", (F.col("_until") - F.col("t")).alias("before"))).alias("e"))
    ends = [(*[r[k] for k in keys], r["e"]["_span"], r["e"]["before"]) for r in ends.collect()]
    end = spark.createDataFrame(ends, ", ".join(f"_x{c} string" for c in levels) + ", _end bigint, _before bigint")
    same = F.lit(True)
    for c in levels:
        same &= F.col(f"_{c}").eqNullSafe(F.col(f"_x{c}"))
    last = placed.join(F.broadcast(end), same & (F.col("_span") == F.col("_end")))
    within = last.withColumn("_until", F.col("_before") + F.sum("n_tokens").over(W.partitionBy(*keys).orderBy("_h", "doc_id")))
    cuts = within.where(F.col("_until") <= F.col("_rest")).groupBy(*keys).agg(F.max(F.struct("_h", "doc_id")).alias("c")).collect()
    cut = {tuple(r[k] for k in keys): (r["c"]["_h"], r["c"]["doc_id"]) for r in cuts}
    bound = {e[:3]: e[3] for e in ends}
    final = spark.createDataFrame(
        [(*p, quota[p] // have[p], quota[p] % have[p], bound.get(p), *cut.get(p, (None, None))) for p in sorted(have, key=str)],
        ", ".join(f"_{c} string" for c in levels) + ", _whole int, _rest bigint, _end bigint, _cut_h bigint, _cut_doc bigint",
    )
    joined = rows.where("n_tokens > 0").join(F.broadcast(final), here).withColumn("_h", order).withColumn("_span", span)
    before_cut = (F.col("_h") < F.col("_cut_h")) | ((F.col("_h") == F.col("_cut_h")) & (F.col("doc_id").isNull() | (F.col("doc_id") <= F.col("_cut_doc"))))
    partly = (F.col("_rest") > 0) & ((F.col("_span") < F.col("_end")) | ((F.col("_span") == F.col("_end")) & F.coalesce(before_cut, F.lit(False))))
    epochs = F.filter(F.sequence(F.lit(0), F.col("_whole")), lambda e: (e < F.col("_whole")) | partly)
    return joined.withColumn("epoch", F.explode(epochs)).select(*[f"`{c}`" for c in columns], "domain", "epoch", "n_tokens")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "domain", "lang", "source", "epoch", "n_tokens")
