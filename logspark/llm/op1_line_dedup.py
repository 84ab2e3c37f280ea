"""Fuzzy line dedup by MinHash, with DataFrame functions only.

Lines are compared lower-cased and without surrounding white space. Their
similarity is that of their sets of character shingles: every run of eight
characters (UTF-16 units), or the whole line where it is shorter.

1. Equal lines become one node, kept once with its wording and its number; they
   are pre-aggregated before the shuffle.
2. All shingles of a node are hashed once; XOR with fixed constants gives the
   permutations, whose minima form the signature. The constants differ in their
   first bits and agree in the rest, so that only hashes with a small rest can
   be minima: of long lines those with a larger one are not aggregated (an
   average of ``PER_MINIMUM`` hashes stays for each minimum).
3. Bands of the signature form buckets. Within a bucket each node is paired
   with the line that occurs most often; further turns pair those still apart
   with two members of its largest component. So large groups come together
   by few pairs; where few comparisons are left, turns are left out. Then all
   pairs still apart are tested, in buckets of any size.
4. Pairs are screened by sketches of 1792 bits, each telling whether an odd
   number of a set's distinct shingles hash to it: two sketches differ in no more
   bits than the sets do in shingles, and similar sets differ in at most a seventh
   of both sizes, so the screen loses no pair.
   What passes fetches its lines and is verified by the exact
   Jaccard similarity of all shingles (64-bit hashes), as arrays within the pair's row,
   with a line over ``LONG`` characters as rows; of those still apart after
   the turns, each node's likeliest pair first, then all that it leaves apart.
   Screening happens inside joins of blocks; other pairs are never rows.
5. Union-find (alternating stars on edge tables) joins verified pairs; links of
   later turns only join the components so far. Of each
   component, equal lines included, the first line by (doc_id, line number)
   stays; texts with the same doc_id come by their hash, null doc_ids first.

Blank lines always stay. A document all of whose lines go keeps them only and
is else empty (the pipeline stage drops it). Null text stays null with no
lines. A row is known by doc_id and text, so different texts with one doc_id
are different documents; of rows equal in both, one counts as the first, and
the others lose all their lines. Empty tables give empty results.
"""

from __future__ import annotations

import random
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import drop_saved, release, save, table
from .graph import components

SHINGLE, THRESHOLD = 8, 0.75
BANDS, ROWS = 9, 3
PER_MINIMUM, BINS = 4, 32
#: 64-bit words of a node's sketch; with some more, the screen's method is too long (8000 bytes of code) for the JVM to compile.
WORDS = 28
#: Shingles, repeated ones included, up to which a line's are held as one array; those of longer lines are rows.
LONG = 50_000
#: Shingles hashed in one row for the sketches.
CHUNK = 16
TURNS = 3
#: Comparisons for each row of a bucket that cost less than one more turn does.
FEW = 8
BLOCK = 256
BLANKS = " \t\r\f\u000b"
_REST = random.Random(1).getrandbits(27)
#: One of 32 five-bit beginnings each (sign included), and one rest.
_MASKS = [((i << 27) | _REST) - (1 << 32) * (i >= 16) for i in range(BANDS * ROWS)]


def normal(line: Column) -> Column:
    # Trimming by a set of characters reads the whole line, so only lines with a blank at an end are trimmed.
    ends = [at(line, F.lit(c)) for c in BLANKS for at in (F.startswith, F.endswith)]
    return F.lower(F.when(reduce(or_, ends), F.btrim(line, F.lit(BLANKS))).otherwise(line))


def row_key(doc_id: str | Column = "doc_id", text: str | Column = "text") -> Column:
    return F.xxhash64(doc_id, text)


def lines_of(docs: DataFrame) -> DataFrame:
    """row, doc_id, pos and normal form of every line that is not blank, with its identity ``node``, a 64-bit hash."""
    each = docs.where("text is not null").select(row_key().alias("row"), "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    each = each.select("row", "doc_id", "pos", normal(F.col("raw")).alias("line")).where("line <> ''")
    return each.select("row", "doc_id", "pos", F.xxhash64("line").alias("node"), "line")


def units(line: str = "line") -> Column:
    """The line as two bytes a character, of which any run is cut out without reading those before."""
    return F.encode(line, "UTF-16BE")


def runs(n_bytes: Column) -> Column:
    """How many shingles begin in a line of that many bytes, repeated ones included."""
    return F.greatest(F.shiftright(n_bytes, 1) - (SHINGLE - 1), F.lit(1))


def hash_at(bin_: str | Column, at: Column) -> Column:
    return F.xxhash64(F.substring(bin_, at * 2 + 1, F.lit(2 * SHINGLE)))


def hashes(bin_: str) -> Column:
    """Hashes of all shingles, repeated ones included, as an array made within the row.

    One regular expression cuts all runs out, of a text with a character for each byte.
    """
    text = F.decode(bin_, "ISO-8859-1")
    cut = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{2 * SHINGLE}}})).."), F.lit(1))
    cut = F.when(F.octet_length(bin_) > 2 * SHINGLE, cut).otherwise(F.array(text))
    return F.transform(cut, lambda x: F.xxhash64(x))


def signatures(nodes: DataFrame) -> DataFrame:
    """node, n and the minima ``sig``, one row for each distinct line (node, bin, n: how often it occurs)."""
    each = nodes.withColumnRenamed("n", "copies").select("node", "copies", "bin", runs(F.octet_length("bin")).alias("n"))
    most = (F.least(F.lit(1.0), F.lit(float(BINS * PER_MINIMUM)) / F.col("n")) * float(1 << 27)).cast("bigint")
    each = each.select("node", "copies", "bin", most.alias("most"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    hashed = each.select("node", "copies", "most", F.shiftright(hash_at("bin", F.col("at")), 32).cast("int").alias("h"))
    small = hashed.where(F.col("h").bitwiseXOR(F.lit(_REST)).bitwiseAND(F.lit((1 << 27) - 1)) < F.col("most"))
    least = small.groupBy("node", "copies").agg(*[F.min(F.col("h").bitwiseXOR(F.lit(m))).alias(f"m{i}") for i, m in enumerate(_MASKS)])
    return least.select("node", F.col("copies").alias("n"), F.array(*[f"m{i}" for i in range(len(_MASKS))]).alias("sig"))


def bands() -> Column:
    return F.array(*[F.xxhash64(F.lit(b), *[F.col("sig")[b * ROWS + r] for r in range(ROWS)]) for b in range(BANDS)])


def sketches(wording: DataFrame) -> DataFrame:
    """node, ``bits`` and n (distinct shingles) of the nodes (node, bin); the caller deals them by node, so that all aggregations stay within their task."""
    bit = F.expr("shiftleft(1L, cast(shiftright(h, 8) & 63 as int))")
    word = F.pmod("h", F.lit(WORDS)).alias("word")
    size = runs(F.octet_length("bin"))
    # Hashes as arrays of a few, a row for each: they are cut by compiled code, which no function of whole arrays is.
    some = wording.where(size <= LONG).select("node", "bin", size.alias("size"), F.explode(F.sequence(F.lit(0), size - 1, F.lit(CHUNK))).alias("at"))
    chunks = some.select("node", F.array(*[hash_at("bin", F.least(F.col("at") + i, F.col("size") - 1)) for i in range(CHUNK)]).alias("chunk"))
    short = chunks.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("chunk"))).alias("set")).select("node", F.explode("set").alias("h"))
    each = wording.where(size > LONG).select("node", "bin", F.explode(F.sequence(F.lit(0), size - 1)).alias("at"))
    long = each.select("node", hash_at("bin", F.col("at")).alias("h")).groupBy("node", "h").agg(F.lit(1).alias("one"))

    # One row a word first: few rows then meet the columns of all words.
    columns = [F.bit_xor(F.when(F.col("word") == i, F.col("bits")).otherwise(F.lit(0).cast("bigint"))).alias(f"w{i}") for i in range(WORDS)]

    def folded(rows: DataFrame) -> DataFrame:
        by_word = rows.groupBy("node", word).agg(F.count("*").alias("n"), F.bit_xor(bit).alias("bits"))
        return by_word.groupBy("node").agg(F.sum("n").alias("n"), *columns)

    return folded(short).unionByName(folded(long)).select("node", "n", F.array(*[f"w{i}" for i in range(WORDS)]).alias("bits"))


def differing(x: Column, y: Column) -> Column:
    """Bits in which two sketches differ."""
    # F.get, as the code that raises errors for x[i] is longer still.
    word = lambda i: F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i))))
    return sum((word(i) for i in range(1, WORDS)), word(0))


def near(n: Column, x: Column, y: Column, threshold: float = THRESHOLD) -> Column:
    """False only for sketches of sets, of n distinct shingles together, whose similarity is below the threshold."""
    return differing(x, y) * (1 + threshold) <= n * (1 - threshold)


def shared_buckets(buckets: DataFrame) -> DataFrame:
    """(bucket, node, n, lead) of the buckets with two nodes or more; lead is the one of them that occurs most often.

    Near copies differ less from their original than from each other, and lines that nobody changed repeat it.
    """
    # Dealt once: the buckets' ends and the join read the same shuffle, and nearly all buckets are of one node, so nothing is
    # gained by aggregating before it.
    dealt = buckets.repartition("bucket")
    ends = dealt.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max("n").alias("top")).where("low <> high").select("bucket", "top")
    shared = save(dealt.join(ends.hint("shuffle_hash"), "bucket"), "shared")
    release(buckets.sparkSession)
    leads = shared.where("n = top").groupBy("bucket").agg(F.min("node").alias("lead"))
    out = save(shared.join(leads, "bucket").select("bucket", "node", "n", "lead"), "shared")
    drop_saved(shared)
    return out


def pairs_with(rows: DataFrame, member: str, others: Column) -> DataFrame:
    """Distinct (a, b) of each member and the others beside it."""
    paired = rows.select(member, F.explode(others).alias("other")).where(F.col(member) != F.col("other"))
    return paired.select(F.least(member, "other").alias("a"), F.greatest(member, "other").alias("b")).distinct()


def similar(pairs: DataFrame, texts: DataFrame, sketched: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs whose exact Jaccard similarity reaches the threshold; ``texts``: node, line; ``sketched``: node, n, bits."""
    left, right = sketched.toDF("a", "m", "p"), sketched.toDF("b", "n", "q")
    met = pairs.join(left, "a").join(right, "b").where(near(F.col("m") + F.col("n"), F.col("p"), F.col("q"), threshold))
    # Only what passes fetches its lines.
    both = (F.col("m") + F.col("n")).alias("both")
    sides = met.select("a", "b", both, F.posexplode(F.array("a", "b")).alias("side", "node")).join(texts, "node")
    # Dealt by pair, however many pairs a node has; a pair's lines then meet in its task. As each byte becomes a shingle, the
    # tasks are not joined to fewer.
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sides.select("a", "b", "both", "side", "line").repartition(tasks, "a", "b")
    bins = [units(F.max(F.when(F.col("side") == i, F.col("line")))).alias(c) for i, c in enumerate(("x", "y"))]
    wording = dealt.groupBy("a", "b", "both").agg(*bins)
    size = runs(F.greatest(F.octet_length("x"), F.octet_length("y")))
    short = wording.where(size <= LONG).select("a", "b", "both", F.size(F.array_intersect(hashes("x"), hashes("y"))).alias("common"))
    sides = wording.where(size > LONG).select("a", "b", "both", F.posexplode(F.array("x", "y")).alias("side", "bin"))
    each = sides.select("a", "b", "both", "side", "bin", F.explode(F.sequence(F.lit(0), runs(F.octet_length("bin")) - 1)).alias("at"))
    found = each.select("a", "b", "both", "side", hash_at("bin", F.col("at")).alias("h")).groupBy("a", "b", "both", "h").agg(F.min("side").alias("low"), F.max("side").alias("high"))
    long = found.groupBy("a", "b", "both").agg(F.sum(F.col("high") - F.col("low")).alias("common"))
    return short.unionByName(long).where(F.col("common") >= threshold * (F.col("both") - F.col("common"))).select("a", "b")


def comparisons(named: DataFrame) -> int:
    """How many pairs :func:`apart_pairs` has to screen, at most."""
    sizes = named.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    whole = sizes.groupBy("bucket").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    return whole.agg(F.sum((F.col("all") - F.col("most")) * F.col("all").cast("double"))).first()[0] or 0


def apart_pairs(named: DataFrame, sketched: DataFrame) -> DataFrame:
    """x, y and ``gap`` (smaller: likelier) of all nodes of a bucket in different components, whose sketches are near enough.

    ``named``: bucket, node, component; ``sketched``: node, n, bits. One of two nodes is outside the bucket's leading component,
    so those meet all others: by blocks, so that no task gets all of a large bucket.
    """
    sizes = named.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    lead = sizes.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("lead"))
    lead = lead.where("parts > 1").select("bucket", F.col("lead.component").alias("lead"), F.ceil(F.col("all") / BLOCK).cast("int").alias("parts"))
    rows = named.drop("n").join(lead, "bucket").join(sketched, "node").withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    one = rows.where("component <> lead").select("bucket", "part", every.alias("other"), F.col("node").alias("x"), F.col("component").alias("cx"), F.col("lead").alias("lx"), F.col("n").alias("m"), F.col("bits").alias("p"))
    two = rows.select("bucket", every.alias("part"), F.col("part").alias("other"), F.col("node").alias("y"), F.col("component").alias("cy"), F.col("n"), F.col("bits").alias("q"))
    met = one.join(two, ["bucket", "part", "other"]).where("cx <> cy and (cy = lx or x < y)").where(near(F.col("m") + F.col("n"), F.col("p"), F.col("q")))
    # The gap comes after a shuffle: beside the screen, it makes the join's method too long for the JVM to compile.
    met = met.select("x", "y", "m", "n", "p", "q").repartition("x", "y")
    return met.select("x", "y", (differing(F.col("p"), F.col("q")) / (F.col("m") + F.col("n"))).alias("gap")).distinct()


def joined_further(joined: DataFrame, links: DataFrame) -> DataFrame:
    """``joined`` (node, component), a stored table, with the components that links (a, b) connect joined."""
    ca, cb = joined.toDF("a", "ca"), joined.toDF("b", "cb")
    between = links.join(ca, "a", "left").join(cb, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    between = save(between.where("a <> b").distinct(), "between")
    if between.isEmpty():
        drop_saved(between)
        return joined
    more = components(between)
    drop_saved(between)
    now = joined.join(more.toDF("component", "top"), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    out = save(now.unionByName(more), "joined")
    for old in (joined, more):
        drop_saved(old)
    return out


def line_components(nodes: DataFrame) -> DataFrame:
    """(node, component) of the distinct lines (node, line, n: how often it occurs) that have a similar one."""
    spark = nodes.sparkSession
    signed = save(signatures(nodes.select("node", "n", units().alias("bin"))), "signatures")
    release(spark)
    shared = shared_buckets(signed.select("node", "n", F.explode(bands()).alias("bucket")))
    drop_saved(signed)
    release(spark)
    texts = save(nodes.select("node", "line").join(shared.select("node").distinct(), "node", "left_semi"), "texts")
    release(spark)
    sketched = save(sketches(texts.repartition("node").select("node", units().alias("bin"))), "sketches")
    release(spark)
    done = [save(pairs_with(shared, "node", F.array("lead")), "pairs")]
    release(spark)
    links = save(similar(done[0], texts, sketched), "links")
    release(spark)
    joined = components(links)
    drop_saved(links)

    def with_components() -> DataFrame:
        return save(shared.join(joined, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component")), "named")

    def test(pairs: DataFrame) -> None:
        nonlocal joined
        for old in done:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        done.append(save(pairs, "pairs"))
        release(spark)
        links = save(similar(done[-1], texts, sketched), "links")
        release(spark)
        joined = joined_further(joined, links)
        drop_saved(links)

    for turn in range(TURNS):  # those of a bucket still apart, with other members of its largest component
        named = with_components()
        if comparisons(named) <= FEW * named.count():
            break
        way = F.xxhash64("node", F.lit(turn))
        reps = F.array(F.max_by("node", F.struct("n", way)), F.min_by("node", way))
        sizes = named.groupBy("bucket", "component").agg(F.count("*").alias("all"), reps.alias("reps"))
        lead = sizes.groupBy("bucket").agg(F.count("*").alias("parts"), F.max(F.struct("all", "component", "reps")).alias("lead")).where("parts > 1")
        apart = named.join(lead, "bucket").where(F.col("component") != F.col("lead.component"))
        test(pairs_with(apart, "node", F.col("lead.reps")))
        drop_saved(named)
    else:
        named = with_components()
    apart = save(apart_pairs(named, sketched), "apart")
    pair = F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")
    test(apart.groupBy("x").agg(F.min_by("y", F.struct("gap", "y")).alias("y")).select(*pair).distinct())
    cx, cy = joined.toDF("x", "cx"), joined.toDF("y", "cy")
    test(apart.join(cx, "x", "left").join(cy, "y", "left").where(F.coalesce("cx", "x") != F.coalesce("cy", "y")).select(*pair).distinct())
    for old in (named, shared, texts, sketched, apart, *done):
        drop_saved(old)
    return joined


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, the text without repeated lines, and n_lines, n_removed_lines.

    Columns named n_lines or n_removed_lines that ``docs`` already has are replaced.
    """
    spark = docs.sparkSession
    lines = lines_of(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))
    # By node and wording, as a hash aggregation; minima of wordings or places would sort all lines.
    nodes = save(lines.groupBy("node", "line").agg(F.count("*").alias("n")), "nodes")
    release(spark)
    linked = line_components(nodes)
    found = linked.unionByName(linked.select(F.col("component").alias("node"), "component").distinct())  # it has no row for the smallest
    repeated = nodes.join(found, "node", "left").where("n > 1 or component is not null").select("node", F.coalesce("component", "node").alias("component"))
    repeated = save(repeated, "repeated")
    drop_saved(linked)
    drop_saved(nodes)
    release(spark)
    # All places of repeated lines; the one that stays is marked, as another row may be equal to its row.
    places = save(lines.select("row", "doc_id", "pos", "node").join(repeated, "node").select("row", "doc_id", "pos", "component"), "places")
    release(spark)
    place = F.struct("doc_id", "row", "pos")
    # Stored, so that Spark can split the places of a very common line between tasks of the join.
    firsts = save(places.groupBy("component").agg(F.min(place).alias("kept")), "firsts")
    gone = save(places.join(firsts, "component").select("row", "pos", place.eqNullSafe(F.col("kept")).alias("stays")), "gone")
    for old in (repeated, places, firsts):
        drop_saved(old)
    release(spark)
    per_row = gone.groupBy(F.col("row").alias("_row")).agg(F.collect_set("pos").alias("_all"), F.collect_set(F.when(F.col("stays"), F.col("pos"))).alias("_stay"))
    rest = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines")]
    keyed = docs.select(*[docs[f"`{c}`"] for c in rest], row_key(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).alias("_row"))
    joined = keyed.join(per_row, "_row", "left")
    # Equal rows lie together already: the join has dealt and sorted them by the same key.
    joined = joined.withColumn("_nth", F.row_number().over(W.partitionBy("_row").orderBy(F.lit(1))))
    split = F.split("text", "\n")
    joined = joined.withColumn("_gone", F.when(F.col("_nth") > 1, F.col("_all")).otherwise(F.array_except("_all", "_stay")))
    joined = joined.withColumn("_lookup", F.map_from_arrays("_gone", F.transform("_gone", lambda _: F.lit(True))))
    kept = F.filter(split, lambda _, i: ~F.map_contains_key(F.col("_lookup"), i))
    none = F.col("_gone").isNull() | (F.size("_gone") == 0)
    text = F.when(none, F.col("text")).when(F.size("_gone") == F.size(split), F.lit("")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in rest],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("n_removed_lines"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed_lines")
