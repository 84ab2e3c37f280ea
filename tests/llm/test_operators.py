"""Each operator against brute force, on a fixture with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from logspark.llm import op1_line_dedup, op2_sharding, op3_packing, op4_mixing, op5_hnsw, op6_license_scan, op7_language_id, op8_ngram_jaccard, op9_quality_rules, op10_suffix_dedup
from logspark.llm.suffix_array import suffix_array

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint, key string, n_words string, domain string"


def _docs():
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(r.randint(30, 200)) for _ in range(12)]
    passage = text(90)
    texts = base[:]
    texts += [base[0], base[0], base[1].upper()]
    for b in base[:6]:  # near copies
        w = b.split()
        w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [b[:50] + "\n" + passage + "\n" + text(30) for b in base[6:10]]
    texts += ["spam spam spam " * 60, None, "", "  \n\t", "one", "one two", "One TWO", "!!! ***", text(3000), "Zeile eins ist hier\n" * 3 + "Ende der Zeilen", "Released under the MIT License.\nhello"]
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 4}" if i % 7 else None, None, 1, "k", "n", "d") for i, t in enumerate(texts)]
    return rows + [rows[3]]  # a row that repeats


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_docs(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


LABELS = "doc_id bigint, quality int, toxic int"


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], LABELS)
    assert op1_line_dedup.dedup_lines(empty).count() == 0
    assert op2_sharding.assign_shards(empty).count() == 0
    assert op3_packing.pack_documents(empty).count() == 0
    assert op4_mixing.mix_sources(empty).count() == 0
    vectors = op5_hnsw.save(op5_hnsw.valid(spark.createDataFrame([], "vec_id bigint, embedding array<float>")), "v")
    assert op5_hnsw.search_index(op5_hnsw.build_index(vectors), vectors).count() == 0
    assert op6_license_scan.scan(empty).count() == 0
    assert op7_language_id.identify_languages(empty).count() == 0
    assert op8_ngram_jaccard.link_components(empty).count() == 0
    assert op9_quality_rules.apply_rules(empty, labels).count() == 0 and op9_quality_rules.keep_good(empty, labels).count() == 0
    assert op10_suffix_dedup.remove_repeats(empty).count() == 0


def _brute_line_dedup(rows):
    """Sorted (doc_id, text) that are left of (doc_id, text) rows with distinct (doc_id, text) or equal ones next to each other."""
    normal = lambda x: x.strip(" \t\r\f\v").lower()
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    first = {}
    for at in order:
        for i, x in enumerate((rows[at][1] or "").split("\n")):
            if normal(x):
                first.setdefault(normal(x), (order.index(at), at, i))
    lines, root = list(first), {x: x for x in first}
    sets = [_windows(x) for x in lines]

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(lines):
        for j, y in enumerate(lines[:i]):
            if len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j]):
                root[top(x)] = top(y)
    keep = {}
    for x in lines:
        keep[top(x)] = min(keep.get(top(x), first[x]), first[x])
    left = lambda at, t: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if not normal(x) or keep[top(normal(x))][1:] == (at, i))
    return sorted(((d, left(at, t)) for at, (d, t) in enumerate(rows)), key=str)


def test_line_dedup(docs):
    got = op1_line_dedup.dedup_lines(docs).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == _brute_line_dedup([r[:2] for r in _docs()])
    assert all(r["node"] == 1 and r["n_words"] == "n" for r in got)


def test_line_dedup_of_shared_and_null_ids(spark):
    """Texts under one doc_id, or under none, are documents of their own; rows equal in both keep their lines once."""
    rows = [(5, "a common line of some length\nunique alpha beta gamma"), (5, "quite another line altogether\na common line of some length"), (7, "repeated row's only line"), (7, "repeated row's only line"), (7, "repeated row's only line"), (None, "a line of no document\nshort"), (None, "a line of no document\n\nnext"), (9, "A Line of no document ")]
    got = op1_line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    lines = Counter(x for r in got for x in r["text"].split("\n") if x)
    assert lines == Counter(["a common line of some length", "unique alpha beta gamma", "quite another line altogether", "repeated row's only line", "a line of no document", "short", "next"])
    assert [r["text"] for r in got if r["doc_id"] == 9] == [""] and sum(r["n_removed_lines"] for r in got) == 5


def test_line_dedup_on_the_documents(spark):
    """Every line of the smallest table, by brute force over all shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = sorted(((r["doc_id"], r["text"]) for r in op1_line_dedup.dedup_lines(docs).collect()), key=str)
    assert got == _brute_line_dedup([tuple(r) for r in docs.collect()])


def _windows(x):
    return {x[i : i + 8] for i in range(max(1, len(x) - 7))}


def test_line_dedup_reads_long_tokens_and_scripts_without_spaces(spark):
    """Lines with equal beginnings only stay; copies that differ in their beginning only go."""
    r = random.Random(5)
    hexes = "".join(r.choices("0123456789abcdef", k=400))
    thai = "".join(chr(0xE01 + r.randrange(46)) for _ in range(300))
    texts = ["https://example.org/one", "https://another.net/x", "2024-01-05T10:00:00Z", "2024-01-17T23:59:41Z", "internationalisation", "internationally", "deadbeef" + hexes[:60], "deadbeef" + hexes[100:160]]
    texts += ["\u0e01\u0e32\u0e23\u0e17\u0e14\u0e2a\u0e2d\u0e1a" + thai[:40], "\u0e01\u0e32\u0e23\u0e17\u0e14\u0e2a\u0e2d\u0e1a" + thai[60:100]]
    texts += [hexes[160:], "ffff" + hexes[164:], thai[100:], "\u0e2e\u0e2e" + thai[102:], "\U0001f600\U0001f680" * 9 + "ab", "ab" + "\U0001f600\U0001f680" * 9, "short", "shorts"]
    want, kept = [], []
    for x in texts:
        same = any(len(_windows(x) & _windows(y)) >= 0.75 * len(_windows(x) | _windows(y)) for y in kept)
        want.append(same)
        kept += [] if same else [x]
    assert want == [False] * 11 + [True, False, True, False, False, False, False]
    got = op1_line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["n_removed_lines"] == 1 for r in got} == dict(enumerate(want))


def test_line_dedup_compares_all_of_a_bucket(spark, monkeypatch):
    """Many small groups of near copies in one bucket, of which only one holds the smallest and one is the largest."""
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    texts = []
    for g in range(40):
        words = [word() for _ in range(r.choice([4, 9, 20]))]
        texts += [" ".join(words) + end for end in ("", ".", "!")[: 3 if g == 0 else 2]]
    want = [any(len(_windows(x) & _windows(y)) >= 0.75 * len(_windows(x) | _windows(y)) for y in texts[:i]) for i, x in enumerate(texts)]
    assert sum(want) == 41
    F = op1_line_dedup.F
    monkeypatch.setattr(op1_line_dedup, "bands", lambda: F.array(F.lit(1).cast("bigint")))
    monkeypatch.setattr(op1_line_dedup, "BLOCK", 16, raising=False)
    got = op1_line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["n_removed_lines"] == 1 for r in got} == dict(enumerate(want))


def test_line_screen_loses_no_pair(spark):
    """Whatever the lengths, short ones and some far beyond the sketch's, similar lines pass the screen."""
    r = random.Random(8)
    lines = []
    for n in (3, 8, 9, 12, 40, 200, 900, 5000):
        base = "".join(r.choices("abcdefgh ", k=n))
        for cut in (0, 1, 2, 5, n // 9, n // 7, n // 5, n // 3):
            lines.append(base[cut:] + "".join(r.choices("xyz", k=r.choice([0, cut, cut // 2]))))
    lines = sorted(set(lines))
    nodes = spark.createDataFrame(list(enumerate(lines)), "node bigint, line string").select("node", op1_line_dedup.units().alias("bin"))
    bits = op1_line_dedup.sketches(nodes)
    F = op1_line_dedup.F
    both = bits.alias("l").join(bits.alias("r"), F.col("l.node") < F.col("r.node"))
    passed = {tuple(x) for x in both.where(op1_line_dedup.near(F.col("l.n") + F.col("r.n"), F.col("l.bits"), F.col("r.bits"))).select("l.node", "r.node").collect()}
    pairs = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines))]
    alike = {(a, b) for a, b in pairs if len(_windows(lines[a]) & _windows(lines[b])) >= 0.75 * len(_windows(lines[a]) | _windows(lines[b]))}
    assert len(alike) > 30 and alike <= passed and len(passed) < len(pairs) // 2


def test_line_screen_of_repeated_shingles(spark):
    """Lines sketched without taking repeated shingles out: similar ones pass, and short unlike ones do not."""
    r = random.Random(9)
    lines = []
    for n in (10, 60, 300, 1200):
        for unit in (1, 7, 30, n):
            base = ("".join(r.choices("abcdefgh ", k=unit)) * n)[:n]
            lines += [base, base + "x", base[n // 9 :], base[: n // 2] + "yz" + base[n // 2 :], base + base[: n // 3], base + "".join(r.choices("xyz", k=n // 8))]
    lines = sorted(set(lines))
    nodes = spark.createDataFrame(list(enumerate(lines)), "node bigint, line string").select("node", op1_line_dedup.units().alias("bin"))
    F = op1_line_dedup.F
    bits = op1_line_dedup.sketches(nodes.repartition("node")).localCheckpoint()
    assert all(r["n"] >= len(_windows(lines[r["node"]])) for r in bits.collect()) and bits.count() == len(lines)
    both = bits.alias("l").join(bits.alias("r"), F.col("l.node") < F.col("r.node"))
    passed = {tuple(x) for x in both.where(op1_line_dedup.near(F.col("l.n") + F.col("r.n"), F.col("l.bits"), F.col("r.bits"))).select("l.node", "r.node").collect()}
    pairs = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines))]
    alike = {(a, b) for a, b in pairs if len(_windows(lines[a]) & _windows(lines[b])) >= 0.75 * len(_windows(lines[a]) | _windows(lines[b]))}
    assert len(alike) > 30 and alike <= passed and len(passed) < len(pairs)


def _char_shingles(line):
    data = line.encode("utf-16-be")
    return {data[i : i + 16] for i in range(0, max(len(data) - 15, 1), 2)}


def test_line_sketches_count_distinct_shingles_and_keep_dissimilar_lines_out(spark):
    """Lines whose similarity is 0.70: a count that allows for repeated shingles let them through, as many as a group has pairs."""
    F, r = op1_line_dedup.F, random.Random(17)
    lines = []
    for _ in range(20):
        base = r.choices("abcdefghijklmnopqrstuvwxyz ", k=540)
        lines.append("".join(base))
        for at in r.sample(range(20, 520, 12), 12):
            base[at] = "#"
        lines.append("".join(base))
    sets = [_char_shingles(x) for x in lines]
    assert all(0.68 < len(a & b) / len(a | b) < 0.74 for a, b in zip(sets[::2], sets[1::2], strict=True))
    nodes = spark.createDataFrame(list(enumerate([*lines, "ab" * 300, "short"])), "node bigint, line string").select("node", op1_line_dedup.units().alias("bin"))
    bits = op1_line_dedup.sketches(nodes.repartition("node")).localCheckpoint()
    assert {x["node"]: x["n"] for x in bits.collect()} == dict(enumerate([*map(len, sets), 2, 1]))
    both = bits.alias("l").join(bits.alias("r"), F.expr("l.node + 1 = r.node and l.node % 2 = 0 and r.node < 40"))
    assert both.where(op1_line_dedup.near(F.col("l.n") + F.col("r.n"), F.col("l.bits"), F.col("r.bits"))).count() == 0


def test_line_pairs_are_verified_alike_as_arrays_and_as_rows(spark, monkeypatch):
    """Surrogates, line separators and short lines too; ``LONG`` decides the way, not the result."""
    F, r = op1_line_dedup.F, random.Random(18)
    alphabet = "abcdefgh \u0000\u00e4\u4e2d\u2028\x85\U0001f600\U0001f680"
    lines = ["\U0001f600", "seven c", "seven cs", "ab" * 200, "ab" * 300]
    for n in (9, 30, 200, 700):
        base = r.choices(alphabet, k=n)
        lines.append("".join(base))
        for k in range(4):
            base[r.randrange(n)] = "x"
            lines.append("".join(base) + "tail" * k)
    sets = [_char_shingles(x) for x in lines]
    pairs = [(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines))]
    expected = {(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j])}
    assert 5 < len(expected) < len(pairs) - 5
    texts = spark.createDataFrame(list(enumerate(lines)), "node bigint, line string")
    nodes = texts.select("node", op1_line_dedup.units().alias("bin")).repartition("node").localCheckpoint()
    found = []
    for long in (50_000, 100, 1):
        monkeypatch.setattr(op1_line_dedup, "LONG", long, raising=False)
        bits = op1_line_dedup.sketches(nodes).localCheckpoint()
        found.append(sorted((x["node"], x["n"], tuple(x["bits"])) for x in bits.collect()))
        got = op1_line_dedup.similar(spark.createDataFrame(pairs, "a bigint, b bigint"), texts, bits)
        assert {tuple(x) for x in got.collect()} == expected
    assert found[0] == found[1] == found[2]


def test_verified_line_pairs_are_no_rows_of_shingles(spark):
    """One line beside 40 near copies: no operator makes more rows than there are sides of pairs."""
    F, r = op1_line_dedup.F, random.Random(19)
    base = "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=600))
    texts = spark.createDataFrame([(i, base[: 10 * i] + "#" + base[10 * i :]) for i in range(41)], "node bigint, line string")
    bits = op1_line_dedup.sketches(texts.select("node", op1_line_dedup.units().alias("bin")).repartition("node")).localCheckpoint()
    found = op1_line_dedup.similar(spark.createDataFrame([(0, i) for i in range(1, 41)], "a bigint, b bigint"), texts, bits)
    plan = found._jdf.queryExecution().executedPlan()
    assert len(found._jdf.collectAsList()) == 40
    made, todo = [], [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        rows = node.metrics().get("numOutputRows")
        if name == "Generate" and rows.isDefined():
            made.append(rows.get().value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert made and max(made) <= 80


def test_line_screens_are_compiled(spark):
    """The JVM leaves methods of over 8000 bytes to its interpreter; each comparison of a bucket then takes some 20 microseconds."""
    nodes = spark.createDataFrame([(1, "one line of text"), (2, "one line of texts"), (3, "quite another line")], "node bigint, line string")
    bits = op1_line_dedup.sketches(nodes.select("node", op1_line_dedup.units().alias("bin")).repartition("node")).localCheckpoint()
    named = spark.createDataFrame([(7, i, 1, i) for i in (1, 2, 3)], "bucket bigint, node bigint, n bigint, component bigint")
    pairs = spark.createDataFrame([(1, 2)], "a bigint, b bigint")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan has its code only after a run
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for broadcast in (threshold, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
            for df in (op1_line_dedup.apart_pairs(named, bits), op1_line_dedup.similar(pairs, nodes, bits)):
                code = df._jdf.queryExecution().debug().codegenToSeq()
                assert 0 < max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())) <= 8000
        found = op1_line_dedup.apart_pairs(named, bits).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert [{r["x"], r["y"]} for r in found] == [{1, 2}] and 0 < found[0]["gap"] < 0.1
    assert op1_line_dedup.comparisons(named) == 6 and op1_line_dedup.comparisons(named.where("node = 1")) == 0


def test_components_of_stars_take_no_round(spark, monkeypatch):
    """Edges that already hang on the smallest node of their component are written once, others until they do."""
    from logspark.llm import graph

    tables, save = [], graph.save
    monkeypatch.setattr(graph, "save", lambda df, name: tables.append(name) or save(df, name))
    star = [(1, x) for x in range(5, 40)] + [(2, x) for x in range(50, 60)]
    got = graph.components(spark.createDataFrame(star, "a bigint, b bigint")).collect()
    assert sorted((r["component"], r["node"]) for r in got) == sorted(star) and len(tables) == 1
    path = [(x, x + 1) for x in range(100, 130)] + [(7, 3), (3, 9)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert got == {x: 100 for x in range(101, 131)} | {7: 3, 9: 3}
    joined = graph.save(spark.createDataFrame([(5, 1), (6, 1), (9, 8)], "node bigint, component bigint"), "joined")
    more = op1_line_dedup.joined_further(joined, spark.createDataFrame([(6, 9), (20, 21), (5, 1)], "a bigint, b bigint"))
    assert {tuple(r) for r in more.collect()} == {(5, 1), (6, 1), (9, 1), (8, 1), (21, 20)}


def test_sharding(docs):
    got = op2_sharding.assign_shards(docs, 5).collect()
    rows = {r[0]: r[1] for r in _docs()}
    assert len(got) == len(_docs())
    slots, shard = defaultdict(list), {}
    for r in got:
        t = rows[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 16 and r["text_crc32"] == (None if t is None else zlib.crc32(t.encode()))
        assert shard.setdefault(t, r["shard"]) == r["shard"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))


def test_minimax_equals_brute_force():
    from itertools import combinations_with_replacement

    r = random.Random(1)
    for _ in range(100):
        sizes, k = [r.randint(1, 30) for _ in range(r.randint(1, 8))], r.randint(1, 4)
        capacity, cuts = op2_sharding.minimax_cuts(sizes, k)
        pieces = lambda c: max(sum(sizes[a:b]) for a, b in zip((0, *c[:-1]), c, strict=True))
        best = min(pieces((*c, len(sizes))) for c in combinations_with_replacement(range(len(sizes) + 1), k - 1))
        assert capacity == best == pieces(tuple(cuts)) and cuts[-1] == len(sizes)


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    path = op3_packing.tokenizer_file("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    odd = ["don't''s it's 'RE x²³ ½ ªº ÀÉ ß <|endoftext|> a", "Ж日本 it", "a\x1cb", "İstanbul", "a.b,c 1.5 ,x. y", "a.. b ., c"]
    code = op3_packing.WordEncoder(path)
    for x in odd:
        assert np.frombuffer(code.encode(x), "<u2").tolist() == t.encode(x, add_special_tokens=False).ids
    rows = {r[0]: r[1] for r in _docs()}
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in op3_packing.pack_documents(docs, sequence=64).collect():
        sequences[r["sequence_id"]].append(r)
        pieces[r["doc_id"]].append(r)
    for v in sequences.values():
        at = 0
        for r in sorted(v, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    for k, v in pieces.items():
        ids = np.array(t.encode(rows[k] or "", add_special_tokens=False).ids + [2], "<u4")
        times = sum(x[0] == k for x in _docs())
        assert sum(r["length"] for r in v) == times * len(ids)
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in v)


def test_hilbert_neighbours_touch():
    n = 8
    cells = np.array([(x, y, z) for x in range(n) for y in range(n) for z in range(n)])
    path = cells[np.argsort(op3_packing.hilbert_key(cells, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_budgets():
    have = {("a", "en", "x"): 10, ("a", "en", "y"): 1000, ("b", "de", "z"): 1000}
    got = op4_mixing.allocate(have, 400, {})
    assert got == {("a", "en", "x"): 10, ("a", "en", "y"): 190, ("b", "de", "z"): 200}
    got = op4_mixing.allocate({("a", "en", "x"): 50, ("b", "de", "z"): 1000}, 400, {})
    assert got == {("a", "en", "x"): 50, ("b", "de", "z"): 350}


def test_budgets_are_spent_and_follow_the_weights():
    """Against filling the tree token by token, each to the neediest child that has room."""
    r = random.Random(2)
    for _ in range(60):
        have = {(d, x, s): r.randint(1, 40) for d in "ab" for x in "xy"[: r.randint(1, 2)] for s in "12"[: r.randint(1, 2)]}
        weights = {("a",): 2.0, ("*", "x"): 3.0}
        budget = r.randint(0, sum(have.values()) + 5)
        got = op4_mixing.allocate(have, budget, weights)
        assert sum(got.values()) == min(budget, sum(have.values())) and all(0 <= got[p] <= have[p] for p in have)
        want = dict.fromkeys(have, 0)
        for _ in range(min(budget, sum(have.values()))):
            node = ()
            for depth in range(3):
                below = {p[: depth + 1] for p in have if p[:depth] == node and any(want[q] < have[q] for q in have if q[: depth + 1] == p[: depth + 1])}
                node = min(below, key=lambda c: (sum(v for p, v in want.items() if p[: depth + 1] == c) + 0.5) / op4_mixing.weight_of(c, weights))
            want[node] += 1
        assert max(abs(want[p] - got[p]) for p in have) <= 3


def test_mixing_is_a_seeded_prefix(spark, docs):
    got = op4_mixing.mix_sources(docs, weights={}, max_epochs=3).collect()
    tokens = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    leaves, used, copies = defaultdict(int), defaultdict(int), Counter(r[0] for r in _docs())
    domains = {r["doc_id"]: r["domain"] for r in got}
    for r in _docs():
        if r[0] in domains:
            leaves[(domains[r[0]], r[2], r[3])] += tokens(r[1])
    for r in got:
        assert r["n_tokens"] == tokens(r["text"]) > 0
        used[(r["domain"], r["lang"], r["source"])] += r["n_tokens"]
    assert all(used[k] <= 3 * v for k, v in leaves.items())
    by_doc = defaultdict(Counter)
    for r in got:
        by_doc[r["doc_id"]][r["epoch"]] += 1
    assert all(set(c.values()) == {copies[k]} and sorted(c) == list(range(len(c))) for k, c in by_doc.items())


def test_hnsw(spark):
    r = np.random.default_rng(2)
    m = r.standard_normal((1500, 16)).astype(np.float32)
    m[100:160] = m[100]  # one common vector
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, []), (5020, [None] * 16)]
    vectors = op5_hnsw.save(op5_hnsw.valid(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")), "v")
    assert vectors.count() == 1500
    found = defaultdict(list)
    for x in op5_hnsw.search_index(op5_hnsw.build_index(vectors, shard_rows=400), vectors.where("vec_id % 20 = 0")).collect():
        found[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    hits = 0
    d = m.astype(float)
    for q in range(0, 1500, 20):
        s = d @ d[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(1500), -s))[:20]
        got = sorted(found[q])
        assert [g[0] for g in got] == list(range(1, 21)) and all(abs(s[g[1]] - g[2]) < 1e-9 for g in got)
        hits += len({g[1] for g in got} & set(want.tolist()))
    assert hits >= 0.95 * 20 * 75
    few = vectors.where("vec_id < 3")
    assert op5_hnsw.search_index(op5_hnsw.build_index(op5_hnsw.save(few, "f")), few).count() == 6


def test_licences(spark, docs):
    cases = [
        (1, "x\nLicensed under the Apache License, Version 2.0.\ny", "Apache-2.0"), (2, "Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), (3, "All rights reserved.", "proprietary"),
        (4, "word " * 500 + "This work is licensed under the GNU General Public License, version 3. " + "word " * 500, "GPL-3.0"), (5, "a permission slip for the licensed driver", None), (6, None, None),
    ]
    df = spark.createDataFrame([(i, t) for i, t, _ in cases], "doc_id bigint, text string")
    got = {r["doc_id"]: r["license"] for r in op6_license_scan.scan(df).collect()}
    assert got == {i: name for i, _, name in cases if name}
    assert {r["license"] for r in op6_license_scan.scan(docs).collect()} == {"MIT"}


def test_licences_over_line_ends():
    import textwrap

    for name, notices in op6_license_scan.NOTICES.items():
        for notice in notices:
            for mark in ("", " * ", "# ", "// "):
                for width in (70, 80):
                    text = "\n".join(mark + x for x in ["Some words.", *textwrap.wrap("This file: " + notice + ".", width), "More words."])
                    assert [(g["license"], g["line"]) for g in op6_license_scan.confirmed(text)] == [(name, 1)], text


def test_all_licences_of_a_line():
    every = {name: notices[0] for name, notices in op6_license_scan.NOTICES.items()}
    found = op6_license_scan.confirmed("; ".join(every.values()))
    assert sorted(g["license"] for g in found) == sorted(every)
    assert len(op6_license_scan.confirmed("All rights reserved.\nAll rights reserved.")) == 2


def test_licences_are_candidates_by_compression(monkeypatch):
    """Compression alone decides what is confirmed, and gives up no licence whose wording is there."""
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9)))
    for name, notices in op6_license_scan.NOTICES.items():
        for notice in notices:
            a = [w.lower() for w in op6_license_scan.WORD.findall(notice)]
            slack = int(op6_license_scan.MAX_MISSING * len(a))
            for pad in (0, 3, 40, 75):
                b = list(a)
                for _ in range(r.randint(0, slack)):
                    b.pop(r.randrange(len(b)))
                for _ in range(r.randint(0, slack)):
                    b.insert(r.randrange(1, len(b)), word())
                b = [word() for _ in range(pad)] + b + [word() for _ in range(pad)]
                got = op6_license_scan.candidates(b)
                assert name in got and list(got.values()) == sorted(got.values(), reverse=True), (name, b)
    assert "CC0-1.0" not in op6_license_scan.candidates(["qqxz", "0171", "vwkj"])
    text = "Released under the MIT License"
    assert [g["license"] for g in op6_license_scan.confirmed(text)] == ["MIT"]
    monkeypatch.setattr(op6_license_scan, "compressors", lambda held=op6_license_scan.compressors(): (held[0], {name: held[0] for name in held[1]}))
    assert op6_license_scan.confirmed(text) == []  # without dictionaries nothing is shortened


def test_language_id(spark):
    r = random.Random(4)
    parts = {"en": ["the", "ing", "th", "and", "er"], "de": ["sch", "ung", "ü", "ver", "ein"], "fr": ["eau", "é", "tion", "que", "oi"]}
    rows = [(i, " ".join("".join(r.choices(parts[x], k=3)) for _ in range(40)), x) for i in range(300) for x in [r.choice(list(parts))]]
    rows += [(1000, None, "en"), (1001, "12 !!", "de"), (1002, "", None), (None, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = op7_language_id.identify_languages(df).collect()
    assert len(got) == len(rows)
    truth = {i: x for i, _, x in rows}
    held = [g for g in got if g["held_out"]]
    assert all(g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 4 == 2) for g in got if g["doc_id"] is not None)
    right = [g["lang_pred"] == truth[g["doc_id"]] for g in held if g["doc_id"] < 1000]
    assert len(right) > 40 and sum(right) >= 0.97 * len(right)
    assert {g["doc_id"]: g["lang_pred"] for g in got if (g["doc_id"] or 0) >= 1000} == {1000: "und", 1001: "und", 1002: "und"}
    assert all(0 <= g["score"] <= 1 for g in got)


def _shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_ngram_jaccard(docs):
    rows = {r[0]: _shingles(r[1]) for r in _docs()}
    label = {k: k for k in rows}
    changed = True
    while changed:
        changed = False
        for a in rows:
            for b in rows:
                if rows[a] and rows[b] and 100 * len(rows[a] & rows[b]) >= 75 * len(rows[a] | rows[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    got = op8_ngram_jaccard.link_components(docs).collect()
    assert len(got) == len(_docs())
    assert all((r["n_shingles"], r["component_id"]) == (len(rows[r["doc_id"]]), label[r["doc_id"]]) for r in got)
    assert len({label[k] for k in range(12)}) == 12 and label[12] == label[13] == 0 and label[14] == 1


def test_ngram_jaccard_without_ids(spark):
    """Rows without an id link, and link others; an id may have several texts."""
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base), " ".join(base[3:]), " ".join(base[6:]), "another text of no great length at all", " ".join(base[:3] + base)]
    rows = [(None, texts[0]), (None, texts[1]), (4, texts[2]), (4, texts[3]), (None, texts[3]), (9, texts[4]), (None, None), (None, "alone with five words here"), (None, "alone with five words here")]
    got = op8_ngram_jaccard.link_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter([(None, 96, 4), (None, 93, 4), (4, 90, 4), (4, 4, 4), (None, 4, 4), (9, 99, 4), (None, 0, None), (None, 1, None), (None, 1, None)])


def test_half_hashes_of_large_sets():
    r = np.random.default_rng(1)
    for n in (1000, 200_000, 1_000_000):
        a, b = (np.unique(r.integers(0, 1 << 32, n)) for _ in range(2))
        assert len(np.intersect1d(a, b)) < op8_ngram_jaccard.by_chance(n, n)


def test_ngram_jaccard_large_group(spark):
    """Near copies by the hundred, where pairs of copies need not link but the original joins them."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = base[:]
        for _ in range(r.randint(0, 4)):
            w[r.randrange(120)] = f"x{r.random()}"
        rows.append((i, " ".join(w)))
    sets = [_shingles(t) for _, t in rows]
    label = list(range(300))
    for _ in range(6):
        for a in range(300):
            for b in range(a):
                if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    low, high = sorted((label[a], label[b]))
                    label = [low if x == high else x for x in label]
    got = op8_ngram_jaccard.link_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(label))


def test_quality_stats(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (None, 1, 0)], LABELS)
    got = op9_quality_rules.apply_rules(docs, labels).collect()
    rows = {r[0]: r[1] for r in _docs()}
    for r in got:
        t = rows[r["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, n_dup = set(), 0
        for x in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", x):
                n_dup += x in seen
                seen.add(x)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), n_dup, len(covered))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and r["kept"] == (not r["base_failed"])
    kept = op9_quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r["base_failed"] for r in got)


def test_risk_control():
    assert abs(op9_quality_rules.upper_bound(0, 100, 0.05) - (1 - 0.05 ** (1 / 100))) < 1e-9
    k = op9_quality_rules.largest_rejections(1000, 0.02, 0.05)
    assert op9_quality_rules.upper_bound(k, 1000, 0.05) <= 0.02 < op9_quality_rules.upper_bound(k + 1, 1000, 0.05)
    assert op9_quality_rules.largest_rejections(10, 0.02, 0.05) == -1


def test_rules_reject_junk_and_keep_good(spark):
    rows = [(i, " ".join(f"word{j}" for j in range(i % 50, i % 50 + 30)), "en") for i in range(3000)] + [(10_000 + i, " ".join(f"w{j}***%%%" for j in range(i, i + 30)), "en") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3000)], LABELS)
    kept = {r["doc_id"] for r in op9_quality_rules.keep_good(df, labels).collect()}
    assert not any(k >= 10_000 for k in kept) and len(kept) >= 0.98 * 3000


def test_suffix_array_sorts():
    r = random.Random(1)
    for _ in range(500):
        t = [r.randint(1, r.choice([1, 2, 3, 20])) for _ in range(r.randint(0, 40))] + [0]
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_suffix_dedup(docs):
    rows = {r[0]: (r[1] or "").encode() for r in _docs()}
    copies = Counter(b for k, b in ((r[0], (r[1] or "").encode()) for r in _docs()))
    starts = Counter(b[i : i + 400] for b, n in copies.items() for i in range(len(b) - 399) for _ in range(min(n, 2)))
    for r in op10_suffix_dedup.remove_repeats(docs).collect():
        b = rows[r["doc_id"]]
        covered = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 399):
            if starts[b[i : i + 400]] > 1:
                covered[i : i + 400] = True
        kept = bytes(x for x, c in zip(b, covered, strict=False) if not c)
        n_spans = int((covered[1:] & ~covered[:-1]).sum() + (covered[0] if len(b) else 0))
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(covered.sum()), n_spans, hashlib.sha256(kept).hexdigest())


def test_suffix_dedup_without_ids(spark):
    r = random.Random(8)
    shared, other = ("".join(r.choices("abcdefgh ", k=n)) for n in (890, 450))
    rows = [(None, "one_" + shared), (3, "two: _x" + shared + "|end"), (3, other + "x"), (None, "y" + other), (None, shared[:399])]
    got = op10_suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((g["doc_id"], g["n_removed"], g["text"].decode()) for g in got) == Counter([(None, 890, "one_"), (3, 890, "two: _x|end"), (3, 450, "x"), (None, 450, "y"), (None, 0, shared[:399])])


def test_suffix_dedup_of_periodic_texts(spark):
    """One region at very many places of a text."""
    rows = [(1, "spam " * 3000), (2, "x" + "spam " * 100), (3, "none of it")]
    got = {g["doc_id"]: g["n_removed"] for g in op10_suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 15000, 2: 500, 3: 0}


def test_ngram_jaccard_blocks_do_not_grow_with_the_table(spark):
    """A passage in 600 of 300,000 documents, 0.2 % of them, counts as frequent; one in a few does not."""
    F = op8_ngram_jaccard.F
    text = F.when(F.col("id") % 500 == 0, "one common passage of words").when(F.col("id") % 30_000 == 1, "a rare passage of words").otherwise(F.concat(F.col("id").cast("string"), F.lit(" own words of it")))
    docs = spark.range(300_000).select(F.col("id").alias("doc_id"), text.alias("text"))
    common, rare = (set(s.tolist()) for _, s in op8_ngram_jaccard.shingle_sets(op8_ngram_jaccard.pa.array(["one common passage of words", "a rare passage of words"])))
    hot = set(op8_ngram_jaccard.hot_shingles(docs, 300_000).tolist())
    assert hot == common and not hot & rare
