"""Jaccard join, substring dedup and packing against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lemmaflow.llm import jaccard, packing, sharding, substring
from lemmaflow.llm.components import connected_components
from lemmaflow.llm.fmindex import FMIndex, suffix_order
from lemmaflow.llm.text import blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [f"w{i}" for i in range(60)] + ["É", "ü,", "日本"]


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", "doc_id as n", "'x' as sig1", "text as pivots", "1 as s1", "2 as copies", "3 as _bucket", "4 as learns", "'s' as source") if extra else df


def shingles(text, k):
    w = words(lowered(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(rows, k, num, den):
    sets = {d: shingles(t, k) for d, t in rows}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and den * common >= num * (len(sets[a] | sets[b])):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def near_copies(seed, n=220):
    rng = random.Random(seed)
    passage = [rng.choice(VOCABULARY) for _ in range(30)]
    bases = [[rng.choice(VOCABULARY) for _ in range(rng.choice([3, 12, 60, 150]))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.8 else [rng.choice(VOCABULARY) for _ in range(80)]
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
        if rng.random() < 0.3:
            w += passage
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "a b"), (n + 4, "A B"), (n + 5, "a b c")]


@pytest.mark.parametrize(("seed", "part", "crowd", "k", "num"), [(1, 2000, 32, 4, 85), (2, 5, 3, 4, 85), (3, 8, 1, 5, 80), (4, 4, 1 << 30, 5, 80)])
def test_jaccard_components(spark, monkeypatch, seed, part, crowd, k, num):
    monkeypatch.setattr(jaccard, "PART", part)
    monkeypatch.setattr(jaccard, "CELLS", 3 if seed == 2 else 6)
    monkeypatch.setattr(jaccard, "GROWTH", 1.2 if seed == 4 else 3)
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    rows = near_copies(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(frame(spark, rows, True), k, num, 100).collect()}
    assert got == brute_components(rows, k, num, 100)


@pytest.mark.parametrize(("n_shared", "crowd"), [(6, 1 << 40), (40, 1 << 40), (40, 32)])
def test_unlike_documents_of_one_region(spark, monkeypatch, n_shared, crowd):
    """Documents that share a passage but nothing else: no member may visit every cell, and none links."""
    n, seen = 1500, []
    monkeypatch.setattr(jaccard, "PART", 50)
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    whole = jaccard._split
    monkeypatch.setattr(jaccard, "_split", lambda *args: seen.append(whole(*args)) or seen[-1])
    text = F.concat_ws(" ", F.lit(" ".join(f"s{i}" for i in range(n_shared))), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: F.hash("id", i).cast("string")), " "))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))
    copies = docs.where("doc_id % 100 = 0").select((F.col("doc_id") + n).alias("doc_id"), F.concat("text", F.lit(" more")).alias("text"))
    got = jaccard.jaccard_components(docs.unionByName(copies), 4, 85, 100).where("doc_id != component_id").collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(n + i, i) for i in range(0, n, 100)}
    if n_shared == 6 or crowd == 32:
        assert seen[0].groupBy("key", "part").count().agg(F.max("count")).first()[0] in (None, *range(51))


def graded_copies(n=300, size=120):
    """Copies of one text with up to half of the words changed: many pairs just link, more just don't."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(size)]
    return [(i, " ".join(f"x{i}.{j}" if rng.random() < i % 30 / 150 else w for j, w in enumerate(base))) for i in range(n)]


@pytest.mark.parametrize("dense", [4, 64])
def test_graded_copies_stay_few_rows(spark, monkeypatch, dense):
    """The regions of one cluster are dealt by its own rarest shingles, not cut by pairs of shingles."""
    seen = []
    monkeypatch.setattr(jaccard, "PART", 100)
    monkeypatch.setattr(jaccard, "DENSE", dense, raising=False)
    whole = jaccard._split
    monkeypatch.setattr(jaccard, "_split", lambda *args: seen.append(whole(*args)) or seen[-1])
    rows = graded_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(frame(spark, rows), 4, 85, 100).collect()}
    assert got == brute_components(rows, 4, 85, 100)
    assert seen[0].count() <= 10 * len(rows)


def test_one_cluster_offers_few_pairs(spark):
    """Pairs that a pass offers for near copies follow their number, not its square; nothing is held back unsaid."""
    n = 120
    cells = spark.range(n).selectExpr("7L as key", "0 as part", "id as node", "id as comp", "false as guest")
    histogram = lambda i: bytearray([200, 200, i % 3, *[0] * (jaccard.BINS - 3)])
    nodes = spark.createDataFrame([(i, 400, histogram(i)) for i in range(n)], "doc_id long, n long, pooled binary")
    got = jaccard._candidates(cells, nodes, 4, 85, 100).collect()
    assert any(r["held"] for r in got) and len(got) <= 4 * n + 1
    assert {r["a"] for r in got} == set(range(n))
    last = jaccard._candidates(cells, nodes, n, 85, 100).collect()
    assert {(r["a"], r["b"], r["held"]) for r in last} == {(a, b, False) for a in range(n) for b in range(n) if a != b}


def test_regions_of_equal_members_are_one(spark):
    """Also with rows repeated; regions that only share some members, or their number, stay."""
    held = {1: [1, 2, 3], 2: [1, 2, 3], 3: [1, 2, 4], 4: [2, 3], 5: [5], 6: [1, 1, 2, 2], 7: [1, 1, 3, 3], 8: [1, 2, 3]}
    rows = spark.createDataFrame([(k, x) for k, nodes in held.items() for x in nodes], "key long, node long")
    found = jaccard._regions(rows).collect()
    got = sorted((tuple(sorted(r["node"] for r in found if r["key"] == k)), cnt, pivot) for k, cnt, pivot in {(r["key"], r["cnt"], r["pivot"]) for r in found})
    assert got == [((1, 1, 2, 2), 4, 1), ((1, 1, 3, 3), 4, 1), ((1, 2, 3), 3, 1), ((1, 2, 4), 3, 1), ((2, 3), 2, 2)]


def test_jaccard_nulls_repeats_and_none(spark):
    rows = [(7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (9, "A b c d e")]
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(frame(spark, rows), 4, 85, 100).collect())
    assert got == [(0, 2, None), (7, 2, 7), (7, 2, 7), (9, 2, 7)]
    assert jaccard.jaccard_components(frame(spark, []), 4, 85, 100).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(5, 5), (7, 6), (None, 3)]
    got = {r["node"]: r["comp"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def brute_removed(rows, width):
    split = [words(t) for _, t in rows]
    counts = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(rows, split, strict=True):
        gone = {j for i in range(len(w) - width + 1) if counts[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def passages(seed):
    rng = random.Random(seed)
    shared = [[rng.choice(VOCABULARY) for _ in range(rng.randint(20, 90))] for _ in range(10)]
    rows = []
    for i in range(200):
        w = []
        for _ in range(rng.randint(0, 5)):
            part = list(rng.choice(shared)) if rng.random() < 0.5 else [rng.choice(VOCABULARY) for _ in range(rng.randint(0, 50))]
            if part and rng.random() < 0.3:
                part[rng.randrange(len(part))] = rng.choice(VOCABULARY)
            w += part
        rows.append((i, rng.choice([" ", "\n"]).join(w)))
    return rows + [(200, None), (201, ""), (202, rows[5][1]), (202, rows[5][1]), (None, rows[6][1]), (203, "a " * 150)]


@pytest.mark.parametrize(("width", "hot", "shard"), [(35, 50_000, 500_000), (35, 2, 100), (12, 50_000, 1), (50, 3, 500_000)])
def test_repeated_removed(spark, monkeypatch, width, hot, shard):
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "SHARD_WORDS", shard)
    rows = passages(width)
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    found = substring.repeated_removed(frame(spark, rows, True), width).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found), key=key) == sorted(brute_removed(rows, width), key=key)
    for r in found:
        assert hashlib.sha256(" ".join(words(r["kept_text"])).encode()).hexdigest() == r["kept_sha256"]
    assert substring.repeated_removed(frame(spark, []), width).collect() == []


def test_fm_index():
    rng = np.random.default_rng(4)
    ids = rng.integers(1, 5, 400)
    ids[::40] = 0
    index = FMIndex(ids, np.ones(len(ids), np.int64), 64)
    text = ids.tolist()
    count = lambda p: sum(text[i : i + len(p)] == p for i in range(len(text) - len(p) + 1))
    starts = np.array([s for s in range(1, 380) if 0 not in text[s : s + 9]])
    long = index.matched(ids, starts, starts + 9, 2)
    for s, got in zip(starts.tolist(), long.tolist(), strict=True):
        assert got == max(n for n in range(10) if not n or count(text[s + 9 - n : s + 9]) >= 2)
    order = suffix_order(ids, 1 << 20).tolist()
    assert order == sorted(range(len(text)), key=lambda i: text[i:])


def best_fit(lengths, room):
    free, bins = [], 0
    for n in sorted(lengths, reverse=True):
        fits = [c for c in free if c >= n]
        c = min(fits) if fits else room
        bins += not fits
        if fits:
            free.remove(c)
        free.append(c - n)
    return bins


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    room = rng.choice([10, 64, 2048])
    lengths = [rng.randint(1, room) for _ in range(rng.randint(0, 250))] * rng.choice([1, 1, 3])
    moves, bins = packing.best_fit_plan(dict(Counter(lengths)), room)
    assert bins == best_fit(lengths, room)
    filled: dict[int, list] = {}
    for n, q0, q1, first, per, offset in moves:
        for q in range(q1 - q0):
            filled.setdefault(first + q // per, []).append((offset + q % per * n, n))
    assert Counter(n for x in filled.values() for _, n in x) == Counter(lengths)
    for x in filled.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= room


def test_packing(spark, monkeypatch):
    from lemmaflow.llm import ranks

    monkeypatch.setattr(ranks, "GROUP_ROWS", 50)
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(VOCABULARY) for _ in range(rng.choice([0, 3, 200, 3000])))) for i in range(60)] + [(60, None), (61, ""), (61, ""), (None, "x"), (62, "<|endoftext|> é日"), (63, "a  <|endoftext|>  <|endoftext|>b <|endoftext>")] + [(None, None)] * 300
    got = packing.best_fit_packing(frame(spark, rows, True), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 2048).collect()
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for d, t in rows:
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or min(2048, len(ids)), len(ids) + 1, 2048)]
        expected += [(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(expected, key=key)
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in by.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))] and sum(n for _, n in x) <= 2048
    assert len(by) == best_fit([r["length"] for r in got], 2048)
    assert packing.best_fit_packing(frame(spark, []), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect() == []


def test_sharding(spark, monkeypatch):
    from lemmaflow.llm import ranks

    monkeypatch.setattr(ranks, "GROUP_ROWS", 50)
    rows = [(i if i % 50 else None, None if i % 40 == 0 else f"t{i % 30}é", f"s{i % 7 if i % 3 else 0}" if i % 11 else None) for i in range(1003)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "'x' as shard", "2 as _rank")
    got = sharding.stratified_shards(df).collect()
    assert len(got) == 1003
    counts = Counter(r["shard"] for r in got)
    assert sorted(counts) == list(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    for stratum in {r["stratum"] for r in got}:
        part = Counter(r["shard"] for r in got if r["stratum"] == stratum)
        assert max(part.get(s, 0) for s in range(16)) - min(part.get(s, 0) for s in range(16)) <= 3
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    monkeypatch.setattr(sharding, "CHUNK", 4)
    again = sharding.stratified_shards(df.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert sharding.stratified_shards(df.limit(0)).collect() == []


def test_equal_rows_are_spread(spark):
    """100,000 rows without id and text: no window of theirs may gather them all."""
    df = spark.range(100_000, numPartitions=4).selectExpr("cast(null as long) as doc_id", "cast(null as string) as text", "'s' as source").unionByName(spark.range(1000).selectExpr("id as doc_id", "string(id) as text", "'t' as source"))
    got = sharding.stratified_shards(df)
    counts = [r["n"] for r in got.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).where("n = d and m = n - 1").collect()]
    assert len(counts) == 16 and sum(counts) == 101_000 and max(counts) - min(counts) <= 1
    made = packing.pieces(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 2048)
    assert made.groupBy(F.pmod("_salt", F.lit(8))).count().agg(F.max("count")).first()[0] < 14_000
    packed = packing.packed(made, 2048)
    assert packed.select("sequence_id", "offset").distinct().count() == 101_000


def test_words_over_blocks():
    texts = [None, "", " a  b\x0bc", "é x y", "long " * 500, "z"]
    for limit in (1, 7, 1 << 20):
        seen = []
        for b in blocks(pa.array(texts), limit=limit):
            raw = b.data.tobytes()
            for i in range(b.n):
                lo, hi = b.first_word[i], b.first_word[i + 1]
                seen.append([raw[x:y].decode() for x, y in zip(b.starts[lo:hi], b.ends[lo:hi], strict=True)])
        assert seen == [words(t) for t in texts]
