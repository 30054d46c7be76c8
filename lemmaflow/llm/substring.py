"""Substring dedup: windows of words that occur more than once are removed.

A window of ``width`` words has an anchor, its least-hashed ``GRAM``-word gram
(leftmost on ties), so equal windows have equal anchors at equal places:

1. Texts with the same words fall together; ``copies`` counts them. A text with
   copies and at least one window loses all words.
2. Anchors are counted. A window whose anchor occurs once is unique.
3. The windows of one repeated anchor place form a segment, at most
   ``2 * width - GRAM`` words. Equal segments of an anchor fall together with a
   weight, before they are shuffled. Segments go to shards by anchor.
4. Each shard has a compressed FM-index over its segments (`fmindex`). Backward
   search over the wavelet matrix finds how far each streamed segment matches
   with a weight of two or more; intervals of ``width`` words or more are
   reported as bits of windows.
5. The bits come back to the texts and the covered words go.

An anchor with more than ``HOT`` places deals out its windows one by one, by
their own hashes, so no shard holds more than that many segments of one anchor.

Texts are known by two 64-bit signatures of their words, not by doc_id, so null
or repeated ids and repeated rows are as good as others. Null texts and texts
without words have zero words and the digest of the empty string; texts shorter
than a window lose nothing; an empty table gives an empty table. Columns of ``docs``
named like those made here (s1, s2, n_words, n_removed, kept_text, kept_sha256) are
replaced.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fmindex import FMIndex
from .store import fresh_path, small_batches, written
from .text import Block, blocks, duplicated, mix, window_hash

GRAM = 8
#: Bytes of texts in a bucket, one task's.
BUCKET_BYTES = 256 << 20
HOT = 50_000
SHARD_WORDS = 200_000
KEY = ["s1", "s2"]


def signatures(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's sequence of words."""
    place = np.arange(len(block.doc), dtype=np.uint64) - block.first_word[block.doc].astype(np.uint64)
    one = np.zeros(len(block.doc) + 1, np.uint64)
    two = np.zeros(len(block.doc) + 1, np.uint64)
    np.cumsum(mix(block.hashes + place * np.uint64(0x9E3779B97F4A7C15)), out=one[1:])
    np.cumsum(mix((block.hashes ^ np.uint64(0xA5A5A5A55A5A5A5A)) - place * np.uint64(0xC2B2AE3D27D4EB4F)), out=two[1:])
    n = block.n_words.astype(np.uint64)
    return mix(np.diff(one[block.first_word]) + n).view(np.int64), mix(np.diff(two[block.first_word]) ^ n).view(np.int64)


def signed(docs: DataFrame, keep_text: bool) -> DataFrame:
    """``docs`` with s1, s2 and n_words."""
    base = docs.drop(*KEY, "n_words")
    schema = T.StructType([f for f in base.schema.fields if keep_text or f.name != "text"] + [T.StructField(c, T.LongType()) for c in (*KEY, "n_words")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s1, s2, n = [], [], []
            for block in blocks(batch.column("text")):
                one, two = signatures(block)
                s1.append(one), s2.append(two), n.append(block.n_words)
            cols = {c: batch.column(c) for c in batch.schema.names if keep_text or c != "text"}
            for name, parts in (("s1", s1), ("s2", s2), ("n_words", n)):
                cols[name] = pa.array(np.concatenate(parts) if parts else [], pa.int64())
            yield pa.RecordBatch.from_pydict(cols)

    return base.mapInArrow(run, schema)


def anchor_places(block: Block, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window of a block: its first word, text, its anchor's first word and the anchor's hash."""
    span = width - GRAM + 1
    at, hashes = block.windows(width)
    if not len(at):
        return at, at, at, hashes
    gram = np.full(len(block.doc), np.iinfo(np.uint64).max, np.uint64)
    places, values = block.windows(GRAM)
    gram[places] = values
    best, where, done = gram, np.arange(len(gram)), 1
    while done < span:  # least of done, then of done + step places, leftmost on ties
        step = min(done, span - done)
        right, right_at = best[step:], where[step:]
        less = right < best[: len(best) - step]
        best, where = np.where(less, right, best[: len(best) - step]), np.where(less, right_at, where[: len(where) - step])
        done += step
    return at, block.doc[at], where[at], best[at]


def _anchors(reps: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s1, s2 = batch.column("s1").to_numpy(), batch.column("s2").to_numpy()
            for block in blocks(batch.column("text")):
                _, doc, place, value = anchor_places(block, width)
                new = np.append(True, place[1:] != place[:-1]) if len(place) else np.zeros(0, bool)
                doc, place, value = doc[new], place[new], value[new]
                yield pa.RecordBatch.from_pydict(
                    {"anchor": pa.array(value.view(np.int64)), "s1": pa.array(s1[block.lo + doc]), "s2": pa.array(s2[block.lo + doc]), "place": pa.array((place - block.first_word[doc]).astype(np.int32))}
                )

    return reps.select(*KEY, "text").mapInArrow(run, "anchor long, s1 long, s2 long, place int")


def _segments(listed: DataFrame, width: int) -> DataFrame:
    """One row per repeated anchor place of a text: the segment's hash, first word and words; hot anchors give one per window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s1, s2 = batch.column("s1").to_numpy(), batch.column("s2").to_numpy()
            lists = batch.column("places")
            ends = lists.offsets.to_numpy()
            flat = lists.values
            place_of, hot_of = flat.field("place").to_numpy(), flat.field("hot").to_numpy(zero_copy_only=False)
            for block in blocks(batch.column("text")):
                at, doc, place, value = anchor_places(block, width)
                state = np.zeros(len(block.doc) + 1, np.int8)  # 1: repeated, 2: hot
                for i in range(block.n):
                    part = slice(ends[block.lo + i], ends[block.lo + i + 1])
                    state[block.first_word[i] + place_of[part]] = 1 + hot_of[part]
                keep = np.flatnonzero(state[place] > 0)
                at, doc, place, value = at[keep], doc[keep], place[keep], value[keep]
                hot = state[place] == 2
                first = np.append(True, (place[1:] != place[:-1]) | hot[1:]) if len(place) else np.zeros(0, bool)
                i0 = np.flatnonzero(first)
                i1 = np.append(i0[1:], len(at)) - 1
                a, e, d = at[i0], at[i1] + width, doc[i0]
                powers = mix(np.arange(2 * width, dtype=np.uint64) + np.uint64(11)) | np.uint64(1)
                content = np.zeros(len(a), np.uint64)
                for j in range(int((e - a).max()) if len(a) else 0):
                    inside = a + j < e
                    content[inside] += mix(block.hashes[(a + j)[inside]] * powers[j])
                content = mix(content + (e - a).astype(np.uint64))
                byte0, byte1 = block.starts[a], block.ends[e - 1]
                raw = block.data.tobytes()
                yield pa.RecordBatch.from_pydict(
                    {
                        "anchor": pa.array(np.where(hot[i0], content, value[i0]).view(np.int64)),
                        "content": pa.array(content.view(np.int64)),
                        "s1": pa.array(s1[block.lo + d]),
                        "s2": pa.array(s2[block.lo + d]),
                        "first": pa.array((a - block.first_word[d]).astype(np.int32)),
                        "segment": pa.array([raw[x:y] for x, y in zip(byte0, byte1, strict=True)], pa.binary()),
                    }
                )

    return listed.mapInArrow(run, "anchor long, content long, s1 long, s2 long, first int, segment binary")


def window_bits(segments: pa.Array, weights: np.ndarray, width: int) -> np.ndarray:
    """For each segment of a shard, bit i tells whether its window i occurs with a weight of two or more."""
    spans = [(b.hashes, b.n_words) for b in blocks(segments.cast(pa.large_binary()).view(pa.large_string()), limit=1 << 62)]
    hashes, n = spans[0]
    ids = np.zeros(len(hashes) + len(n) + 1, np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    starts = np.cumsum(np.append(0, n[:-1])) + np.arange(len(n)) + 1  # a separator before each segment
    where = np.arange(len(hashes)) + owner + 1
    ids[where] = np.unique(hashes, return_inverse=True)[1] + 1
    weight = np.zeros(len(ids), np.int64)
    weight[where] = weights[owner]
    bits = np.zeros(len(n), np.int64)
    # A gram that occurs once can be in no repeated window: searches begin between such grams.
    spread = np.zeros(len(ids), np.uint64)
    spread[where] = hashes
    held = np.zeros(len(ids), np.int64)
    held[where] = n[owner] - (where - starts[owner])
    places = np.flatnonzero(held >= GRAM)
    grams = window_hash(spread, places, GRAM)
    again = duplicated(grams) | (weight[places] >= 2)
    good = np.zeros(len(ids) + 1, np.int64)
    good[places[again]] = 1
    lone = np.concatenate([[0], np.cumsum(1 - good[:-1])])
    windows = np.flatnonzero(held >= width)
    windows = windows[lone[windows + width - GRAM + 1] == lone[windows]]
    if not len(windows):
        return bits
    part = np.cumsum(np.append(False, np.diff(windows) != 1))
    begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    last = np.append(begin[1:], len(windows)) - 1
    index = FMIndex(ids, weight, 2 * width)
    a, e = windows[begin], windows[last] + width
    found = np.zeros(len(ids), bool)
    long = index.matched(ids, a, e, 2)
    whole = long == e - a
    size = last - begin + 1
    for_all = np.repeat(whole, size)
    found[windows[for_all]] = True
    # A run that doesn't match as a whole: its last windows within the match hold, the others are searched one by one.
    tail = np.repeat(e - long, size)
    sure = ~for_all & (windows >= tail)
    found[windows[sure]] = True
    open_ = windows[~for_all & ~sure]
    found[open_] = index.matched(ids, open_, open_ + width, 2) == width
    hit = np.flatnonzero(found)
    seg = owner[hit - np.searchsorted(starts, hit, "right")]
    np.bitwise_or.at(bits, seg, np.int64(1) << (hit - starts[seg]))
    return bits


def _shards(distinct: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            if size:
                t = pa.Table.from_batches(rest).combine_chunks()
                bits = window_bits(t.column("segment").chunk(0), t.column("weight").to_numpy(), width)
                some = pa.array(bits != 0)
                made = pa.RecordBatch.from_pydict({"anchor": t.column("anchor").combine_chunks(), "content": t.column("content").combine_chunks(), "bits": pa.array(bits)})
                yield made.filter(some)

        for batch in batches:
            lo = 0
            anchor = batch.column("anchor").to_numpy()
            for cut in [*(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1), batch.num_rows]:
                if lo == 0 and rest and rest[-1].column("anchor")[-1].as_py() != anchor[0] and size >= SHARD_WORDS or lo and size >= SHARD_WORDS:
                    yield from out()
                    rest, size = [], 0
                if cut > lo:
                    piece = batch.slice(lo, cut - lo)
                    rest.append(piece)
                    size += (cut - lo) * width
                    lo = int(cut)
        yield from out()

    return distinct.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "anchor long, content long, bits long")


def _applied(reps: DataFrame, width: int) -> DataFrame:
    """Per text: n_removed, the kept words and their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, texts, digests = [], [], []
            whole = (batch.column("copies").to_numpy() > 1) & (batch.column("n_words").to_numpy() >= width)
            found = batch.column("found")
            for block in blocks(batch.column("text")):
                raw = block.data.tobytes()
                for i in range(block.n):
                    lo, hi = block.first_word[i], block.first_word[i + 1]
                    gone = np.zeros(hi - lo + 1, np.int64)
                    if whole[block.lo + i]:
                        gone[0] = 1
                    for row in found[block.lo + i].as_py() or ():
                        for k in range(int(row["bits"]).bit_length()):
                            if row["bits"] >> k & 1:
                                gone[row["first"] + k] += 1
                                gone[row["first"] + k + width] -= 1
                    keep = np.flatnonzero(np.cumsum(gone)[:-1] == 0) + lo
                    removed.append(int(hi - lo - len(keep)))
                    digests.append(hashlib.sha256(b" ".join([raw[a:b] for a, b in zip(block.starts[keep].tolist(), block.ends[keep].tolist(), strict=True)])).hexdigest())
                    runs = np.flatnonzero(np.append(True, np.diff(keep) != 1)) if len(keep) else keep
                    last = np.append(runs[1:], len(keep)) - 1 if len(keep) else keep
                    texts.append(b"\n".join([raw[a:b] for a, b in zip(block.starts[keep[runs]].tolist(), block.ends[keep[last]].tolist(), strict=True)]))
            yield pa.RecordBatch.from_pydict(
                {"s1": batch.column("s1"), "s2": batch.column("s2"), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(texts, pa.binary()).view(pa.string()), "kept_sha256": pa.array(digests, pa.string())}
            )

    return reps.select(*KEY, "text", "n_words", "copies", "found").mapInArrow(run, "s1 long, s2 long, n_removed long, kept_text string, kept_sha256 string")


def text_bytes(docs: DataFrame) -> int:
    """Bytes of the texts: the size of the files that Spark knows, or counted where it only guesses."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 50 else docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def _bucketed(df: DataFrame, size: int) -> DataFrame:
    """The texts, ``size`` bytes of them, as a table in buckets of their signatures, so that later joins move only the small side."""
    spark = df.sparkSession
    name = f"lemmaflow_{uuid.uuid4().hex}"
    # A multiple of the shuffle's partitions: each of its tasks then writes whole buckets, and no bucket outgrows a task.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = parts * max(1, -(-size // (BUCKET_BYTES * parts)))
    df.write.format("parquet").bucketBy(buckets, *KEY).option("path", fresh_path(spark, "reps")).option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name goes, the external files and the resolved plan stay
    return table


def repeated_removed(docs: DataFrame, width: int = 50, keep_text: bool = True) -> DataFrame:
    """``docs`` without text, with n_words, n_removed, kept_sha256 (of the kept words, joined by one space) and, if
    asked for, kept_text: the runs of kept words as they stand in the text, or in one with the same words, a line each."""
    if not GRAM <= width <= 63 - GRAM + 1:
        raise ValueError(f"width must be {GRAM} to {63 - GRAM + 1}")
    small_batches(docs.sparkSession)
    reps = _bucketed(signed(docs.select("text"), True).groupBy(*KEY).agg(F.first("n_words").alias("n_words"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")), text_bytes(docs))
    long_reps = reps.where(F.col("n_words") >= width)
    places = written(_anchors(long_reps, width), "anchors")
    # Written, the repeated anchors have a shuffle of their own in the join, so a crowded anchor's places can be split there.
    again = places.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", (F.col("n") > HOT).alias("hot"))
    again = written(again, "repeated")
    listed = places.join(again, "anchor").groupBy(*KEY).agg(F.collect_list(F.struct("place", "hot")).alias("places"))
    segments = written(_segments(long_reps.join(listed, KEY).select(*KEY, "text", "places"), width), "segments")
    distinct = segments.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("weight"), F.first("segment").alias("segment"))
    bits = written(_shards(distinct, width), "bits")
    found = segments.select("anchor", "content", *KEY, "first").join(bits, ["anchor", "content"]).groupBy(*KEY).agg(F.collect_list(F.struct("first", "bits")).alias("found"))
    results = _applied(reps.join(found, KEY, "left"), width)
    light = signed(docs.drop("n_removed", "kept_text", "kept_sha256"), False)
    return light.join(results if keep_text else results.drop("kept_text"), KEY).drop(*KEY)
