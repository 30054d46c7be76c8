"""Scores of whole texts under a causal self-attention model (`attention`).

What is learnt comes from all training documents: counts of words and of pairs of
subwords are summed over all of them, and the weights are trained in ``ROUNDS``
rounds over disjoint parts that cover all of them, at every size alike. Texts are cut
into subwords once and written with them. In each round
every task passes over its documents of the part and the tasks' weights are
averaged by tokens. A text's score is the log10 probability of its words, each
the mixture of its subwords' probability under attention and of its counted share.

Score and baseline need the training count of every word of every document. The
head, ``HEAD`` words at most, is sent to the tasks, a bounded table; the other words
go with their subwords' probability to a join with the word counts by hash, which
splits by words and not by documents, and there get what their counts add.

Edge cases: a null text counts as empty and is scored as one end; texts of any
length are scored whole, window by window; rows with null or repeated ids are
scored each by itself (a null id's row is not held out); with no training
documents the counts are zero and the weights untrained; an empty table gives an
empty table; only doc_id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attention import LOG10, Attention, begins_word, encoded
from .ranks import most_frequent
from .store import written
from .text import blocks, give_back

HEAD = 1 << 19
ROUNDS = 3
#: Adam's rate in the first round; a round's rate is that over its number.
RATE = 0.03
SIZE = 1024
LIMIT = 1 << 22
#: The hash that stands for a text's end among the words.
END = 0x5851F42D4C957F2D


def encoded_texts(marked: DataFrame, vocabulary: str, pattern: str, size: int, rounds: int) -> DataFrame:
    """``marked`` with the texts' subwords (16-bit numbers) and the round that a training text belongs to.

    The first row of each block of texts also holds the block's training words, by hash, and their counts."""
    lists = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            learns = batch.column("learns").to_numpy(zero_copy_only=False).astype(bool)
            for block in blocks(batch.column("text"), lower=True, limit=LIMIT):
                made = encoded(block, vocabulary, pattern, size)
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), block.n, [None, pa.py_buffer(made.first * 2), pa.py_buffer(made.ids)])
                mine = learns[block.lo : block.hi]
                times = np.bincount(made.of[mine[block.doc]], minlength=len(made.words))
                words, times = np.append(made.words[times > 0], np.uint64(END)).view(np.int64), np.append(times[times > 0], mine.sum())
                cols = {c: batch.column(c)[block.lo : block.hi] for c in ("doc_id", "text", "held_out", "learns", "part")}
                once = lambda x, n=block.n: pa.array([x, *[None] * (n - 1)], lists)
                yield pa.RecordBatch.from_pydict({**cols, "doc_id": cols["doc_id"].cast(pa.int64()), "ids": ids.cast(pa.binary()), "words": once(words), "times": once(times)})

    dealt = marked.select("doc_id", "text", "held_out", "learns", F.pmod(F.monotonically_increasing_id(), F.lit(rounds)).cast("int").alias("part"))
    return written(dealt.mapInArrow(run, "doc_id long, text string, held_out boolean, learns boolean, part int, ids binary, words array<long>, times array<long>"), "encoded")


def word_counts(made: DataFrame) -> DataFrame:
    """(word, c): counts of the hashes of words, and of ends, over the training documents."""
    listed = made.where(F.col("words").isNotNull()).select(F.explode(F.arrays_zip("words", "times")).alias("x"))
    return listed.groupBy(F.col("x.words").alias("word")).agg(F.sum("x.times").alias("c")).where("c > 0")


def id_blocks(column: pa.Array, size: int, limit: int = LIMIT // 2) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` subwords: first and last row, ids with an end before the first text, where texts begin."""
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(ends, ends[lo] + 2 * limit, "right")) - 1))
        flat = data[ends[lo] : ends[hi]].view(np.uint16) if ends[lo] % 2 == 0 else np.frombuffer(data[ends[lo] : ends[hi]].tobytes(), np.uint16)
        yield lo, hi, np.append(size, flat.astype(np.int64)), (ends[lo : hi + 1] - ends[lo]) // 2
        lo = hi


def pair_counts(made: DataFrame, size: int) -> np.ndarray:
    """Counts of pairs of subwords over the training documents, ``size + 1`` squared at most."""
    n = size + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, np.int64)
        for batch in batches:
            for _, _, ids, _ in id_blocks(batch.column("ids"), size):
                total += np.bincount(ids[:-1] * n + ids[1:], minlength=n * n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(some.astype(np.int32)), "c": pa.array(total[some])})

    rows = made.where("learns").select("ids").mapInArrow(run, "pair int, c long").groupBy("pair").agg(F.sum("c").alias("c"))
    out = np.zeros(n * n)
    for batch in rows.toArrow().to_batches():
        out[batch.column("pair").to_numpy()] = batch.column("c").to_numpy()
    return out.reshape(n, n)


def trained(made: DataFrame, model: Attention, size: int, rounds: int = ROUNDS) -> Attention:
    """Weights after rounds of passes, each over its part of the training documents and averaged by tokens; every document is in one part."""
    names = list(model.weights)
    shapes = [model.weights[k].shape for k in names]
    for r in range(rounds):
        chosen = made.where(F.col("learns") & (F.col("part") == r)).select("ids")

        def run(batches: Iterator[pa.RecordBatch], r: int = r) -> Iterator[pa.RecordBatch]:
            own = Attention(model.pair, model.to_class, model.classes, model.mixture, dict(model.weights))
            seen = 0
            for batch in batches:
                for _, _, ids, first in id_blocks(batch.column("ids"), size):
                    seen += own.train(ids, first, rate=RATE / (r + 1), seed=r)
                give_back()
            if seen:
                flat = np.concatenate([own.weights[k].ravel() for k in names]).astype(np.float64) * seen
                yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(flat)), pa.int32()), "v": pa.array(flat), "n": pa.array(np.full(len(flat), seen))})

        parts = chosen.mapInArrow(run, "at int, v double, n long")
        rows = parts.groupBy("at").agg((F.sum("v") / F.sum("n")).alias("v")).toArrow()  # as many as weights
        if not rows.num_rows:
            continue
        total = rows.column("v").to_numpy()[np.argsort(rows.column("at").to_numpy())]
        lo = 0
        for k, shape in zip(names, shapes, strict=True):
            hi = lo + int(np.prod(shape))
            model.weights[k] = total[lo:hi].reshape(shape).astype(np.float32)
            lo = hi
    return model


def scored(docs: DataFrame, vocabulary: str, pattern: str, held_out: F.Column, size: int = SIZE, mixture: float = 0.3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text."""
    marked = docs.select("doc_id", "text").withColumn("held_out", F.coalesce(held_out, F.lit(False))).withColumn("learns", ~F.col("held_out"))
    made = encoded_texts(marked, vocabulary, pattern, size, ROUNDS)
    counts = written(word_counts(made), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    head = most_frequent(counts, HEAD).toArrow()  # HEAD rows at most
    order = np.argsort(head.column("word").to_numpy().view(np.uint64))
    words, times = head.column("word").to_numpy().view(np.uint64)[order], head.column("c").to_numpy()[order]
    model = trained(made, Attention.from_counts(pair_counts(made, size)), size)
    begins = begins_word(vocabulary, pattern, size)
    base = float(np.log10(total + distinct + 1))
    whole = max(total, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, ids, first in id_blocks(batch.column("ids"), size):
                (block,) = blocks(batch.column("text")[lo:hi], lower=True, limit=1 << 62)
                uniq, back = np.unique(block.hashes, return_inverse=True)
                of = np.full(len(back) + block.n, len(uniq))
                of[np.arange(len(back)) + block.doc] = back
                uniq = np.append(uniq, np.uint64(END))
                if len(words):
                    at = np.minimum(np.searchsorted(words, uniq), len(words) - 1)
                    c = np.where(words[at] == uniq, times[at], 0)
                else:
                    c = np.zeros(len(uniq), np.int64)
                n = block.n_words
                text = np.repeat(np.arange(block.n), n + 1)
                got = c[of]
                known = np.bincount(text, got > 0, minlength=block.n)
                summed = np.bincount(text, np.log10(c + 1.0)[of], minlength=block.n) - base * (n + 1)
                each = model.log_probabilities(ids, first).astype(np.float64)
                by_word = np.add.reduceat(each, np.flatnonzero(begins[ids[1:]]))
                mixed = np.log10(mixture * got / whole + (1 - mixture) * np.exp(by_word) + 1e-300)
                score = np.bincount(text, np.maximum(mixed, by_word * LOG10 + np.log10(1 - mixture)), minlength=block.n)
                rare = np.flatnonzero(got == 0)
                cuts = np.searchsorted(text[rare], np.arange(block.n + 1))
                span = slice(lo, hi)
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": pa.array(np.arange(row, row + block.n) + (task << 40)),
                        "doc_id": batch.column("doc_id").cast(pa.int64())[span],
                        "held_out": batch.column("held_out")[span],
                        "n_tokens": pa.array((n + 1).astype(np.int64)),
                        "known": pa.array(known.astype(np.int64)),
                        "summed": pa.array(summed),
                        "score": pa.array(score),
                        "rare": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(uniq[of[rare]].view(np.int64))),
                        "by_word": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(by_word[rare])),
                    }
                )
                row += block.n
            give_back()

    first_pass = written(made.select("doc_id", "text", "held_out", "ids").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, summed double, score double, rare array<long>, by_word array<double>"), "scores")
    rows = first_pass.drop("rare", "by_word")
    tail = first_pass.select("row", F.explode(F.arrays_zip("rare", "by_word")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.by_word").alias("by_word"))

    def mixed(c: F.Column) -> F.Column:
        """As in the first pass, where the word's count was taken for 0."""
        own = F.col("by_word")
        return F.greatest(F.log10(mixture * c / whole + (1 - mixture) * F.exp(own) + 1e-300), own * float(LOG10) + float(np.log10(1 - mixture)))

    # Without a tail beyond the head the join has nothing to find.
    if distinct > len(words):
        found = tail.join(counts, "word").groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("add"), F.sum(mixed(F.col("c")) - mixed(F.lit(0))).alias("gain"))
        rows = rows.join(found, "row", "left")
    else:
        rows = rows.withColumn("more", F.lit(0).cast("long")).withColumn("add", F.lit(0.0)).withColumn("gain", F.lit(0.0))
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("summed") + F.coalesce("add", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )
