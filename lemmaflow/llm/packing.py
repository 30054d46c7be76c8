"""Best-fit decreasing packing of token sequences.

A document's ids end with one separator. Only documents longer than ``room`` are
cut: a shorter first piece, then full ones. Best-fit decreasing depends on the
lengths alone, so it runs on the counts of the at most ``room`` lengths: lengths
go down, and a segment tree over remaining capacities finds the tightest bins
that are open, all bins of one capacity at once. The result is the packing that
item-by-item best fit makes, at a cost that doesn't grow with the rows, and a
plan of a bounded number of moves: ranks ``q0`` to ``q1`` of a length go to bins
from ``bin`` on, ``per`` to a bin, from ``offset`` on. Rows are ranked within
their length (`ranks`) and look their place up in the plan.

Edge cases: a null or empty text is one separator; the string of a special token is
that token, wherever it stands; repeated rows and repeated or
null ids are packed as often as they stand; an empty table gives an empty table;
only doc_id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import groups_for, with_rank
from .store import small_batches, written
from .text import give_back, mix


#: Strings that the vocabulary's own tokenizer takes for one id wherever they stand in a text (fixed value).
SPECIAL = (("<|endoftext|>", 50256),)


@lru_cache(maxsize=4)
def encoder(vocabulary: str, pattern: str, special: tuple[tuple[str, int], ...] = SPECIAL) -> tiktoken.Encoding:
    """A byte-level BPE from a file of ranks and its special tokens."""
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))


def pieces(docs: DataFrame, vocabulary: str, pattern: str, room: int, separator: int = 0, special: tuple[tuple[str, int], ...] = SPECIAL) -> DataFrame:
    """Per piece: doc_id, piece, start, length, the crc of its ids, and a random number to deal equal rows out by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary, pattern, special)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.array([*code.encode(text.as_py() or "", allowed_special="all"), separator], "<u4")
                lo = 0
                hi = len(ids) % room or min(room, len(ids))
                k = 0
                while lo < len(ids):
                    at.append(i), piece.append(k), start.append(lo), length.append(hi - lo), crc.append(zlib.crc32(ids[lo:hi].tobytes()))
                    lo, hi, k = hi, hi + room, k + 1
            give_back()
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").cast(pa.int64()).take(pa.array(at, pa.int64())),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                    "_salt": pa.array(mix(np.arange(row, row + len(at), dtype=np.uint64)).view(np.int64)),
                }
            )
            row += len(at)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, _salt long")


class OpenBins:
    """Ranges of equal bins by remaining capacity, and a segment tree of the capacities that have any."""

    def __init__(self, room: int) -> None:
        self.leaves = 1 << room.bit_length()
        self.some = [False] * (2 * self.leaves)
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def _set(self, capacity: int) -> None:
        i = self.leaves + capacity
        self.some[i] = bool(self.ranges.get(capacity))
        while i > 1:
            i //= 2
            self.some[i] = self.some[2 * i] or self.some[2 * i + 1]

    def put(self, capacity: int, first: int, count: int) -> None:
        if capacity and count:
            self.ranges.setdefault(capacity, []).append((first, count))
            self._set(capacity)

    def take(self, capacity: int) -> tuple[int, int]:
        out = self.ranges[capacity].pop()
        self._set(capacity)
        return out

    def tightest(self, need: int) -> int | None:
        """The least capacity of ``need`` or more that an open bin has."""
        i = self.leaves + need
        if self.some[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.some[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_plan(counts: dict[int, int], room: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Moves (length, q0, q1, bin, per, offset) and the number of bins."""
    bins, moves, opened = OpenBins(room), [], 0
    for length in sorted(counts, reverse=True):
        done, total = 0, counts[length]
        while done < total:
            capacity = bins.tightest(length)
            left = total - done
            if capacity is None:
                capacity, first, count = room, opened, -(-left // (room // length))
                opened += count
            else:
                first, count = bins.take(capacity)
            per = min(capacity // length, left)
            full = min(count, left // per)
            moves.append((length, done, done + full * per, first, per, room - capacity))
            done += full * per
            bins.put(capacity - per * length, first, full)
            bins.put(capacity, first + full, count - full)
    return moves, opened


def packed(made: DataFrame, room: int) -> DataFrame:
    """``made`` (pieces) with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    moves, _ = best_fit_plan(counts, room)
    groups = groups_for(max(counts.values(), default=0))
    dealt = made.withColumn("_bucket", F.pmod("_salt", F.lit(groups)))
    ranked = with_rank(dealt, ["length"], "_bucket", [F.col("_salt"), *[F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")]], "_rank")
    plan = np.array(sorted(moves), np.int64).reshape(-1, 6)
    scale = 1 << 44

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = plan[:, 0] * scale + plan[:, 1]
        for batch in batches:
            length, q = batch.column("length").to_numpy(), batch.column("_rank").to_numpy() - 1
            move = plan[np.searchsorted(begins, length * scale + q, "right") - 1] if len(q) else plan[:0]
            nth = q - move[:, 1]
            cols = {c: batch.column(c) for c in batch.schema.names if c != "_rank"}
            cols["sequence_id"] = pa.array(move[:, 3] + nth // np.maximum(move[:, 4], 1))
            cols["offset"] = pa.array(move[:, 5] + nth % np.maximum(move[:, 4], 1) * length)
            yield pa.RecordBatch.from_pydict(cols)

    out = made.drop("_salt")
    return ranked.select(*out.columns, "_rank").mapInArrow(run, out.schema.add("sequence_id", "long").add("offset", "long"))


def best_fit_packing(docs: DataFrame, vocabulary: str, pattern: str, room: int = 2048, separator: int = 0, special: tuple[tuple[str, int], ...] = SPECIAL) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    small_batches(docs.sparkSession)
    return packed(written(pieces(docs, vocabulary, pattern, room, separator, special), "pieces"), room)
