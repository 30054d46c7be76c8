"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into pieces of at most ``PIECE`` words and documents into
passages of twice that, half overlapping, so each stretch of a piece's length
lies whole in a passage. The steps:

1. Document frequencies of the benchmark's words, over all documents; a word weighs
   its inverse document frequency, and nothing in more than one document of ``STOP``.
2. Passages that could match: a match holds ``MASS`` of a piece's weight, so a passage
   that weighs less than any piece asks for is out, exactly. The others are written
   once, as places in the vocabulary.
3. A distributed randomised SVD of the TF-IDF matrix of these passages (of those that
   tile the texts) and, at equal weight, of the pieces: tasks sum ``A^T A Q`` and the driver holds only matrices of
   vocabulary times rank.
4. Cosine search in the latent space: pieces against all passages of the table. A piece
   of fewer than ``SHORT`` words is a small part of any passage's vector; for those all
   passages are candidates. Inverted lists tell which candidates hold ``MASS`` of a
   piece's weight.
5. Candidates are verified: the longest common subsequence with the piece, in
   order, and the share of the piece's answer (its last sentence) that the
   passage holds. ``LCS`` of the words is a copy; ``LCS_LOOSE`` with ``ANSWER``
   of the answer is a paraphrase. Either holds ``MASS`` of the piece's weight, so that
   common words alone make no match.

The benchmark is a stated query set, taken in blocks of at most ``BLOCK_WORDS`` words
(or one longer item); only one block's vocabulary, and matrices of that height, are
held by a task or the driver at a time.

Edge cases: null and empty texts, and items of fewer than ``LEAST_WORDS`` different words, match nothing; equal items each match;
rows with one doc_id give one result per item, those with a null doc_id too, under
null; an empty table gives no matches; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .text import Block, as_strings, blocks

PIECE, STOP, MASS, SHORT = 48, 20, 0.4, 20
#: An item of fewer different words can't be told from chance and matches nothing.
LEAST_WORDS = 3
LCS, LCS_LOOSE, ANSWER = 0.6, 0.45, 0.8
RANK, EXTRA, COSINE = 128, 16, 0.3
BLOCK_WORDS = 60_000
_TRIM = np.zeros(256, bool)
_TRIM[[ord(c) for c in ".,;:!?\"'()[]#*$%&|<>_-"]] = True


def folded(column: pa.Array) -> Iterator[Block]:
    """Blocks of the texts in lower case, of all letters."""
    return blocks(pc.utf8_lower(as_strings(column)))


def trimmed(block: Block) -> np.ndarray:
    """Hashes of words without up to three marks at either end."""
    starts, ends = block.starts, block.ends
    if not len(starts):
        return block.hashes
    for _ in range(3):
        ends = ends - (_TRIM[block.data[ends - 1]] & (ends - starts > 1))
        starts = starts + (_TRIM[block.data[starts]] & (ends - starts > 1))
    return block.span_hash(starts, ends)


def word_hashes(text: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(trimmed(b) for b in folded(pa.array([text], pa.large_string())))])


@dataclass
class Pieces:
    """A block of the benchmark: each piece's item, words (places in ``vocabulary``) and answer."""

    items: np.ndarray
    words: list[np.ndarray]
    answers: list[np.ndarray]
    vocabulary: np.ndarray


def cut(items: list[tuple[int, str]]) -> Pieces:
    ids, hashed, answers = [], [], []
    for item, text in items:
        words = word_hashes(text)
        if len(np.unique(words)) < LEAST_WORDS:
            continue
        sentences = [s for s in re.split(r"(?<=[.?!])\s+|\n", text) if len(word_hashes(s))]
        last = word_hashes(sentences[-1])
        for part in np.array_split(words, -(-len(words) // PIECE)):
            ids.append(item), hashed.append(part), answers.append(last)
    vocabulary = np.unique(np.concatenate(hashed)) if hashed else np.zeros(0, np.uint64)
    at = lambda w: np.searchsorted(vocabulary, w)
    return Pieces(np.array(ids, np.int64), [at(w) for w in hashed], [at(w) for w in answers], vocabulary)


def weights_of(pieces: Pieces, n: int, df: np.ndarray) -> np.ndarray:
    """Inverse document frequencies; 0 for words in more than one document of ``STOP``, but for pieces of hardly any others."""
    stop = df > np.maximum(20, n // STOP)
    for w in pieces.words:
        if len(np.unique(w[~stop[w]])) < 3:
            stop[w] = False
    return np.where(stop, 0, np.log((n + 1) / (df + 0.5)).clip(0.05)).astype(np.float32)


def places_in(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of words in a vocabulary, -1 for others."""
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, -1)


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of documents, and how many hold each word."""
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(size + 1, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for block in folded(batch.column("text")):
                at = places_in(vocabulary, trimmed(block))
                known = at >= 0
                counts += np.bincount(np.unique(block.doc[known] * size + at[known]) % size, minlength=size + 1)
        counts[size] = n
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"word": pa.array(some), "n": pa.array(counts[some])})

    rows = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size + 1, np.int64)
    for r in rows:
        out[r["word"]] = r["n"]
    return int(out[size]), out[:size]


def possible_passages(docs: DataFrame, vocabulary: np.ndarray, idf: np.ndarray, least: float) -> DataFrame:
    """(doc_id, words, tile) of passages that weigh ``least`` or more; words: places in the vocabulary, -1 for others.

    Tiles are every second passage and a text's last: they cover each word, and overlap at the end only."""
    weight = np.append(idf, 0).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for block in folded(batch.column("text")):
                at = places_in(vocabulary, trimmed(block))
                sums = np.concatenate([[0], np.cumsum(weight[at])])
                n = np.maximum(1, -(-(block.n_words - PIECE) // PIECE)) * (block.n_words > 0)
                doc = np.repeat(np.arange(block.n), n)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                tile = (nth % 2 == 0) | np.append(doc[1:] != doc[:-1], np.ones(min(1, len(doc)), bool))
                lo = block.first_word[doc] + nth * PIECE
                hi = np.minimum(lo + 2 * PIECE, block.first_word[doc + 1])
                keep = np.flatnonzero((sums[hi] - sums[lo] >= least) & (hi > lo))
                lo, hi = lo[keep], hi[keep]
                ends = np.concatenate([[0], np.cumsum(hi - lo)])
                flat = np.arange(ends[-1]) - np.repeat(ends[:-1] - lo, hi - lo)
                yield pa.RecordBatch.from_pydict({"doc_id": ids.take(pa.array(block.lo + doc[keep])), "words": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[flat], pa.int32())), "tile": pa.array(tile[keep])})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, words array<int>, tile boolean")


@dataclass
class Rows:
    """Sparse TF-IDF rows of unit length."""

    row: np.ndarray
    word: np.ndarray
    value: np.ndarray
    n: int

    def times(self, m: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, m.shape[1]), m.dtype)
        if len(self.row):
            begin = np.flatnonzero(np.append(True, self.row[1:] != self.row[:-1]))
            out[self.row[begin]] = np.add.reduceat(m[self.word] * self.value[:, None], begin, axis=0)
        return out

    def transposed_times(self, m: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((size, m.shape[1]), m.dtype)
        if len(self.row):
            order = np.argsort(self.word, kind="stable")
            word = self.word[order]
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            out[word[begin]] = np.add.reduceat(m[self.row[order]] * self.value[order][:, None], begin, axis=0)
        return out


def tf_idf(ends: np.ndarray, words: np.ndarray, idf: np.ndarray) -> Rows:
    n = len(ends) - 1
    row = np.repeat(np.arange(n), np.diff(ends))
    known = (words >= 0) & (idf[words] > 0)
    key, counts = np.unique(row[known] * len(idf) + words[known], return_counts=True)
    row, word = key // len(idf), key % len(idf)
    value = (1 + np.log(counts)) * idf[word]
    norm = np.sqrt(np.bincount(row, value**2, minlength=n))
    return Rows(row, word, (value / np.maximum(norm[row], 1e-12)).astype(np.float32), n)


def _slices(batch: pa.RecordBatch, most: int = 512) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    lists = batch.column("words")
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    for lo in range(0, len(lists), most):
        part = ends[lo : min(lo + most, len(lists)) + 1]
        yield lo, part - part[0], values[part[0] : part[-1]]


def latent_basis(passages: DataFrame, pieces: Rows, idf: np.ndarray, rank: int, seed: int = 5) -> np.ndarray:
    """Right singular vectors (vocabulary x rank) of the passages stacked on the pieces, which weigh as much."""
    size = len(idf)
    width = min(rank + EXTRA, size)
    n = passages.count()
    weight = max(1.0, n / max(pieces.n, 1))

    def gram_times(q: np.ndarray) -> np.ndarray:
        small = q.astype(np.float32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size, width), np.float64)
            for batch in batches:
                for _, ends, words in _slices(batch):
                    rows = tf_idf(ends, words, idf)
                    total += rows.transposed_times(rows.times(small), size)
            some = np.flatnonzero(np.abs(total).sum(axis=1))
            yield pa.RecordBatch.from_pydict({"word": pa.array(some, pa.int32()), "v": pa.FixedSizeListArray.from_arrays(pa.array(total[some].ravel()), width).cast(pa.list_(pa.float64()))})

        parts = passages.select("words").mapInArrow(run, "word int, v array<double>")
        summed = parts.groupBy("word").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(width)])
        out = weight * pieces.transposed_times(pieces.times(small), size).astype(np.float64)
        for r in summed.toLocalIterator():
            out[r[0]] += r[1:]
        return out

    rng = np.random.Generator(np.random.PCG64(seed))
    q = np.linalg.qr(rng.standard_normal((size, width)))[0]
    q = np.linalg.qr(gram_times(q))[0]
    values, turn = np.linalg.eigh(q.T @ gram_times(q))
    top = np.argsort(-values)[:rank]
    return (q @ turn[:, top]).astype(np.float32)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel; words below 0 match nothing."""
    masks: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b.tolist():
        if w >= 0 and (m := masks.get(w)):
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def piece_mass(words: np.ndarray, idf: np.ndarray) -> float:
    """What the different words of a piece weigh."""
    return float(idf[np.unique(words)].sum(dtype=np.float64))


def is_match(piece: np.ndarray, answer: np.ndarray, passage: np.ndarray, idf: np.ndarray) -> tuple[float, float] | None:
    """The shares of the common subsequence and of the answer, if they make a match."""
    here = np.unique(passage[passage >= 0])
    own = np.unique(piece)
    if idf[own[np.isin(own, here)]].sum(dtype=np.float64) < MASS * piece_mass(piece, idf) - 1e-6:
        return None
    share = common_subsequence(piece, passage) / len(piece)
    told = float(np.isin(answer, here).mean())
    return (share, told) if share >= LCS or share >= LCS_LOOSE and told >= ANSWER else None


@dataclass
class Postings:
    """Inverted lists: for each word of the vocabulary its pieces and its share of their weight."""

    n: int
    begin: np.ndarray
    piece: np.ndarray
    share: np.ndarray

    @classmethod
    def of(cls, pieces: Pieces, idf: np.ndarray) -> Postings:
        lists = [np.unique(w) for w in pieces.words]
        word, piece = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        mass = np.array([piece_mass(x, idf) for x in lists])
        some = np.flatnonzero(idf[word] > 0)
        some = some[np.argsort(word[some], kind="stable")]
        word, piece = word[some], piece[some]
        return cls(len(lists), np.searchsorted(word, np.arange(len(idf) + 1)), piece, idf[word] / np.maximum(mass[piece], 1e-12))

    def held(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """(row, piece) of rows that hold ``MASS`` of a piece's weight; a row has each of its words once."""
        n = self.begin[rows.word + 1] - self.begin[rows.word]
        flat = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.begin[rows.word], n)
        key, back = np.unique(np.repeat(rows.row, n) * self.n + self.piece[flat], return_inverse=True)
        key = key[np.bincount(back, self.share[flat], minlength=len(key)) >= MASS - 1e-6]
        return key // self.n, key % self.n


def _matches(passages: DataFrame, pieces: Pieces, idf: np.ndarray, basis: np.ndarray, cosine: float) -> DataFrame:
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)

    ends = np.concatenate([[0], np.cumsum([len(w) for w in pieces.words])])
    latent = unit(tf_idf(ends, np.concatenate(pieces.words), idf).times(basis))
    postings, short = Postings.of(pieces, idf), np.array([len(w) < SHORT for w in pieces.words])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            at, found = [], []
            for lo, cuts, words in _slices(batch):
                rows = tf_idf(cuts, words, idf)
                near = unit(rows.times(basis)) @ latent.T
                # What a match must hold is tested for all candidates at once, before they are taken one by one.
                row, piece = postings.held(rows)
                some = (near[row, piece] >= cosine) | short[piece]
                for p, k in zip(row[some], piece[some], strict=True):
                    got = is_match(pieces.words[k], pieces.answers[k], words[cuts[p] : cuts[p + 1]], idf)
                    if got:
                        at.append(lo + int(p))
                        found.append((int(pieces.items[k]), float(near[p, k]), *got))
            cols = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_pydict({"doc_id": ids.take(pa.array(at, pa.int64())), "item_id": pa.array(cols[0], pa.int64()), "cosine": pa.array(cols[1], pa.float64()), "lcs_share": pa.array(cols[2], pa.float64()), "answer_share": pa.array(cols[3], pa.float64())})

    return passages.mapInArrow(run, "doc_id long, item_id long, cosine double, lcs_share double, answer_share double")


def item_blocks(items: Iterator[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most ``BLOCK_WORDS`` words, or one longer item."""
    block: list[tuple[int, str]] = []
    size = 0
    for item, text in items:
        n = len(text.split())
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += n
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, cosine: float = COSINE) -> DataFrame:
    """(doc_id, item_id) with the best cosine, lcs_share and answer_share, one row per leaked item of a document."""
    schema = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"
    found = docs.sparkSession.createDataFrame([], schema)
    ordered = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").toLocalIterator()
    for block in item_blocks((r[0], r[1]) for r in ordered):
        pieces = cut(block)
        if not len(pieces.items):
            continue
        n, df = document_frequencies(docs, pieces.vocabulary)
        idf = weights_of(pieces, n, df)
        least = MASS * min(piece_mass(w, idf) for w in pieces.words) - 1e-3
        passages = written(possible_passages(docs, pieces.vocabulary, idf, least), "passages")
        ends = np.concatenate([[0], np.cumsum([len(w) for w in pieces.words])])
        basis = latent_basis(passages.where("tile"), tf_idf(ends, np.concatenate(pieces.words), idf), idf, min(rank, len(idf)))
        found = found.union(_matches(passages, pieces, idf, basis, cosine))
    return found.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs_share").alias("lcs_share"), F.max("answer_share").alias("answer_share"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that leak an item; rows with a null doc_id stand or fall together."""
    found = written(leaks(docs.select("doc_id", "text"), benchmark).select(F.col("doc_id").alias("_leaky")).distinct(), "leaks")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_leaky"]), "left_anti")
