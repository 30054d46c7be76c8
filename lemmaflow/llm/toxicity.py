"""Toxicity by a convolutional text classifier, trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its first
bytes, so that inflected and compound forms share what they begin with. Filters
of several widths run over the whole text; each filter keeps its ``TOP`` largest
values (max pooling, with runners-up), and a logistic layer weighs them.

Training takes a bounded sample of labelled rows, ``max_positive`` and
``max_negative`` by a fixed digest of their ids; the labels, the language, the
source and the id are never inputs of a score. The language that thresholds are
calibrated by is guessed from the text's own function words. A part of the sample
is kept from training; there, each guessed language gets the logit at which the
classes part best, and scores are shifted so that it becomes ``threshold``.

Edge cases: null and empty texts get the score of no words; a null doc_id is
held out of training and, as no remainder, not marked held out; repeated rows
get equal scores; with no labels of one class every score is the share of label
1; an empty table gives an empty table; only the id and the text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches
from .text import Block, blocks

ROWS, DIM, WIDTHS, FILTERS, TOP = 1 << 17, 12, (1, 2, 3), 12, 3
PREFIXES = (0, 4, 6, 7)  # bytes; 0: the whole word
PAD = max(WIDTHS) - 1
BATCH = 24
#: Function words, by which a text's language is guessed. Fixed values.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "for", "with"),
    "de": ("der", "die", "das", "und", "den", "nicht", "ist", "ein", "mit", "sich"),
    "fr": ("le", "les", "des", "et", "est", "pour", "dans", "que", "une", "avec"),
    "es": ("el", "los", "las", "que", "y", "del", "por", "con", "para", "una"),
}
_TRIM = np.zeros(256, bool)
_TRIM[[ord(c) for c in ".,;:!?\"')("]] = True


def _hash(word: str) -> int:
    return int(next(blocks(pa.array([word]))).hashes[0])


_LANGS = tuple(FUNCTION_WORDS)
_WORD_LANG = sorted((_hash(w), i) for i, ws in enumerate(FUNCTION_WORDS.values()) for w in ws)
_WORDS = np.array([h for h, _ in _WORD_LANG], np.uint64)
_OWNER = np.array([i for _, i in _WORD_LANG])


@dataclass
class Texts:
    """Rows of hashed features of padded texts: text i has rows ``first[i]`` to ``first[i + 1]``."""

    ids: np.ndarray
    first: np.ndarray
    lang: np.ndarray


def features(block: Block) -> Texts:
    starts, ends = block.starts, block.ends
    ends = ends - (_TRIM[block.data[ends - 1]] & (ends - starts > 1)) if len(ends) else ends
    n = block.n
    first = block.first_word + np.arange(n + 1) * (PAD + 1)
    ids = np.full((int(first[-1]), len(PREFIXES)), ROWS, np.int32)
    place = np.arange(len(starts)) + block.doc * (PAD + 1) + 1
    whole = block.span_hash(starts, ends)
    for k, size in enumerate(PREFIXES):
        h = whole if not size else block.span_hash(starts, np.minimum(ends, starts + size))
        ids[place, k] = ((h >> np.uint64(7)) + np.uint64(k * 7919)) % np.uint64(ROWS)
    at = np.minimum(np.searchsorted(_WORDS, whole), len(_WORDS) - 1)
    hit = _WORDS[at] == whole
    votes = np.zeros((n, len(_LANGS)), np.int64)
    for shift in (0, 1):  # a word may belong to two languages
        j = np.minimum(at + shift, len(_WORDS) - 1)
        same = hit & (_WORDS[j] == whole) & ((shift == 0) | (j != at))
        np.add.at(votes, (block.doc[same], _OWNER[j[same]]), 1)
    return Texts(ids, first, np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), len(_LANGS)) if n else np.zeros(0, np.int64))


class Convolutional:
    """The network's weights, scoring and training."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        self.embed = (rng.standard_normal((ROWS + 1, DIM)) * 0.1).astype(np.float32)
        self.embed[ROWS] = 0
        self.filters = [(rng.standard_normal((w * DIM, FILTERS)) / np.sqrt(w * DIM)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = np.tile(rng.choice([-0.3, 0.3], FILTERS * len(WIDTHS)), TOP).astype(np.float32)
        self.base = np.float32(0)
        self.shift = np.zeros(len(_LANGS) + 1)

    def _vectors(self, ids: np.ndarray) -> np.ndarray:
        x = self.embed[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            x += self.embed[ids[:, k]]
        return x

    def _pooled(self, t: Texts, where: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pooled values (text, TOP, filter), with their rows if asked for, and the word vectors."""
        x = self._vectors(t.ids)
        rows = len(x)
        values = np.empty((rows, FILTERS * len(WIDTHS)), np.float32)
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            part = values[:, k * FILTERS : (k + 1) * FILTERS]
            part[:] = x @ f[:DIM]
            for j in range(1, w):
                part[: rows - j] += x[j:] @ f[j * DIM : (j + 1) * DIM]
        values += self.bias
        np.maximum(values, 0, out=values)
        values[t.first[1:] - 1] = 0  # windows that begin in the last padding
        starts = t.first[:-1]
        n = len(starts)
        top = np.empty((n, TOP, values.shape[1]), np.float32)
        at = np.zeros(top.shape, np.int64)
        text_of = np.repeat(np.arange(n), np.diff(t.first)) if where or TOP > 1 else None
        for k in range(TOP):
            top[:, k] = np.maximum.reduceat(values, starts, axis=0)
            if k + 1 == TOP and not where:
                break
            hits = values == top[text_of, k]
            hits &= values > 0
            r, c = np.nonzero(hits)
            if len(r):
                key = text_of[r] * values.shape[1] + c
                one = np.unique(key, return_index=True)[1]
                r, c = r[one], c[one]
                at[text_of[r], k, c] = r
                values[r, c] = 0
        return top, at, x

    def logits(self, t: Texts) -> np.ndarray:
        if len(t.first) < 2:
            return np.zeros(0)
        top, _, _ = self._pooled(t, False)
        return top.reshape(len(top), -1) @ self.out + self.base

    def fit(self, sets: list[Texts], labels: list[np.ndarray], epochs: int, rate: float = 0.05, seed: int = 11) -> None:
        """Adagrad on batches of texts; each of ``sets`` is one batch."""
        rng = np.random.Generator(np.random.PCG64(seed))
        grown = [np.full_like(v, 1e-3) for v in (self.embed, *self.filters, self.bias, self.out)]
        base_grown = 1e-3
        share = max(1e-3, float(np.concatenate(labels).mean()))
        self.base = np.float32(np.log(share / (1 - share)) if share < 1 else 0)
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            for b in rng.permutation(len(sets)):
                t, y = sets[b], labels[b]
                top, at, x = self._pooled(t, True)
                flat = top.reshape(len(top), -1)
                p = 1 / (1 + np.exp(-np.clip(flat @ self.out + self.base, -30, 30)))
                d = ((p - y) / len(y)).astype(np.float32)
                g_out = flat.T @ d + 1e-5 * self.out
                back = (d[:, None] * self.out).reshape(top.shape) * (top > 0)
                g_bias = back.sum(axis=(0, 1))
                text, _, c = np.nonzero(back)
                g, r = back[back != 0], at[back != 0]
                g_embed: dict[str, list[np.ndarray]] = {"id": [], "g": []}
                g_filters = []
                for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                    mine = c // FILTERS == k
                    gk, rk, ck = g[mine], r[mine], c[mine] % FILTERS
                    g_f = np.zeros_like(f)
                    for j in range(w):
                        rows = np.minimum(rk + j, len(x) - 1)
                        np.add.at(g_f[j * DIM : (j + 1) * DIM].T, ck, gk[:, None] * x[rows])
                        gx = gk[:, None] * f[j * DIM : (j + 1) * DIM].T[ck]
                        for e in range(len(PREFIXES)):
                            g_embed["id"].append(t.ids[rows, e])
                            g_embed["g"].append(gx)
                    g_filters.append(g_f)
                if g_embed["id"]:
                    ids, back_to = np.unique(np.concatenate(g_embed["id"]), return_inverse=True)
                    total = np.zeros((len(ids), DIM), np.float32)
                    np.add.at(total, back_to, np.concatenate(g_embed["g"]))
                    total[ids == ROWS] = 0
                    grown[0][ids] += total**2
                    self.embed[ids] -= step * total / np.sqrt(grown[0][ids])
                for v, gr, grad in zip((*self.filters, self.bias, self.out), grown[1:], (*g_filters, g_bias, g_out), strict=True):
                    gr += grad**2
                    v -= step * grad / np.sqrt(gr)
                base_grown += float(d.sum()) ** 2
                self.base -= np.float32(step * d.sum() / np.sqrt(base_grown))

    def calibrate(self, logits: np.ndarray, lang: np.ndarray, labels: np.ndarray, threshold: float) -> None:
        """For each guessed language the logit that parts the classes best; with fewer than ten rows of a class, that of all."""

        def best(z: np.ndarray, y: np.ndarray) -> float:
            order = np.argsort(-z, kind="stable")
            z, y = z[order], y[order]
            hits = np.cumsum(y)
            f = 1.25 * hits / (0.25 * y.sum() + np.arange(1, len(y) + 1))  # F-measure that weighs precision twice
            ends = np.append(z[1:] != z[:-1], True)
            k = int(np.argmax(np.where(ends, f, -1)))
            return float(z[k] if k + 1 == len(z) else (z[k] + z[k + 1]) / 2)

        everywhere = best(logits, labels) if 0 < labels.sum() < len(labels) else 0.0
        for i in range(len(self.shift)):
            mine = lang == i
            enough = min(labels[mine].sum(), (1 - labels[mine]).sum()) >= 10
            self.shift[i] = np.log(threshold / (1 - threshold)) - (best(logits[mine], labels[mine]) if enough else everywhere)

    def scores(self, t: Texts) -> np.ndarray:
        z = self.logits(t) + self.shift[t.lang]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def crc_remainder(column: str, n: int) -> F.Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def sample(docs: DataFrame, labels: DataFrame, label: str, may_learn: F.Column, max_positive: int, max_negative: int, max_bytes: int) -> list:
    """At most the stated numbers of labelled rows (text, label), least digests of their ids first, and of these, in
    that order, whole texts of at most ``max_bytes`` together (one at least)."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_y")).where(may_learn)
    digest = F.xxhash64("doc_id", F.lit(20240229))
    chosen = None
    for y, most in ((1, max_positive), (0, max_negative)):
        part = known.where(F.col("_y") == y).withColumn("_d", digest).orderBy("_d", "doc_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    rows = chosen.collect()
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["_y"], r["_d"]) for r in rows], "doc_id long, _y int, _d long")
    # The side to broadcast has at most max_positive + max_negative rows.
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    sizes = sorted((r["_d"], r["doc_id"], r["n"]) for r in found.groupBy("_d", "doc_id").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("n")).collect())
    total = np.cumsum([n for _, _, n in sizes])
    if len(sizes) and total[-1] > max_bytes:
        last = max(1, int(np.searchsorted(total, max_bytes, "right")))
        found = found.where(F.struct("_d", "doc_id") <= F.struct(F.lit(sizes[last - 1][0]).cast("long"), F.lit(sizes[last - 1][1]).cast("long")))
    found = found.collect()
    return sorted(((r["_d"], r["doc_id"], r["text"] or "", r["_y"]) for r in found))


def trained(docs: DataFrame, labels: DataFrame, label: str = "toxic", may_learn: F.Column | None = None, max_positive: int = 3000, max_negative: int = 6000, max_bytes: int = 64 << 20, epochs: int = 10, threshold: float = 0.7, seed: int = 7) -> Convolutional:
    rows = sample(docs, labels, label, F.lit(True) if may_learn is None else may_learn, max_positive, max_negative, max_bytes)
    model = Convolutional(seed)
    y_all = np.array([r[3] for r in rows], np.float64)
    if not len(y_all) or y_all.min() == y_all.max():
        model.out[:] = 0
        model.shift[:] = 20.0 if len(y_all) and y_all[0] else -20.0
        return model
    held = np.array([zlib.crc32(f"c{r[1]}".encode()) % 5 == 0 for r in rows])

    def sets(pick: np.ndarray, order: np.ndarray) -> tuple[list[Texts], list[np.ndarray]]:
        out, ys = [], []
        for lo in range(0, len(order), BATCH):
            part = [i for i in order[lo : lo + BATCH] if pick[i]]
            if part:
                (block,) = blocks(pa.array([rows[i][2] for i in part], pa.large_string()), lower=True, limit=1 << 62)
                out.append(features(block))
                ys.append(y_all[part])
        return out, ys

    order = np.random.Generator(np.random.PCG64(seed)).permutation(len(rows))
    model.fit(*sets(~held, order), epochs)
    inner, ys = sets(held, order)
    if inner:
        model.calibrate(np.concatenate([model.logits(t) for t in inner]), np.concatenate([t.lang for t in inner]), np.concatenate(ys), threshold)
    return model


def scored(docs: DataFrame, model: Convolutional, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of every whole text."""

    small_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.scores(features(b)) for b in blocks(batch.column("text"), lower=True, limit=1 << 18)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "score": pa.array(score, pa.float64()), "predicted": pa.array((score >= threshold).astype(np.int32), pa.int32())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
