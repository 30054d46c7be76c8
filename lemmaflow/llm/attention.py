"""A small causal self-attention model over subword ids, in numpy.

Subwords are the first merges of a public byte-level BPE. The hidden state of a
token is its embedding plus attention over the tokens before it, in windows of
``2 * STEP`` tokens that overlap by half: the second half of a window is scored
with the first half as context, so each token is scored once, with STEP to
``2 * STEP - 1`` tokens of context (fewer at a text's start), in batches under one
causal mask. The next token's class is a softmax over the hidden state and
the counted class given the last token; its place in the class comes from counted
pairs of tokens. Counts are those of the whole training corpus.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import tiktoken

from .text import Block

STEP, DIM, CLASSES = 8, 16, 32
#: Windows of a training batch.
BATCH = 256
LOG10 = np.float32(np.log10(np.e))


@lru_cache(maxsize=4)
def _ones(n: int) -> np.ndarray:
    """A column of ones: sums of short rows are much faster as products with it."""
    return np.ones((n, 1), np.float32)


def _tanh(x: np.ndarray) -> np.ndarray:
    """Hyperbolic tangents in place, by exponentials, which numpy is faster at; one beyond float32 gives 1."""
    x *= 2
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    np.divide(-2, x, out=x)
    x += 1
    return x


@lru_cache(maxsize=4)
def _lags(rows: int, columns: int) -> np.ndarray:
    """How far each of the last ``rows`` of ``columns`` places is behind each place; negative for places after it."""
    return columns - rows + np.arange(rows)[:, None] - np.arange(columns)[None, :]


@lru_cache(maxsize=2)
def subwords(vocabulary: str, pattern: str, size: int) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("first", pat_str=pattern, mergeable_ranks={k: v for k, v in ranks.items() if v < size}, special_tokens={})


@lru_cache(maxsize=2)
def begins_word(vocabulary: str, pattern: str, size: int) -> np.ndarray:
    """Which subwords begin with the space before a word; the end does too."""
    code = subwords(vocabulary, pattern, size)
    return np.array([code.decode_single_token_bytes(i)[:1] == b" " for i in range(size)] + [True])


@dataclass
class Encoded:
    """Subwords of a block's texts, each text with an end after it; where texts begin, one past included; the block's
    different words (sorted hashes) and, for each of its words in order, its place among them."""

    ids: np.ndarray
    first: np.ndarray
    words: np.ndarray
    of: np.ndarray


def encoded(block: Block, vocabulary: str, pattern: str, size: int) -> Encoded:
    """Subwords of a lower-cased block, ``size`` being the end; each different word is cut once."""
    code, begins = subwords(vocabulary, pattern, size), begins_word(vocabulary, pattern, size)
    words, back = np.unique(block.hashes, return_inverse=True)
    index = np.empty(len(words), np.int64)  # any place where the word stands
    index[back] = np.arange(len(back))
    starts, length = block.starts[index], block.ends[index] - block.starts[index] + 1
    cuts = np.cumsum(length)
    listed = np.arange(cuts[-1] if len(cuts) else 0)  # a blank, then the word's bytes
    listed = block.data[np.maximum(listed + np.repeat(starts - 1 - cuts + length, length), 0)]
    listed[cuts - length] = 32
    ids = code.encode_to_numpy(listed.tobytes().decode("utf-8", "replace"), disallowed_special=()).astype(np.uint16) if len(words) else np.zeros(0, np.uint16)
    at = np.append(np.flatnonzero(begins[ids]), len(ids))
    if len(at) != len(words) + 1:
        raise ValueError("subwords do not follow the words")
    lengths = np.append(np.diff(at), 1)
    ids = np.append(ids, np.uint16(size))
    n = block.n_words
    of = np.full(len(back) + block.n, len(words))
    of[np.arange(len(back)) + block.doc] = back
    each = lengths[of]
    ends = np.cumsum(each)
    flat = ids[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - each - at[of], each)]
    return Encoded(flat, np.append(0, ends[np.cumsum(n + 1) - 1]), words, back)


def padded(ids: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and targets of texts, each text filled up with ends to a multiple of ``width``; where inputs stand, and where texts begin.

    Text t has inputs ``first[t]`` to ``first[t + 1] - 1``; the target of an input is the next id."""
    n = np.diff(first)
    size = -(-n // width) * width
    begin = np.cumsum(size) - size
    where = np.arange(len(ids) - 1) - np.repeat(first[:-1] - begin, n)
    asks, target = np.full((2, int(size.sum())), ids[0])
    asks[where], target[where] = ids[:-1], ids[1:]
    return asks, target, where, begin[n > 0]


@dataclass
class Attention:
    """Counted tables and trained weights; ``end`` is the last id."""

    pair: np.ndarray  # log P(next | last), float32
    to_class: np.ndarray  # log P(class of next | last), float32
    classes: np.ndarray
    mixture: float = 0.5
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def from_counts(cls, counts: np.ndarray, seed: int = 3) -> Attention:
        size = len(counts)
        seen = counts.sum(axis=0) + 0.5
        unigram = seen / seen.sum()
        total, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
        pair = (np.maximum(counts - 0.5, 0) + (0.5 * kinds + 1e-3) * unigram) / (total + 1e-3)
        pair /= pair.sum(axis=1, keepdims=True)
        classes = _clustered(pair, unigram, seed)
        by_class = np.zeros((size, CLASSES))
        np.add.at(by_class.T, classes, pair.T)
        rng = np.random.Generator(np.random.PCG64(seed))
        normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        weights = {"embed": (rng.standard_normal((size, DIM)) * 0.3).astype(np.float32), "state": (rng.standard_normal((size, DIM)) * 0.3).astype(np.float32), "q": normal(DIM, DIM), "k": normal(DIM, DIM), "v": normal(DIM, DIM), "lag": np.zeros(2 * STEP, np.float32), "out": np.zeros((DIM, CLASSES), np.float32)}
        return cls(np.log(pair).astype(np.float32), np.log(np.maximum(by_class, 1e-30)).astype(np.float32), classes, 0.5, weights)

    def _tables(self) -> tuple[np.ndarray, ...]:
        """Of each subword: queries (scaled), keys, values, states; numpy gathers from four tables in half the time it needs along the second axis of one."""
        w = self.weights
        e = w["embed"]
        return e @ (w["q"] / np.float32(np.sqrt(DIM))), e @ w["k"], e @ w["v"], w["state"]

    def _logits(self, q: np.ndarray, k: np.ndarray, v: np.ndarray, state: np.ndarray, alone: np.ndarray | None = None) -> tuple:
        """Attention of windows: queries q are the last of the places that have keys k and values v; ``alone`` windows see only places with queries."""
        wide = k.shape[1]
        lag = _lags(q.shape[1], wide)
        scores = q @ k.transpose(0, 2, 1)
        scores += np.where(lag >= 0, self.weights["lag"][lag], np.float32(-1e9))
        if alone is not None:
            scores[alone, :, : wide - q.shape[1]] = -1e9
        np.exp(scores, out=scores)
        flat = scores.reshape(-1, wide)
        flat /= flat @ _ones(wide)
        mixed = (scores @ v).reshape(-1, DIM)
        mixed += state
        hidden = _tanh(mixed)
        return scores, hidden, hidden @ self.weights["out"]

    def _exp(self, logits: np.ndarray) -> np.ndarray:
        """The exponentials in place; hidden states are at most 1, so only large weights can take a logit beyond what exp holds."""
        if np.abs(self.weights["out"]).sum(axis=0).max() > 80:
            np.minimum(logits, 80, out=logits)
        return np.exp(logits, out=logits)

    def log_probabilities(self, ids: np.ndarray, first: np.ndarray, batch: int = 512) -> np.ndarray:
        """Natural logarithm of each target's probability, ``ids[1:]`` in order.

        Windows of ``2 * STEP`` places overlap by half, as views; the second half is scored."""
        asks, target, where, begin = padded(ids, first, STEP)
        asks = np.append(np.full(STEP, ids[0]), asks)
        alone = np.zeros(len(target) // STEP, bool)
        alone[begin // STEP] = True
        out = np.empty(len(target), np.float32)
        rows = np.arange(batch * STEP) * CLASSES
        tables = self._tables()
        pair, size = self.pair.reshape(-1), self.pair.shape[1]

        def overlapping(x: np.ndarray) -> np.ndarray:
            return np.lib.stride_tricks.as_strided(x, (len(x) // STEP - 1, 2 * STEP, DIM), (STEP * DIM * x.itemsize, DIM * x.itemsize, x.itemsize), writeable=False)

        for lo in range(0, len(alone), batch):
            here = asks[lo * STEP : (lo + batch + 1) * STEP]
            last, goal = here[STEP:], target[lo * STEP : (lo + batch) * STEP]
            q, k, v, state = (table.take(x, axis=0) for table, x in zip(tables, (last, here, here, last), strict=True))
            *_, logits = self._logits(q.reshape(-1, STEP, DIM), overlapping(k), overlapping(v), state, alone[lo : lo + batch])
            told = pair.take(last * size + goal)
            told += logits.reshape(-1).take(rows[: len(goal)] + self.classes.take(goal))
            logits += self.to_class.take(last, axis=0)
            self._exp(logits)
            told -= np.log((logits @ _ones(CLASSES))[:, 0])
            out[lo * STEP : lo * STEP + len(goal)] = told
        return out[where]

    def gradients(self, here: np.ndarray, target: np.ndarray, real: np.ndarray, whole: bool = True) -> tuple[np.ndarray, int, dict[str, np.ndarray]]:
        """Probabilities of the targets' classes, number of targets and summed gradients of the class log loss over windows (rows) of inputs, targets and whether they are real;
        if not ``whole``, of the weights behind attention only."""
        w = self.weights
        shape = (*here.shape, DIM)
        last, real = here.reshape(-1), real.reshape(-1)
        q, k, v, state = (table.take(last, axis=0) for table in self._tables())
        q, k, v = q.reshape(shape), k.reshape(shape), v.reshape(shape)
        attn, hidden, logits = self._logits(q, k, v, state)
        at = np.arange(0, logits.size, CLASSES) + self.classes.take(target.reshape(-1))
        logits += self.to_class.take(last, axis=0)
        p = self._exp(logits)
        p /= p @ _ones(CLASSES)
        flat = p.reshape(-1)
        told = flat.take(at)
        flat[at] = told - 1
        p[~real] = 0
        g = {"out": hidden.T @ p}
        np.multiply(hidden, hidden, out=hidden)
        np.subtract(1, hidden, out=hidden)
        d_mixed = p @ w["out"].T
        d_mixed *= hidden
        cells = np.add.outer(last * DIM, np.arange(DIM)).reshape(-1)

        def by_subword(x: np.ndarray) -> np.ndarray:
            return np.bincount(cells, x.reshape(-1), w["embed"].size).reshape(-1, DIM).astype(np.float32)

        g["state"] = by_subword(d_mixed)
        if whole:
            d_mixed = d_mixed.reshape(shape)
            d_scores = d_mixed @ v.transpose(0, 2, 1)
            flat, seen = d_scores.reshape(len(last), -1), attn.reshape(len(last), -1)
            flat -= (flat * seen) @ _ones(here.shape[1])
            flat *= seen
            lag = _lags(here.shape[1], here.shape[1])
            g["lag"] = np.bincount(lag[lag >= 0], d_scores.sum(axis=0)[lag >= 0], 2 * STEP).astype(np.float32)
            g["embed"] = np.zeros_like(w["embed"])
            for name, d in (("q", d_scores @ k), ("k", d_scores.transpose(0, 2, 1) @ q), ("v", attn.transpose(0, 2, 1) @ d_mixed)):
                summed = by_subword(d)
                if name == "q":
                    summed /= np.float32(np.sqrt(DIM))
                g[name] = w["embed"].T @ summed
                g["embed"] += summed @ w[name].T
        return told[real], int(real.sum()), g

    def train(self, ids: np.ndarray, first: np.ndarray, batch: int = BATCH, rate: float = 0.01, seed: int = 1) -> int:
        """One pass of Adam over the windows of some texts, which cover all tokens, in random order; the number of targets.

        Every window moves all weights, those of attention too."""
        asks, target, where, _ = padded(ids, first, 2 * STEP)
        real = np.zeros(len(asks), bool)
        real[where] = True
        asks, target, real = (x.reshape(-1, 2 * STEP) for x in (asks, target, real))
        order = np.random.Generator(np.random.PCG64(seed)).permutation(len(asks))
        # All weights stand in one array, which the steps change in place.
        shapes = {k: v.shape for k, v in self.weights.items()}
        flat = np.concatenate([v.reshape(-1) for v in self.weights.values()])
        parts = np.split(flat, np.cumsum([v.size for v in self.weights.values()])[:-1])
        self.weights = {k: v.reshape(shape) for (k, shape), v in zip(shapes.items(), parts, strict=True)}
        m, s = np.zeros((2, len(flat)), np.float32)
        seen, steps = 0, max(1, -(-len(order) // batch))
        for t in range(steps):
            pick = order[t * batch : (t + 1) * batch]
            if not len(pick):
                break
            _, n_real, g = self.gradients(asks[pick], target[pick], real[pick])
            seen += n_real
            now = rate * (1 - 0.9 * t / steps) * min(1, (t + 1) / 10)
            # Adam with 0.9 and 0.99: a tenth of the gradient goes into m, and its square is the hundredth that goes into s.
            step = np.concatenate([g[k].reshape(-1) for k in shapes])
            step *= np.float32(0.1 / max(1, n_real))
            m *= np.float32(0.9)
            m += step
            np.multiply(step, step, out=step)
            s *= np.float32(0.99)
            s += step
            unbiased = np.sqrt(1 - 0.99 ** (t + 1))
            np.sqrt(s, out=step)
            step += np.float32(1e-6 * unbiased)
            np.divide(m, step, out=step)
            step *= np.float32(now * unbiased / (1 - 0.9 ** (t + 1)))
            flat -= step
        return seen


def _clustered(pair: np.ndarray, unigram: np.ndarray, seed: int) -> np.ndarray:
    """Classes of tokens by what stands before them: k-means on weighted directions of P(token | last)."""
    back = np.sqrt(np.maximum(pair * unigram[:, None] / unigram[None, :], 0)).T
    u, s, _ = np.linalg.svd(back - back.mean(axis=0), full_matrices=False)
    x = u[:, :24] * s[:24]
    rng = np.random.Generator(np.random.PCG64(seed))
    centers = x[rng.choice(len(x), CLASSES, replace=False, p=unigram / unigram.sum())]
    out = np.zeros(len(x), np.int64)
    for _ in range(25):
        far = (x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1)
        out = far.argmin(axis=1)
        for c in range(CLASSES):
            mine = out == c
            if mine.any():
                centers[c] = np.average(x[mine], axis=0, weights=unigram[mine])
    return out
