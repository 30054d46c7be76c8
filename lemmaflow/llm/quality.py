"""Quality rules by host.

Each text gets counts and rule failures. Failures are summed by host, each
host's failure rate is shrunk by a beta prior that is fitted to all hosts by
moments, and a host whose shrunk rate exceeds ``host_limit`` is bad. The verdict
comes back to the documents: all documents of a bad host go, and one that fails the
base rules goes everywhere. With ``spare_clean`` the host's verdict is held only
against those of its documents that fail a rule themselves.

Edge cases: a null text counts as empty (no words, fails the base); a null host
is a host of its own; repeated rows each count and each get a row; an empty table
gives an empty table; a column whose name clashes with one that is made here is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import small_batches, written
from .text import Block, blocks, duplicated, mix

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
RULES = ("short", "repeats", "symbols", "lines", "lengths")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def measures(block: Block) -> dict[str, np.ndarray]:
    """The counts of each text in a block, over the whole text."""
    data, n = block.data, block.n
    word_bytes = block._word & ((data & 0xC0) != 0x80)
    out = {"n_words": block.n_words, "word_chars": block.per_text(word_bytes), "n_symbols": block.per_text(_SYMBOL[data])}
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([block.offsets[:-1], breaks + 1])
    owner = np.concatenate([np.arange(n), np.searchsorted(block.offsets, breaks, "right") - 1])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    ends = np.append(starts[1:] - 1, len(data))
    last = np.append(owner[1:] != owner[:-1], True)
    ends[last] = block.offsets[owner[last] + 1]
    full = np.searchsorted(block.starts, ends) > np.searchsorted(block.starts, starts)
    starts, ends, owner = starts[full], ends[full], owner[full]
    keys = mix(block.span_hash(starts, ends) + mix(owner.astype(np.uint64) + np.uint64(1)))
    firsts = np.unique(keys, return_index=True)[1]
    out["n_lines"] = np.bincount(owner, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(owner[firsts], minlength=n)
    at, hashes = block.windows(3)
    twice = at[duplicated(mix(hashes + mix(block.doc[at].astype(np.uint64) + np.uint64(1))))]
    cover = np.zeros(len(block.starts) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 3, -1)
    out["n_repeat_words"] = np.bincount(block.doc[np.cumsum(cover)[:-1] > 0], minlength=n)
    return out


def measured(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with the counts as long columns."""
    base = docs.drop(*METRICS)
    schema = T.StructType([f for f in base.schema.fields if keep_text or f.name != text] + [T.StructField(m, T.LongType()) for m in METRICS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measures(b) for b in blocks(batch.column(text))]
            cols = {f: batch.column(f) for f in batch.schema.names if keep_text or f != text}
            for m in METRICS:
                cols[m] = pa.array(np.concatenate([p[m] for p in parts]) if parts else [], pa.int64())
            yield pa.RecordBatch.from_pydict(cols)

    return base.mapInArrow(run, schema)


def failures() -> dict[str, F.Column]:
    """The rules; each is true where a text fails."""
    words = F.col("n_words")
    return {
        "short": words < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * words,
        "symbols": 10 * F.col("n_symbols") > words,
        "lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "lengths": (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 15 * words),
    }


def host_verdicts(counts: DataFrame, host: str = "source", host_limit: float = 0.5) -> DataFrame:
    """Per host: n_docs, n_failed, the shrunk ``rate`` and ``host_bad``.

    The prior's mean and strength come from the mean and variance of the hosts'
    rates (method of moments); with no variance the strength is that of
    ``n_docs`` on average. Only one row of moments meets the host table, as a
    scalar subquery."""
    failed = F.greatest(*[f.cast("long") for f in failures().values()])
    by_host = written(counts.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(failed).alias("n_failed"), *[F.sum(f.cast("long")).alias(f"n_{k}") for k, f in failures().items()]), "hosts")
    rate = F.col("n_failed") / F.col("n_docs")
    row = by_host.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"), F.avg("n_docs").alias("n")).first()
    mean = min(max(row["m"] or 0.0, 1e-6), 1 - 1e-6)
    room = mean * (1 - mean)
    strength = min(max(room / row["v"] - 1, 1.0), 1e6) if row["v"] else float(max(row["n"] or 1.0, 1.0))
    shrunk = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    return by_host.withColumn("rate", shrunk).withColumn("host_bad", F.col("rate") > host_limit)


def with_verdicts(counts: DataFrame, hosts: DataFrame, host: str = "source", spare_clean: bool = False) -> DataFrame:
    """Adds base_failed, n_failed_rules and kept: false if base_failed, else the host's verdict."""
    rules = failures()
    failed = sum((F.coalesce(f, F.lit(False)).cast("int") for f in rules.values()), F.lit(0))
    bad = hosts.where("host_bad").select(F.col(host).alias("_host"), F.lit(True).alias("_bad"))
    base = counts.drop("base_failed", "n_failed_rules", "kept")
    joined = base.join(bad, base[host].eqNullSafe(bad["_host"]), "left").drop("_host")
    base_failed = rules["short"] | rules["repeats"]
    by_host = F.coalesce("_bad", F.lit(False))
    verdict = ~base_failed & ~(by_host & (F.col("n_failed_rules") > 0) if spare_clean else by_host)
    return joined.withColumn("base_failed", base_failed).withColumn("n_failed_rules", failed).withColumn("kept", verdict).drop("_bad")


def quality_rules(docs: DataFrame, host: str = "source", host_limit: float = 0.5, keep_text: bool = True, spare_clean: bool = False) -> DataFrame:
    """``docs`` with counts, base_failed, n_failed_rules and kept.

    Without the text, the counts are written once and read for both the host
    rates and the rows. With it they are made twice, for texts are not written."""
    small_batches(docs.sparkSession)
    light = measured(docs.select(host, "text"), keep_text=False) if keep_text else written(measured(docs, keep_text=False), "counts")
    hosts = host_verdicts(light, host, host_limit)
    return with_verdicts(measured(docs) if keep_text else light, hosts, host, spare_clean)
