"""N-gram Jaccard join in metric space.

Jaccard distance 1 - J is a metric, and a pair links within ``eps = 1 - t``.
Distances between unrelated documents all equal 1, so whole documents as pivots
would put nearly all rows into one region. The join therefore descends:

1. Documents with equal shingle sets (distance 0) fall together into one point.
2. Pivots of the first level are single shingles: a point's distance to pivot
   ``{s}`` is ``1 - 1/n`` if it holds s, else 1. All pivots that it holds tie, and
   one order of all shingles breaks the tie; the window around that cell is the
   first ``n - ceil(t n) + 1`` pivots of its own. Two points within eps have a
   common pivot in their windows, so each linked pair meets in a region. Any one
   order is exact; here it is by hash, with shingles of crowded regions last, for
   which the lower hashes of all documents are counted once. Documents that a region of
   more than ``DENSE`` still holds meet each other by an order of their own instead,
   the rarest among them first, and such a region, which holds no others, is left out.
3. In a region the pivots of the next levels are documents. Every member is first held
   against one of them; those within eps link to it and collapse into its component.
4. Inside a region distances are bounded from below by a histogram of the shingle
   hashes: pooling shingles only moves sets closer, so the difference of histograms is
   a contraction of the symmetric difference, a metric itself, in which all that links
   to a set of n shingles lies within ``r = n (1 - t) / t``. What is still apart joins
   recursively there: a region of more than ``PART`` members is cut into the Voronoi
   cells of about ``CELLS`` of its documents, and a member replicates into each cell
   whose pivot is at most ``2 r`` farther than its nearest (the triangle inequality),
   but for members of the region's largest component, which need no comparing with each
   other. Cells are cut again until they are small. Where all distances are alike and
   the windows would cover most cells, the region is taken in blocks of ``PART`` owners.

Whatever passes the bound is verified on the whole texts. A pass offers each point at
most ``k`` candidates in a cell, of as many other components as it can, nearest first.
Components then merge, which leaves fewer to offer, and ``k`` grows until nobody holds
candidates back, so no link is lost and a pass's output stays linear in the region.

Edge cases: null and empty texts, or texts without words, have empty sets and
link with nothing; texts under k words have one shingle, the whole sequence;
doc_id is the key of a point, so rows repeated with one doc_id are one point;
rows with a null doc_id keep their count and get a null component; an empty table
gives an empty table; only doc_id and the text are read, so other columns cannot
clash.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .ranks import most_frequent
from .store import written
from .text import Block, blocks, mix, window_hash

BINS = 256
#: Members of a cell, cells made of a region at once, the rows a cut may make of one, and the cuts one after another.
PART, CELLS, GROWTH, TURNS = 500, 32, 3, 8
#: Candidates of a member that a cell offers in the first pass.
MOST = 4
#: A shingle in more windows than this goes last in the order, up to so many shingles.
CROWD, MOST_CROWDED = 32, 1 << 20
#: Members of a region beyond which they are dealt anew, by the order of their own.
DENSE = 64


def shingle_sets(block: Block, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text in a block."""
    _, hashes = block.windows(k)
    n = block.n_words
    at = np.concatenate([[0], np.cumsum(np.maximum(n - k + 1, 0))])
    for i in range(block.n):
        if n[i] >= k:
            yield np.unique(hashes[at[i] : at[i + 1]])
        elif n[i]:
            yield window_hash(block.hashes, block.first_word[i : i + 1], int(n[i]))
        else:
            yield hashes[:0]


def _window(size: int, num: int, den: int) -> int:
    return size - -(-num * size // den) + 1


def crowded(docs: DataFrame, k: int, num: int, den: int) -> np.ndarray:
    """Sorted hashes of the shingles that crowd the windows; an order's bounded part, on which no result depends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), lower=True):
                low = [s[: _window(len(s), num, den) * 3 // 2 + 4] for s in shingle_sets(block, k)]
                keys, counts = np.unique(np.concatenate(low), return_counts=True)
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys.view(np.int64)), "c": pa.array(counts)})

    counted = written(docs.select("text").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).where(F.col("c") > CROWD), "crowded")
    found = most_frequent(counted, MOST_CROWDED).select("key").toArrow().column("key").to_numpy()
    return np.sort(found.view(np.uint64))


def _first(s: np.ndarray, last: np.ndarray, p: int) -> np.ndarray:
    """The first p of a sorted set in the order that puts ``last`` behind the others."""
    if not len(last):
        return s[:p]
    for part in (s[: 2 * p + 16], s):
        late = last[np.minimum(np.searchsorted(last, part), len(last) - 1)] == part
        early = part[~late]
        if len(early) >= p:
            return early[:p]
    return np.concatenate([early, part[late]])[:p]


def points(docs: DataFrame, last: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    """Per document: n, two signatures of the set, the pivots of its window and its histogram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, pivots, pooled = [], [], [], [], []
            for block in blocks(batch.column("text"), lower=True):
                for s in shingle_sets(block, k):
                    size = len(s)
                    n.append(size)
                    one.append(int(mix(s).sum(dtype=np.uint64)))
                    two.append(int(mix(s * np.uint64(3) + np.uint64(7)).sum(dtype=np.uint64)))
                    pivots.append(_first(s, last, _window(size, num, den) if size else 0).view(np.int64))
                    pooled.append(np.minimum(np.bincount((s >> np.uint64(7)).astype(np.int64) % BINS, minlength=BINS), 255).astype(np.uint8).tobytes())
            ends = np.cumsum([0, *map(len, pivots)])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").cast(pa.int64()),
                    "n": pa.array(n, pa.int64()),
                    "sig1": pa.array(np.array(one, np.uint64).view(np.int64)),
                    "sig2": pa.array(np.array(two, np.uint64).view(np.int64)),
                    "pivots": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(pivots) if pivots else [], pa.int64())),
                    "pooled": pa.array(pooled, pa.binary()),
                }
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sig1 long, sig2 long, pivots array<long>, pooled binary")


def _regions(rows: DataFrame) -> DataFrame:
    """(node, key) rows of shingles in two windows or more, with cnt, the members, and one of them as pivot.

    Near copies share most of their windows; of shingles with the same members, told by sums of two hashes, one is kept."""
    sums = [F.sum(F.shiftright(F.xxhash64("node", F.lit(i)), 32)).alias(f"s{i}") for i in (1, 2)]
    found = rows.groupBy("key").agg(F.count(F.lit(1)).alias("cnt"), F.min("node").alias("pivot"), *sums).where("cnt > 1")
    # A written count has a shuffle of its own in the join, so a crowded key's rows can be split there.
    one = written(found.groupBy("cnt", "pivot", "s1", "s2").agg(F.min("key").alias("key")).select("key", "cnt", "pivot"), "found")
    return written(rows.join(one, "key").select("key", "node", "cnt", "pivot"), "regions")


def _dealt_anew(regions: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The regions without those of more than ``DENSE`` members; windows of these members under a second order, the
    rarest among them first, make up for all their pairs."""
    members = written(regions.where(F.col("cnt") > DENSE).select(F.col("node").alias("doc_id")).distinct(), "dense")
    if members.isEmpty():
        return regions
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(members, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for block in blocks(batch.column("text"), lower=True) for s in shingle_sets(block, k)]
            listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets) if sets else [], pa.int64()))
            yield pa.RecordBatch.from_pydict({"node": batch.column("doc_id"), "shingles": listed})

    held = written(texts.mapInArrow(run, "node long, shingles array<long>").withColumn("row", F.monotonically_increasing_id()), "shingles")
    each = held.select("row", "node", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("key"))
    often = written(each.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "often")
    # Shingles of one row alone come first in its window and make no region: only their number counts.
    ranked = each.join(often, "key").groupBy("row", "node", "n").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("shared"))
    left = (_window_column(num, den) - (F.col("n") - F.size("shared"))).cast("int")
    second = ranked.withColumn("left", left).where("left > 0").select("node", F.explode(F.slice("shared", F.lit(1), F.col("left"))).alias("x"))
    return regions.where(F.col("cnt") <= DENSE).unionByName(_regions(second.select("node", F.xxhash64("x.key", F.lit(2)).alias("key"))))


def _window_column(num: int, den: int) -> F.Column:
    return F.col("n") - F.call_function("div", F.col("n") * num + (den - 1), F.lit(den).cast("long")) + 1


def _near(size: np.ndarray, apart: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets with sizes summing to ``size`` and a difference of at least ``apart`` can link."""
    return den * (size - apart) >= num * (size + apart)


def _pooled(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16)


def _can_link(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) pairs that the pooled distance does not exclude."""
    left = nodes.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("pooled").alias("pa"))
    right = nodes.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("pooled").alias("pb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apart = np.abs(_pooled(batch.column("pa")) - _pooled(batch.column("pb"))).sum(axis=1, dtype=np.int64)
                size = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
                kept = pa.array(_near(size, apart, num, den))
                yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}).filter(kept)

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b) pairs whose whole texts link."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")  # with its size known, Catalyst broadcasts it only if small
    texts = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi"), "texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(column: pa.Array) -> Iterator[np.ndarray]:
            for block in blocks(column, lower=True):
                yield from shingle_sets(block, k)

        for batch in batches:
            kept = []
            for x, y in zip(sets(batch.column("ta")), sets(batch.column("tb")), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(common > 0 and den * common >= num * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(kept, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _described(rows: DataFrame) -> DataFrame:
    """Rows of regions that hold a pair to test, with cnt, the members, and ``home``, the region's largest component."""
    by = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("guest")).cast("long")).alias("owners"))
    largest = F.max_by("comp", F.struct("n", "comp")).alias("home")
    per = by.groupBy("key").agg(F.sum("n").alias("cnt"), F.count(F.lit(1)).alias("comps"), F.sum("owners").alias("owners"), largest).where("comps > 1 and owners > 0")
    return rows.join(written(per.select("key", "cnt", "home"), "spread"), "key")


def _apart(regions: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of regions that span more than one component and hold more than the pivot and one other."""
    named = regions.where("cnt > 2").select("key", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rows = written(named.select("key", "node", "comp", F.lit(False).alias("guest")), "members")
    return written(_described(rows), "apart")


def _reach(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """The farthest, in the pooled metric, that a set linked to one of ``n`` shingles can be: n (1 - t) / t."""
    return n * (den - num) / num


def _voronoi(rows: DataFrame, nodes: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """Each region's rows dealt to the cells of some of its members: the cell of the nearest, and as guests all cells
    that the triangle inequality leaves. Members of the home component, never compared with each other, don't visit."""
    shares = F.greatest(F.lit(1), F.floor(F.col("cnt") / CELLS))
    chosen = rows.where(F.pmod(F.xxhash64("node", F.lit(turn)), shares) == 0).select("key", "node").distinct()
    light = nodes.select(F.col("doc_id").alias("node"), "n", "pooled")
    pivots = chosen.join(light, "node").groupBy("key").agg(F.collect_list(F.struct("node", "pooled")).alias("pivots"))  # about CELLS of each region
    both = rows.join(light, "node").join(written(pivots, "pivots"), "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, home = batch.column("key").to_numpy(), (batch.column("comp").to_numpy() == batch.column("home").to_numpy())
            guest, reach = batch.column("guest").to_numpy(zero_copy_only=False), _reach(batch.column("n").to_numpy(), num, den)
            pooled = _pooled(batch.column("pooled")) if batch.num_rows else None
            at, cell, visits = [], [], []
            for k in np.unique(key):
                mine = np.flatnonzero(key == k)
                listed = batch.column("pivots")[int(mine[0])].as_py()
                if not listed:
                    at.append(mine), cell.append(np.full(len(mine), -1)), visits.append(guest[mine])
                    continue
                centres = np.frombuffer(b"".join(p["pooled"] for p in listed), np.uint8).reshape(-1, BINS).astype(np.int16)
                far = np.stack([np.abs(pooled[mine] - c).sum(axis=1, dtype=np.int64) for c in centres], axis=1)
                near = far.argmin(axis=1)
                inside = ~home[mine, None] & (far - far.min(axis=1, keepdims=True) <= 2 * reach[mine, None])
                inside[np.arange(len(mine)), near] = True
                i, j = np.nonzero(inside)
                at.append(mine[i]), cell.append(np.array([p["node"] for p in listed])[j]), visits.append(guest[mine[i]] | (j != near[i]))
            take = pa.array(np.concatenate(at) if at else [], pa.int64())
            cols = {c: batch.column(c).take(take) for c in ("key", "node", "comp", "cnt")}
            yield pa.RecordBatch.from_pydict({**cols, "cell": pa.array(np.concatenate(cell) if cell else [], pa.int64()), "guest": pa.array(np.concatenate(visits) if visits else [], pa.bool_())})

    dealt = both.select("key", "node", "comp", "guest", "cnt", "home", "n", "pooled", "pivots")
    return dealt.mapInArrow(run, "key long, node long, comp long, cnt long, cell long, guest boolean")


def _split(apart: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(key, node, comp, part, own) of regions cut, again and again, into cells of at most ``PART`` members.

    Where windows leave members in most cells, for their distances to all pivots are alike, the region
    is taken in blocks of ``PART`` owners, each with all members that could link to them."""
    cols = ("key", "node", "comp", "guest")
    done = [apart.where(F.col("cnt") <= PART)]
    rows, stuck = written(apart.where(F.col("cnt") > PART), "wide"), []
    for turn in range(TURNS):
        if rows.isEmpty():
            break
        cut = written(_voronoi(rows, nodes, turn, num, den), "cells")
        grown = written(cut.groupBy("key").agg(F.count(F.lit(1)).alias("made"), F.first("cnt").alias("cnt")).where(F.col("made") > GROWTH * F.col("cnt")).select("key"), "grown")
        stuck.append(rows.join(grown, "key", "left_semi"))
        good = cut.join(grown, "key", "left_anti").withColumn("key", F.xxhash64("key", "cell"))
        rows = written(_described(written(good.select(*cols), "cut")), "rows")
        done.append(rows.where(F.col("cnt") <= PART))
        rows = rows.where(F.col("cnt") > PART)
    stuck.append(rows)
    whole = functools.reduce(DataFrame.unionByName, [x.select("key", "node", "comp", "guest") for x in done])
    parts = F.ceil(F.col("cnt") / F.lit(PART)).cast("int")
    own = F.pmod(F.xxhash64("node"), parts.cast("long")).cast("int")
    visits = F.when(F.col("comp") != F.col("home"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))
    blocks_ = functools.reduce(DataFrame.unionByName, stuck).select("key", "node", "comp", "guest", own.alias("_own"), F.explode(visits).alias("part"))
    return whole.withColumn("part", F.lit(0)).unionByName(blocks_.withColumn("guest", F.col("guest") | (F.col("part") != F.col("_own"))).drop("_own"))


def _candidates(cells: DataFrame, nodes: DataFrame, most: int, num: int, den: int) -> DataFrame:
    """(a, b, held) for members of one cell in different components, at least one of them no guest: of each a the ``most`` first,
    the nearest of each component before its others; held: a has more than these, told once a cell."""
    cols = ("key", "part", "node", "comp", "guest", "n")

    def pairs(at: dict[str, np.ndarray], pooled: np.ndarray) -> Iterator[tuple[int, int, bool]]:
        own = np.flatnonzero(~at["guest"])
        if len(np.unique(at["comp"])) < 2:
            return
        told = False
        for i in own:
            apart = np.abs(pooled - pooled[i]).sum(axis=1, dtype=np.int64)
            ok = _near(at["n"] + at["n"][i], apart, num, den) & (at["comp"] != at["comp"][i])
            found = np.flatnonzero(ok)
            if len(found):
                found = found[np.lexsort((apart[found], at["comp"][found]))]
                comp = at["comp"][found]
                starts = np.flatnonzero(np.append(True, comp[1:] != comp[:-1]))
                rank = np.arange(len(found)) - np.repeat(starts, np.diff(np.append(starts, len(found))))
                found = found[np.lexsort((apart[found], rank))]
                for j in found[:most]:
                    yield int(at["node"][i]), int(at["node"][j]), False
                if len(found) > most and not told:
                    told = True
                    yield int(at["node"][i]), int(at["node"][found[most]]), True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def out(t: pa.Table) -> pa.RecordBatch:
            at = {c: t.column(c).to_numpy() for c in cols}
            at["guest"] = at["guest"].astype(bool)
            pooled = _pooled(t.column("pooled").combine_chunks())
            cut = np.flatnonzero((at["key"][1:] != at["key"][:-1]) | (at["part"][1:] != at["part"][:-1])) + 1
            rows = [r for lo, hi in zip([0, *cut], [*cut, t.num_rows], strict=True) for r in pairs({c: v[lo:hi] for c, v in at.items()}, pooled[lo:hi])]
            return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], kind) for i, (n, kind) in enumerate((("a", pa.int64()), ("b", pa.int64()), ("held", pa.bool_())))})

        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            key, part = now.column("key").to_numpy(), now.column("part").to_numpy()
            cut = int(np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))[-1])
            rest = now.slice(cut)
            if cut:
                yield out(now.slice(0, cut))
        if rest is not None:
            yield out(rest)

    dealt = cells.join(nodes.select(F.col("doc_id").alias("node"), "n", "pooled"), "node").select(*cols, "pooled").repartition("key", "part").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(run, "a long, b long, held boolean")


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id, the least doc_id reachable by links.

    Two documents link when ``den * intersection >= num * union`` of their k-word shingle sets."""
    all_points = written(points(docs, crowded(docs, k, num, den), k, num, den), "points")
    light = all_points.select("doc_id", "n", "sig1", "sig2")
    same = written(light.where("n > 0 and doc_id is not null").groupBy("n", "sig1", "sig2").agg(F.min("doc_id").alias("node")), "same")
    extra = written(light.join(same, ["n", "sig1", "sig2"]).where("doc_id != node").select("doc_id").distinct(), "extra")
    points_of = all_points.where("n > 0 and doc_id is not null").join(extra, "doc_id", "left_anti")
    nodes = written(points_of.select("doc_id", "n", "pooled"), "nodes")
    rows = points_of.select(F.col("doc_id").alias("node"), F.explode("pivots").alias("key"))
    regions = _dealt_anew(_regions(rows), docs, k, num, den)
    stars = regions.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    tested = written(_can_link(stars, nodes, num, den), "pairs")
    links = written(_verified(tested, docs, k, num, den), "links")
    comps = connected_components(links)
    most = MOST
    while True:
        cells = written(_split(_apart(regions, comps), nodes, num, den), "split")
        offered = written(_candidates(cells, nodes, most, num, den), "offered")
        # Written, or the anti-join would move below the aggregate and take every pair once for each of its cells.
        pairs = written(offered.where("not held").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "distinct")
        pairs = written(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            more = written(_verified(pairs, docs, k, num, den), "links")
            if not more.isEmpty():
                links = links.union(more)
                comps = connected_components(links)
            tested = tested.union(pairs)
        if offered.where("held").isEmpty():
            break
        most *= 64
    grouped = light.join(same, ["n", "sig1", "sig2"], "left").join(comps.withColumnRenamed("comp", "_comp"), "node", "left")
    return grouped.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("_comp", "node", "doc_id")).alias("component_id"))
