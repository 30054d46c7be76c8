"""Proportional stratified interleaving into shards; DataFrame functions only.

Rows are shuffled by a seeded digest of their id, text and size and ranked within
their stratum.
Rank r of n gets the fractional rank ``(r - u) / n`` with a fixed ``u`` in (0, 1)
for each stratum, so that strata of one size don't fall together. Sorted by it,
every stretch has the mixture of the whole, and cuts at equal counts give shards
whose row counts differ by one at most: the law is ``rows``.

Both ranks are exact and spread (`ranks`): a stratum with a third of all rows is
counted by buckets of its shuffle order and sorted bucket by bucket. Equal rows, which
no order tells apart, are counted first and unfolded once they have their ranks.

Edge cases: a null stratum is one of its own; a null text has size 1 and the crc
of the empty string; null or repeated ids and repeated rows take places of their
own, in an order fixed by the remaining columns; an empty table gives an empty
table; only the id, the text and the stratum are read, so other columns cannot
clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import groups_for, with_rank
from .store import written


#: Equal rows that one row stands for while they are unfolded.
CHUNK = 10_000


def unfolded(grouped: DataFrame, n: str, rank: str) -> DataFrame:
    """Each row as often as ``n`` says, with ranks from its own on; many equal rows are unfolded in several tasks."""
    few = grouped.where(F.col(n) <= CHUNK).withColumn("_chunk", F.lit(0).cast("long"))
    many = grouped.where(F.col(n) > CHUNK).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), _div(F.col(n) - 1, CHUNK))))
    dealt = many.repartition("_chunk", n, rank)
    nth = F.explode(F.sequence(F.col("_chunk") * CHUNK, F.least(F.col(n), (F.col("_chunk") + 1) * CHUNK) - 1))
    return few.unionByName(dealt).withColumn("_nth", nth).withColumn(rank, F.col(rank) + F.col("_nth")).drop("_chunk", "_nth", n)


def stratified_shards(docs: DataFrame, n_shards: int = 16, seed: int = 17, stratum: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and stratum of every row."""
    name = F.coalesce(F.concat(F.lit("s"), F.col(stratum).cast("string")), F.lit("n"))
    text = F.coalesce("text", F.lit(""))
    light = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.col(stratum).alias("stratum"), name.alias("_stratum"))
    # Equal rows, which no order tells apart, are counted before anything is shuffled by key.
    grouped = written(light.groupBy(*light.columns).agg(F.count(F.lit(1)).alias("_n")), "rows")
    rows = grouped.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    groups = groups_for(rows)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32").cast("string"), F.col("size").cast("string")))
    base = grouped.withColumn("_order", digest).withColumn("_bucket", F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * groups / F.lit(2**32)))
    ties = [F.col(c) for c in ("_order", "doc_id", "text_crc32", "size")]
    ranked = unfolded(with_rank(base, ["_stratum"], "_bucket", ties, "_rank", "_of", "_n"), "_n", "_rank")
    offset = (F.conv(F.substring(F.md5("_stratum"), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(float(2**32))
    spread = ranked.withColumn("_share", (F.col("_rank") - offset) / F.col("_of")).withColumn("_bucket", F.least(F.floor(F.col("_share") * groups), F.lit(groups - 1)))
    mixed = with_rank(written(spread, "strata"), [], "_bucket", [F.col("_share"), F.col("_stratum"), *ties], "_place")
    place = F.col("_place") - 1
    return mixed.withColumn("shard", _div(place * n_shards, max(rows, 1)).cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (place - _div(F.col("shard").cast("long") * rows + (n_shards - 1), n_shards)).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "stratum"
    )


def _div(a: Column, b: int) -> Column:
    """Whole division of non-negative longs."""
    return F.call_function("div", a, F.lit(b).cast("long"))
