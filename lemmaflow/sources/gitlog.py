"""Git logs as text: decoding of records, headers and numstat blocks.

A record begins with 0x1E; its header fields are split by 0x01 and end at 0x1F,
before the numstat lines. Files are read with that record separator, so a log of
any size is split into tasks by its own records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD, FIELD, BLOCK, NUL = "\x1e", "\x01", "\x1f", "\x00"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", RECORD).text(path).where("value != ''")



def numstat(line: Column) -> Column:
    """(added, deleted, path) of a numstat line; binary files count 0, other lines give null."""
    parts = F.split(line, "\t", 3)

    def count(i: int) -> Column:
        raw = F.try_element_at(parts, F.lit(i))
        return F.when(raw == "-", F.lit(0)).otherwise(F.trim(raw).try_cast("int"))

    made = F.struct(count(1).alias("added"), count(2).alias("deleted"), F.trim(F.try_element_at(parts, F.lit(3))).alias("path"))
    return F.when((F.size(parts) == 3) & count(1).isNotNull() & count(2).isNotNull(), made)


def decoded(log: DataFrame, extension: str = ".v") -> DataFrame:
    """Commit records of raw records; those with fewer than seven header fields are left out."""
    head = F.split(F.split_part("value", F.lit(BLOCK), F.lit(1)), FIELD)
    block = F.split_part("value", F.lit(BLOCK), F.lit(2))
    files = F.filter(F.transform(F.split(block, "\n"), numstat), lambda x: x.isNotNull())
    staged = log.select(head.alias("h"), files.alias("f")).where(F.size("h") >= 7)
    paths = F.transform("f", lambda x: x["path"])
    proofs = F.filter(paths, lambda p: p.endswith(extension))
    total = lambda name: F.aggregate("f", F.lit(0), lambda s, x: s + x[name])
    return staged.select(
        F.trim(F.col("h")[0]).alias("hash"),
        F.filter(F.split(F.col("h")[1], " "), lambda p: p != "").alias("parent_hashes"),
        F.col("h")[2].alias("author"),
        F.col("h")[3].alias("author_email"),
        F.col("h")[4].alias("date"),
        F.col("h")[5].alias("message_subject"),
        F.trim(F.regexp_replace(F.col("h")[6], r"\A\s+|\s+\z", "")).alias("message_body"),
        F.size("f").alias("files_changed_count"),
        total("added").alias("insertions"),
        total("deleted").alias("deletions"),
        paths.alias("changed_files"),
        proofs.alias("coq_files_changed"),
        (F.size(proofs) > 0).alias("touches_proof_files"),
    )


def headers(lines: DataFrame) -> DataFrame:
    """hash, first parent, author, date and message of NUL-separated lines; shorter lines are left out."""
    parts = F.split("value", NUL)
    return lines.where(F.size(parts) >= 5).select(
        parts[0].alias("hash"), F.split(parts[1], " ")[0].alias("parent_hash"), parts[2].alias("author"), parts[3].alias("date"), parts[4].alias("message")
    )


def modified_proof_files(name_status: DataFrame, extension: str) -> DataFrame:
    """Modified files (status M) with the extension."""
    return name_status.where((F.col("status") == "M") & F.col("path").endswith(extension))


def files_at(requests: DataFrame, blobs: DataFrame) -> DataFrame:
    """Contents of (commit_hash, path) pairs, null where there is none; each pair is looked up once."""
    keys = ["commit_hash", "path"]
    return requests.join(requests.select(*keys).distinct().join(blobs, keys, "left"), keys, "left")


def recent_subjects(commits: DataFrame, n: int) -> DataFrame:
    """The n most recent messages with a subject, by log position."""
    return commits.where(F.trim("message_subject") != "").orderBy("_pos").limit(n).select("_pos", "message_subject")
