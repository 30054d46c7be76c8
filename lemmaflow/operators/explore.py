"""Interactive queries over commit records: filters, search, pages and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def matching(commits: DataFrame, commit_class: str | None = None, author: str | None = None, tactic: str | None = None, search: str | None = None) -> DataFrame:
    """Commits that meet all given filters. A search looks in subject, author and keywords, and at the start of the hash."""
    out = commits
    if commit_class:
        out = out.where(F.col("commit_class") == commit_class)
    if author:
        out = out.where(F.col("author") == author)
    if tactic:
        out = out.where(F.array_contains("tactic_tags", tactic))
    if search:
        q = F.lit(search.lower())
        hit = F.contains(F.lower("message_subject"), q) | F.contains(F.lower("author"), q) | F.startswith("hash", q) | F.exists("keywords", lambda k: F.contains(F.lower(k), q))
        out = out.where(F.coalesce(hit, F.lit(False)))
    return out


def page(commits: DataFrame, number: int, size: int) -> DataFrame:
    """One page, newest first; dates compare as text, the position in the log breaks ties."""
    number = max(1, number)
    return commits.orderBy(F.desc("date"), "_pos").offset((number - 1) * size).limit(size)


def page_totals(commits: DataFrame, size: int) -> DataFrame:
    return commits.agg(F.count(F.lit(1)).alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size))


def totals(commits: DataFrame) -> DataFrame:
    """One row: counts, the range of dates as text, and sums."""
    dated = F.when(F.col("date") != "", F.col("date"))
    return commits.agg(
        F.count(F.lit(1)).alias("total"),
        F.min(dated).alias("earliest"),
        F.max(dated).alias("latest"),
        F.count_if(F.coalesce("diff_sorry_removed", F.lit(False))).alias("sorry_removed"),
        F.coalesce(F.sum("insertions"), F.lit(0)).alias("total_insertions"),
        F.coalesce(F.sum("deletions"), F.lit(0)).alias("total_deletions"),
    )


def class_counts(commits: DataFrame) -> DataFrame:
    counts = commits.where(F.coalesce("commit_class", F.lit("")) != "").groupBy("commit_class").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("of_most", F.col("n") / F.max("n").over(Window.partitionBy()))


def top_authors(commits: DataFrame, n: int = 15) -> DataFrame:
    """The authors with the most commits; the first seen goes before on a tie."""
    counts = commits.groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("_first"))
    return counts.orderBy(F.desc("n"), "_first").limit(n).drop("_first")


def tactic_counts(commits: DataFrame) -> DataFrame:
    return commits.select("_pos", F.explode("tactic_tags").alias("tactic")).groupBy("tactic").agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("_first"))


def top_tactics(commits: DataFrame, n: int = 20) -> DataFrame:
    best = tactic_counts(commits).orderBy(F.desc("n"), "_first", "tactic").limit(n).drop("_first")
    return best.withColumn("of_most", F.col("n") / F.max("n").over(Window.partitionBy()))


def tactic_choices(commits: DataFrame) -> DataFrame:
    """All tactics, for a menu."""
    return commits.select(F.explode("tactic_tags").alias("tactic")).distinct()


def study_overview(records: DataFrame) -> DataFrame:
    """One row for a qualitative study: records, observations, mean complexity and codes used."""
    obs = F.col("analysis.observations")
    return records.agg(F.count(F.lit(1)).alias("n_records"), F.coalesce(F.sum(F.size(obs)), F.lit(0)).cast("long").alias("n_observations"), F.avg("analysis.complexity").alias("avg_complexity"), F.size(F.array_distinct(F.flatten(F.collect_set(F.array_distinct(F.transform(obs, lambda o: o["code"])))))).alias("n_codes"))


def code_counts(records: DataFrame, by_record: bool = False) -> DataFrame:
    keys = ["declaration", "code"] if by_record else ["code"]
    rows = records.select(F.col("analysis.declaration").alias("declaration"), F.explode("analysis.observations").alias("o")).withColumn("code", F.col("o.code"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def study_cards(records: DataFrame) -> DataFrame:
    """Records, the most complex first."""
    return records.orderBy(F.desc("analysis.complexity"), "analysis.declaration")
