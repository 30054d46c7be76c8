"""Partitions of commit records, slots of evaluation runs, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab


def split_by_proof_files(commits: DataFrame, unique: bool = True) -> tuple[DataFrame, DataFrame]:
    """Commits with proof files, and the rest: two filters over one scan.

    Where a hash can stand on both sides (``unique`` false) the rest is by hash, which takes a join."""
    touched = commits.where(F.size("coq_files_changed") > 0)
    if unique:
        return touched, commits.where(F.coalesce(F.size("coq_files_changed"), F.lit(0)) <= 0)
    return touched, commits.join(touched.select("hash").distinct(), "hash", "left_anti")


def recombined(first: DataFrame, rest: DataFrame) -> DataFrame:
    """The bag union of both, with the place of each part in front for writers that keep the order."""
    return first.withColumn("_part", F.lit(0)).unionByName(rest.withColumn("_part", F.lit(1)))


def restored(first: DataFrame, rest: DataFrame) -> DataFrame:
    """The union in order: the first part, then the rest, each as it came in (``_pos``)."""
    return recombined(first, rest).orderBy("_part", "_pos")


def tactic_buckets(commits: DataFrame) -> DataFrame:
    """One row per bucket of a proof_add commit: its tactics, and its styles as style_*; a commit stands in many."""
    buckets = F.concat(F.coalesce("tactic_tags", F.array().cast("array<string>")), F.transform(F.coalesce("proof_style", F.array().cast("array<string>")), lambda s: F.concat(F.lit("style_"), s)))
    return commits.where(F.col("commit_class") == "proof_add").withColumn("bucket", F.explode(buckets))


def group_buckets(commits: DataFrame) -> DataFrame:
    """One row per behaviour group of a commit."""
    return commits.withColumn("bucket", F.explode("tactic_group_tags"))


def write_buckets(buckets: DataFrame, path: str) -> None:
    """One folder per bucket; tasks write their part of each."""
    buckets.write.mode("overwrite").partitionBy("bucket").json(path, ignoreNullFields=False)


def write_records(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").json(path, ignoreNullFields=False)


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path, ignoreNullFields=False)


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Counts and percent of all by value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.try_divide(100.0 * F.col("n"), F.sum("n").over(Window.partitionBy())))


def capped_slots(slots: DataFrame, cap: int, only: str | None = None) -> DataFrame:
    """The first ``cap`` slots by name of each condition and deletion size, of those whose name holds ``only``."""
    named = slots.where(F.col("slot").contains(only)) if only else slots
    place = F.row_number().over(Window.partitionBy("condition", "deletion_size").orderBy("slot"))
    return named.withColumn("_n", place).where(F.col("_n") <= cap).drop("_n")


def slots_for_commits(metas: DataFrame, files: DataFrame) -> DataFrame:
    """Slots of metas (condition, slot, commit_hash): condition A has one, B one per deletion size whose file exists."""
    sizes = F.when(F.col("condition") == "A", F.array(F.lit(-1))).otherwise(F.array(*[F.lit(n) for n in vocab.DELETION_SIZES]))
    each = metas.withColumn("deletion_size", F.explode(sizes))
    name = F.when(F.col("deletion_size") == -1, "challenge.v").otherwise(F.concat(F.lit("challenge"), F.col("deletion_size").cast("string"), F.lit(".v")))
    return each.withColumn("challenge_file", name).join(files, ["condition", "slot", "challenge_file"], "left_semi")


def run_configs(slots: DataFrame) -> DataFrame:
    """One JSON configuration per commit."""
    slot = F.struct("condition", "slot", "deletion_size", "challenge_file")
    listed = slots.groupBy("commit_hash").agg(F.array_sort(F.collect_list(slot)).alias("slots"))
    return listed.select("commit_hash", F.to_json(F.struct(F.col("commit_hash").alias("commit"), "slots")).alias("config"))


def slots_of_configs(configs: DataFrame, schema: str) -> DataFrame:
    """Slots of JSON configurations; a slot without a size has -1 under condition A."""
    rows = configs.select(F.from_json("config", schema).alias("c")).select("c.commit", F.explode("c.slots").alias("s"))
    size = F.coalesce("s.deletion_size", F.when(F.col("s.condition") == "A", -1))
    return rows.select(F.col("commit").alias("commit_hash"), "s.condition", "s.slot", size.alias("deletion_size"), "s.challenge_file")


def warm_targets(metas: DataFrame, commit: str) -> DataFrame:
    """Build targets of a commit's files."""
    return metas.where(F.col("commit_hash") == commit).select(F.regexp_replace("file_path", r"\.v$", ".vo").alias("target")).distinct()


def main_assistant(paths: DataFrame) -> DataFrame:
    """The proof assistant with the most files outside of skipped folders; the first seen wins a tie."""
    table = F.create_map(*[F.lit(x) for v in vocab.LANGUAGES.values() for x in (v.extension, v.name)])
    skipped = F.arrays_overlap(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), F.array(*[F.lit(x) for x in vocab.SKIP_FOLDERS]))
    named = paths.where(~skipped).withColumn("assistant", F.try_element_at(table, F.regexp_extract("path", r"(\.[^./]+)$", 1))).where("assistant is not null")
    return named.groupBy("assistant").agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("first")).orderBy(F.desc("n"), "first").limit(1).select("assistant", "n")


# Build files, their assistant and their tool.
BUILD_FILES = [("Makefile", "coq", "make"), ("_CoqProject", "coq", "coq_makefile"), ("lakefile.lean", "lean4", "lake build"), ("lakefile.toml", "lean4", "lake build"), ("ROOT", "isabelle", "isabelle build")]


def build_systems(root: DataFrame) -> DataFrame:
    """Build files among the names at a repository's root."""
    known = root.sparkSession.createDataFrame(BUILD_FILES, "name string, assistant string, tool string")
    return root.select("name").distinct().join(F.broadcast(known), "name")  # a literal table of a few rows


def excluded_folders(root: DataFrame) -> DataFrame:
    return root.where(F.col("name").isin(*vocab.EXCLUDED_FOLDERS)).select("name").distinct()


def project_flags(lines: DataFrame) -> DataFrame:
    """Flag triples of a project file, one row each."""
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    return lines.where(parts[0].isin("-R", "-Q", "-I") & (F.size(parts) >= 3)).select(parts[0].alias("flag"), parts[1].alias("folder"), parts[2].alias("prefix"))


def repo_summary(assistant: DataFrame, root: DataFrame, commits: DataFrame, n_messages: int = 20) -> DataFrame:
    """One row of what is known of a repository."""
    row = F.lit(1)
    tools = build_systems(root).agg(F.array_sort(F.collect_list(F.concat_ws("=", "name", "tool"))).alias("build_files")).withColumn("_k", row)
    folders = excluded_folders(root).agg(F.array_sort(F.collect_list("name")).alias("exclude_paths")).withColumn("_k", row)
    recent = commits.where(F.trim("message_subject") != "").orderBy("_pos").limit(n_messages).agg(F.count(F.lit(1)).alias("n_sampled")).withColumn("_k", row)
    return assistant.select("assistant").withColumn("_k", row).join(tools, "_k").join(folders, "_k").join(recent, "_k").drop("_k")


def write_transcripts(transcripts: DataFrame, path: str) -> None:
    """Transcripts by slot, one folder each."""
    transcripts.write.mode("append").partitionBy("slot").json(path, ignoreNullFields=False)


def remote_url(config: DataFrame) -> DataFrame:
    """The URL of the origin in a repository's configuration, given as one text."""
    url = F.regexp_extract("value", r'(?s)\[remote "origin"\].*?url\s*=\s*(\S+)', 1)
    return config.select(F.when(url != "", url).otherwise("").alias("url"))
