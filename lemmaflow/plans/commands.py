"""What the command line offers elsewhere, as functions from DataFrames to DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import commits as C
from ..functions import proofs, texts
from ..functions.diffs import unified_diff
from ..operators import datasets, evaluation, explore, holes, lifecycle
from ..sources import gitlog, records
from .scratch import written


def dump_commits(spark: SparkSession, log_path: str, extension: str = ".v") -> DataFrame:
    """Commit records of an exported log."""
    return gitlog.decoded(gitlog.read_log(spark, log_path), extension)


def enrich_commits(commits: DataFrame) -> DataFrame:
    return C.enriched(commits)


def diff_enrich(commits: DataFrame) -> DataFrame:
    """The diff pass with groups; commits need a ``diff`` column."""
    out = C.diff_enriched(commits)
    return out.withColumn("tactic_group_tags", C.tactic_groups(F.col("tactic_tags")))


def stratify_tactics(commits: DataFrame, path: str) -> None:
    datasets.write_buckets(datasets.tactic_buckets(commits), path)


def group_tactics(commits: DataFrame, path: str) -> None:
    datasets.write_buckets(datasets.group_buckets(commits), path)


def mine(changes: DataFrame, repo: str, language: str = "coq") -> DataFrame:
    """Challenges of changed files: those in which a hole of the parent side is filled.

    changes: commit_hash, parent_hash, commit_message, path, status, before, after."""
    lang = vocab.LANGUAGES[language]
    keys = ["commit_hash", "path"]
    usable = gitlog.modified_proof_files(changes, lang.extension).where("parent_hash != '' and before is not null and after is not null")
    side = lambda c: holes.found_holes(usable.select(*keys, F.col(c).alias("content")), keys, lang.markers, lang.declaration)
    found = holes.challenges(holes.filled_holes(side("before"), side("after"), keys), keys)
    return usable.join(found, keys).select(
        C.task_id(F.lit(repo), F.col("commit_hash"), F.col("path")).alias("task_id"),
        F.lit(repo).alias("repo"),
        F.lit(lang.name).alias("proof_assistant"),
        "commit_hash",
        "parent_hash",
        "commit_message",
        F.col("path").alias("file_path"),
        F.col("before").alias("challenge_file_content"),
        F.col("after").alias("solution_file_content"),
        F.transform("holes_filled", lambda h: h.withField("proof_assistant", F.lit(lang.name))).alias("holes_filled"),
        unified_diff("before", "after", "path").alias("diff"),
        C.instructions(F.col("holes_filled"), F.col("path")).alias("instructions"),
    )


def partial_challenges(solutions: DataFrame, known: DataFrame, sizes: tuple[int, ...] = (5, 7, 10, 15)) -> DataFrame:
    """Challenge files of solved slots, one per number of tactics removed.

    solutions: slot, declaration, solution; known: slot, file, for files that are there already and stay. Slots whose
    proof can't be read give none."""
    read = solutions.withColumn("_s", proofs.extract_sentences("solution", "declaration")).where("_s is not null")
    each = read.withColumn("deletion_size", F.explode(F.array(*map(F.lit, sizes))))
    made = each.select("slot", "deletion_size", F.format_string("challenge%d.v", "deletion_size").alias("file"), proofs.remove_last_tactics(F.col("solution"), F.col("_s"), F.col("deletion_size")).alias("content"))
    return made.join(known.select("slot", "file").distinct(), ["slot", "file"], "left_anti")


def study_prompts(timelines: DataFrame) -> DataFrame:
    """A prompt per declaration of enriched lifecycle records, with the fields that `texts.trajectory_prompt` names."""
    return timelines.select("declaration", texts.trajectory_prompt({c: F.col(c) for c in timelines.columns}).alias("prompt"))


def stats(challenges: DataFrame) -> DataFrame:
    """Challenges and holes: in all, by repository and by assistant."""
    counted = challenges.select("repo", "proof_assistant", F.size("holes_filled").alias("h"))
    return counted.groupingSets([["repo"], ["proof_assistant"], []], "repo", "proof_assistant").agg(F.count(F.lit(1)).alias("n_challenges"), F.sum("h").alias("n_holes"))


def trace(challenges: DataFrame, commits: DataFrame, blobs: DataFrame) -> DataFrame:
    """Lifecycle records from challenges, commits and file contents (hash, file, content)."""
    proved = written(lifecycle.proved_declarations(challenges, commits), "proved")
    return lifecycle.lifecycles(lifecycle.open_commits(proved, commits, blobs), proved)


def summarise_runs(spark: SparkSession, paths: str | list[str]) -> dict[str, DataFrame]:
    """All tables of a run summary."""
    groups = evaluation.group_summary(records.read_results(spark, paths))
    return {"groups": groups, "faithfulness": evaluation.faithfulness(groups), "drift": evaluation.drift_faithfulness(groups), "deltas": evaluation.baseline_against_agent(groups)}


def search(commits: DataFrame, number: int = 1, size: int = 50, **filters: str) -> tuple[DataFrame, DataFrame]:
    """A page of matching commits and the totals."""
    found = explore.matching(commits, **filters)
    return explore.page(found, number, size), explore.page_totals(found, size)
