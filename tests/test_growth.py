"""What a step hands on grows with its input: rows between tasks, bytes of Arrow batches."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from lemmaflow.operators import holes as H
from lemmaflow.plans import commands
from lemmaflow.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def metrics_of(df, *wanted):
    """The values of the named metrics in the plan that ran, each for nodes whose name holds a word."""
    df.collect()
    found, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        found += [node.metrics().apply(name).value() for of, name in wanted if of in kind and node.metrics().contains(name)]
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_histories_are_not_multiplied_by_declarations(spark):
    """41 declarations a file: joins and shuffles have its commits as one row each."""
    rows = metrics_of(QUERIES["lifecycle_records"](spark, DATA), ("Join", "numOutputRows"), ("Exchange", "shuffleRecordsWritten"))
    assert 1 < max(rows) <= spark.read.parquet(f"{DATA}/events.parquet").count()


def test_trace(spark):
    """Two declarations of a file that are finished one after the other; a content given twice counts once."""
    fields = "_pos long, hash string, date string, message_subject string, commit_class string, tactic_group_tags array<string>, tactic_tags array<string>, diff_net_proof_lines int, coq_files_changed array<string>"
    rows = [(i, f"h{i}", f"2024-01-0{i}T00:00:00+00:00", f"s{i}", "proof_add", ["g", "k"][: i % 3], ["auto"] * (i % 2), i, ["f.v"]) for i in range(1, 6)]
    commits = spark.createDataFrame(rows, fields)
    hole = "array<struct<kind: string, enclosing_decl: string>>"
    challenges = spark.createDataFrame([(0, "h3", "f.v", [("admitted", "a")]), (1, "h5", "f.v", [("admit", "b"), ("admit", "")])], f"_pos long, commit_hash string, file_path string, holes_filled {hole}")
    both, late, none = "Lemma a : x.\nAdmitted.\nLemma b : x.\nAdmitted.\n", "Lemma a : x.\nQed.\nLemma b : x.\nAdmitted.\n", "Lemma a : x.\nQed.\nLemma b : x.\nQed.\n"
    blobs = [("h1", both), ("h1", both), ("h2", both), ("h3", late), ("h4", both), ("h5", none), ("h9", both)]
    contents = spark.createDataFrame([(h, "f.v", t) for h, t in blobs] + [("h2", "g.v", both), ("h3", "f.v", None)], "hash string, file string, content string")
    a, b = commands.trace(challenges, commits, contents).orderBy("declaration").collect()
    assert (a["declaration"], a["hole_kind"], a["n_commits_with_hole"], a["first_hole_date"][:10], a["proof_complete_hash"], a["days_to_prove"]) == ("a", "admitted", 2, "2024-01-01", "h3", 2)
    assert (b["declaration"], b["hole_kind"], b["n_commits_with_hole"], b["proof_complete_hash"], b["days_to_prove"]) == ("b", "admit", 4, "h5", 4)
    assert [e["hash"] for e in b["commit_timeline"]] == ["h1", "h2", "h3", "h4"] and b["commit_timeline"][3]["net_proof_lines"] == 4
    assert b["n_tactic_groups"] == 2 and b["tactic_groups_used"] == ["g", "k"] and b["group_commit_counts"] == {"g": 3, "k": 1} and b["top_tactics"] == ["auto"]


LINE = "Lemma the " + "word the " * 1000
DECLARED = r"^\s*Lemma\s+(\w+)"


def long_lines(spark, n):
    return spark.range(n, numPartitions=1).select("id", F.lit("x\n" + LINE).alias("content"))


def test_contexts_leave_python_once_a_line(spark):
    """1,001 holes in a line of 9 kB share one context of that size; a context for each would be 9 MB."""
    (sent,) = [n for n in metrics_of(H.found_holes(long_lines(spark, 1), ["id"], ["the"], DECLARED), ("", "pythonDataReceived")) if n]
    assert sent < 10 * len(LINE)


def test_holes_over_many_batches(spark):
    found = H.found_holes(long_lines(spark, 100), ["id"], ["the"], DECLARED)
    assert found.columns == ["id", "line", "column", "kind", "context", "enclosing_decl"]
    by = found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("column").alias("c"), F.max("column").alias("last"), F.min("column").alias("first")).collect()
    assert len(by) == 100 and {(r["n"], r["c"], r["last"], r["first"]) for r in by} == {(1001, 1001, LINE.rindex("the"), 6)}
    assert [tuple(r) for r in found.select("line", "kind", "context", "enclosing_decl").distinct().collect()] == [(2, "the", "x\n" + LINE, "the")]


def test_contexts_of_filled_holes_leave_python_once_a_line(spark):
    """The same for both sides of a change, with what it filled: the first line's holes, for the second line's stay."""
    parent = long_lines(spark, 1).withColumn("content", F.concat("content", F.lit("\nLemma foo "), F.lit("the " * 3)))
    child = parent.withColumn("content", F.replace("content", F.lit("Lemma the "), F.lit("Lemma bar ")))
    sides = [H.found_holes(df, ["id"], ["the"], DECLARED) for df in (parent, child)]
    out = H.challenges(H.filled_holes(*sides, ["id"]), ["id"]).select("n_holes", F.col("holes_filled")[0]["line"].alias("first"))
    sent = metrics_of(out, ("", "pythonDataReceived"))
    assert [tuple(r) for r in out.collect()] == [(1001, 2)] and 0 < max(sent) < 10 * len(LINE)
