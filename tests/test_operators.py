"""Holes, summaries, readers, writers and streams on small fixtures."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lemmaflow import schemas, vocab
from lemmaflow.operators import datasets as D
from lemmaflow.operators import evaluation as E
from lemmaflow.operators import explore as Q
from lemmaflow.operators import holes as H
from lemmaflow.operators import lifecycle as L
from lemmaflow.operators import report
from lemmaflow.sources import gitlog as G
from lemmaflow.sources import records as R
from lemmaflow.streaming import tail

COQ = "Theorem foo : x.\nProof.\n  auto.\nAdmitted.\n\nLemma bar : y.\nProof.\n  admit.\nAdmitted.\n"


def holes(spark, text, language):
    lang = vocab.LANGUAGES[language]
    df = spark.createDataFrame([("f", text)], "file string, content string")
    return H.found_holes(df, ["file"], lang.markers, lang.declaration)


def test_coq_holes(spark):
    rows = holes(spark, COQ, "coq").collect()
    assert sorted((r["line"], r["column"], r["kind"], r["enclosing_decl"]) for r in rows) == [(4, 0, "admitted", "foo"), (8, 2, "admit", "bar"), (9, 0, "admitted", "bar")]
    assert next(r for r in rows if r["line"] == 4)["context"] == "Theorem foo : x.\nProof.\n  auto.\nAdmitted.\n\nLemma bar : y.\nProof."


def test_filled(spark):
    child = holes(spark, COQ.replace("Admitted", "Qed").replace("admit", "auto"), "coq")
    assert H.filled_holes(holes(spark, COQ, "coq"), child, ["file"]).count() == 3


def test_other_languages(spark):
    isabelle = 'theorem test_thm: "x"\n  sorry\nlemma helper: "y"\n  oops\n'
    assert {(r["kind"], r["enclosing_decl"]) for r in holes(spark, isabelle, "isabelle").collect()} == {("sorry", "test_thm"), ("oops", "helper")}
    lean = "theorem test_thm : x := by\n  sorry; sorry\ndef helper := sorry\n"
    assert sorted((r["column"], r["enclosing_decl"]) for r in holes(spark, lean, "lean4").collect()) == [(2, "test_thm"), (9, "test_thm"), (14, "helper")]


def test_program_names_its_keyword(spark):
    assert holes(spark, "Program Definition foo := x.\nAdmitted.", "coq").first()["enclosing_decl"] == "Definition"


def test_line_breaks(spark):
    df = spark.createDataFrame([("f", "a\r\nb\x0bc d\n"), ("g", ""), ("h", None)], "k string, content string")
    assert [r["text"] for r in H.lines_of(df, ["k"]).orderBy("line").collect()] == ["a", "b", "c", "d"]


def result(mode, size, verdict, **more):
    return {"mode": mode, "deletion_size": size, "verdict": verdict, "condition": "B"} | more


def results(spark, rows):
    return spark.createDataFrame(spark.sparkContext.parallelize([]), T._parse_datatype_string(schemas.RESULT)) if not rows else spark.read.schema(schemas.RESULT).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))


def test_summary(spark):
    rows = [result(m, s, "PASS" if s == 3 else "FAIL", normalized_edit_distance=0.1 * s, llm_metrics={"vo_bytes": 100 * k, "n_assumptions": k}, human_metrics={"vo_bytes": 100, "n_assumptions": 1}, agent_n_turns=k) for m in ("baseline", "agent") for k, s in enumerate((3, 7, 15), 1)]
    rows += [result("baseline", None, "PASS"), result("agent", 3, "PASS", llm_metrics={"ends_with_admitted": True})]
    groups = E.group_summary(results(spark, rows))
    by = {(r["mode"], r["deletion_size"]): r for r in groups.collect()}
    assert len(by) == 6 and by["agent", 3]["n_pass"] == 1 and by["agent", 3]["n_admitted"] == 1 and by["agent", 3]["pass_rate"] == 0.5
    assert [by["baseline", s]["mean_vo_bytes_ratio"] for s in (3, 7, 15)] == [1, 2, 3]
    assert [by["baseline", s]["mean_n_assumptions_diff"] for s in (3, 7, 15)] == [0, 1, 2]
    assert by["baseline", 3]["mean_agent_n_turns"] is None
    faith = {r["mode"]: r["r"] for r in E.faithfulness(groups).collect()}
    assert faith["baseline"] < 0
    deltas = {r["deletion_size"]: r for r in E.baseline_against_agent(groups).collect()}
    assert deltas[3]["delta_pass_rate"] == -0.5 and deltas[7]["delta_mean_agent_n_turns"] == 2
    out = report.summary(groups, E.faithfulness(groups), E.drift_faithfulness(groups), E.baseline_against_agent(groups))
    assert out["n_total_runs"] == 7 and json.loads(report.summary_json(out))["groups"][0]["mode"] == "agent"
    assert report.markdown_table(groups.orderBy("mode", "deletion_size"), ["mode", "n_total"]).count("\n") == 7


def test_no_variance_gives_no_r(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 3, "x double, y double")
    assert df.agg(E.pearson(F.col("x"), F.col("y"))).first()[0] is None
    assert df.limit(2).agg(E.pearson(F.col("x"), F.col("y"))).first()[0] is None


def test_empty_inputs(spark):
    assert E.group_summary(results(spark, [])).collect() == []
    empty = spark.createDataFrame([], schemas.LIFECYCLE)
    assert L.histogram(empty, vocab.BUCKETS7).agg(F.sum("n")).first()[0] == 0
    assert L.hardest(empty).collect() == [] and L.percentiles(empty).collect() == []


def test_days(spark):
    df = spark.createDataFrame([("2024-01-01T23:00:00+02:00", "2024-01-03T01:00:00Z"), ("2024-01-02T00:00:00", "2024-01-01T00:00:00"), ("x", "y")], "a string, b string")
    assert [r[0] for r in df.select(L.days_between(F.col("a"), F.col("b"))).collect()] == [1, 0, -1]


def test_log_and_readers(spark, tmp_path):
    log = "\x1eH1\x01P1 P2\x01ann\x01a@x\x012024-01-01\x01subject\x01body\n\x1f\n3\t1\tproof.v\n-\t-\timg.png\n1\t0\t{a => b}.v\n\x1eshort\x1f\n"
    (tmp_path / "log").write_text(log)
    (row,) = G.decoded(G.read_log(spark, str(tmp_path / "log"))).collect()
    assert (row["parent_hashes"], row["insertions"], row["deletions"], row["files_changed_count"]) == (["P1", "P2"], 4, 1, 3)
    assert row["coq_files_changed"] == ["proof.v", "{a => b}.v"] and row["message_body"] == "body"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"hash": "h"}\n\n{bad\n')
    got = R.read_commits(spark, str(tmp_path / "in")).collect()
    assert len(got) == 1 and got[0]["tactic_tags"] == [] and got[0]["insertions"] == 0
    assert R.cached_records(spark, str(tmp_path / "in"), schemas.COMMIT).count() == 1
    (tmp_path / "in" / "b.jsonl").write_text('{"hash": "g"}\n')
    assert R.cached_records(spark, str(tmp_path / "in"), schemas.COMMIT).count() == 2
    catalog = R.list_datasets(spark, str(tmp_path / "in"))
    assert {r["id"] for r in catalog.collect()} == {"a", "b"} and R.resolve_dataset(catalog, "a").count() == 1


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "proof_add", ["lia", "ring"], ["mixed"])], "k int, commit_class string, tactic_tags array<string>, proof_style array<string>")
    D.write_buckets(D.tactic_buckets(df), str(tmp_path / "b"))
    assert {p.name for p in (tmp_path / "b").glob("bucket=*")} == {"bucket=lia", "bucket=ring", "bucket=style_mixed"}
    D.write_records(df, str(tmp_path / "w"), single=True)
    D.append_records(df, str(tmp_path / "w"))
    assert spark.read.json(str(tmp_path / "w")).count() == 2


def test_ties_and_pages(spark):
    df = spark.createDataFrame([(i, "d", f"u{i % 3}") for i in range(7)], "_pos int, date string, author string")
    assert [r["_pos"] for r in Q.page(df, 2, 3).collect()] == [3, 4, 5]
    assert [r["_pos"] for r in Q.page(df, -1, 3).collect()] == [0, 1, 2]
    assert tuple(Q.page_totals(df, 3).first()) == (7, 3)
    assert [r["author"] for r in Q.top_authors(df).collect()] == ["u0", "u1", "u2"]


def test_stream(spark, tmp_path):
    folder, cp = tmp_path / "in", str(tmp_path / "cp")
    folder.mkdir()
    (folder / "1.jsonl").write_text(json.dumps(result("agent", 3, "PASS")) + "\n{bad\n")
    stream = tail.result_stream(spark, str(folder))
    tail.live_summary(stream, "live", cp).awaitTermination()
    assert spark.table("live").first()["n_total"] == 1
    (folder / "2.jsonl").write_text(json.dumps({"deletion_size": 3, "verdict": "FAIL"}) + "\n")
    tail.live_summary(tail.result_stream(spark, str(folder)), "live", cp).awaitTermination()
    assert {(r["mode"], r["n_total"]) for r in spark.table("live").collect()} == {("agent", 1), ("baseline", 1)}


@pytest.mark.parametrize("values", [[], [5], [1, 2, 3, 4], [1] * 50 + [9]])
def test_percentiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "n_commits_with_hole int")
    got = {r["point"]: r["value"] for r in L.percentiles(df).collect()}
    assert got == {p: sorted(values)[min(int(p / 100 * len(values)), len(values) - 1)] for p in (25, 50, 75, 90, 95, 99) if values}


def test_repository_to_challenges(spark, tmp_path):
    """Three commits: a hole, its filling, another file with holes."""
    import os
    import subprocess

    from lemmaflow.plans import commands
    from lemmaflow.sources import git

    repo = tmp_path / "repo"
    repo.mkdir()
    env = os.environ | {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@x"}
    run = lambda *a: subprocess.run(["git", "-C", str(repo), *a], check=True, env=env, capture_output=True)
    run("init", "-q")
    for name, text, message in (("proof.v", "Lemma a : x.\nProof.\nAdmitted.\n", "first"), ("proof.v", "Lemma a : x.\nProof.\nauto.\nQed.\n", "fill"), ("helpers.v", "Lemma b : y. admit.\nAdmitted.\n", "more")):
        (repo / name).write_text(text)
        run("add", ".")
        run("commit", "-qm", message)
    commits = G.decoded(git.read_repository(spark, str(repo))).cache()
    assert [r["message_subject"] for r in commits.collect()] == ["more", "fill", "first"]
    pairs = commits.where("size(parent_hashes) > 0").select("hash", F.col("parent_hashes")[0].alias("parent_hash"), "message_subject", F.explode("coq_files_changed").alias("path"))
    after = git.contents(pairs.select(F.col("hash").alias("commit_hash"), "path"), str(repo)).withColumnsRenamed({"commit_hash": "hash", "content": "after"})
    before = git.contents(pairs.select(F.col("parent_hash").alias("commit_hash"), "path"), str(repo)).withColumnsRenamed({"commit_hash": "parent_hash", "content": "before"})
    changes = pairs.join(after, ["hash", "path"]).join(before, ["parent_hash", "path"]).select(F.col("hash").alias("commit_hash"), "parent_hash", F.col("message_subject").alias("commit_message"), "path", F.when(F.col("before").isNull(), "A").otherwise("M").alias("status"), "before", "after")
    (c,) = commands.mine(changes, "demo").collect()
    assert c["file_path"] == "proof.v" and c["holes_filled"][0]["enclosing_decl"] == "a" and c["diff"].startswith("--- a/proof.v")
    assert c["instructions"] == "Fill in the proof(s) marked with placeholder tactics (admitted in a) in proof.v."
    total = [r for r in commands.stats(commands.mine(changes, "demo")).collect() if r["repo"] is None and r["proof_assistant"] is None]
    assert total[0]["n_challenges"] == 1 and total[0]["n_holes"] == 1


def test_remote_url(spark):
    df = spark.createDataFrame([('[core]\n[remote "origin"]\n\turl = git@host:x.git\n',), ("[core]",)], "value string")
    assert [r["url"] for r in D.remote_url(df).collect()] == ["git@host:x.git", ""]
