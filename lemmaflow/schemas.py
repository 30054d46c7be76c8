"""Schemas of records; readers never infer types."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)  # noqa: SLF001


COMMIT = (
    "hash string, parent_hashes array<string>, author string, author_email string, date string, message_subject string, message_body string, "
    "files_changed_count int, insertions int, deletions int, changed_files array<string>, coq_files_changed array<string>, touches_proof_files boolean, "
    "commit_class string, keywords array<string>, class_confidence string, diff_sorry_removed boolean, diff_net_proof_lines int, "
    "tactic_tags array<string>, proof_style array<string>, tactic_group_tags array<string>"
)
HOLE = "struct<line:int,column:int,kind:string,proof_assistant:string,context:string,enclosing_decl:string>"
CHALLENGE = (
    "task_id string, repo string, proof_assistant string, commit_hash string, parent_hash string, commit_message string, file_path string, "
    f"challenge_file_content string, solution_file_content string, holes_filled array<{HOLE}>, diff string, instructions string"
)
TIMELINE = "array<struct<hash:string,date:string,subject:string,commit_class:string,tactic_groups:array<string>,tactic_tags:array<string>,net_proof_lines:int>>"
LIFECYCLE = (
    "declaration string, file string, hole_kind string, proof_complete_hash string, proof_complete_date string, first_hole_date string, days_to_prove int, "
    f"n_commits_with_hole int, n_tactic_groups int, tactic_groups_used array<string>, top_tactics array<string>, group_commit_counts map<string,bigint>, commit_timeline {TIMELINE}"
)
SLOT = "task_id string, declaration string, hole_kind string, file_path string, commit_hash string, parent_hash string, commit_message string, instructions string, context_lines string"
METRICS = (
    "struct<tactic_count:int,automation_ratio:double,unique_tactic_types:int,max_bullet_depth:int,proof_chars:int,proof_lines:int,ends_with_admitted:boolean,"
    "vo_bytes:bigint,compile_time_s:double,assumptions:array<string>,n_assumptions:int>"
)
RESULT = (
    "challenge_id string, declaration string, deletion_size int, condition string, verdict string, inference_time_s double, output_tokens int, mode string, "
    "agent_n_turns int, agent_give_up_reason string, agent_total_input_tokens int, agent_total_output_tokens int, "
    f"human_metrics {METRICS}, llm_metrics {METRICS}, compile_stderr string, compile_stdout string, tactic_edit_distance int, normalized_edit_distance double"
)
STUDY = (
    "source struct<declaration:string,file:string,hole_kind:string,first_hole_date:string,proof_complete_date:string,days_to_prove:int,n_commits:int,top_tactics:array<string>>, "
    "analysis struct<declaration:string,file:string,observations:array<struct<code:string,commit_hash:string,evidence:string>>,narrative:string,trajectory_signature:string,complexity:int,dominant_strategy:string>"
)
RUN_CONFIG = "commit string, slots array<struct<condition:string,slot:string,deletion_size:int,challenge_file:string>>"

# What enumerated fields may hold.
COMMIT_CLASSES = ["proof_complete", "proof_new", "proof_add", "proof_optimise", "spec_change", "refactor", "infra", "fix", "other"]
VERDICTS = ["PASS", "ADMITTED", "FAIL", "TIMEOUT", "ERROR"]
MODES = ["baseline", "agent"]
