"""Column expressions over commit messages and diffs: classes, keywords, tactics, groups and styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab


def _has(text: Column, name: str) -> Column:
    return text.rlike(vocab.java(vocab.bank(name)))


def commit_class(subject: Column, body: Column, touches: Column, insertions: Column, deletions: Column) -> Column:
    """First rule that matches, from infrastructure down to other."""
    subject, body = F.coalesce(subject, F.lit("")), F.coalesce(body, F.lit(""))
    text = F.lower(F.concat(subject, F.lit(" "), body))
    title = F.lower(subject)
    touches = F.coalesce(touches, F.lit(False))
    moved, fixed = _has(text, "refactor"), _has(text, "fix")
    return (
        F.when(_has(title, "infra") & ~_has(title, "context"), "infra")
        .when(_has(text, "complete") & _has(text, "context"), "proof_complete")
        .when(touches & (deletions > insertions) & (body == "") & _has(text, "context") & ~_has(text, "infra"), "proof_complete")
        .when(touches & _has(text, "spec"), "spec_change")
        .when(touches & _has(text, "new"), "proof_new")
        .when(touches, "proof_add")  # any other work in proof files, refactoring and fixes included
        .when(moved, "refactor")
        .when(fixed, "fix")
        .otherwise("other")
    )


def message_class(message: Column, keywords: Column | None = None) -> Column:
    """Class of a lone message, taken to touch proof files; keywords stand in for a body."""
    body = F.lit("") if keywords is None else F.array_join(keywords, " ")
    return commit_class(message, body, F.lit(True), F.lit(0), F.lit(0))


def _distinct_lower(found: Column) -> Column:
    return F.array_distinct(F.transform(found, F.lower))


def keywords(subject: Column, body: Column) -> Column:
    """Keywords of a message in order of first appearance."""
    text = F.concat(F.coalesce(subject, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))
    return _distinct_lower(F.regexp_extract_all(text, F.lit(vocab.java(vocab.keyword_pattern())), F.lit(1)))


def tactic_groups(tags: Column) -> Column:
    """Groups of tactics in order of first appearance; tactics of no group are left out."""
    table = F.create_map(*[F.lit(x) for pair in vocab.GROUP_OF.items() for x in pair])
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.try_element_at(table, F.lower(t))), lambda g: g.isNotNull()))


def diff_lines(diff: Column, sign: str) -> Column:
    """Lines of a unified diff with a sign, without it; file headers are left out."""
    lines = F.filter(F.split(F.coalesce(diff, F.lit("")), "\\r\\n|\\n|\\r"), lambda x: x.startswith(sign) & ~x.startswith(sign * 3))
    return F.transform(lines, lambda x: F.substr(x, F.lit(2)))


def _with_hole(lines: Column) -> Column:
    return F.size(F.filter(lines, lambda x: x.rlike(vocab.java(vocab.HOLE))))


def proof_style(ssreflect: Column, term: Column, tactic: Column) -> Column:
    """Styles by what the added lines show."""
    both = term & tactic
    parts = F.array(
        F.when(ssreflect, "ssreflect"),
        F.when(term & ~both, "term_mode"),
        F.when(tactic & ~ssreflect & ~both, "tactic_mode"),
        F.when(both, "mixed"),
        F.when(~ssreflect & ~term & ~tactic, "unknown"),
    )
    return F.filter(parts, lambda s: s.isNotNull())


def with_diff_signals(df: DataFrame, diff: str = "diff") -> DataFrame:
    """Adds sorry_removed, net_proof_lines, added_count, removed_count, tactic_tags and proof_style; a null or empty diff has none of them."""
    empty = F.coalesce(F.col(diff), F.lit("")) == ""
    staged = df.withColumn("_added", diff_lines(F.col(diff), "+")).withColumn("_removed", diff_lines(F.col(diff), "-"))
    staged = staged.withColumn("_text", F.array_join("_added", "\n"))
    staged = staged.withColumn("_tags", _distinct_lower(F.regexp_extract_all("_text", F.lit(vocab.java(vocab.tactic_pattern().replace("(?im)", "(?imd)"))), F.lit(1))))
    style = proof_style(F.col("_text").rlike("(?mdU)" + vocab.SSREFLECT), F.col("_text").rlike(vocab.java(vocab.TERM_MODE)), F.size("_tags") > 0)
    none = F.array().cast("array<string>")
    return staged.withColumns(
        {
            "sorry_removed": _with_hole(F.col("_removed")) > _with_hole(F.col("_added")),
            "net_proof_lines": F.size("_added") - F.size("_removed"),
            "added_count": F.size("_added"),
            "removed_count": F.size("_removed"),
            "tactic_tags": F.when(empty, none).otherwise(F.col("_tags")),
            "proof_style": F.when(empty, none).otherwise(style),
        }
    ).drop("_added", "_removed", "_text", "_tags")


def diff_class(before: Column, has_files: Column, sorry_removed: Column, net_lines: Column) -> Column:
    """The class after the diff pass: new proofs and changed statements stay, as do commits without proof files."""
    return (
        F.when(~has_files | before.isin("proof_new", "spec_change"), before)
        .when(sorry_removed, "proof_complete")
        .when(net_lines < 0, "proof_optimise")
        .otherwise("proof_add")
    )


def enriched(commits: DataFrame) -> DataFrame:
    """The message pass over commit records."""
    return commits.withColumns(
        {
            "commit_class": commit_class(F.col("message_subject"), F.col("message_body"), F.col("touches_proof_files"), F.col("insertions"), F.col("deletions")),
            "keywords": keywords(F.col("message_subject"), F.col("message_body")),
            "class_confidence": F.lit("heuristic"),
        }
    )


def diff_enriched(commits: DataFrame, diff: str = "diff") -> DataFrame:
    """The diff pass: commits without a parent or without proof files have an empty diff."""
    has_files = F.size("coq_files_changed") > 0
    usable = F.when(has_files & (F.size("parent_hashes") > 0), F.col(diff))
    out = with_diff_signals(commits.withColumn("_diff", usable), "_diff").drop("_diff")
    return out.withColumn("commit_class", diff_class(F.col("commit_class"), has_files, F.col("sorry_removed"), F.col("net_proof_lines"))).withColumn("class_confidence", F.when(has_files, "diff").otherwise(F.col("class_confidence")))


def task_id(repo: Column, commit: Column, path: Column) -> Column:
    raw = F.concat_ws("_", repo, F.substring(commit, 1, 12), path)
    return F.concat_ws("_", repo, F.substring(commit, 1, 8), F.substring(F.sha2(raw, 256), 1, 8))


def instructions(holes: Column, path: Column) -> Column:
    """The request text for an array of holes (kind, enclosing_decl)."""
    named = F.array_join(F.transform(holes, lambda h: F.concat(h["kind"], F.lit(" in "), F.when(h["enclosing_decl"] == "", "unknown").otherwise(h["enclosing_decl"]))), ", ")
    return F.concat(F.lit("Fill in the proof(s) marked with placeholder tactics ("), named, F.lit(") in "), path, F.lit("."))
