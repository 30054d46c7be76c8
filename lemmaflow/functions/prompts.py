"""Prompt texts. The wording is part of recorded runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def full(name: Column, content: Column) -> Column:
    return F.concat(F.lit("The proof of `"), name, F.lit("` is replaced entirely by `Admitted.`.\nWrite the complete tactic proof body (tactics only, ending with Qed.).\n\nFILE:\n"), content)


def partial(name: Column, content: Column, n: Column) -> Column:
    return F.concat(F.lit("The last "), n.cast("string"), F.lit(" tactic sentences of the proof of `"), name, F.lit("` have been removed and replaced with `Admitted.`.\nWrite only those missing tactic lines (ending with Qed.) to complete the proof.\n\nFILE:\n"), content)


def agent_full(name: Column, path: Column) -> Column:
    return F.concat(F.lit("The proof of `"), name, F.lit("` has been replaced entirely by `Admitted.`.\nThe challenge file is `"), path, F.lit("`. Use `read_file` to inspect it, then write and compile a complete tactic proof ending with `Qed.`."))


def agent_partial(name: Column, path: Column, n: Column) -> Column:
    return F.concat(F.lit("The last "), n.cast("string"), F.lit(" tactic sentences of the proof of `"), name, F.lit("` have been removed and replaced with `Admitted.`.\nThe challenge file is `"), path, F.lit("`. Use `read_file` to inspect the proof context around `"), name, F.lit("`, then supply only the missing tactics ending with `Qed.`."))
