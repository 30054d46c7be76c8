"""Expressions over file texts, compiler output and display values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def patch_admitted(content: Column, name: Column, tactics: Column) -> Column:
    """Replaces the first line with only ``Admitted.`` after the name by tactics at its indentation; else unchanged."""
    at = F.instr(content, name)
    rest = F.substr(content, at)
    pattern = r"(?sm)\A(.*?)(^\s*)Admitted\.\s*$(.*)\z"
    before, indent, after = (F.regexp_extract(rest, pattern, i) for i in (1, 2, 3))
    lines = F.transform(F.split(F.trim(F.regexp_replace(tactics, r"\A\s+|\s+\z", "")), "\n"), lambda x: F.when(F.trim(x) == "", x).otherwise(F.concat(indent, x)))
    patched = F.concat(F.substr(content, F.lit(1), at - 1), before, F.array_join(lines, "\n"), after)
    return F.when((at > 0) & F.regexp_like(rest, F.lit(r"(?m)^\s*Admitted\.\s*$")), patched).otherwise(content)


def first_bytes(text: Column, n: int) -> Column:
    """At most n bytes of UTF-8; a split character becomes the replacement character."""
    raw = F.encode(text, "UTF-8")
    return F.when(F.octet_length(text) <= n, text).otherwise(F.call_function("make_valid_utf8", F.substring(raw, 1, n).cast("string")))


def axioms(stdout: Column) -> Column:
    """Names in the block after ``Axioms:``, up to a blank line or the closing notice."""
    lines = F.transform(F.split(F.regexp_replace(stdout, r"\r\n?", "\n"), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\A\s+|\s+\z", "")))
    start = F.struct(F.lit(0).alias("state"), F.array().cast("array<string>").alias("names"))

    def step(s: Column, line: Column) -> Column:
        head = line.startswith("Axioms:")
        rest = F.trim(F.substr(line, F.lit(8)))
        name = lambda x: F.trim(F.split_part(x, F.lit(":"), F.lit(1)))
        stop = (line == "") | (line == "Closed under the global context.")
        added = F.when((s["state"] == 0) & head & (rest != ""), F.array(name(rest))).when((s["state"] == 1) & ~stop, F.array(name(line))).otherwise(F.array().cast("array<string>"))
        state = F.when((s["state"] == 0) & head, 1).when((s["state"] == 1) & stop, 2).otherwise(s["state"])
        return F.struct(state.alias("state"), F.concat(s["names"], added).alias("names"))

    return F.filter(F.aggregate(lines, start, step, lambda s: s["names"]), lambda x: x != "")


def verdict(exit_code: Column, ends_with_admitted: Column) -> Column:
    """PASS, ADMITTED, TIMEOUT, ERROR or FAIL from an exit code and the proof's end."""
    return F.when((exit_code == 0) & F.coalesce(ends_with_admitted, F.lit(False)), "ADMITTED").when(exit_code == 0, "PASS").when(exit_code == 124, "TIMEOUT").when(exit_code == 127, "ERROR").otherwise("FAIL")


def give_up_reason(has_verdict: Column, stated: Column, succeeded: Column, limit_hit: Column, error: Column) -> Column:
    finished = F.when(F.coalesce(stated, F.lit("")) != "", stated).when(succeeded, "compile_success").otherwise("completed_without_success")
    return F.when(has_verdict, finished).when(limit_hit, "turn_limit_exceeded").otherwise(F.when(F.coalesce(error, F.lit("")) != "", error).otherwise("run_failed"))


def version_tag(version: Column) -> Column:
    return F.regexp_replace(version, r"\.0$", "")


def _first_release(found: Column, unstable: tuple[str, ...]) -> Column:
    """The first entry that is no moving branch, else the first."""
    stable = F.filter(found, lambda v: ~v.isin(*unstable))
    return F.coalesce(F.try_element_at(stable, F.lit(1)), F.try_element_at(found, F.lit(1)))


def docker_version(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"""DOCKER_COQ_VERSION\s*:\s*["']?([^"',}\s]+)"""), F.lit(1))
    return F.when(F.size(found) > 0, F.coalesce(F.try_element_at(F.filter(found, lambda v: v != "dev"), F.lit(1)), F.lit("dev")))


def opam_version(text: Column) -> Column:
    quoted = F.lit(r"""['"]([^'"]+)['"]""")
    inline = F.regexp_extract_all(F.regexp_extract(text, r"coq-version\s*:\s*\[([^\]]*)\]", 1), quoted, F.lit(1))
    listed = F.regexp_extract_all(F.regexp_extract(text, r"""coq-version\s*:\s*\n((?:\s*-\s*['"][^'"]+['"]\s*\n?)+)""", 1), quoted, F.lit(1))
    return F.coalesce(_first_release(inline, ("dev", "master")), _first_release(listed, ("dev", "master")))


def debian_version(text: Column) -> Column:
    return F.when(F.trim(F.coalesce(text, F.lit(""))) != "", "dev")


def travis_version(text: Column) -> Column:
    line = r'COQ_VERSION\s*=\s*"([^"]+)"[^\n]*?COQ_PACKAGE\s*=\s*"([^"]+)"'
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(line), F.lit(1)).alias("v"), F.regexp_extract_all(text, F.lit(line), F.lit(2)).alias("p"))

    def one(x: Column) -> Column:
        package = F.regexp_extract(x["p"], r"\Acoq-(\d+\.\d+(?:\.\d+)?)\z", 1)
        hint = F.regexp_extract(x["v"], r"\Av?(\d+\.\d+(?:\.\d+)?)\z", 1)
        return F.when(x["v"] != "master", F.when(package != "", package).when(hint != "", hint))

    return F.try_element_at(F.filter(F.transform(both, one), lambda v: v.isNotNull()), F.lit(1))


def detected_version(docker: Column, opam: Column, debian: Column, travis: Column) -> Column:
    """The first of four sources that tells a version; a null source is missing."""
    return version_tag(F.coalesce(docker_version(docker), opam_version(opam), debian_version(debian), travis_version(travis)))


def module_path(path: Column, flags: Column) -> Column:
    """Dotted module of a file by the longest folder among flags (folder, prefix); the first of equals wins, null if none covers it."""
    target = F.regexp_replace(F.regexp_replace(path, r"\.vo?$", ""), r"\A[./]+", "")

    def scored(f: Column, i: Column) -> Column:
        folder = F.regexp_replace(f["folder"], r"/+$", "")
        base = F.when(folder.isin("", "."), "").otherwise(F.concat(folder, F.lit("/")))
        rest = F.translate(F.substr(target, F.length(base) + 1), "/", ".")
        module = F.when(f["prefix"] == "", rest).otherwise(F.concat_ws(".", f["prefix"], rest))
        return F.when((base == "") | target.startswith(base), F.struct(F.length(base).alias("score"), (-i).alias("order"), module.alias("module")))

    return F.array_max(F.filter(F.transform(flags, scored), lambda x: x.isNotNull()))["module"]


def short_hash(sha: Column, n: int = 8) -> Column:
    return F.lower(F.substring(sha, 1, n))


def day(date: Column) -> Column:
    """The day of an ISO date, a dash for none."""
    return F.when(F.coalesce(date, F.lit("")) == "", "—").otherwise(F.substring(date, 1, 10))


def byte_size(n: Column) -> Column:
    return F.when(n > 1_000_000, F.format_string("%.1f MB", n / 1e6)).when(n > 1_000, F.format_string("%.1f KB", n / 1e3)).otherwise(F.format_string("%d B", n.cast("long")))


def complexity_dots(n: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.when(i <= n, "●").otherwise("○")), " ")


def code_label(code: Column) -> Column:
    return F.replace(code, F.lit("_"), F.lit(" "))


def bar(percent: Column) -> Column:
    """One block for each two percent."""
    return F.repeat(F.lit("█"), F.floor(percent / 2).cast("int"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def trajectory_prompt(r: dict[str, Column]) -> Column:
    """The prompt for one declaration: head lines, then its timeline (date, hash, author, subject, body, commit_class, net, tags, style)."""
    joined = lambda xs: F.array_join(F.coalesce(xs, F.array().cast("array<string>")), ", ")
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("## Declaration: `"), r["declaration"], F.lit("`")),
        F.concat(F.lit("**File:** `"), r["file"], F.lit("`")),
        F.concat(F.lit("**Hole kind:** "), r["hole_kind"]),
        F.concat(F.lit("**First hole:** "), r["first_hole_date"]),
        F.concat(F.lit("**Proof completed:** "), r["proof_complete_date"]),
        F.concat(F.lit("**Days to prove:** "), r["days_to_prove"].cast("string")),
        F.concat(F.lit("**Commits touching this proof:** "), r["n_commits_with_hole"].cast("string")),
        F.concat(F.lit("**Top tactics used:** "), joined(F.slice(r["top_tactics"], 1, 15))),
        F.concat(F.lit("**Tactic groups:** "), joined(r["tactic_groups_used"])),
        F.lit(""),
        F.lit("### Commit Timeline"),
        F.lit(""),
    )

    def one(e: Column, i: Column) -> Column:
        optional = lambda x, label: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(label), x))
        return F.concat_ws(
            "\n",
            F.concat(F.lit("**Commit "), (i + 1).cast("string"), F.lit("** ("), F.substring(e["date"], 1, 10), F.lit(")")),
            F.concat(F.lit("- Hash: `"), F.substring(e["hash"], 1, 12), F.lit("`")),
            F.concat(F.lit("- Author: "), e["author"]),
            F.concat(F.lit("- Subject: "), e["subject"]),
            optional(F.substring(e["message_body"], 1, 500), "- Body: "),
            F.concat(F.lit("- Class: "), e["commit_class"]),
            F.concat(F.lit("- Net proof lines: "), F.format_string("%+d", e["net_proof_lines"])),
            optional(joined(F.slice(e["tactic_tags"], 1, 20)), "- Tactics: "),
            optional(joined(e["proof_style"]), "- Style: "),
            F.lit(""),
        )

    closing = F.lit("Analyze this proof's evolution. What does the trajectory reveal about the human proof engineering process?")
    return F.concat(head, F.lit("\n"), F.array_join(F.transform(r["timeline"], one), "\n"), F.lit("\n"), closing)


def parsed_keywords(reply: Column) -> Column:
    """A model's JSON list of words in lower case; anything else gives none."""
    return F.transform(F.coalesce(F.from_json(reply, "array<string>"), F.array().cast("array<string>")), F.lower)
