"""Views that give the driver's tables the shapes of commits, diffs, lines, timelines and runs.

Each view stands twice, as a DataFrame and as SQL for the oracle, from the same
banks of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUBJECTS = [
    "Bump dependency version", "Close proof of lemma foo", "Remove sorry from theorem bar", "Generalize statement of main result", "Add lemma about word size",
    "WIP: apply induction tactic", "Refactor module layout", "Fix bug in parser", "Prove montgomery correct", "Update docs", "rename files and clean up",
    "proof cleanup", "Simplify rewrite rules with ring", "Finish admitted proof", "CI: proof checks", "Issue with docker build",
]
BODIES = ["", "", "no more sorry here", "", "theorem and corollary", "more cases", "", "workaround for regression", "p256 and curve25519", "", "", "", "simplif destructur", "qed", "coq tactic", ""]
DIFFS = [
    "--- a/x.v\n+++ b/x.v\n+Proof.\n+  intros x.\n+  simpl; auto.\n+Qed.\n-Admitted.",
    "+ repeat rewrite foo.\n+ lia.\n- omega.\n- omega.\n- ring.",
    "-Lemma a : b.\n-Proof. auto. Qed.",
    "+Definition f := fun x => x.\n+ exact (conj a b).",
    "+  move/eqP: H => H.\n+  rewrite /foo.\n+  by case: x.",
    "+let x := 3 in x",
    "",
    " context only\n@@ -1,3 +1,3 @@",
    "+admit.\n-sorry\n-oops",
    "+  apply: foo.\n+match x with _ => y end",
    "+wlog H : x.\n+destruct x; congruence.\n+- unfold f.",
    "+(* intros *) text\n-text",
]
COMMIT_SQL_LIST = lambda xs: "[" + ", ".join("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in xs) + "]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(bank: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in bank]), (index + 1).cast("int"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    path = F.concat(F.lit("src/F"), (F.col("user_id") % 20).cast("string"), F.lit(".v"))
    touches = i % 10 < 7
    sha = lambda c: F.sha2(c.cast("string"), 256)
    return e.select(
        i.alias("_pos"),
        sha(i).alias("hash"),
        F.when(i % 97 == 0, F.array().cast("array<string>")).otherwise(F.array(sha(i - 1))).alias("parent_hashes"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("author"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("date"),
        _pick(SUBJECTS, i % 16).alias("message_subject"),
        _pick(BODIES, (i / 3).cast("long") % 16).alias("message_body"),
        (i % 37).cast("int").alias("insertions"),
        (i % 100).cast("int").alias("deletions"),
        F.when(touches, F.array(path)).otherwise(F.array(F.lit("README.md"))).alias("changed_files"),
        F.when(touches, F.array(path)).otherwise(F.array().cast("array<string>")).alias("coq_files_changed"),
        touches.alias("touches_proof_files"),
        _pick(DIFFS, i % 12).alias("diff"),
    )


COMMITS = f"""base as (select event_id as i, user_id, ts, event_id % 10 < 7 as touches, 'src/F' || (user_id % 20) || '.v' as path from events),
commits as (select i as _pos, sha256(i::varchar) as hash, case when i % 97 = 0 then [] else [sha256((i - 1)::varchar)] end as parent_hashes,
 'user' || user_id as author, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') as date, ({COMMIT_SQL_LIST(SUBJECTS)})[(i % 16 + 1)::int] as message_subject,
 ({COMMIT_SQL_LIST(BODIES)})[((i // 3) % 16 + 1)::int] as message_body, (i % 37)::int as insertions, (i % 100)::int as deletions,
 case when touches then [path] else ['README.md'] end as changed_files, case when touches then [path] else [] end as coq_files_changed,
 touches as touches_proof_files, ({COMMIT_SQL_LIST(DIFFS)})[(i % 12 + 1)::int] as diff from base)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as files."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))


# Line breaks of the texts are \n alone; a last empty line doesn't count.
LINES = """lines as (select doc_id, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) as text, unnest(range(1, len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) + 1)) as line
 from documents where text <> '')"""
DECLARATION = r"^\s*([A-Z]\w+)"
#: The same where \w covers ASCII only, and a text in which other letters are ASCII ones, as long as before.
DECLARATION_SQL = r"^\s*([A-Z][\p{L}\p{N}_]+)"
PLAIN = r"regexp_replace(regexp_replace(text, '[^\x00-\x7F\p{L}\p{N}]', ' ', 'g'), '[^\x00-\x7F]', 'x', 'g')"
MARKER = "the"


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as lifecycle records: one declaration each, its turns as commits."""
    c = table(spark, sf_dir, "conversations")
    words = lambda pattern: F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^ -~]", "x"), F.lit(pattern), F.lit(1)))
    rows = c.select(
        "conv_id",
        "turn",
        F.concat(F.lit("2024-01-"), F.lpad((F.col("turn") % 27 + 1).cast("string"), 2, "0"), F.lit("T00:00:00+00:00")).alias("date"),
        F.sha2(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")), 256).alias("hash"),
        "role",
        words(r"\b(in|on|an|is)\b").alias("groups"),
        words(r"\b(the|of|and|to|a|for)\b").alias("tags"),
        (F.length(F.coalesce("text", F.lit(""))) % 90 - 40).cast("int").alias("net"),
    )
    entry = F.struct("date", "turn", "hash", F.col("role").alias("subject"), F.col("role").alias("commit_class"), F.col("groups").alias("tactic_groups"), F.col("tags").alias("tactic_tags"), F.col("net").alias("net_proof_lines"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("commit_timeline"))
    groups = F.array_distinct(F.flatten(F.transform("commit_timeline", lambda e: e["tactic_groups"])))
    return grouped.select(
        F.concat(F.lit("d"), F.col("conv_id").cast("string")).alias("declaration"),
        F.concat(F.lit("src/F"), (F.col("conv_id") % 30).cast("string"), F.lit(".v")).alias("file"),
        F.lit("admitted").alias("hole_kind"),
        F.element_at("commit_timeline", 1)["date"].alias("first_hole_date"),
        F.element_at("commit_timeline", -1)["date"].alias("proof_complete_date"),
        F.when(F.col("conv_id") % 11 == 0, F.lit(-1)).otherwise((F.col("conv_id") % 50).cast("int")).alias("days_to_prove"),
        F.size("commit_timeline").alias("n_commits_with_hole"),
        F.size(groups).alias("n_tactic_groups"),
        groups.alias("tactic_groups_used"),
        "commit_timeline",
    )


TURNS = r"""turns as (select conv_id, turn, '2024-01-' || lpad((turn % 27 + 1)::varchar, 2, '0') || 'T00:00:00+00:00' as date, sha256(conv_id::varchar || ':' || turn::varchar) as hash, role,
 list_distinct(regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[^ -~]', 'x', 'g'), '\b(in|on|an|is)\b', 1)) as groups, list_distinct(regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[^ -~]', 'x', 'g'), '\b(the|of|and|to|a|for)\b', 1)) as tags,
 (length(coalesce(text, '')) % 90 - 40)::int as net, 'd' || conv_id as declaration, 'src/F' || (conv_id % 30) || '.v' as file from conversations),
decls as (select declaration, file, case when conv_id % 11 = 0 then -1 else (conv_id % 50)::int end as days, count(*)::int as n from turns group by conv_id, declaration, file),
used as (select distinct declaration, file, unnest(groups) as grp from turns)"""
BUCKET7 = "case when n <= 1 then '1' when n <= 3 then '2-3' when n <= 5 then '4-5' when n <= 10 then '6-10' when n <= 20 then '11-20' when n <= 50 then '21-50' else '51+' end"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as evaluation results."""
    li = table(spark, sf_dir, "lineitem")
    q, k = F.col("l_quantity"), F.col("l_orderkey")
    whole = lambda c: c.cast("long")

    def metrics(price: Column, factor: int) -> Column:
        return F.struct(
            (k % 7 + factor).cast("int").alias("tactic_count"),
            whole(price).alias("vo_bytes"),
            F.when(k % 5 != 0, q / 4).alias("compile_time_s"),
            F.when(k % 6 != 0, (k % 4 * factor).cast("int")).alias("n_assumptions"),
            (whole(price) % 1000).cast("int").alias("proof_chars"),
            (whole(q) % 9).cast("int").alias("proof_lines"),
            ((k % 13 == 0) & F.lit(factor == 1)).alias("ends_with_admitted"),
        )

    return li.select(
        F.when(F.col("l_linestatus") == "F", "agent").otherwise("baseline").alias("mode"),
        F.when(k % 50 != 0, F.col("l_linenumber")).alias("deletion_size"),
        F.when(F.col("l_linenumber") % 2 == 0, "A").otherwise("B").alias("condition"),
        F.when(F.col("l_returnflag") == "N", "PASS").when(F.col("l_returnflag") == "R", "FAIL").when(k % 3 == 0, "ADMITTED").when(k % 3 == 1, "TIMEOUT").otherwise("ERROR").alias("verdict"),
        (q / 8).alias("inference_time_s"),
        whole(q * 3).cast("int").alias("output_tokens"),
        F.when(k % 4 != 0, (whole(q) % 8).cast("int")).alias("tactic_edit_distance"),
        F.when(k % 4 != 0, (whole(q) % 8) / 8).alias("normalized_edit_distance"),
        (k % 40).cast("int").alias("agent_n_turns"),
        F.when(k % 9 != 0, metrics(F.col("l_extendedprice"), 1)).alias("llm_metrics"),
        F.when(k % 10 != 0, metrics(F.col("l_extendedprice") * (k % 3), 2)).alias("human_metrics"),
    )


RUNS = """r0 as (select *, l_orderkey as k, trunc(l_quantity)::bigint as qi, trunc(l_extendedprice)::bigint as lp, trunc(l_extendedprice * (l_orderkey % 3))::bigint as hp from lineitem),
runs as (select case when l_linestatus = 'F' then 'agent' else 'baseline' end as mode, case when k % 50 <> 0 then l_linenumber end as deletion_size, case when l_linenumber % 2 = 0 then 'A' else 'B' end as condition,
 case when l_returnflag = 'N' then 'PASS' when l_returnflag = 'R' then 'FAIL' when k % 3 = 0 then 'ADMITTED' when k % 3 = 1 then 'TIMEOUT' else 'ERROR' end as verdict,
 l_quantity / 8 as inference_time_s, trunc(l_quantity * 3)::int as output_tokens, case when k % 4 <> 0 then qi % 8 end as ted, case when k % 4 <> 0 then (qi % 8) / 8 end as ned, (k % 40)::int as turns,
 case when k % 9 <> 0 then {'tactic_count': k % 7 + 1, 'vo_bytes': lp, 'compile_time_s': case when k % 5 <> 0 then l_quantity / 4 end, 'n_assumptions': case when k % 6 <> 0 then k % 4 end, 'proof_chars': lp % 1000, 'proof_lines': qi % 9, 'ends_with_admitted': k % 13 = 0} end as m,
 case when k % 10 <> 0 then {'tactic_count': k % 7 + 2, 'vo_bytes': hp, 'compile_time_s': case when k % 5 <> 0 then l_quantity / 4 end, 'n_assumptions': case when k % 6 <> 0 then k % 4 * 2 end, 'proof_chars': hp % 1000, 'proof_lines': qi % 9} end as h from r0)"""
