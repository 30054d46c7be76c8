"""The registered queries over the driver's tables, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas, vocab
from ..functions import commits as C
from ..functions import proofs as P
from ..functions import prompts
from ..functions import texts as X
from ..functions.diffs import unified_diff
from ..operators import datasets as D
from ..operators import evaluation as E
from ..operators import explore as Q
from ..operators import holes as H
from ..operators import lifecycle as L
from ..operators import report as P_
from ..sources import gitlog as G
from ..sources import records as R
from . import commands
from . import views as V
from .scratch import fresh_path, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at a fixed number of digits, so that the order of sums doesn't show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _joined(column: str) -> F.Column:
    return F.array_join(F.coalesce(column, F.array().cast("array<string>")), ",")


def _sorted(column: str) -> F.Column:
    return F.array_join(F.array_sort(column), ",")


# --- SQL of the message and diff passes, from the same banks of patterns ---
def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _m(text: str, name: str) -> str:
    return f"regexp_matches({text}, '{_q(vocab.bank(name))}')"


_TEXT, _SUBJECT = "lower(message_subject || ' ' || message_body)", "lower(message_subject)"
_CLASS = f"""case when {_m(_SUBJECT, 'infra')} and not {_m(_SUBJECT, 'context')} then 'infra'
 when {_m(_TEXT, 'complete')} and {_m(_TEXT, 'context')} then 'proof_complete'
 when touches_proof_files and deletions > insertions and message_body = '' and {_m(_TEXT, 'context')} and not {_m(_TEXT, 'infra')} then 'proof_complete'
 when {_m(_TEXT, 'spec')} and touches_proof_files then 'spec_change'
 when {_m(_TEXT, 'new')} and touches_proof_files then 'proof_new'
 when {_m(_TEXT, 'add')} and touches_proof_files then 'proof_add'
 when touches_proof_files and ({_m(_TEXT, 'refactor')} or {_m(_TEXT, 'fix')}) then 'proof_add'
 when {_m(_TEXT, 'refactor')} then 'refactor' when {_m(_TEXT, 'fix')} then 'fix'
 when touches_proof_files then 'proof_add' else 'other' end"""
_KEYWORDS = f"list_distinct(list_transform(regexp_extract_all(message_subject || ' ' || message_body, '{_q(vocab.keyword_pattern())}', 1), lambda x: lower(x)))"
_LINES = lambda sign: f"list_transform(list_filter(string_split(diff, chr(10)), lambda x: starts_with(x, '{sign}') and not starts_with(x, '{sign * 3}')), lambda x: x[2:])"
_HOLES = lambda xs: f"len(list_filter({xs}, lambda x: regexp_matches(x, '{_q(vocab.HOLE)}')))"
_ENRICHED = f"""with {V.COMMITS},
heur as (select *, {_CLASS} as message_class, {_KEYWORDS} as keywords from commits),
d0 as (select * replace (case when len(coq_files_changed) > 0 and len(parent_hashes) > 0 then diff else '' end as diff) from heur),
d1 as (select *, {_LINES('+')} as added, {_LINES('-')} as removed from d0),
d2 as (select *, array_to_string(added, chr(10)) as added_text from d1),
d3 as (select *, list_distinct(list_transform(regexp_extract_all(added_text, '{_q(vocab.tactic_pattern())}', 1), lambda x: lower(x))) as tags, regexp_matches(added_text, '(?m){_q(vocab.SSREFLECT)}') as ssr, regexp_matches(added_text, '{_q(vocab.TERM_MODE)}') as term from d2),
enr as (select *, {_HOLES('removed')} > {_HOLES('added')} as sorry_removed, len(added)::int - len(removed)::int as net,
 case when diff = '' then '' else concat_ws(',', case when ssr then 'ssreflect' end, case when term and not len(tags) > 0 then 'term_mode' end, case when len(tags) > 0 and not ssr and not term then 'tactic_mode' end, case when term and len(tags) > 0 then 'mixed' end, case when not ssr and not term and len(tags) = 0 then 'unknown' end) end as style from d3),
fin as (select *, case when len(coq_files_changed) = 0 or message_class in ('proof_new', 'spec_change') then message_class when sorry_removed then 'proof_complete' when net < 0 then 'proof_optimise' else 'proof_add' end as commit_class from enr)"""
_GROUP_CASE = "case t " + " ".join(f"when '{t}' then '{g}'" for t, g in vocab.GROUP_OF.items()) + " end"


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.enriched(V.commits(spark, sf_dir))


def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits after the message pass, the diff pass and grouping."""
    out = C.diff_enriched(enriched(spark, sf_dir))
    return out.withColumns({"tactic_group_tags": C.tactic_groups(F.col("tactic_tags")), "diff_sorry_removed": F.col("sorry_removed"), "diff_net_proof_lines": F.col("net_proof_lines")})


# --- sources ---
@query(f"with {V.COMMITS} select hash, array_to_string(parent_hashes, ' ') as parents, author, date, message_subject, message_body, 2 as files_changed_count, insertions, deletions, changed_files[1] as first_path, touches_proof_files from commits")
def src_log_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw log records, with a binary file and a line that is no numstat."""
    c = V.commits(spark, sf_dir)
    head = F.concat_ws(G.FIELD, "hash", F.array_join("parent_hashes", " "), "author", F.lit("a@b"), "date", "message_subject", "message_body")
    raw = F.concat(head, F.lit(G.BLOCK + "\n"), "insertions", F.lit("\t"), "deletions", F.lit("\t"), F.col("changed_files")[0], F.lit("\n-\t-\timg.png\nno numstat\nx\ty\tz.v\n"))
    out = G.decoded(c.select(raw.alias("value")))
    return out.select("hash", F.array_join("parent_hashes", " ").alias("parents"), "author", "date", "message_subject", "message_body", "files_changed_count", "insertions", "deletions", F.col("changed_files")[0].alias("first_path"), "touches_proof_files")


@query(f"with {V.COMMITS} select hash, coalesce(parent_hashes[1], '') as parent_hash, author, date, message_subject as message from commits where _pos % 10 <> 3")
def src_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUL-separated headers; short lines are left out."""
    c = V.commits(spark, sf_dir)
    line = F.when(F.col("_pos") % 10 == 3, F.concat_ws(G.NUL, "hash", "author")).otherwise(F.concat_ws(G.NUL, "hash", F.array_join("parent_hashes", " "), "author", "date", "message_subject"))
    return G.headers(c.select(line.alias("value")))


@query("""with b as (select lang as commit_hash, doc_id::varchar as path, text as content from documents where doc_id % 3 = 0), r as (select lang as commit_hash, (doc_id - doc_id % 2)::varchar as path, doc_id from documents)
select doc_id, r.commit_hash, r.path, length(content) as n from r left join b using (commit_hash, path)""")
def src_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of (commit, path), null where missing."""
    d = V.table(spark, sf_dir, "documents")
    blobs = d.where("doc_id % 3 = 0").select(F.col("lang").alias("commit_hash"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    asked = d.select("doc_id", F.col("lang").alias("commit_hash"), (F.col("doc_id") - F.col("doc_id") % 2).cast("string").alias("path"))
    return G.files_at(asked, blobs).select("doc_id", "commit_hash", "path", F.length("content").cast("long").alias("n"))


@query("select event_id, case when event_id % 4 = 0 then 'M' else 'A' end as status, event_type || case when event_id % 3 = 0 then '.v' else '.ml' end as path from events where event_id % 4 = 0 and event_id % 3 = 0")
def src_modified_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modified files with a proof extension."""
    e = V.table(spark, sf_dir, "events")
    status = e.select("event_id", F.when(F.col("event_id") % 4 == 0, "M").otherwise("A").alias("status"), F.concat("event_type", F.when(F.col("event_id") % 3 == 0, ".v").otherwise(".ml")).alias("path"))
    return G.modified_proof_files(status, vocab.LANGUAGES["coq"].extension)


@query("select 'h' || event_id as hash, 'user' || user_id as author, (event_id % 37)::int as insertions, '' as message_body from events where event_id % 5 not in (3, 4)")
def src_records_permissive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank and malformed lines are left out, missing fields get defaults."""
    e = V.table(spark, sf_dir, "events")
    good = F.to_json(F.struct(F.concat(F.lit("h"), F.col("event_id").cast("string")).alias("hash"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("author"), (F.col("event_id") % 37).alias("insertions")))
    line = F.when(F.col("event_id") % 5 == 3, "  ").when(F.col("event_id") % 5 == 4, F.concat(F.lit("{bad "), good)).otherwise(good)
    return R.with_defaults(R.parsed_lines(e.select(line.alias("value")), schemas.COMMIT)).select("hash", "author", "insertions", "message_body")


@query("""with s as (select distinct 'slot' || l_suppkey as slot, case when l_linenumber % 2 = 0 then 'A' else 'B' end as condition, l_linenumber as deletion_size from lineitem where ('slot' || l_suppkey) like '%1%')
select slot, condition, deletion_size from s qualify row_number() over (partition by condition, deletion_size order by slot) <= 3""")
def src_capped_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cap per condition and size, of slots whose name holds a text."""
    li = V.table(spark, sf_dir, "lineitem")
    s = li.select(F.concat(F.lit("slot"), F.col("l_suppkey").cast("string")).alias("slot"), F.when(F.col("l_linenumber") % 2 == 0, "A").otherwise("B").alias("condition"), F.col("l_linenumber").alias("deletion_size")).distinct()
    return D.capped_slots(s, 3, "1")


def _metas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = V.table(spark, sf_dir, "supplier")
    metas = s.select(F.when(F.col("s_suppkey") % 2 == 0, "A").otherwise("B").alias("condition"), F.concat(F.lit("slot"), F.col("s_suppkey").cast("string")).alias("slot"), F.sha2((F.col("s_suppkey") % 7).cast("string"), 256).alias("commit_hash"), F.concat(F.lit("src/"), "s_name", F.lit(".v")).alias("file_path"), "s_suppkey")
    sizes = F.explode(F.array(*[F.lit(n) for n in [-1, *vocab.DELETION_SIZES]])).alias("n")
    files = metas.select("*", sizes).where((F.col("n") == -1) & (F.col("condition") == "A") & (F.col("s_suppkey") % 8 != 0) | (F.col("n") > 0) & (F.col("condition") == "B") & (F.col("s_suppkey") % F.col("n") != 0))
    return metas, files.select("condition", "slot", F.when(F.col("n") == -1, "challenge.v").otherwise(F.concat(F.lit("challenge"), F.col("n").cast("string"), F.lit(".v"))).alias("challenge_file"))


_SLOTS = """m as (select s_suppkey, case when s_suppkey % 2 = 0 then 'A' else 'B' end as condition, 'slot' || s_suppkey as slot, sha256((s_suppkey % 7)::varchar) as commit_hash, 'src/' || s_name || '.v' as file_path from supplier),
slots as (select commit_hash, condition, slot, -1 as deletion_size, 'challenge.v' as challenge_file from m where condition = 'A' and s_suppkey % 8 <> 0 union all
 select commit_hash, condition, slot, n as deletion_size, 'challenge' || n || '.v' as challenge_file from m, (values (3), (5), (7), (10), (15)) t(n) where condition = 'B' and s_suppkey % n <> 0)"""


@query(f"with {_SLOTS} select commit_hash, condition, slot, deletion_size, challenge_file from slots")
def src_slots_for_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots times sizes where the file is there."""
    return D.slots_for_commits(*_metas(spark, sf_dir)).select("commit_hash", "condition", "slot", "deletion_size", "challenge_file")


@query(f"with {_SLOTS} select commit_hash, condition, slot, deletion_size, challenge_file from slots")
def src_run_config_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations as JSON, and their slots back."""
    return D.slots_of_configs(D.run_configs(D.slots_for_commits(*_metas(spark, sf_dir))), schemas.RUN_CONFIG)


@query(f"with {_SLOTS} select distinct commit_hash from m")
def src_distinct_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S19, U7."""
    return _metas(spark, sf_dir)[0].select("commit_hash").distinct()


@query(f"with {_SLOTS} select distinct regexp_replace(file_path, '\\.v$', '.vo') as target from m where commit_hash = sha256('3')")
def src_warm_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S22."""
    import hashlib

    return D.warm_targets(_metas(spark, sf_dir)[0], hashlib.sha256(b"3").hexdigest())


@query(f"with {V.COMMITS} select _pos, message_subject from commits where trim(message_subject) <> '' order by _pos limit 25")
def src_recent_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S23, O10."""
    return G.recent_subjects(V.commits(spark, sf_dir), 25)


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.table(spark, sf_dir, "part")
    folder = F.when(F.col("p_partkey") % 9 == 0, "node_modules/").otherwise("src/")
    return p.select(F.col("p_partkey").alias("_pos"), F.concat(folder, F.lit("f"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 3 == 0, ".v").when(F.col("p_size") % 3 == 1, ".lean").otherwise(".md")).alias("path"))


@query("select case p_size % 3 when 0 then 'coq' else 'lean4' end as assistant, count(*) as n from part where p_partkey % 9 <> 0 and p_size % 3 <> 2 group by 1 order by n desc, min(p_partkey) limit 1")
def src_main_assistant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assistant with the most files outside of skipped folders."""
    return D.main_assistant(_paths(spark, sf_dir))


def _root(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return V.table(spark, sf_dir, "nation").select(F.when(n == 1, "Makefile").when(n == 2, "_CoqProject").when(n == 3, "vendor").when(n == 4, "build").otherwise(F.col("n_name")).alias("name"))


@query("select * from (values ('Makefile', 'coq', 'make'), ('_CoqProject', 'coq', 'coq_makefile')) t(name, assistant, tool) where (select count(*) from nation where n_nationkey in (1, 2)) = 2")
def src_build_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build files at the root."""
    return D.build_systems(_root(spark, sf_dir))


@query("""select case p_size % 3 when 0 then 'coq' else 'lean4' end as assistant, 'Makefile=make,_CoqProject=coq_makefile' as build_files, 'build,vendor' as exclude_paths, 20::bigint as n_sampled
from part where p_partkey % 9 <> 0 and p_size % 3 <> 2 group by 1 order by count(*) desc, min(p_partkey) limit 1""")
def src_repo_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S26."""
    out = D.repo_summary(D.main_assistant(_paths(spark, sf_dir)), _root(spark, sf_dir), V.commits(spark, sf_dir))
    return out.select("assistant", _joined("build_files").alias("build_files"), _joined("exclude_paths").alias("exclude_paths"), "n_sampled")


@query("select case when s_suppkey % 3 = 0 then '-R' else '-Q' end as flag, 'src' || s_suppkey as folder, s_name as prefix from supplier where s_suppkey % 3 <> 2")
def src_project_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S27."""
    s = V.table(spark, sf_dir, "supplier")
    flag = F.when(F.col("s_suppkey") % 3 == 0, "-R").when(F.col("s_suppkey") % 3 == 1, "-Q").otherwise("-arg")
    return D.project_flags(s.select(F.concat(F.lit("  "), flag, F.lit("  src"), F.col("s_suppkey").cast("string"), F.lit(" "), F.replace("s_name", F.lit(" "), F.lit("_")), F.lit(" ")).alias("value")))


# --- classification ---
@query(_ENRICHED + " select hash, message_class as commit_class, array_to_string(list_sort(keywords), ',') as keywords, 'heuristic' as class_confidence from fin")
def classify_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1-X4, U6."""
    return enriched(spark, sf_dir).select("hash", "commit_class", _sorted("keywords").alias("keywords"), "class_confidence")


@query(_ENRICHED + " select message_class as commit_class, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as pct from fin group by 1")
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, W7."""
    return rounded(D.distribution(enriched(spark, sf_dir), "commit_class"))


@query(f"with {V.COMMITS}, t as (select _pos, message_subject, '' as message_body, true as touches_proof_files, 0 as insertions, 0 as deletions from commits) select _pos, {_CLASS} as commit_class from t")
def classify_lone_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X6."""
    return V.commits(spark, sf_dir).select("_pos", C.message_class(F.col("message_subject")).alias("commit_class"))


@query(_ENRICHED + " select _pos, commit_class, sorry_removed, net as net_proof_lines, len(added)::int as added_count, len(removed)::int as removed_count, array_to_string(list_sort(tags), ',') as tactic_tags, style as proof_style, case when len(coq_files_changed) > 0 then 'diff' else 'heuristic' end as class_confidence from fin")
def diff_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X5, X8-X12."""
    return full(spark, sf_dir).select("_pos", "commit_class", "sorry_removed", "net_proof_lines", "added_count", "removed_count", _sorted("tactic_tags").alias("tactic_tags"), _joined("proof_style").alias("proof_style"), "class_confidence")


@query(_ENRICHED + f" select _pos, coalesce(array_to_string(list_sort(list_distinct(list_transform(tags, lambda t: {_GROUP_CASE}))), ','), '') as groups from fin")
def tactic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X7, J12."""
    return full(spark, sf_dir).select("_pos", _sorted("tactic_group_tags").alias("groups"))


@query(_ENRICHED + " , b as (select unnest(tags) as bucket from fin where commit_class = 'proof_add' union all select 'style_' || unnest(string_split(style, ',')) from fin where commit_class = 'proof_add' and style <> '') select bucket, count(*) as n from b group by 1")
def stratify_tactics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes to each tactic's and style's folder."""
    return D.tactic_buckets(full(spark, sf_dir)).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query(_ENRICHED + f" , g as (select unnest(list_distinct(list_transform(tags, lambda t: {_GROUP_CASE}))) as grp from fin) select grp as bucket, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as pct from g where grp is not null group by 1")
def group_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3, A3."""
    return rounded(D.distribution(D.group_buckets(full(spark, sf_dir)), "bucket"))


@query(f"with {V.COMMITS} select hash, case when len(coq_files_changed) > 0 then 0 else 1 end as part from commits")
def split_and_recombine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F2, J7, U1, T16."""
    first, rest = D.split_by_proof_files(V.commits(spark, sf_dir))
    return D.recombined(first, rest).select("hash", F.col("_part").alias("part"))


@query(f"with {V.COMMITS} select hash, 'repo_' || hash[:8] || '_' || sha256('repo_' || hash[:12] || '_' || changed_files[1])[:8] as task_id from commits")
def task_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X13, X38."""
    return V.commits(spark, sf_dir).select("hash", C.task_id(F.lit("repo"), F.col("hash"), F.col("changed_files")[0]).alias("task_id"))


# --- explorer ---
@query(_ENRICHED + " select hash, date, author, message_subject from fin where commit_class = 'proof_add' and list_contains(tags, 'lia') and (contains(lower(message_subject), 'ring') or contains(author, 'ring') or starts_with(hash, 'ring') or len(list_filter(keywords, lambda k: contains(k, 'ring'))) > 0) order by date desc, _pos limit 10 offset 10")
def explore_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters, search, newest first, the second page."""
    found = Q.matching(full(spark, sf_dir), commit_class="proof_add", tactic="lia", search="Ring")
    return Q.page(found, 2, 10).select("hash", "date", "author", "message_subject")


@query(_ENRICHED + " select count(*) as total, ceil(count(*) / 50)::bigint as total_pages from fin where starts_with(hash, 'a') or contains(lower(message_subject), 'a') or contains(author, 'a') or len(list_filter(keywords, lambda k: contains(k, 'a'))) > 0")
def explore_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.page_totals(Q.matching(full(spark, sf_dir), search="a"), 50)


@query(_ENRICHED + " select count(*) as total, min(date) as earliest, max(date) as latest, count(*) filter (sorry_removed) as sorry_removed, sum(insertions)::bigint as total_insertions, sum(deletions)::bigint as total_deletions from fin")
def explore_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5, T1."""
    return Q.totals(full(spark, sf_dir))


@query(_ENRICHED + " select commit_class, count(*) as n, round(count(*) / max(count(*)) over (), 6) as of_most from fin group by 1")
def explore_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5, A37, W8."""
    return rounded(Q.class_counts(full(spark, sf_dir)))


@query(f"with {V.COMMITS} select author, count(*) as n from commits group by 1 order by n desc, min(_pos) limit 15")
def explore_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3."""
    return Q.top_authors(V.commits(spark, sf_dir))


@query(_ENRICHED + " , t as (select _pos, unnest(tags) as tactic from fin) select tactic, count(*) as n, round(count(*) / max(count(*)) over (), 6) as of_most from t group by 1 order by n desc, min(_pos), tactic limit 20")
def explore_tactics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3, A37."""
    return rounded(Q.top_tactics(full(spark, sf_dir)))


@query(_ENRICHED + " select distinct unnest(tags) as tactic from fin")
def explore_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.tactic_choices(full(spark, sf_dir))


# --- holes ---
_HOLES_CTE = rf"""{V.LINES}, named as (select *, coalesce(last_value(nullif(regexp_extract(text, '{V.DECLARATION_SQL}', 1), '') ignore nulls) over (partition by doc_id order by line), '') as enclosing_decl,
 array_to_string(list(text) over (partition by doc_id order by line rows between 3 preceding and 3 following), chr(10)) as context from lines),
hit as (select *, list_transform(regexp_extract_all({V.PLAIN}, '(.*?)\b{V.MARKER}\b', 1), lambda x: length(x)) as steps from named),
holes as (select doc_id, line::int as line, (list_sum(steps[:i])::bigint + (i - 1) * {len(V.MARKER)})::int as "column", '{V.MARKER}' as kind, context, enclosing_decl from (select *, unnest(range(1, len(steps) + 1)) as i from hit where len(steps) > 0))"""


@query(f'with {_HOLES_CTE} select doc_id, line, "column", kind, enclosing_decl, context from holes')
def find_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every marker with its column, declaration and context."""
    return H.found_holes(V.files(spark, sf_dir), ["doc_id"], (V.MARKER,), V.DECLARATION)


@query(f"""with {_HOLES_CTE}, p as (select doc_id // 2 as pair, * from holes where doc_id % 2 = 0), c as (select distinct doc_id // 2 as pair, enclosing_decl from holes where doc_id % 2 = 1)
select pair, count(*) as n_holes, min(line) as first_line from p anti join c using (pair, enclosing_decl) group by pair""")
def filled_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the odd text of a pair filled of the even one."""
    found = H.found_holes(V.files(spark, sf_dir), ["doc_id"], (V.MARKER,), V.DECLARATION).withColumn("pair", F.expr("doc_id div 2")).drop("context")
    filled = H.filled_holes(found.where("doc_id % 2 = 0"), found.where("doc_id % 2 = 1"), ["pair"])
    out = H.challenges(filled, ["pair"])
    return out.select("pair", "n_holes", F.col("holes_filled")[0]["line"].alias("first_line"))


@query("select doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) as chunk from documents")
def line_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L5."""
    return H.line_slice(V.files(spark, sf_dir), ["doc_id"], 2, 4)


@query(f"""with {V.LINES}, w as (select doc_id, line, array_to_string(list(text) over (partition by doc_id order by line rows between 6 preceding and 2 following), chr(10)) as context, row_number() over (partition by doc_id order by line) as k from lines)
select doc_id, context from w where line = 2""")
def placeholder_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wider frame around one line."""
    lines = H.with_context(H.lines_of(V.files(spark, sf_dir), ["doc_id"]), ["doc_id"], 6, 2)
    return lines.where("line = 2").select("doc_id", "context")


@query("select lang, source, count(*) as n_challenges, sum(len(string_split(text, chr(10))))::bigint as n_holes from documents group by grouping sets ((lang), (source), ())")
def challenge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, by assistant and by repository, in one pass."""
    d = V.table(spark, sf_dir, "documents").select("lang", "source", F.size(F.split("text", "\n")).alias("h"))
    return d.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count(F.lit(1)).alias("n_challenges"), F.sum("h").alias("n_holes"))


_LINES_OF = "string_split(regexp_replace(coalesce(text, ''), '\n+$', ''), chr(10))"


@query(f"""with l as (select doc_id, text, regexp_replace(coalesce(text, ''), '\n+$', '') as a, case when regexp_replace(coalesce(text, ''), '\n+$', '') = '' then [] else {_LINES_OF} end as ls from documents),
m as (select *, len(ls) as n, least(len(ls), 3) as m from l)
select doc_id, case when doc_id % 5 = 0 then '' else '--- a/text' || chr(10) || '+++ b/text' || chr(10) || '@@ -' || case m when 0 then '0,0' when 1 then n::varchar else (n - m + 1) || ',' || m end
 || ' +' || case m when 0 then '1' else (n - m + 1) || ',' || (m + 1) end || ' @@' || chr(10) || array_to_string(list_transform(ls[n - m + 1:], lambda x: ' ' || x || chr(10)), '') || '+end ' || doc_id end as diff from m""")
def diff_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unified diffs of texts and the same texts with a line more; every fifth has none."""
    before = F.regexp_replace(F.coalesce("text", F.lit("")), r"\n+\z", "")
    more = F.concat(before, F.when(before == "", "").otherwise("\n"), F.format_string("end %d", "doc_id"))
    d = V.table(spark, sf_dir, "documents").select("doc_id", before.alias("a"), F.when(F.col("doc_id") % 5 == 0, before).otherwise(more).alias("b"))
    return d.select("doc_id", unified_diff("a", "b", F.lit("text")).alias("diff"))


# --- proofs ---
# Proofs are put together from sentences: comments within comments, strings, braces, bullets, repeated tactics.
_COMMENTED = ("\n  intros (* c. (* d. *) e. *) x.", "\n  (* a. *) intros.")
_BRACED, _OTHER = "\n  destruct n as [|m]; { auto; { trivial } }.", "\n  induction n as [|m]; { auto; { trivial } }."
_QUOTED, _AUTO, _BULLET = '\n  rewrite (f "q. r (* x").', "\n  lia.", "\n  - auto."
_TAIL = "\n\nLemma b : y.\nProof.\n  Admitted.\n"


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _steps_sql(repeats: str, braced: str) -> str:
    pick = f"[case k % 3 when 1 then {_sql_text(_COMMENTED[0])} when 2 then {_sql_text(_COMMENTED[1])} end, case when k // 3 % 2 = 1 then {braced} end, case when k // 6 % 2 = 1 then {_sql_text(_QUOTED)} end]"
    return f"list_filter(list_concat({pick}, list_transform(range({repeats}), lambda i: {_sql_text(_AUTO)}), [case when k // 12 % 2 = 1 then {_sql_text(_BULLET)} end]), lambda x: x is not null)"


_PROOFS = f"""with o as (select o_orderkey as k, case o_orderkey % 5 when 0 then 'Admitted.' when 1 then 'Defined.' else 'Qed.' end as term from orders),
p as (select *, {_steps_sql("k % 4", _sql_text(_BRACED))} as human, {_steps_sql("k // 7 % 4", f"case when k % 11 = 0 then {_sql_text(_OTHER)} else {_sql_text(_BRACED)} end")} as model from o),
q as (select *, len(human) as n, least(k % 5, len(human)) as gone, 'Lemma a : x.' || chr(10) || 'Proof.' as head, list_distinct(list_filter(list_transform(human, lambda x: regexp_extract(x, '^\\s*([a-zA-Z_]\\w*)', 1)), lambda x: x <> '')) as names from p)"""


def _proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    digit = lambda by, of: F.floor(k / by) % of

    def steps(repeats: F.Column, braced: F.Column) -> F.Column:
        first = F.when(k % 3 == 1, _COMMENTED[0]).when(k % 3 == 2, _COMMENTED[1]).otherwise("")
        return F.concat(first, F.when(digit(3, 2) == 1, braced).otherwise(""), F.when(digit(6, 2) == 1, _QUOTED).otherwise(""), F.repeat(F.lit(_AUTO), repeats.cast("int")), F.when(digit(12, 2) == 1, _BULLET).otherwise(""))

    term = F.when(k % 5 == 0, "Admitted.").when(k % 5 == 1, "Defined.").otherwise("Qed.")
    whole = lambda body: F.concat(F.lit("Lemma a : x.\nProof."), body, F.lit("\n"), term, F.lit(_TAIL))
    human, model = steps(k % 4, F.lit(_BRACED)), steps(digit(7, 4), F.when(k % 11 == 0, _OTHER).otherwise(_BRACED))
    return V.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(human, F.lit("\n"), term).alias("body"), whole(human).alias("human"), whole(model).alias("model"))


@query(rf"""{_PROOFS}, d as (select *, abs(k % 4 - k // 7 % 4) + case when k // 3 % 2 = 1 and k % 11 = 0 then 1 else 0 end as distance from q)
select k as o_orderkey, n::int as human_count, len(model)::int as model_count, distance::int as distance, round(case when greatest(n, len(model)) > 0 then distance / greatest(n, len(model)) else 0 end, 6)::double as normalized,
 round(case when n > 0 then (k % 4) / n else 0 end, 6)::double as automation, len(names)::int as kinds, case when k // 3 % 2 = 1 then 2 else 0 end as depth, (length(array_to_string(human, '')) + 1 + length(term))::int as chars, (n + 1)::int as n_lines, term = 'Admitted.' as admitted from d""")
def proof_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of two proofs, their metrics and distance."""
    s = _proofs(spark, sf_dir).withColumns({"h": P.extract_sentences("human", F.lit("a")), "m": P.extract_sentences("model", F.lit("a"))})
    d = s.withColumns({"hm": P.proof_metrics(F.col("h")), "model_count": P.tactic_count(F.col("m")), "distance": P.edit_distance(P.tactic_names(F.col("h")), P.tactic_names(F.col("m")))})
    normalized = P.normalized_distance(F.col("distance"), F.col("hm.tactic_count"), F.col("model_count"))
    named = {"human_count": "tactic_count", "automation": "automation_ratio", "kinds": "unique_tactic_types", "depth": "max_bullet_depth", "chars": "proof_chars", "n_lines": "proof_lines", "admitted": "ends_with_admitted"}
    return rounded(d.select("o_orderkey", "model_count", "distance", normalized.alias("normalized"), *[F.col(f"hm.{b}").alias(a) for a, b in named.items()]))


@query(rf"""{_PROOFS} select k as o_orderkey, case when k % 13 = 0 then null when gone = 0 then head || array_to_string(human, '') || chr(10) || term || {_sql_text(_TAIL)}
 else head || array_to_string(human[:n - gone], '') || chr(10) || '  Admitted.' || chr(10) || {_sql_text(_TAIL)} end as content from q""")
def remove_tactics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs with their last tactics removed; null where no declaration has the name."""
    p = _proofs(spark, sf_dir)
    found = P.extract_sentences(F.col("human"), F.when(F.col("o_orderkey") % 13 == 0, "missing").otherwise("a"))
    return p.withColumn("s", found).select("o_orderkey", P.remove_last_tactics(F.col("human"), F.col("s"), (F.col("o_orderkey") % 5).cast("int")).alias("content"))


@query(f"""{_PROOFS}, t as (select *, list_transform(human, lambda x: x[4:]) as xs from q), u as (select *, list_filter(range(1, len(xs) + 1), lambda i: not starts_with(xs[i], '(*')) as steps from t),
v as (select *, steps[greatest(len(steps) - k % 5, 0) + 1:] as gone_at from u)
select k as o_orderkey, array_to_string(list_append(list_transform(list_filter(range(1, len(xs) + 1), lambda i: not list_contains(gone_at, i)), lambda i: xs[i]), '  Admitted.'), chr(10)) as body, array_to_string(list_transform(gone_at, lambda i: xs[i]), '|') as removed from v""")
def remove_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The removal that goes by steps and keeps what begins with a comment."""
    cut = P.remove_last_steps(F.col("body"), (F.col("o_orderkey") % 5).cast("int"))
    return _proofs(spark, sf_dir).select("o_orderkey", cut.alias("c")).select("o_orderkey", "c.body", F.array_join("c.removed", "|").alias("removed"))


@query("select o_orderkey, replace('Lemma b : y.' || chr(10) || 'Proof.' || chr(10) || '  T.' || chr(10) || '  Qed.', 'T', 't' || (o_orderkey % 5)) as patched from orders")
def patch_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X23."""
    o = V.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", X.patch_admitted(F.lit("Lemma b : y.\nProof.\n  Admitted.\n"), F.lit("Lemma b"), F.format_string("t%d.\nQed.", F.col("o_orderkey") % 5)).alias("patched"))


@query(rf"""{_PROOFS}, s as (select *, unnest([5, 7, 10, 15]) as size from q where k % 13 <> 0)
select 'slot' || k as slot, size::int as deletion_size, 'challenge' || size || '.v' as file, case when n = 0 then head || chr(10) || term || {_sql_text(_TAIL)}
 else head || array_to_string(human[:n - least(size, n)], '') || chr(10) || '  Admitted.' || chr(10) || {_sql_text(_TAIL)} end as content from s where (k + size) % 4 <> 0""")
def partial_challenges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X21 over slots: challenge files for all sizes, but for those that are there already."""
    k = F.col("o_orderkey")
    solved = _proofs(spark, sf_dir).select(F.concat(F.lit("slot"), k.cast("string")).alias("slot"), F.when(k % 13 == 0, "missing").otherwise("a").alias("declaration"), F.col("human").alias("solution"), k.alias("k"))
    known = solved.withColumn("n", F.explode(F.array(*map(F.lit, (5, 7, 10, 15))))).where("(k + n) % 4 = 0").select("slot", F.format_string("challenge%d.v", "n").alias("file"))
    return commands.partial_challenges(solved, known)


@query("select o_orderkey, case o_orderkey % 6 when 0 then 'a' when 1 then 'b' when 2 then 'a,b' when 3 then 'c' else '' end as open from orders")
def declarations_with_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block runs to the first end, over later declarations too."""
    o = V.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 6).alias("k"))
    texts = ("Lemma a : x.\nProof.\nAdmitted.\n", "Lemma a : x.\nProof. auto. Qed.\nLemma b : y. Admitted.\n", "Lemma a : x.\nLemma b : y. admit. Qed.\n", "Theorem c : x. (* sorry *) Qed.", None, "  Instance d : x.\nDefined. oops")
    text = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("k") + 1).cast("int"))
    return o.select("o_orderkey", F.array_join(P.open_declarations(text), ",").alias("open"))


@query("""select o_orderkey, case when o_orderkey % 6 = 0 and o_orderkey % 4 = 0 then 'ADMITTED' when o_orderkey % 6 = 0 then 'PASS' when o_orderkey % 6 = 1 then 'TIMEOUT' when o_orderkey % 6 = 2 then 'ERROR' else 'FAIL' end as verdict,
 case when o_orderkey % 5 = 0 then case when o_orderkey % 2 = 0 then 'stuck' when o_orderkey % 3 = 0 then 'compile_success' else 'completed_without_success' end when o_orderkey % 5 = 1 then 'turn_limit_exceeded' when o_orderkey % 5 = 2 then 'boom' else 'run_failed' end as reason from orders""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X28, X29."""
    k = F.col("o_orderkey")
    code = F.when(k % 6 == 0, 0).when(k % 6 == 1, 124).when(k % 6 == 2, 127).otherwise(2)
    reason = X.give_up_reason(k % 5 == 0, F.when(k % 2 == 0, "stuck"), k % 3 == 0, k % 5 == 1, F.when(k % 5 == 2, "boom"))
    return V.table(spark, sf_dir, "orders").select("o_orderkey", X.verdict(code, k % 4 == 0).alias("verdict"), reason.alias("reason"))


@query("""with c as (select doc_id, text, list_max(list_filter(range(0, 41), lambda k: strlen(text[:k]) <= 40)) as k from documents)
select doc_id, case when text is null then null when strlen(text) <= 40 then text else text[:k] || case when strlen(text[:k]) < 40 then '�' else '' end end as start from c""")
def trimmed_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most so many bytes, split characters and all."""
    return V.table(spark, sf_dir, "documents").select("doc_id", X.first_bytes(F.col("text"), 40).alias("start"))


@query("select s_suppkey, 'ax' || s_suppkey || ',classic' as names from supplier")
def parsed_axioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X31."""
    out = F.concat(F.lit("noise\nAxioms:\nax"), F.col("s_suppkey").cast("string"), F.lit(" : nat\n  classic : forall P, P\n\nlater : x"))
    return V.table(spark, sf_dir, "supplier").select("s_suppkey", _joined_col(X.axioms(out)).alias("names"))


def _joined_col(c: F.Column) -> F.Column:
    return F.array_join(c, ",")


@query("select s_suppkey, case when s_suppkey % 2 = 0 then 'Deep.a.F' || s_suppkey else 'Top.lib.F' || s_suppkey end as module from supplier")
def module_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest folder wins, the first of equals stays."""
    k = F.col("s_suppkey")
    path = F.concat(F.when(k % 2 == 0, "./src/deep/a/F").otherwise("src/lib/F"), k.cast("string"), F.lit(".vo"))
    flags = F.array(*[F.struct(F.lit(a).alias("folder"), F.lit(b).alias("prefix")) for a, b in (("src", "Top"), ("src/deep/", "Deep"), ("src/deep", "Other"), ("x", "X"))])
    return V.table(spark, sf_dir, "supplier").select("s_suppkey", X.module_path(path, flags).alias("module"))


@query("select s_suppkey, case s_suppkey % 5 when 0 then '8.20' when 1 then '8.14' when 2 then 'dev' when 3 then '8.9' else null end as version from supplier")
def coq_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sources in order of precedence, trailing .0 cut."""
    k = F.col("s_suppkey") % 5
    text = lambda i, t: F.when(k == i, t)
    out = X.detected_version(
        text(0, 'env: { DOCKER_COQ_VERSION: "dev" }\n DOCKER_COQ_VERSION: "8.20.0"'),
        text(1, "matrix:\n  coq-version: ['dev', '8.14.0']"),
        text(2, "name: debian"),
        text(3, 'env: COQ_VERSION="master" COQ_PACKAGE="coq"\nenv: COQ_VERSION="v8.9" COQ_PACKAGE="coq"'),
    )
    return V.table(spark, sf_dir, "supplier").select("s_suppkey", out.alias("version"))


@query("""select s_suppkey, substr('2024-05-06T07', 1, 10) as day, case when s_suppkey % 2 = 0 then 'two words' else 'one' end as label, repeat('█', (s_suppkey % 100 / 2)::int - case when s_suppkey % 2 = 1 and (s_suppkey % 100 / 2)::int > s_suppkey % 100 // 2 then 1 else 0 end) as bar,
 case s_suppkey % 3 when 0 then '● ○ ○ ○ ○' when 1 then '● ● ○ ○ ○' else '● ● ● ○ ○' end as dots, 'F.v' as base from supplier""")
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X36, X37."""
    k = F.col("s_suppkey")
    return V.table(spark, sf_dir, "supplier").select("s_suppkey", X.day(F.lit("2024-05-06T07")).alias("day"), X.code_label(F.when(k % 2 == 0, "two_words").otherwise("one")).alias("label"), X.bar((k % 100).cast("double")).alias("bar"), X.complexity_dots(k % 3 + 1).alias("dots"), X.base_name(F.lit("a/b/F.v")).alias("base"))


@query("""select s_suppkey, 'The last ' || (s_suppkey % 9) || ' tactic sentences of the proof of `' || s_name || '` have been removed and replaced with `Admitted.`.' || chr(10) || 'Write only those missing tactic lines (ending with Qed.) to complete the proof.' || chr(10) || chr(10) || 'FILE:' || chr(10) || 'body' as prompt from supplier""")
def partial_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X35."""
    return V.table(spark, sf_dir, "supplier").select("s_suppkey", prompts.partial(F.col("s_name"), F.lit("body"), F.col("s_suppkey") % 9).alias("prompt"))


@query("select s_suppkey, case when s_suppkey % 2 = 0 then 'fill,close' else '' end as words from supplier")
def reply_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reply's list in lower case; what is no list gives none."""
    reply = F.when(F.col("s_suppkey") % 2 == 0, '["Fill", "CLOSE"]').otherwise("sorry, no list")
    return V.table(spark, sf_dir, "supplier").select("s_suppkey", _joined_col(X.parsed_keywords(reply)).alias("words"))


# --- evaluation ---
_GROUPS = f"""{V.RUNS}, g as (select mode, deletion_size, count(*) as n_total, count(*) filter (verdict = 'PASS' and not coalesce(m.ends_with_admitted, false)) as n_pass,
 count(*) filter (verdict = 'ADMITTED' or verdict = 'PASS' and coalesce(m.ends_with_admitted, false)) as n_admitted, avg(inference_time_s) as mean_inference_time_s, avg(output_tokens) as mean_output_tokens, avg(ned) as mean_normalized_edit_distance,
 avg(m.vo_bytes) as mean_vo_bytes, avg(case when h.vo_bytes > 0 then m.vo_bytes / h.vo_bytes end) as mean_vo_bytes_human_ratio, avg(m.compile_time_s) as mean_compile_time_s, avg(m.n_assumptions) as mean_n_assumptions,
 avg(m.vo_bytes / nullif(h.vo_bytes, 0)) as mean_vo_bytes_ratio, avg(m.compile_time_s / nullif(h.compile_time_s, 0)) as mean_compile_time_ratio, avg(m.n_assumptions - h.n_assumptions) as mean_n_assumptions_diff,
 avg(m.proof_chars / nullif(h.proof_chars, 0)) as mean_proof_chars_ratio, avg(m.proof_lines / nullif(h.proof_lines, 0)) as mean_proof_lines_ratio, avg(m.tactic_count / nullif(h.tactic_count, 0)) as mean_tactic_count_ratio,
 avg(case when mode = 'agent' then turns end) as mean_agent_n_turns, count(*) filter (verdict = 'PASS' and not coalesce(m.ends_with_admitted, false)) / count(*) as pass_rate from runs where deletion_size is not null group by mode, deletion_size)"""
_GROUP_COLUMNS = "mean_inference_time_s mean_output_tokens mean_normalized_edit_distance mean_vo_bytes mean_vo_bytes_human_ratio mean_compile_time_s mean_n_assumptions mean_vo_bytes_ratio mean_compile_time_ratio mean_n_assumptions_diff mean_proof_chars_ratio mean_proof_lines_ratio mean_tactic_count_ratio mean_agent_n_turns pass_rate".split()
_R = "case when count(v) >= 3 and var_pop(d) > 0 and var_pop(v) > 0 then round(covar_pop(d, v) / sqrt(var_pop(d) * var_pop(v)), 6) end"


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.group_summary(V.runs(spark, sf_dir))


@query(f"with {_GROUPS} select mode, deletion_size, n_total, n_pass, n_admitted, " + ", ".join(f"round({c}, 4) as {c}" for c in _GROUP_COLUMNS) + " from g")
def run_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A27, A28, F13, F14, J9, O8, T11, T12."""
    return rounded(groups(spark, sf_dir), 4)


@query(f"with {_GROUPS} select mode, {_R} as r from (select mode, deletion_size::double as d, pass_rate as v from g) group by mode")
def run_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A29, A30, T13."""
    return rounded(E.faithfulness(groups(spark, sf_dir)))


@query(f"with {_GROUPS}, u as (" + " union all ".join(f"select '{c}' as metric, mode, case when {c} is not null then deletion_size::double end as d, {c}::double as v from g" for c in E.SIGNALS) + f") select metric, mode, {_R} as r from u group by metric, mode")
def run_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A30, U9."""
    return rounded(E.drift_faithfulness(groups(spark, sf_dir)))


@query(f"with {_GROUPS} select a.deletion_size, b.n_total as baseline_n_total, a.n_total as agent_n_total, round(a.pass_rate - b.pass_rate, 6) as delta_pass_rate, round(a.mean_normalized_edit_distance - b.mean_normalized_edit_distance, 6) as delta_normalized_edit_distance, round(a.mean_agent_n_turns, 6) as delta_mean_agent_n_turns from g a join g b on a.deletion_size = b.deletion_size and a.mode = 'agent' and b.mode = 'baseline'")
def run_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A31, J8, U2, T17."""
    return rounded(E.baseline_against_agent(groups(spark, sf_dir)))


_CONDITIONS = f"""{V.RUNS}, c as (select condition, deletion_size, count(*) as n_challenges, count(*) filter (verdict = 'PASS') as n_pass, count(*) filter (verdict = 'ADMITTED') as n_admitted, count(*) filter (verdict = 'FAIL') as n_fail, count(*) filter (verdict in ('TIMEOUT', 'ERROR')) as n_error_or_timeout,
 avg(inference_time_s) as mean_inference_time_s, avg(output_tokens) as mean_output_tokens, avg(ted) as mean_tactic_edit_distance, avg(ned) as mean_normalized_edit_distance, count(*) filter (verdict = 'PASS') / count(*) as pass_rate from runs group by condition, deletion_size)"""


@query(f"with {_CONDITIONS} select * replace (round(mean_inference_time_s, 4) as mean_inference_time_s, round(mean_output_tokens, 4) as mean_output_tokens, round(mean_tactic_edit_distance, 4) as mean_tactic_edit_distance, round(mean_normalized_edit_distance, 4) as mean_normalized_edit_distance, round(pass_rate, 4) as pass_rate) from c")
def condition_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A32, U8."""
    return rounded(E.condition_summary(V.runs(spark, sf_dir)), 4)


@query(f"with {_CONDITIONS} select {_R} as r from (select case when pass_rate is not null then deletion_size::double end as d, case when deletion_size is not null then pass_rate end as v from c where condition = 'B')")
def condition_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over condition B alone."""
    return rounded(E.run_faithfulness(E.condition_summary(V.runs(spark, sf_dir))))


@query("select o_orderkey, o_custkey % 50 as commit_hash, m.v as vo_bytes from orders left join (select c_custkey % 50 as k, min(c_custkey) as v from customer where c_custkey % 50 <> 7 group by 1) m on o_custkey % 50 = m.k")
def human_compiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One compile outcome per commit."""
    o = V.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("commit_hash"))
    done = V.table(spark, sf_dir, "customer").where("c_custkey % 50 <> 7").select((F.col("c_custkey") % 50).alias("commit_hash"), F.col("c_custkey").alias("vo_bytes"))
    return E.human_outcomes(o, done, by_file=False)


@query("select l_returnflag as mode, count(*) as n from (select l_returnflag from lineitem where l_linenumber = 1 union all select l_returnflag from lineitem where l_linenumber = 2) group by 1")
def concatenated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5, U4, A38."""
    li = V.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("mode"), "l_linenumber")
    whole = E.concatenated([li.where("l_linenumber = 1"), li.where("l_linenumber = 2")], li)
    return whole.groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


@query("select max('2026050' || (user_id % 9 + 1) || '-' || lpad(event_id::varchar, 6, '0')) as run_id from events where event_id % 3 <> 0")
def newest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ids that look like runs."""
    e = V.table(spark, sf_dir, "events")
    run = F.concat(F.lit("2026050"), (F.col("user_id") % 9 + 1).cast("string"), F.lit("-"), F.lpad(F.col("event_id").cast("string"), 6, "0"))
    return R.newest_run(e.select(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("z"), run)).otherwise(run).alias("run_id")))


# --- lifecycles ---
@query(f"""with {V.COMMITS}, ch as (select _pos, hash, coq_files_changed[1] as file, 'd' || (_pos % 60) as declaration, date from commits where touches_proof_files and _pos % 60 <> 0),
p as (select file, declaration, hash as proof_complete_hash, date as proof_complete_date from ch qualify row_number() over (partition by file, declaration order by date desc, _pos) = 1)
select * from p""")
def proved_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest finishing commit of each declaration."""
    return L.proved_declarations(_challenges(spark, sf_dir), V.commits(spark, sf_dir)).drop("hole_kind")


def _challenges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.commits(spark, sf_dir).where("touches_proof_files")
    name = F.when(F.col("_pos") % 60 == 0, F.when(F.col("_pos") % 120 == 0, "").otherwise("Definition")).otherwise(F.concat(F.lit("d"), (F.col("_pos") % 60).cast("string")))
    return c.select("_pos", F.col("hash").alias("commit_hash"), F.col("coq_files_changed")[0].alias("file_path"), F.array(F.struct(F.lit("admitted").alias("kind"), name.alias("enclosing_decl"))).alias("holes_filled"))


_OPEN = f"""{_ENRICHED.removeprefix('with ')}, ch as (select _pos, hash, coq_files_changed[1] as file, 'd' || (_pos % 60) as declaration, date from commits where touches_proof_files and _pos % 60 <> 0),
p as (select file, declaration, date as done from ch qualify row_number() over (partition by file, declaration order by date desc, _pos) = 1),
walk as (select p.file, p.declaration, p.done, f._pos, f.hash, f.date, f.tags from p join fin f on p.file = f.coq_files_changed[1] and f.date <= p.done where f._pos % 4 <> 0 and f._pos % 3 <> 0)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycles over blobs in which every third content is finished and every fourth is missing."""
    c = full(spark, sf_dir)
    proved = written(L.proved_declarations(_challenges(spark, sf_dir), c), "proved")
    blobs = L.history(proved, c).where("_pos % 4 <> 0")
    t = F.array_join(F.transform("declarations", lambda d: F.concat(F.lit("Lemma "), d, F.lit(" : x.\nProof.\n"))), "END")
    # Each declaration's block ends in a hole, or is finished.
    text = F.concat(F.replace(t, F.lit("END"), F.when(F.col("_pos") % 3 == 0, "Qed.\n").otherwise("Admitted.\nEnd x.\n")), F.when(F.col("_pos") % 3 == 0, "Qed.\n").otherwise("Admitted.\n"))
    return L.lifecycles(L.open_commits(proved, c, blobs.select("hash", "file", text.alias("content"))), proved)


@query(f"""with {_OPEN} select declaration, file, min(date) as first_hole_date, max(done) as proof_complete_date, count(*)::int as n_commits_with_hole, greatest(0, date_sub('day', min(date)[:19]::timestamp, max(done)[:19]::timestamp))::int as days_to_prove,
 coalesce((select count(distinct {_GROUP_CASE}) from (select unnest(flatten(list(tags))) as t)), 0)::int as n_tactic_groups from walk group by declaration, file""")
def lifecycle_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories of declarations up to the finished proof."""
    return _records(spark, sf_dir).select("declaration", "file", "first_hole_date", "proof_complete_date", "n_commits_with_hole", "days_to_prove", "n_tactic_groups")


def _buckets_sql(buckets: list[tuple[str, int | None]]) -> str:
    case = "case " + " ".join(f"when n <= {m} then '{b}'" for b, m in buckets[:-1]) + f" else '{buckets[-1][0]}' end"
    labels = ", ".join(f"('{b}')" for b, _ in buckets)
    return f"with {V.TURNS}, b as (select {case} as bucket, count(*) as n from decls group by 1) select l.bucket, coalesce(b.n, 0) as n, round(100.0 * coalesce(b.n, 0) / sum(b.n) over (), 6) as pct from (values {labels}) l(bucket) left join b using (bucket)"


@query(_buckets_sql(vocab.BUCKETS6))
def report_histogram6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    return rounded(L.histogram(V.timeline(spark, sf_dir), vocab.BUCKETS6))


@query(_buckets_sql(vocab.BUCKETS7))
def report_histogram7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16."""
    return rounded(L.histogram(V.timeline(spark, sf_dir), vocab.BUCKETS7))


@query(f"with {V.TURNS} select count(*) as declarations, sum(n)::bigint as commits, median(n)::double as median, round(avg(n), 6) as mean, round(stddev_samp(n), 6) as stdev, min(n) as least, max(n) as most, (select declaration from decls order by n desc, declaration desc limit 1) as hardest from decls")
def report_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9, A14."""
    return rounded(L.commit_statistics(V.timeline(spark, sf_dir)))


@query(f"with {V.TURNS}, s as (select list_sort(list(n)) as xs from decls) select p as point, xs[least(floor(p / 100.0 * len(xs))::int + 1, len(xs))] as value from s, (values (25), (50), (75), (90), (95), (99)) t(p)")
def report_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    return L.percentiles(V.timeline(spark, sf_dir))


@query(f"with {V.TURNS} select count(*) as n, count(*) filter (days = 0) as same_day, count(*) filter (days <= 7) as within_week, count(*) filter (days <= 30) as within_month, median(days)::double as median, round(avg(days), 6) as mean, max(days) as most from decls where days >= 0")
def report_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11, A17, F10."""
    return rounded(L.time_statistics(V.timeline(spark, sf_dir)))


@query(f"with {V.TURNS} select row_number() over (order by n desc, file, declaration)::int as rank, declaration, n as n_commits_with_hole, days as days_to_prove from decls order by n desc, file, declaration limit 30")
def report_hardest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O6, W5."""
    return L.hardest(V.timeline(spark, sf_dir)).drop("groups")


@query(f"""with {V.TURNS}, r as (select *, string_split(file, '/')[-1] as name, row_number() over (partition by string_split(file, '/')[-1] order by n desc, declaration, file) as k from decls)
select name, count(*) as declarations, sum(n)::bigint as commits, round(avg(n), 6) as mean, max(n) as most, array_to_string(list(declaration order by k) filter (k <= 8), ',') as hardest from r group by name having count(*) >= 3 order by commits desc, name limit 25""")
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18, F12, X37."""
    return rounded(L.by_file(V.timeline(spark, sf_dir)))


@query(f"with {V.TURNS}, c as (select grp, count(*) as n, avg(d.n) as m from used join decls d using (declaration, file) group by grp) select g as grp, 0::bigint as n, 0.0::double as pct, 0.0::double as mean_commits from (values " + ", ".join(f"('{g}')" for g in vocab.GROUPS) + ") t(g)")
def report_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed list of groups, those that none used too."""
    return rounded(L.group_usage(V.timeline(spark, sf_dir)))


@query(f"""with {V.TURNS}, e as (select *, row_number() over (partition by conv_id order by date, turn, hash) as a, row_number() over (partition by conv_id order by date desc, turn desc, hash desc) as z from turns),
u as (select unnest(groups) as grp, 1 as a, 0 as b from e where a = 1 union all select unnest(groups), 0, 1 from e where z = 1) select grp, sum(a)::bigint as first, sum(b)::bigint as last from u group by grp""")
def report_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20."""
    return L.first_and_last_groups(V.timeline(spark, sf_dir))


@query(f"with {V.TURNS} select x.grp as a, y.grp as b, count(*) as n from used x join used y on x.declaration = y.declaration and x.file = y.file and x.grp < y.grp group by 1, 2 order by n desc, a, b limit 15")
def report_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21."""
    return L.group_pairs(V.timeline(spark, sf_dir))


@query(f"with {V.TURNS} select role as commit_class, count(*) as n from turns group by 1")
def report_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22."""
    return L.timeline_classes(V.timeline(spark, sf_dir))


@query(f"with {V.TURNS}, s as (select conv_id, array_to_string(list(role order by date, turn, hash), '>') as sequence from turns group by conv_id having count(*) >= 4) select sequence, count(*) as n from s group by 1")
def report_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23."""
    return L.class_sequences(V.timeline(spark, sf_dir))


@query(f"with {V.TURNS} select {V.BUCKET7} as bucket, count(*) as n, sum(net)::bigint as net, round(avg(net), 6) as mean from turns join decls using (declaration, file) group by 1")
def report_net_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24."""
    return rounded(L.net_lines(V.timeline(spark, sf_dir)))


@query(f"with {V.TURNS}, t as (select unnest(tags) as tactic from turns) select tactic, count(*) as n, round(count(*) / max(count(*)) over (), 6) as of_most from t group by 1 order by n desc, tactic limit 40")
def report_tactics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25, W8."""
    return rounded(L.tactic_frequency(V.timeline(spark, sf_dir)))


@query(f"with {V.TURNS} select declaration, hash, date[:10] as day, net from turns where net < -20")
def report_shrinking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11."""
    return L.shrinking(V.timeline(spark, sf_dir))


@query(f"""with {V.TURNS}, k as (select declaration, file, count(*) as g from used group by 1, 2), d as (select decls.*, coalesce(g, 0) as g from decls left join k using (declaration, file))
select {V.BUCKET7} as bucket, count(*) as n, round(avg(g), 6) as mean_groups, round(100.0 * count(*) filter (g = 7) / count(*), 6) as pct_all, round(coalesce(avg(days) filter (days >= 0), -1.0), 6) as mean_days from d group by 1""")
def report_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13, A26."""
    out = L.diversity(V.timeline(spark, sf_dir))
    return rounded(out.groupBy("bucket").agg(*[F.first(c).alias(c) for c in out.columns if c != "bucket"]))


@query(f"with {V.TURNS} select declaration, file from decls where n = 1 order by declaration, file")
def report_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O7, F12."""
    return L.single_commit(V.timeline(spark, sf_dir))


@query(f"with {V.TURNS} select declaration, n as n_commits_with_hole from decls where n >= 3 and days >= 0 order by n desc, file, declaration limit 20")
def study_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8, O4."""
    return L.study_candidates(V.timeline(spark, sf_dir)).select("declaration", "n_commits_with_hole")


@query(f"""with {V.TURNS}, o as (select *, (row_number() over (partition by conv_id order by date, turn, hash) - 1)::int as ordinal from turns)
select declaration, ordinal, hash, case when turn % 3 = 0 then 'known' else 'unknown' end as author, case when turn % 3 = 0 then 5 else 0 end as insertions from o""")
def enriched_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timelines with their commits, defaults for unknown ones."""
    t = V.timeline(spark, sf_dir)
    known = t.select(F.explode("commit_timeline").alias("c")).where("c.turn % 3 = 0").select("c.hash", F.lit("known").alias("author"), F.lit("").alias("message_body"), F.array().cast("array<string>").alias("proof_style"), F.lit(5).alias("insertions"), F.lit(1).alias("deletions"))
    return L.enriched_timelines(t, known).select("declaration", "ordinal", "hash", "author", "insertions")


@query(f"""with {V.TURNS}, c as (select *, row_number() over (partition by conv_id order by date, turn, hash) as i from turns),
b as (select conv_id, declaration, file, min(date) as first_date, max(date) as last_date, count(*) as n, list_sort(list_distinct(flatten(list(groups)))) as used,
 string_agg('**Commit ' || i || '** (' || date[:10] || ')' || chr(10) || '- Hash: `' || hash[:12] || '`' || chr(10) || '- Author: unknown' || chr(10) || '- Subject: ' || role || chr(10) || '- Class: ' || role || chr(10)
  || '- Net proof lines: ' || case when net >= 0 then '+' else '' end || net || chr(10) || case when len(tags) > 0 then '- Tactics: ' || array_to_string(list_sort(tags), ', ') || chr(10) else '' end, chr(10) order by i) as timeline from c group by conv_id, declaration, file)
select declaration, '## Declaration: `' || declaration || '`' || chr(10) || '**File:** `' || file || '`' || chr(10) || '**Hole kind:** admitted' || chr(10) || '**First hole:** ' || first_date || chr(10) || '**Proof completed:** ' || last_date || chr(10)
 || '**Days to prove:** ' || case when conv_id % 11 = 0 then -1 else conv_id % 50 end || chr(10) || '**Commits touching this proof:** ' || n || chr(10) || '**Top tactics used:** ' || chr(10) || '**Tactic groups:** ' || array_to_string(used, ', ') || chr(10) || chr(10)
 || '### Commit Timeline' || chr(10) || chr(10) || timeline || chr(10) || 'Analyze this proof''s evolution. What does the trajectory reveal about the human proof engineering process?' as prompt from b""")
def study_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prompt per declaration, longest histories first."""
    t = V.timeline(spark, sf_dir)
    timeline = F.transform("commit_timeline", lambda c: F.struct(c["date"].alias("date"), c["hash"].alias("hash"), F.lit("unknown").alias("author"), c["subject"].alias("subject"), F.lit("").alias("message_body"), c["commit_class"].alias("commit_class"), c["net_proof_lines"].alias("net_proof_lines"), F.array_sort(c["tactic_tags"]).alias("tactic_tags"), F.array().cast("array<string>").alias("proof_style")))
    fields = {c: F.col(c) for c in ("declaration", "file", "hole_kind", "first_hole_date", "proof_complete_date", "days_to_prove", "n_commits_with_hole")} | {"timeline": timeline, "top_tactics": F.array().cast("array<string>"), "tactic_groups_used": F.array_sort("tactic_groups_used")}
    return commands.study_prompts(t.select(*[c.alias(n) for n, c in fields.items()]))


def _study(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("code")))).alias("o"))
    analysis = F.struct(F.concat(F.lit("d"), F.col("conv_id").cast("string")).alias("declaration"), F.col("o").alias("observations"), (F.col("conv_id") % 5 + 1).cast("int").alias("complexity"))
    return c.select(analysis.alias("analysis"))


@query("select count(distinct conv_id) as n_records, count(*) as n_observations, (select round(avg(conv_id % 5 + 1), 6) from (select distinct conv_id from conversations)) as avg_complexity, count(distinct role)::int as n_codes from conversations")
def study_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A35."""
    return rounded(Q.study_overview(_study(spark, sf_dir)))


@query("select role as code, count(*) as n from conversations group by 1")
def study_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A35."""
    return Q.code_counts(_study(spark, sf_dir))


@query("select 'd' || conv_id as declaration, role as code, count(*) as n from conversations group by 1, 2")
def study_card_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A36."""
    return Q.code_counts(_study(spark, sf_dir), by_record=True)


@query("select distinct 'd' || conv_id as declaration, (conv_id % 5 + 1)::int as complexity from conversations")
def study_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O9."""
    return Q.study_cards(_study(spark, sf_dir)).select("analysis.declaration", "analysis.complexity")


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(f"select unnest([{', '.join(repr(t) for t in TABLES)}]) as id, true as has_bytes")
def list_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder, by name, with their sizes, contents unread; a table of many files counts once."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(sf_dir)
    named = files.select(F.regexp_extract("path", r"/([a-z]+)\.parquet(?:/[^/]*)?$", 1).alias("id"), "length")
    return named.groupBy("id").agg((F.sum("length") > 0).alias("has_bytes"))


# --- sinks, written and read back ---
@query(f"with {V.COMMITS} select hash, case when insertions % 2 = 0 then message_body end as body, coq_files_changed[1] as path from commits")
def sink_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: records as JSON lines in one file, nulls kept."""
    c = V.commits(spark, sf_dir).select("hash", F.when(F.col("insertions") % 2 == 0, F.col("message_body")).alias("body"), F.try_element_at("coq_files_changed", F.lit(1)).alias("path"))
    D.write_records(c, path := fresh_path(spark, "records"), single=True)
    return spark.read.schema("hash string, body string, path string").json(path)


@query("select o_orderkey, o_orderkey % 2 as batch from orders")
def sink_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: rows appended batch by batch."""
    o, path = V.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 2).alias("batch")), fresh_path(spark, "appends")
    for batch in (0, 1):
        D.append_records(o.where(F.col("batch") == batch), path)
    return spark.read.schema("o_orderkey long, batch long").json(path)


@query("select 'slot' || conv_id % 7 as slot, conv_id, count(*) as n_messages, sum(length(coalesce(text, '')))::bigint as n_chars from conversations group by conv_id")
def sink_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: transcripts by slot, one folder each."""
    c = V.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("messages"))
    D.write_transcripts(c.withColumn("slot", F.concat(F.lit("slot"), (F.col("conv_id") % 7).cast("string"))), path := fresh_path(spark, "transcripts"))
    back = spark.read.schema("conv_id long, messages array<struct<turn: long, role: string, text: string>>, slot string").json(path)
    return back.select("slot", "conv_id", F.size("messages").cast("long").alias("n_messages"), F.aggregate("messages", F.lit(0).cast("long"), lambda s, m: s + F.length(m["text"])).alias("n_chars"))


_GROUPED = "select n_regionkey, count(*) as n, avg(n_nationkey) as mean from nation group by 1"


@query(f"""with g as ({_GROUPED}), l as (select n_regionkey + 2 as i, '| ' || n_regionkey || ' | ' || n || ' | ' || format('{{:.4f}}', mean) || ' |' as line from g)
select * from l union all select 0, '| n_regionkey | n | mean |' union all select 1, '|---|---|---|'""")
def render_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: a small result as lines of Markdown."""
    g = V.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.avg("n_nationkey").alias("mean")).orderBy("n_regionkey")
    lines = P_.markdown_table(g, ["n_regionkey", "n", "mean"]).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "i long, line string")


@query(f"""with g as ({_GROUPED}) select n_regionkey + 3 as i, '  ' || n_regionkey || '  ' || n || '  ' || format('{{:.4f}}', mean) as line from g
 union all select 0, '' union all select 1, 'NATIONS' union all select 2, repeat('-', 60)""")
def render_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: a small result as a titled block of text."""
    g = V.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.avg("n_nationkey").alias("mean")).orderBy("n_regionkey")
    return spark.createDataFrame(list(enumerate(P_.section("NATIONS", g).split("\n"))), "i long, line string")


@query(f"with {V.RUNS} select mode, deletion_size, count(*) as n_total, (select count(*) from runs where deletion_size is not null) as n_total_runs from runs where deletion_size is not null group by mode, deletion_size")
def summary_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: the summary of runs as one JSON document, read back."""
    groups = E.group_summary(V.runs(spark, sf_dir))
    text = P_.summary_json(P_.summary(groups, E.faithfulness(groups), E.drift_faithfulness(groups), E.baseline_against_agent(groups)))
    schema = "n_total_runs long, groups array<struct<mode: string, deletion_size: int, n_total: long>>"
    doc = spark.createDataFrame([(text,)], "text string").select(F.from_json("text", schema).alias("d"))
    return doc.select("d.n_total_runs", F.explode("d.groups").alias("g")).select("g.*", "n_total_runs")


@query("""select 'repo_' || h[:8] || '_' || sha256('repo_' || h[:12] || '_' || path)[:8] as task_id, path as file_path, case when k % 3 = 0 then 'a' else 'b' end as filled, k as o_orderkey
 from (select o_orderkey as k, sha256(o_orderkey::varchar) as h, 'src/F' || o_orderkey || '.v' as path from orders) where k % 3 <> 1""")
def mined_challenges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The challenges of all commits as one bag; commits in which no hole is filled give none."""
    k = F.col("o_orderkey")
    open_, closed = "Lemma a : x.\nProof.\nAdmitted.\n", "Lemma a : x.\nProof. auto. Qed.\n"
    two, one = open_ + "Lemma b : y.\nProof.\n  admit.\nQed.\n", open_ + "Lemma b : y.\nProof.\n  auto.\nQed.\n"
    side = lambda a, b, c: F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise(c)
    changes = V.table(spark, sf_dir, "orders").select(
        F.sha2(k.cast("string"), 256).alias("commit_hash"), F.sha2((-k).cast("string"), 256).alias("parent_hash"), F.format_string("change %d", k).alias("commit_message"), F.format_string("src/F%d.v", k).alias("path"), F.lit("M").alias("status"),
        side(open_, open_, two).alias("before"), side(closed, open_, one).alias("after"),
    )
    out = commands.mine(changes, "repo")
    return out.select("task_id", "file_path", _joined_col(F.transform("holes_filled", lambda h: h["enclosing_decl"])).alias("filled"), F.regexp_extract("file_path", r"F(\d+)", 1).cast("long").alias("o_orderkey"))


@query(f"with {V.COMMITS} select _pos as pos, hash, case when len(coq_files_changed) > 0 then 0 else 1 end as part from commits")
def restored_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both parts again in the order they came in."""
    return D.restored(*D.split_by_proof_files(V.commits(spark, sf_dir))).select(F.col("_pos").alias("pos"), "hash", F.col("_part").alias("part"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes after both passes with their share, the most frequent first."""
    return D.distribution(full(spark, sf_dir), "commit_class").orderBy(F.desc("n"), "commit_class")
