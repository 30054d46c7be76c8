"""Histories of declarations: from the first hole to the finished proof, and statistics over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.proofs import open_declarations


def proved_declarations(challenges: DataFrame, commits: DataFrame) -> DataFrame:
    """The latest finishing commit of each (file, declaration); of equal dates the first challenge wins.

    challenges: _pos, commit_hash, file_path, holes_filled (kind, enclosing_decl)."""
    holes = challenges.select("_pos", "commit_hash", F.col("file_path").alias("file"), F.posexplode("holes_filled").alias("_i", "h"))
    named = holes.where(~F.coalesce("h.enclosing_decl", F.lit("")).isin("", "Definition"))
    dated = named.join(commits.select(F.col("hash").alias("commit_hash"), F.col("date").alias("proof_complete_date")), "commit_hash")
    latest = Window.partitionBy("file", "declaration").orderBy(F.desc("proof_complete_date"), "_pos", "_i")
    picked = dated.withColumn("declaration", F.col("h.enclosing_decl")).withColumn("_n", F.row_number().over(latest)).where("_n = 1")
    return picked.select("file", "declaration", F.col("commit_hash").alias("proof_complete_hash"), "proof_complete_date", F.col("h.kind").alias("hole_kind"))


def touching(commits: DataFrame) -> DataFrame:
    """One row per commit and proof file that it touched."""
    return commits.select("_pos", "hash", "date", "message_subject", "commit_class", "tactic_group_tags", "tactic_tags", "diff_net_proof_lines", F.explode("coq_files_changed").alias("file"))


def with_declarations(touched: DataFrame, proved: DataFrame) -> DataFrame:
    """Adds declarations, the array of those of a file that are finished at a row's date or later; dates compare as text.

    A file's declarations come to its commits in one array, so rows stay one per commit and file."""
    due = proved.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("declaration", "proof_complete_date"))).alias("_due"))
    left = F.transform(F.filter("_due", lambda d: d["proof_complete_date"] >= F.col("date")), lambda d: d["declaration"])
    return touched.join(due, "file").withColumn("declarations", left).drop("_due")


def history(proved: DataFrame, commits: DataFrame) -> DataFrame:
    """The commits of each file with the declarations whose history they belong to."""
    return with_declarations(touching(commits), proved).where(F.size("declarations") > 0)


def open_commits(proved: DataFrame, commits: DataFrame, blobs: DataFrame) -> DataFrame:
    """Rows of a history whose file content still has holes, with the declarations that have them. blobs: hash, file, content.

    Each content is read once for all its open declarations; their names, not the contents, meet the commits."""
    names = blobs.where(F.coalesce("content", F.lit("")) != "").select("hash", "file", open_declarations("content").alias("_open")).where(F.size("_open") > 0)
    names = names.groupBy("hash", "file").agg(F.flatten(F.collect_list("_open")).alias("_open"))
    still = with_declarations(touching(commits).join(names, ["hash", "file"]), proved)
    return still.withColumn("declarations", F.array_intersect("declarations", "_open")).drop("_open").where(F.size("declarations") > 0)


def days_between(first: Column, last: Column) -> Column:
    """Whole days of wall clock between ISO dates, never below 0; -1 where one can't be read."""
    clock = lambda d: F.try_to_timestamp(F.substring(d, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    days = F.timestamp_diff("DAY", clock(first), clock(last)).cast("int")
    return F.when(days.isNull(), -1).otherwise(F.greatest(F.lit(0), days))


def lifecycles(still_open: DataFrame, proved: DataFrame) -> DataFrame:
    """One record per declaration with an open commit: counts, dates, groups, tactics and the timeline in order of date.

    Commits that leave the same declarations of a file open are gathered before they are dealt out to each of them;
    what is not asked of a record, its timeline above all, is not gathered."""
    keys = ["file", "declaration"]
    entry = F.struct("date", "_pos", "hash", F.col("message_subject").alias("subject"), "commit_class", F.col("tactic_group_tags").alias("tactic_groups"), "tactic_tags", F.col("diff_net_proof_lines").alias("net_proof_lines"))
    alike = still_open.groupBy("file", "declarations").agg(F.count(F.lit(1)).alias("_n"), F.min("date").alias("_first"), F.collect_set("tactic_group_tags").alias("_groups"), F.collect_list(entry).alias("_entries"))
    dealt = alike.select("file", F.explode("declarations").alias("declaration"), "_n", "_first", "_groups", "_entries")
    base = dealt.groupBy(*keys).agg(
        F.sum("_n").cast("int").alias("n_commits_with_hole"),
        F.min("_first").alias("first_hole_date"),
        F.size(F.array_distinct(F.flatten(F.flatten(F.collect_list("_groups"))))).alias("n_tactic_groups"),
        F.array_sort(F.flatten(F.collect_list("_entries"))).alias("commit_timeline"),
    ).join(proved, keys)
    flat = F.flatten(F.transform("commit_timeline", lambda e: F.coalesce(e["tactic_groups"], F.array().cast("array<string>"))))
    tags = F.flatten(F.transform("commit_timeline", lambda e: F.coalesce(e["tactic_tags"], F.array().cast("array<string>"))))
    # Arrays keep first appearance, so ties go to what came first; a timeline is as long as a file's history.
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    ranked = F.array_sort(F.transform(F.array_distinct(tags), lambda t, i: F.struct((-count(tags, t)).alias("n"), i.alias("i"), t.alias("t"))))
    return base.select(
        "declaration",
        "file",
        "hole_kind",
        "proof_complete_hash",
        "proof_complete_date",
        "first_hole_date",
        days_between(F.col("first_hole_date"), F.col("proof_complete_date")).alias("days_to_prove"),
        "n_commits_with_hole",
        "n_tactic_groups",
        F.array_distinct(flat).alias("tactic_groups_used"),
        F.slice(F.transform(ranked, lambda r: r["t"]), 1, 10).alias("top_tactics"),
        F.map_from_entries(F.transform(F.array_distinct(flat), lambda g: F.struct(g.alias("k"), count(flat, g).cast("long").alias("v")))).alias("group_commit_counts"),
        "commit_timeline",
    )


def bucket(n: Column, buckets: list[tuple[str, int | None]]) -> Column:
    out = None
    for label, most in buckets:
        if most is not None:
            out = F.when(n <= most, label) if out is None else out.when(n <= most, label)
    return out.otherwise(buckets[-1][0])


def _labels(df: DataFrame, labels: list[str], name: str) -> DataFrame:
    return df.sparkSession.createDataFrame(list(enumerate(labels)), f"_order int, {name} string")


def histogram(records: DataFrame, buckets: list[tuple[str, int | None]]) -> DataFrame:
    """Declarations by bucket of commits, empty buckets too."""
    counts = records.groupBy(bucket(F.col("n_commits_with_hole"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    full = _labels(records, [b for b, _ in buckets], "bucket").join(counts, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return full.withColumn("pct", F.coalesce(F.try_divide(100.0 * F.col("n"), F.sum("n").over(Window.partitionBy())), F.lit(0.0))).drop("_order")


def commit_statistics(records: DataFrame) -> DataFrame:
    """Counts, centre and spread of commits per declaration, and who has the most."""
    n = F.col("n_commits_with_hole")
    return records.agg(
        F.count(F.lit(1)).alias("declarations"),
        F.sum(n).alias("commits"),
        F.median(n).alias("median"),
        F.avg(n).alias("mean"),
        F.stddev_samp(n).alias("stdev"),
        F.min(n).alias("least"),
        F.max(n).alias("most"),
        F.max_by("declaration", F.struct(n, F.col("declaration"))).alias("hardest"),
    )


def percentiles(records: DataFrame, points: tuple[int, ...] = (25, 50, 75, 90, 95, 99)) -> DataFrame:
    """The value at place int(p / 100 * n) in order, one row per point.

    Counts per value are summed up in order, so only distinct values are sorted, not rows."""
    counts = records.groupBy(F.col("n_commits_with_hole").alias("value")).agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy()
    run = counts.withColumn("upto", F.sum("c").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("n", F.sum("c").over(whole))
    at = run.crossJoin(records.sparkSession.createDataFrame([(p,) for p in points], "point int"))
    place = F.least(F.floor(F.col("point") / F.lit(100.0) * F.col("n")), F.col("n") - 1)
    return at.where(F.col("upto") > place).groupBy("point").agg(F.min("value").alias("value"))


def time_statistics(records: DataFrame) -> DataFrame:
    """Days to prove over declarations that have them."""
    valid = records.where("days_to_prove >= 0")
    d = F.col("days_to_prove")
    return valid.agg(F.count(F.lit(1)).alias("n"), F.count_if(d == 0).alias("same_day"), F.count_if(d <= 7).alias("within_week"), F.count_if(d <= 30).alias("within_month"), F.median(d).alias("median"), F.avg(d).alias("mean"), F.max(d).alias("most"))


def hardest(records: DataFrame, n: int = 30) -> DataFrame:
    """The declarations with the most commits, ranked."""
    top = records.orderBy(F.desc("n_commits_with_hole"), "file", "declaration").limit(n)
    place = F.row_number().over(Window.orderBy(F.desc("n_commits_with_hole"), "file", "declaration"))
    return top.select(place.alias("rank"), "declaration", "n_commits_with_hole", "days_to_prove", F.array_join("tactic_groups_used", ", ").alias("groups"))


def by_file(records: DataFrame, least: int = 3, n: int = 25, inner: int = 8) -> DataFrame:
    """Files with at least ``least`` declarations, the most commits first, with their hardest declarations."""
    named = records.withColumn("name", F.substring_index("file", "/", -1))
    order = Window.partitionBy("name").orderBy(F.desc("n_commits_with_hole"), "declaration", "file")
    ranked = named.withColumn("_n", F.row_number().over(order))
    sums = ranked.groupBy("name").agg(
        F.count(F.lit(1)).alias("declarations"),
        F.sum("n_commits_with_hole").alias("commits"),
        F.avg("n_commits_with_hole").alias("mean"),
        F.max("n_commits_with_hole").alias("most"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= inner, F.struct("_n", "declaration")))), lambda x: x["declaration"]), ",").alias("hardest"),
    )
    return sums.where(F.col("declarations") >= least).orderBy(F.desc("commits"), "name").limit(n)


def group_usage(records: DataFrame) -> DataFrame:
    """Declarations per group with mean commits, groups that none used too."""
    used = records.select("n_commits_with_hole", F.explode("tactic_groups_used").alias("grp"))
    counts = used.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("n_commits_with_hole").alias("mean_commits"))
    total = records.agg(F.count(F.lit(1)).alias("total"))
    full = _labels(records, list(vocab.GROUPS), "grp").join(counts, "grp", "left").crossJoin(total)
    return full.select("grp", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce(F.try_divide(100.0 * F.col("n"), F.col("total")), F.lit(0.0)).alias("pct"), F.coalesce("mean_commits", F.lit(0.0)).alias("mean_commits"))


def first_and_last_groups(records: DataFrame) -> DataFrame:
    """How often each group stands in the first and in the last commit of a timeline."""
    ends = records.where(F.size("commit_timeline") > 0).select(F.element_at("commit_timeline", 1)["tactic_groups"].alias("f"), F.element_at("commit_timeline", -1)["tactic_groups"].alias("l"))
    long = ends.select(F.explode("f").alias("grp"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(ends.select(F.explode("l").alias("grp"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    return long.groupBy("grp").agg(F.sum("a").alias("first"), F.sum("b").alias("last"))


def group_pairs(records: DataFrame, n: int = 15) -> DataFrame:
    """Unordered pairs of groups in one declaration, the most frequent first; a declaration has 21 at most."""
    gs = F.array_sort(F.array_distinct("tactic_groups_used"))
    pairs = records.select(gs.alias("gs")).select(F.explode(F.flatten(F.transform("gs", lambda a: F.transform(F.filter("gs", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "a", "b").limit(n)


def _commits(records: DataFrame) -> DataFrame:
    return records.select("file", "declaration", "n_commits_with_hole", F.posexplode("commit_timeline").alias("ordinal", "c"))


def timeline_classes(records: DataFrame) -> DataFrame:
    return _commits(records).groupBy(F.col("c.commit_class").alias("commit_class")).agg(F.count(F.lit(1)).alias("n"))


def class_sequences(records: DataFrame, least: int = 4) -> DataFrame:
    """How often each sequence of classes occurs in timelines of at least ``least`` commits."""
    return records.where(F.col("n_commits_with_hole") >= least).groupBy(F.array_join(F.transform("commit_timeline", lambda c: c["commit_class"]), ">").alias("sequence")).agg(F.count(F.lit(1)).alias("n"))


def net_lines(records: DataFrame) -> DataFrame:
    """Net proof lines by bucket."""
    rows = _commits(records).withColumn("bucket", bucket(F.col("n_commits_with_hole"), vocab.BUCKETS7))
    return rows.groupBy("bucket").agg(F.count("c.net_proof_lines").alias("n"), F.sum("c.net_proof_lines").alias("net"), F.avg("c.net_proof_lines").alias("mean"))


def tactic_frequency(records: DataFrame, n: int = 40) -> DataFrame:
    counts = _commits(records).select(F.explode("c.tactic_tags").alias("tactic")).groupBy("tactic").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "tactic").limit(n).withColumn("of_most", F.col("n") / F.max("n").over(Window.partitionBy()))


def shrinking(records: DataFrame, below: int = -20) -> DataFrame:
    """Commits that shrank a proof by more than a number of lines."""
    return _commits(records).where(F.col("c.net_proof_lines") < below).select("declaration", F.col("c.hash").alias("hash"), F.substring("c.date", 1, 10).alias("day"), F.col("c.net_proof_lines").alias("net"))


def diversity(records: DataFrame) -> DataFrame:
    """By bucket: declarations, mean groups, share with all seven, and mean days of those that have them, else -1."""
    d = F.col("days_to_prove")
    return records.groupBy(bucket(F.col("n_commits_with_hole"), vocab.BUCKETS7).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("n_tactic_groups").alias("mean_groups"), (100.0 * F.count_if(F.col("n_tactic_groups") == 7) / F.count(F.lit(1))).alias("pct_all"), F.coalesce(F.avg(F.when(d >= 0, d)), F.lit(-1.0)).alias("mean_days")
    )


def single_commit(records: DataFrame) -> DataFrame:
    return records.where("n_commits_with_hole = 1").select("declaration", "file").orderBy("declaration", "file")


def study_candidates(records: DataFrame, least_commits: int = 3, least_days: int = 0, n: int = 20) -> DataFrame:
    """Declarations for a qualitative study, the most commits first."""
    return records.where((F.col("n_commits_with_hole") >= least_commits) & (F.col("days_to_prove") >= least_days)).orderBy(F.desc("n_commits_with_hole"), "file", "declaration").limit(n)


def enriched_timelines(records: DataFrame, commits: DataFrame) -> DataFrame:
    """Timeline rows with author, body, style and sizes of their commits; unknown commits get defaults."""
    rows = _commits(records).select("file", "declaration", "ordinal", "c.*")
    full = commits.select("hash", "author", "message_body", "proof_style", "insertions", "deletions")
    return rows.join(full, "hash", "left").withColumns(
        {"author": F.coalesce("author", F.lit("unknown")), "message_body": F.coalesce("message_body", F.lit("")), "proof_style": F.coalesce("proof_style", F.array().cast("array<string>")), "insertions": F.coalesce("insertions", F.lit(0)), "deletions": F.coalesce("deletions", F.lit(0))}
    )
