"""Summaries of evaluation runs by mode and deletion size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Drift measures, their kind and the metric that both sides have.
DRIFT = [
    ("mean_vo_bytes_ratio", "ratio", "vo_bytes"),
    ("mean_compile_time_ratio", "ratio", "compile_time_s"),
    ("mean_n_assumptions_diff", "diff", "n_assumptions"),
    ("mean_proof_chars_ratio", "ratio", "proof_chars"),
    ("mean_proof_lines_ratio", "ratio", "proof_lines"),
    ("mean_tactic_count_ratio", "ratio", "tactic_count"),
]
SIGNALS = [name for name, _, _ in DRIFT] + ["pass_rate", "mean_normalized_edit_distance"]


def passed() -> Column:
    """A PASS whose proof doesn't end in Admitted."""
    return (F.col("verdict") == "PASS") & ~F.coalesce(F.col("llm_metrics.ends_with_admitted"), F.lit(False))


def admitted() -> Column:
    """ADMITTED, or the older form of it: a PASS that ends in Admitted."""
    return (F.col("verdict") == "ADMITTED") | (F.col("verdict") == "PASS") & F.coalesce(F.col("llm_metrics.ends_with_admitted"), F.lit(False))


def _drift(kind: str, metric: str) -> Column:
    model, human = F.col(f"llm_metrics.{metric}").cast("double"), F.col(f"human_metrics.{metric}").cast("double")
    return F.avg(F.try_divide(model, human)) if kind == "ratio" else F.avg(model - human)


def group_summary(results: DataFrame) -> DataFrame:
    """One row per mode and deletion size; rows without a size are left out. Values are not rounded."""
    rows = results.where("deletion_size is not null").withColumn("mode", F.coalesce("mode", F.lit("baseline")))
    vo, human = F.col("llm_metrics.vo_bytes").cast("double"), F.col("human_metrics.vo_bytes").cast("double")
    grouped = rows.groupBy("mode", "deletion_size").agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(passed()).alias("n_pass"),
        F.count_if(admitted()).alias("n_admitted"),
        F.avg("inference_time_s").alias("mean_inference_time_s"),
        F.avg("output_tokens").alias("mean_output_tokens"),
        F.avg("normalized_edit_distance").alias("mean_normalized_edit_distance"),
        F.avg(vo).alias("mean_vo_bytes"),
        F.avg(F.when(human > 0, vo / human)).alias("mean_vo_bytes_human_ratio"),
        F.avg("llm_metrics.compile_time_s").alias("mean_compile_time_s"),
        F.avg("llm_metrics.n_assumptions").alias("mean_n_assumptions"),
        *[_drift(kind, metric).alias(name) for name, kind, metric in DRIFT],
        F.avg(F.when(F.col("mode") == "agent", F.col("agent_n_turns"))).alias("mean_agent_n_turns"),
    )
    return grouped.withColumn("pass_rate", F.col("n_pass") / F.col("n_total"))


def pearson(x: Column, y: Column) -> Column:
    """Pearson's r over pairs without nulls: null for fewer than three or no variance."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    n = F.count(x)
    xx, yy, xy = F.var_pop(x), F.var_pop(y), F.covar_pop(x, y)
    return F.when((n >= 3) & (xx > 0) & (yy > 0), F.try_divide(xy, F.sqrt(xx * yy)))


def faithfulness(groups: DataFrame) -> DataFrame:
    """r of deletion size and pass rate by mode."""
    return groups.groupBy("mode").agg(pearson(F.col("deletion_size"), F.col("pass_rate")).alias("r"))


def drift_faithfulness(groups: DataFrame) -> DataFrame:
    """r of deletion size and each signal, by signal and mode."""
    long = groups.unpivot(["mode", "deletion_size"], [F.col(s).cast("double").alias(s) for s in SIGNALS], "metric", "value")
    return long.groupBy("metric", "mode").agg(pearson(F.col("deletion_size"), F.col("value")).alias("r"))


def baseline_against_agent(groups: DataFrame) -> DataFrame:
    """Agent less baseline at the sizes that both have; the turns are the agent's own."""
    side = lambda mode: groups.where(F.col("mode") == mode).alias(mode)
    b, a = side("baseline"), side("agent")
    return b.join(a, F.col("baseline.deletion_size") == F.col("agent.deletion_size")).select(
        F.col("agent.deletion_size").alias("deletion_size"),
        F.col("baseline.n_total").alias("baseline_n_total"),
        F.col("agent.n_total").alias("agent_n_total"),
        (F.col("agent.pass_rate") - F.col("baseline.pass_rate")).alias("delta_pass_rate"),
        (F.col("agent.mean_normalized_edit_distance") - F.col("baseline.mean_normalized_edit_distance")).alias("delta_normalized_edit_distance"),
        F.col("agent.mean_agent_n_turns").alias("delta_mean_agent_n_turns"),
    )


def condition_summary(results: DataFrame) -> DataFrame:
    """One row per condition and deletion size of a run; here a verdict counts as it stands."""
    is_ = lambda *v: F.count_if(F.col("verdict").isin(*v))
    grouped = results.groupBy("condition", "deletion_size").agg(
        F.count(F.lit(1)).alias("n_challenges"),
        is_("PASS").alias("n_pass"),
        is_("ADMITTED").alias("n_admitted"),
        is_("FAIL").alias("n_fail"),
        is_("TIMEOUT", "ERROR").alias("n_error_or_timeout"),
        F.avg("inference_time_s").alias("mean_inference_time_s"),
        F.avg("output_tokens").alias("mean_output_tokens"),
        F.avg("tactic_edit_distance").alias("mean_tactic_edit_distance"),
        F.avg("normalized_edit_distance").alias("mean_normalized_edit_distance"),
    )
    return grouped.withColumn("pass_rate", F.col("n_pass") / F.col("n_challenges"))


def run_faithfulness(conditions: DataFrame) -> DataFrame:
    """r over condition B alone, as the runners state it."""
    return conditions.where("condition = 'B'").agg(pearson(F.col("deletion_size"), F.col("pass_rate")).alias("r"))


def human_outcomes(results: DataFrame, compiled: DataFrame, by_file: bool) -> DataFrame:
    """Human compile outcomes joined by commit, or by commit and file; the first of a key stands for all."""
    keys = ["commit_hash", "file_path"] if by_file else ["commit_hash"]
    order = [c for c in compiled.columns if c not in keys]
    first = compiled.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_o")).select(*keys, *[F.col(f"_o.{c}").alias(f"human_{c}" if c in results.columns else c) for c in order])
    return results.join(first, keys, "left")


def concatenated(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    """All parts in one, with the schema of ``empty`` where there are none."""
    out = empty.limit(0)
    for p in parts:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
