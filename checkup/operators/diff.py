"""Plan diffs (D1-D4) between a run and its previous run of the same query.

Verdict per pair: node counts differ -> STRUCTURE_CHANGED (not aligned).
Otherwise the metric of each side is its execution time if present, else its
root cost; before null/0 or after null -> SAME; after < 0.9 x before -> FASTER;
after > 1.1 x before -> SLOWER; else SAME. Node deltas pair nodes by pre-order
position for aligned pairs only.

Documents are parsed once into per-run summaries (node count, root cost,
execution time, and for D2 the pre-order node list), written once to the
shared folder. The previous run's summary travels with the skew-safe ordered
window of ``history.sequence_within``, so the pairing needs no self-join on
the query key. Explicit pairs (D3) join on ``run_id``, which is unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checkup.operators.history import previous_runs
from checkup.plans.flatten import plan_summaries
from checkup.session import materialize

# Verdict names and the +-10% band of "no meaningful change".
FASTER, SLOWER, SAME, STRUCTURE_CHANGED = "FASTER", "SLOWER", "SAME", "STRUCTURE_CHANGED"
SAME_LOW = 0.9
SAME_HIGH = 1.1


def _metric(prefix: str) -> tuple[Column, Column]:
    t = F.col(f"{prefix}execution_time_ms")
    value = F.coalesce(t, F.col(f"{prefix}root_cost"))
    kind = F.when(t.isNotNull(), F.lit("execution_time")).otherwise(F.lit("root_cost"))
    return value, kind


def _verdict(pairs: DataFrame) -> DataFrame:
    mb, kb = _metric("b_")
    ma, ka = _metric("a_")
    aligned = F.col("b_node_count") == F.col("a_node_count")
    verdict = (F.when(~aligned, F.lit(STRUCTURE_CHANGED))
               .when(mb.isNull() | ma.isNull() | (mb == 0), F.lit(SAME))
               .when(ma < mb * F.lit(SAME_LOW), F.lit(FASTER))
               .when(ma > mb * F.lit(SAME_HIGH), F.lit(SLOWER))
               .otherwise(F.lit(SAME)))
    return pairs.select(
        "*", verdict.alias("verdict"), aligned.alias("aligned"),
        mb.alias("metric_before"), ma.alias("metric_after"),
        kb.alias("metric_before_kind"), ka.alias("metric_after_kind"))


def run_summaries(runs: DataFrame, json_col: str = "plan_json", with_nodes: bool = False) -> DataFrame:
    keep = tuple(c for c in ("run_id", "query_hash", "git_ref") if c in runs.columns)
    return plan_summaries(runs, json_col, keep=keep, with_nodes=with_nodes)


def _side(summ: DataFrame, prefix: str) -> DataFrame:
    return summ.select(*[F.col(c).alias(prefix + c) for c in
                         ("run_id", "node_count", "root_cost", "execution_time_ms")])


def diff_pairs(summaries: DataFrame, pairs: DataFrame,
               before_col: str = "before_run_id", after_col: str = "after_run_id") -> DataFrame:
    """D3: verdicts for explicit (before, after) run pairs, e.g. a baseline
    and a candidate plan. Joins on run_id, which is unique per run."""
    j = (pairs.join(_side(summaries, "b_"), F.col(before_col) == F.col("b_run_id"), "inner")
         .join(_side(summaries, "a_"), F.col(after_col) == F.col("a_run_id"), "inner"))
    out = _verdict(j)
    return out.select(
        F.col(before_col).alias("before_run_id"), F.col(after_col).alias("after_run_id"),
        "verdict", "aligned",
        F.col("b_node_count").alias("node_count_before"), F.col("a_node_count").alias("node_count_after"),
        F.col("b_execution_time_ms").alias("time_before_ms"), F.col("a_execution_time_ms").alias("time_after_ms"),
        "metric_before", "metric_after", "metric_before_kind", "metric_after_kind")


_CARRY = ("node_count", "root_cost", "execution_time_ms")


def _paired(summ: DataFrame) -> DataFrame:
    """Each run with the summary of its previous run of the same query, carried
    by the (skew-safe) ordered window -- no self-join."""
    seq = previous_runs(summ, carry=_CARRY)
    renames = {"node_count": "a_node_count", "root_cost": "a_root_cost",
               "execution_time_ms": "a_execution_time_ms", "prev_node_count": "b_node_count",
               "prev_root_cost": "b_root_cost", "prev_execution_time_ms": "b_execution_time_ms"}
    for old, new in renames.items():
        seq = seq.withColumnRenamed(old, new)
    return seq


def diff_runs(runs: DataFrame | None, json_col: str = "plan_json",
              summaries: DataFrame | None = None, materialize_summaries: bool = True) -> DataFrame:
    """Every run with its previous run of the same query and the verdict.

    First runs are kept with ``prev_run_id``, ``verdict`` and the other diff
    columns null. Columns: run_id, query_hash, git_ref, prev_run_id, verdict,
    aligned, node counts, times, metrics and metric kinds.

    Documents are parsed once into per-run summaries, which are written to
    the shared folder (``materialize_summaries``) because the ordered window
    reads them twice; then one shuffle by (query, run range)."""
    if summaries is None:
        summaries = run_summaries(runs, json_col)
        if materialize_summaries:
            summaries = materialize(summaries, "run-summaries")
    v = _verdict(_paired(summaries))
    return _diff_columns(v)


def _diff_columns(v: DataFrame) -> DataFrame:
    first = F.col("prev_run_id").isNull()

    def unless_first(c: Column) -> Column:
        return F.when(~first, c)

    return v.select(
        "run_id", "query_hash", "git_ref", "prev_run_id",
        unless_first(F.col("verdict")).alias("verdict"),
        unless_first(F.col("aligned")).alias("aligned"),
        F.col("b_node_count").alias("node_count_before"), F.col("a_node_count").alias("node_count_after"),
        F.col("b_execution_time_ms").alias("time_before_ms"), F.col("a_execution_time_ms").alias("time_after_ms"),
        unless_first(F.col("metric_before")).alias("metric_before"),
        F.col("metric_after"),
        unless_first(F.col("metric_before_kind")).alias("metric_before_kind"),
        F.col("metric_after_kind"))


def node_deltas(runs: DataFrame, json_col: str = "plan_json", materialize_summaries: bool = True) -> DataFrame:
    """For each run aligned with its previous run (same node count), one row
    per node position: after's type, relation (after's or else before's),
    estimated cost / rows and actual time of both sides, and whether the
    normalised type changed. Runs are paired by their ids and counts alone; the
    node lists of aligned pairs are then fetched by ``run_id``, which is unique."""
    summ = run_summaries(runs, json_col, with_nodes=True)
    if materialize_summaries:
        summ = materialize(summ, "run-node-lists")
    pairs = previous_runs(summ.select("run_id", "query_hash", "node_count"), carry=("node_count",))
    aligned = (pairs.where(F.col("prev_run_id").isNotNull() & (F.col("node_count") == F.col("prev_node_count")))
               .select("run_id", "prev_run_id"))
    z = (aligned.join(summ.select("run_id", F.col("nodes").alias("a")), "run_id")
         .join(summ.select(F.col("run_id").alias("prev_run_id"), F.col("nodes").alias("b")), "prev_run_id")
         .select("run_id", "prev_run_id", F.explode(F.arrays_zip("b", "a")).alias("z")))
    return _delta_columns(z.select("run_id", "prev_run_id", F.col("z.a").alias("a"), F.col("z.b").alias("b")))


def _delta_columns(z: DataFrame) -> DataFrame:
    return z.select(
        "run_id", "prev_run_id",
        F.col("a.node_ord").alias("node_ord"),
        F.col("a.node_type").alias("node_type"),
        F.coalesce(F.nullif(F.col("a.relation"), F.lit("")), F.col("b.relation")).alias("relation"),  # an empty name is none
        F.col("b.estimated_cost").alias("cost_before"), F.col("a.estimated_cost").alias("cost_after"),
        F.col("b.estimated_rows").alias("rows_before"), F.col("a.estimated_rows").alias("rows_after"),
        F.col("b.actual_time_ms").alias("time_before"), F.col("a.actual_time_ms").alias("time_after"),
        (F.col("a.node_type") != F.col("b.node_type")).alias("node_type_changed"))


# What is compared of a node.
DELTA_COLS = ["node_ord", "node_type", "relation", "estimated_cost", "estimated_rows", "actual_time_ms"]


def node_deltas_for_pairs(pairs: DataFrame, nodes: DataFrame, before_col: str = "before_run_id",
                          after_col: str = "after_run_id") -> DataFrame:
    """D2 for explicit pairs (D3): nodes joined on (run_id, node_ord); pairs
    whose node counts differ give no rows."""
    counts = nodes.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"))
    ok = (pairs.join(counts.select(F.col("run_id").alias("_b"), F.col("_n").alias("_nb")),
                     F.col(before_col) == F.col("_b"))
          .join(counts.select(F.col("run_id").alias("_a"), F.col("_n").alias("_na")),
                F.col(after_col) == F.col("_a"))
          .where(F.col("_na") == F.col("_nb")).select(F.col(before_col).alias("prev_run_id"),
                                                      F.col(after_col).alias("run_id")))
    cols = DELTA_COLS
    a = nodes.select(F.col("run_id"), F.struct(*cols).alias("a"), F.col("node_ord").alias("_o"))
    b = nodes.select(F.col("run_id").alias("_rb"), F.struct(*cols).alias("b"), F.col("node_ord").alias("_ob"))
    j = ok.join(a, "run_id").join(b, (F.col("prev_run_id") == F.col("_rb")) & (F.col("_o") == F.col("_ob")))
    return _delta_columns(j.select("run_id", "prev_run_id", "a", "b"))


def slowdown_history(diffs: DataFrame) -> DataFrame:
    """D4: "when did this get slow?" -- per query, how many runs were SLOWER than
    their previous run, and the first and last such run with its git_ref."""
    slow = diffs.where(F.col("verdict") == SLOWER)
    return slow.groupBy("query_hash").agg(
        F.count(F.lit(1)).alias("slower_runs"),
        F.min("run_id").alias("first_slower_run_id"),
        F.min_by("git_ref", "run_id").alias("first_slower_git_ref"),
        F.max("run_id").alias("last_slower_run_id"),
        F.max_by("git_ref", "run_id").alias("last_slower_git_ref"))
