"""Plan history (H2-H5): runs keyed by query fingerprint, newest run per
query, runs newest first, and each run paired with its previous run.

"Previous" follows ``run_id`` (arrival order), not timestamps. One query may
hold a large share of all runs, so ordering within a query never sends a whole
query to one task: all runs are cut into run_id ranges of equal count; each
(query, range) pair is ordered on its own, and a summary row per pair carries the last
run and the run count across the borders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from checkup.functions.fingerprint import query_hash
from checkup.functions.text import redact_credentials
from checkup.operators.run_store import with_gapless_ids
from checkup.session import materialize

# About this many runs are in one range.
ROWS_PER_BUCKET = 1 << 18


def with_fingerprint(runs: DataFrame, text_col: str = "query_text", out_col: str = "query_hash") -> DataFrame:
    """H1 applied to a log: adds the query fingerprint."""
    return runs.withColumn(out_col, query_hash(F.col(text_col)))


def redact_log(runs: DataFrame, cols: tuple[str, ...] = ("query_text",)) -> DataFrame:
    """F1 on the text columns of a log, before it is stored (K4)."""
    for c in cols:
        if c in runs.columns:
            runs = runs.withColumn(c, redact_credentials(F.col(c)))
    return runs


def in_ranges(df: DataFrame, key: str, order: str, rows_per_range: int) -> DataFrame:
    """``df`` with ``_b``, a range number that grows with (key, order). The rows are
    range-partitioned by both columns into as many ranges as their number asks for, so a
    large key spans several ranges and none has many more than ``rows_per_range`` rows (a third
    is left for the error of Spark's sampled bounds). More than one range is
    written once, which fixes the bounds for everything that reads them."""
    ranges = -(-df.count() * 4 // (3 * rows_per_range))
    if ranges < 2:
        return df.withColumn("_b", F.lit(0))
    ranged = df.repartitionByRange(ranges, F.col(key), F.col(order))
    return materialize(ranged.withColumn("_b", F.spark_partition_id()), "ordered-ranges")


def sequence_within(df: DataFrame, key: str, order: str, *, carry: tuple[str, ...] = (),
                    rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds, per row, within its ``key`` group ordered by ``order`` (unique):
    ``prev_<order>`` and ``prev_<c>`` for each carried column ``c`` (values of
    the previous row, null on the first), ``pos_asc`` (1 = first) and
    ``pos_desc`` (1 = last). Rows with a null key are one group.

    A group never goes to one task whole. All rows are sorted into ranges of
    (key, order) (``in_ranges``), as many as the data need; rows are windowed per (key, range),
    and nothing is joined on the bare key. A summary row per (key, range) carries the last row
    and the count over to the ranges behind it (a prefix scan): there are as many of
    them as keys and ranges together, as only the first and last key of a range
    lie in others too. The input is read more than once; pass a materialised table
    (``checkup.session.materialize``) when it is costly to compute.
    """
    payload = F.struct(*[F.col(c) for c in (order, *carry)])
    inb = Window.partitionBy(key, "_b").orderBy(order)
    cut = in_ranges(df, key, order, rows_per_bucket)
    rows = (cut.withColumn("_prev_in", F.lag(payload).over(inb))
            .withColumn("_pos_in", F.row_number().over(inb).cast("bigint")))
    byb = Window.partitionBy(key).orderBy("_b")
    summary = (cut.groupBy(key, "_b")
               .agg(F.max_by(payload, F.col(order)).alias("_blast"), F.count(F.lit(1)).alias("_bn"))
               .withColumn("_prev_blast", F.lag("_blast").over(byb))
               .withColumn("_before", F.coalesce(F.sum("_bn").over(
                   byb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .withColumn("_total", F.sum("_bn").over(Window.partitionBy(key)))
               .select(F.col(key).alias("_key"), F.col("_b").alias("_sb"), "_prev_blast", "_before", "_total"))
    out = rows.join(summary, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_sb")), "inner")
    prev = F.coalesce(F.col("_prev_in"), F.col("_prev_blast"))
    pos = F.col("_before") + F.col("_pos_in")
    out = out.withColumn("_prev", prev)
    for c in (order, *carry):
        out = out.withColumn(f"prev_{c}", F.col("_prev")[c])
    return (out.withColumn("pos_asc", pos.cast("bigint"))
            .withColumn("pos_desc", (F.col("_total") - pos + 1).cast("bigint"))
            .drop("_b", "_prev_in", "_pos_in", "_prev_blast", "_before", "_total", "_prev", "_key", "_sb"))


def latest_runs(runs: DataFrame, key: str = "query_hash", order: str = "run_id") -> DataFrame:
    """H3: the run with the highest ``run_id`` of each query (one aggregation,
    combined map-side; no sort)."""
    others = [c for c in runs.columns if c != key]
    packed = F.max_by(F.struct(*[F.col(c) for c in others]), F.col(order))
    return runs.groupBy(key).agg(packed.alias("_r")).select(key, "_r.*")


def runs_newest_first(runs: DataFrame, query_hash_value: str | None = None,
                      key: str = "query_hash", order: str = "run_id") -> DataFrame:
    """H4: with a fingerprint, that query's runs ordered newest first; without,
    every run with its position from the newest (``pos_desc``, 1 = latest)."""
    if query_hash_value is not None:
        return runs.where(F.col(key) == query_hash_value).orderBy(F.desc(order))
    return sequence_within(runs, key, order).drop("pos_asc")


def previous_runs(runs: DataFrame, key: str = "query_hash", order: str = "run_id",
                  carry: tuple[str, ...] = ()) -> DataFrame:
    """H5: each run with ``prev_run_id``, the latest earlier run of its query
    (null on the first run), and ``prev_<c>`` for carried columns."""
    return sequence_within(runs, key, order, carry=carry).drop("pos_asc", "pos_desc")


def assign_run_ids(new_runs: DataFrame, start_after: int, order_cols: tuple[str, ...] = ("recorded_at",)) -> DataFrame:
    """H2: ``run_id`` for runs that arrive without one, in ``order_cols`` order, without
    gaps, from the first id above ``start_after`` (the largest stored id). See
    ``run_store`` for ids that two writers cannot both take."""
    ids = with_gapless_ids(new_runs, order_cols, int(start_after) + 1)
    return ids.select(*new_runs.columns, "run_id")
