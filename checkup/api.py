"""Entry points for the three kinds of checks.

* ``infer`` -- candidate constraints for a set of tables (not null, unique,
  enum, foreign key), with DDL.
* ``report`` -- plan findings for a log of plan documents.
* ``record_and_diff`` -- compare new runs with the stored history of their
  queries, then store them (the batch form of the regression watch).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from checkup.operators.advise import UserRule, advise
from checkup.operators.infer import infer_constraints
from checkup.operators.history import redact_log
from checkup.plans.flatten import document_errors, flatten_plans, trim_plan_documents
from checkup.sinks.report import record_runs
from checkup.sources.catalog import Catalog, columns_listing
from checkup.streaming.watch import RegressionWatch


def infer(tables: dict[str, DataFrame], catalog: Catalog | None = None, **options) -> DataFrame:
    """Findings of the inference rules. Without a catalog, one is derived from
    the tables' schemas (every column nullable, nothing declared)."""
    if catalog is None:
        spark = next(iter(tables.values())).sparkSession
        catalog = Catalog(columns_listing(spark, tables))
    return infer_constraints(tables, catalog, **options)


def report(runs: DataFrame, catalog: Catalog | None = None, *, json_col: str = "plan_json",
           extra_rules: list[UserRule] | None = None, isolate: bool = True) -> DataFrame:
    """Findings of the plan rules over every document in ``runs`` (which needs
    ``run_id`` and the document column), and one for each document that cannot
    be read."""
    nodes = flatten_plans(runs, json_col)
    return (advise(nodes, catalog, extra_rules=extra_rules, isolate=isolate)
            .unionByName(document_errors(runs, json_col)))


def record_and_diff(new_runs: DataFrame, base_path: str, batch_id: int) -> DataFrame:
    """Diff ``new_runs`` (run_id, query_hash, git_ref, plan_json) against the
    latest stored run of each query, then store them.

    ``base_path`` holds ``runs`` (history, K4; credentials in query texts are
    redacted, documents trimmed, K5), ``state`` (latest run per query), ``diffs`` and ``errors`` (one
    finding for each document that cannot be read); batch ``batch_id`` must follow the previous one.
    Re-running a batch id replaces its partitions, so nothing doubles."""
    watch = RegressionWatch(source="", output=f"{base_path}/diffs", state=f"{base_path}/state",
                            checkpoint="")
    watch.process_batch(new_runs, batch_id)
    record_runs(trim_plan_documents(redact_log(new_runs)), f"{base_path}/runs", batch_id)
    record_runs(document_errors(new_runs), f"{base_path}/errors", batch_id)
    spark = new_runs.sparkSession
    return spark.read.parquet(f"{base_path}/diffs").where(f"batch_id = {int(batch_id)}").drop("batch_id")
