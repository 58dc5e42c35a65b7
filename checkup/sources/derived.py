"""Inputs derived by Spark from the TPC-H-style test tables.

* ``plan_runs_from_orders``: one plan document per order (a query log whose
  size grows with the tables), built with DataFrame functions and ``to_json``.
* ``as_is_tables`` / ``as_is_catalog``: the test tables with two null-bearing
  columns, and a catalog derived from their schemas.
* ``fk_tables`` / ``fk_catalog``: the tables renamed to ``*_id`` style with
  declared keys, for foreign-key inference.
* ``index_catalog``: secondary / unique indexes for the unused-index rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checkup.functions.fingerprint import query_hash
from checkup.sources.catalog import Catalog, columns_listing, constraints_listing, indexes_listing
from checkup.sources.tables import load_tables

# Fixed values of the derived plan log.
RELATION_BY_FLAG = {"A": "orders", "N": "customers", "R": "parts"}
CHILD_TYPE_BY_LINE_MOD4 = {0: "Sort", 1: "Seq Scan", 2: "Index Scan", 3: "Gather"}
QUERY_EVEN = "SELECT * FROM orders WHERE o_custkey = {k} AND note <> 'As Is'"
QUERY_ODD = "select *\n  FROM   Orders where O_CUSTKEY = {k}  and NOTE <> 'As Is' "
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_returnflag"]  # lines equal in these have equal nodes


def _query_text(k: F.Column, orderkey: F.Column) -> F.Column:
    even_a, even_b = QUERY_EVEN.split("{k}")
    odd_a, odd_b = QUERY_ODD.split("{k}")
    ks = k.cast("string")
    return F.when(orderkey % 2 == 0, F.concat(F.lit(even_a), ks, F.lit(even_b))) \
        .otherwise(F.concat(F.lit(odd_a), ks, F.lit(odd_b)))


def _line_node(line: F.Column) -> F.Column:
    """The plan node of a line item."""
    lm4 = line["l_linenumber"] % 4
    node_type = F.try_element_at(F.create_map(*[F.lit(x) for kv in CHILD_TYPE_BY_LINE_MOD4.items() for x in kv]), lm4)
    relation = F.when(lm4.isin(1, 2), F.try_element_at(
        F.create_map(*[F.lit(x) for kv in RELATION_BY_FLAG.items() for x in kv]), line["l_returnflag"]))
    actual_rows = F.when(line["l_linenumber"] == 7, F.lit(None).cast("double")) \
        .when(line["l_suppkey"] % 10 == 0, F.lit(0.0)) \
        .otherwise(F.floor(line["l_extendedprice"]).cast("double"))
    grandchild = F.when(lm4 == 0, F.array(F.struct(
        F.lit("Seq Scan").alias("Node Type"),
        F.lit("orders").alias("Relation Name"),
        (line["l_partkey"] * 100).alias("Plan Rows"),
        (line["l_extendedprice"] / 200).alias("Total Cost"),
    )))
    return F.struct(
        node_type.alias("Node Type"),
        relation.alias("Relation Name"),
        line["l_quantity"].alias("Plan Rows"),
        actual_rows.alias("Actual Rows"),
        (line["l_partkey"] * 10).alias("Actual Loops"),
        (line["l_extendedprice"] / 100).alias("Total Cost"),
        F.when(lm4 == 0, F.when(line["l_tax"] > 0.04, F.lit("External Merge"))
               .otherwise(F.lit("quicksort"))).alias("Sort Method"),
        F.when(lm4 == 0, line["l_partkey"]).alias("Sort Space Used"),
        grandchild.alias("Plans"),
    )


def plan_runs_from_orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One run per order: run_id, query_text, query_hash, git_ref, recorded_at,
    execution_time_ms, plan_json.

    Root: Nested Loop (Plan Rows 100, Actual Rows 950, Actual Loops 1, Total
    Cost o_totalprice / 1000). One child per line item, in line order; the child
    type follows l_linenumber % 4 (Sort, Seq Scan, Index Scan, Gather). Scans
    name a relation by return flag. A Sort holds one Seq Scan on orders.
    """
    # One shuffle, no join: order rows and line rows meet in one group per
    # order key (an order and its few lines), lines sorted inside the group. Nodes are
    # built behind the shuffle, which carries what they are built from.
    line = F.struct(*[F.col(c) for c in LINE_ORDER])
    order = F.struct("o_custkey", "o_totalprice", "o_orderdate")
    o_side = orders.select(F.col("o_orderkey").alias("_k"), order.alias("_o"))
    l_side = lineitem.select(F.col("l_orderkey").alias("_k"), line.alias("_l"))
    both = o_side.withColumn("_l", F.lit(None).cast(l_side.schema["_l"].dataType)).unionByName(
        l_side.withColumn("_o", F.lit(None).cast(o_side.schema["_o"].dataType)))
    runs = (both.groupBy("_k")
            .agg(F.max("_o").alias("_o"), F.sort_array(F.collect_list("_l")).alias("_lines"))
            .where(F.col("_o").isNotNull())
            .select(F.col("_k").alias("o_orderkey"), "_o.*",
                    F.when(F.size("_lines") > 0, F.transform("_lines", _line_node)).alias("children")))
    exec_ms = F.when(F.col("o_orderkey") % 5 == 0, F.lit(None).cast("double")) \
        .otherwise(F.col("o_totalprice") / 1000)
    root = F.struct(
        F.lit("Nested Loop").alias("Node Type"),
        F.lit(100).alias("Plan Rows"),
        F.lit(950).alias("Actual Rows"),
        F.lit(1).alias("Actual Loops"),
        (F.col("o_totalprice") / 1000).alias("Total Cost"),
        F.col("children").alias("Plans"),
    )
    doc = F.array(F.struct(root.alias("Plan"),
                           (F.col("o_totalprice") / 100000).alias("Planning Time"),
                           exec_ms.alias("Execution Time")))
    qtext = _query_text(F.col("o_custkey"), F.col("o_orderkey"))
    return runs.select(
        F.col("o_orderkey").alias("run_id"),
        qtext.alias("query_text"),
        query_hash(qtext).alias("query_hash"),
        F.concat(F.lit("r"), (F.col("o_orderkey") % 10).cast("string")).alias("git_ref"),
        F.col("o_orderdate").cast("timestamp").alias("recorded_at"),
        exec_ms.alias("execution_time_ms"),
        F.to_json(doc).alias("plan_json"),
    )


def plan_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load_tables(spark, sf_dir, ["orders", "lineitem"])
    return plan_runs_from_orders(t["orders"], t["lineitem"])


def broken_plan_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived log with three of every seven documents spoilt: missing, cut
    short, and without a plan."""
    turn = F.col("run_id") % 7
    doc = (F.when(turn == 0, F.lit(None).cast("string"))
           .when(turn == 1, F.expr("substring(plan_json, 1, length(plan_json) - 1)"))
           .when(turn == 2, F.lit('[{"Planning Time": 1.5}]')).otherwise(F.col("plan_json")))
    return plan_runs(spark, sf_dir).withColumn("plan_json", doc)


def supplier_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plan document per supplier of lineitem: an Aggregate over a Seq Scan, whose
    rows and cost are the supplier's lines and highest price. Of every seven
    suppliers one has its document cut short and one has a document without a plan."""
    k = F.col("l_suppkey")
    t = load_tables(spark, sf_dir, ["lineitem"])["lineitem"].groupBy(k).agg(
        F.count(F.lit(1)).alias("n"), F.max("l_extendedprice").alias("price"))
    scan = F.struct(F.lit("Seq Scan").alias("Node Type"), F.lit("line_items").alias("Relation Name"),
                    F.col("n").alias("Plan Rows"), (F.col("price") / 200).alias("Total Cost"))
    root = F.struct(F.lit("Aggregate").alias("Node Type"), F.lit(1).alias("Plan Rows"),
                    (F.col("price") / 100).alias("Total Cost"), F.array(scan).alias("Plans"))
    doc = (F.when(k % 7 == 1, F.expr("substring(doc, 1, length(doc) - 1)"))
           .when(k % 7 == 2, F.lit('[{"Planning Time": 1.5}]')).otherwise(F.col("doc")))
    return t.withColumn("doc", F.to_json(F.array(F.struct(root.alias("Plan"))))).select(k, doc.alias("doc"))


def as_is_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All test tables; lineitem and orders gain one column with nulls each."""
    t = load_tables(spark, sf_dir)
    t["lineitem"] = t["lineitem"].withColumn(
        "l_returnflag_or_null", F.nullif(F.col("l_returnflag"), F.lit("R")))
    t["orders"] = t["orders"].withColumn(
        "o_orderstatus_or_null", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    return t


def as_is_catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> Catalog:
    """Column listing from the schemas (all nullable), nothing declared."""
    return Catalog(columns_listing(spark, tables))


def fk_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = load_tables(spark, sf_dir, ["region", "nation", "customer", "supplier", "part",
                                    "orders", "lineitem", "events"])
    c = F.col
    return {
        "regions": t["region"].select(c("r_regionkey").alias("id"), c("r_name").alias("name")),
        "nations": t["nation"].select(c("n_nationkey").alias("id"), c("n_name").alias("name"),
                                      c("n_regionkey").alias("region_id")),
        "customers": t["customer"].select(c("c_custkey").alias("id"), c("c_name").alias("name"),
                                          c("c_nationkey").alias("nation_id")),
        "suppliers": t["supplier"].select(c("s_suppkey").alias("id"), c("s_name").alias("name"),
                                          c("s_nationkey").alias("nation_id")),
        "parts": t["part"].select(c("p_partkey").alias("id"), c("p_name").alias("name")),
        "part": t["part"].select(c("p_partkey").alias("id"), c("p_name").alias("name")),
        "orders": t["orders"].select(c("o_orderkey").alias("id"), c("o_custkey").alias("customer_id"),
                                     c("o_orderstatus").alias("status"), c("o_totalprice").alias("total")),
        "line_items": t["lineitem"].select(c("l_orderkey").alias("order_id"), c("l_partkey").alias("part_id"),
                                           c("l_suppkey").alias("supplier_id"),
                                           c("l_linenumber").alias("line_number"),
                                           c("l_partkey").alias("customer_id")),
        "events": t["events"].select("event_id", "user_id", "event_type"),
    }


# Keys declared in the renamed catalog.
FK_PRIMARY_KEYS = {"regions": "id", "nations": "id", "customers": "id", "suppliers": "id",
                   "parts": "id", "orders": "id", "events": "event_id"}
FK_DECLARED = [("suppliers", "suppliers_nation_id_fkey", "nation_id", "nations(id)")]


def fk_catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> Catalog:
    cons = [(t, f"{t}_pkey", "p", [col], f"PRIMARY KEY ({col})") for t, col in FK_PRIMARY_KEYS.items()]
    cons += [(t, name, "f", [col], f"FOREIGN KEY ({col}) REFERENCES {ref}") for t, name, col, ref in FK_DECLARED]
    not_null = {t: [col] for t, col in FK_PRIMARY_KEYS.items()}
    return Catalog(columns_listing(spark, tables, not_null=not_null),
                   constraints=constraints_listing(spark, cons))


# Indexes known for the unused-index rule.
INDEXES = [
    ("orders", "ix_orders_customer_id", ["customer_id"], False, None),
    ("orders", "ix_orders_status", ["status"], False, None),
    ("orders", "orders_pkey", ["id"], True, None),
    ("customers", "customers_pkey", ["id"], True, None),
]


def index_catalog(spark: SparkSession) -> DataFrame:
    return indexes_listing(spark, INDEXES)
