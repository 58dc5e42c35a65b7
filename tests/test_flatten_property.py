"""Random plan trees: Spark's flattening equals a plain recursive walk."""

import json
import random

from checkup.functions.nodetypes import NODE_TYPE_NAMES
from checkup.plans import flatten_plans, plan_summaries

TYPES = list(NODE_TYPE_NAMES) + ["Gather", "Memoize", "Incremental Sort"]


def random_tree(rnd, depth=0):
    n = {"Node Type": rnd.choice(TYPES), "Plan Rows": rnd.randrange(0, 50000),
         "Total Cost": round(rnd.random() * 1000, 2)}
    if rnd.random() < 0.5:
        n["Actual Rows"] = rnd.randrange(0, 5000)
    if rnd.random() < 0.5:
        n["Actual Loops"] = rnd.randrange(0, 20000)
    if rnd.random() < 0.3:
        n["Relation Name"] = rnd.choice(["a", "b", "c"])
    if depth < 6 and rnd.random() < 0.7:
        n["Plans"] = [random_tree(rnd, depth + 1) for _ in range(rnd.randrange(0, 4))]
    return n


def walk(node, depth=0):
    """Expected rows: pre-order, parent before children, children in order."""
    kids = node.get("Plans", [])
    loops = [float(k.get("Actual Loops", 1)) for k in kids]
    yield (node["Node Type"], float(node.get("Plan Rows", 0)), node.get("Relation Name"), depth,
           len(kids), max(loops) if loops else 0.0)
    for k in kids:
        yield from walk(k, depth + 1)


def test_random_trees_match_recursive_walk(spark):
    rnd = random.Random(11)
    docs, expected = [], {}
    for i in range(300):
        root = random_tree(rnd)
        payload = [{"Plan": root, "Execution Time": 1.0}] if i % 2 else {"Plan": root}
        docs.append((i, json.dumps(payload)))
        expected[i] = list(walk(root))
    runs = spark.createDataFrame(docs, "run_id long, plan_json string")
    got: dict[int, list] = {}
    for r in flatten_plans(runs).orderBy("run_id", "node_ord").collect():
        got.setdefault(r.run_id, []).append((r.node_type_raw, r.estimated_rows, r.relation, r.depth,
                                             r.child_count, r.max_child_loops))
    assert got == expected
    counts = {r.run_id: r.node_count for r in plan_summaries(runs).collect()}
    assert counts == {i: len(v) for i, v in expected.items()}
