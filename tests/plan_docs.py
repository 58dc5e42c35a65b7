"""Small plan documents for the tests (written for these tests)."""

import json


def node(node_type, rows, cost, *, relation=None, actual=None, loops=None, time=None, plans=None, **extra):
    n = {"Node Type": node_type, "Plan Rows": rows, "Total Cost": cost}
    if relation is not None:
        n["Relation Name"] = relation
    if actual is not None:
        n["Actual Rows"] = actual
    if loops is not None:
        n["Actual Loops"] = loops
    if time is not None:
        n["Actual Total Time"] = time
    if plans is not None:
        n["Plans"] = plans
    n.update(extra)
    return n


def doc(root, planning=None, execution=None, as_list=True, **top):
    d = {"Plan": root}
    if planning is not None:
        d["Planning Time"] = planning
    if execution is not None:
        d["Execution Time"] = execution
    d.update(top)
    return json.dumps([d] if as_list else d)


# A nested loop over a sequential scan, probing an index 950 times.
SLOW = doc(node("Nested Loop", 100, 250.5, actual=950, loops=1, time=12.3, plans=[
    node("Seq Scan", 100, 200.0, relation="orders", actual=950, loops=1, time=8.0),
    node("Index Scan", 1, 0.5, relation="customers", actual=1, loops=950, time=0.004),
]), planning=0.35, execution=13.1)

# The same query after an index: both sides are index scans.
FAST = doc(node("Nested Loop", 100, 30.5, actual=950, loops=1, time=1.2, plans=[
    node("Index Scan", 100, 10.0, relation="orders", actual=950, loops=1, time=0.4),
    node("Index Scan", 1, 0.5, relation="customers", actual=1, loops=950, time=0.004),
]), planning=0.3, execution=1.9)

# A single large sequential scan (25,000 rows).
BIG_SCAN = doc(node("Seq Scan", 24763, 2013.0, relation="orders", actual=25000, loops=1, time=14.5),
               planning=1.4, execution=15.6, Triggers=[])


def chain(depth):
    n = node("Seq Scan", 10, 1.0, relation="t")
    for i in range(depth - 1):
        n = node("Hash" if i % 2 else "Sort", 10, 1.0 + i, plans=[n])
    return doc(n)
