"""Plan node type names -> normalised node types."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The node type names recognised, and the normalised type of each.
# Every other name (e.g. "Gather", "Incremental Sort") becomes UNKNOWN.
NODE_TYPE_NAMES = {
    "Seq Scan": "SEQ_SCAN",
    "Index Scan": "INDEX_SCAN",
    "Index Only Scan": "INDEX_ONLY_SCAN",
    "Bitmap Heap Scan": "BITMAP_HEAP_SCAN",
    "Bitmap Index Scan": "BITMAP_INDEX_SCAN",
    "Nested Loop": "NESTED_LOOP",
    "Hash Join": "HASH_JOIN",
    "Merge Join": "MERGE_JOIN",
    "Hash": "HASH",
    "Sort": "SORT",
    "Aggregate": "AGGREGATE",
    "Limit": "LIMIT",
}
UNKNOWN = "UNKNOWN"


def normalize_node_type(c: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for x in chain.from_iterable(NODE_TYPE_NAMES.items())])
    return F.coalesce(F.try_element_at(mapping, F.coalesce(c, F.lit(""))), F.lit(UNKNOWN))
