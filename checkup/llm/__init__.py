"""Training-data operators: near-duplicate joins, quality rules, token counts,
secret and licence scans, packing, sharding, tokenizer codecs and exact search.

Nothing else in the library imports this subpackage. ``queries.QUERIES`` and
``queries.ORACLE_SQL`` hold what ``__spark_entry__`` registers.
"""
