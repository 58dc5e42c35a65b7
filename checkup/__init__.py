"""checkup: table-health and query-plan checks written as Spark jobs.

Sub-packages:

* ``sources``   -- table, catalog-listing and plan-document inputs
* ``functions`` -- column expressions (quoting, redaction, fingerprints, formats)
* ``operators`` -- profiling, constraint inference, catalog assembly, plan
  rules, history pairing and plan diffs
* ``plans``     -- flattening of plan documents into a node table
* ``streaming`` -- regression watch over arriving plan runs
* ``sinks``     -- findings JSON, DDL scripts, report lines, history tables
"""

__version__ = "0.1.0"
