"""Inputs: tables (S1), plan documents (S2/S3), catalog listings."""

from checkup.sources.tables import TEST_TABLES, load_tables  # noqa: F401
from checkup.sources.catalog import (  # noqa: F401
    Catalog,
    columns_listing,
    constraints_listing,
    indexes_listing,
    pg_type_name,
)
from checkup.sources.plan_docs import read_plan_files, stream_plan_files  # noqa: F401
