"""Plan documents -> plan node table (N1-N6) and stored payloads (K5)."""

from checkup.plans.flatten import (  # noqa: F401
    flatten_plans,
    parse_plan_documents,
    plan_summaries,
    split_plan_documents,
    trim_plan_documents,
)
