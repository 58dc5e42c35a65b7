"""Column expressions shared by the operators (all JVM-side built-ins)."""

from checkup.functions.text import (  # noqa: F401
    fmt_half_even,
    quote_ident,
    quote_literal,
    redact_credentials,
    trunc_int,
)
from checkup.functions.fingerprint import normalize_query, query_hash  # noqa: F401
from checkup.functions.nodetypes import NODE_TYPE_NAMES, normalize_node_type  # noqa: F401
