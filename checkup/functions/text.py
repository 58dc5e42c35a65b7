"""String building, quoting, redaction and number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The credential pattern of a libpq-style URL and its replacement.
CREDENTIAL_PATTERN = r"(://[^:/@]+:)[^@]*(@)"
CREDENTIAL_REPLACEMENT = "$1***$2"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def redact_credentials(c: Column | str) -> Column:
    """replace the password of every ``scheme://user:password@`` in the text."""
    return F.regexp_replace(_col(c), CREDENTIAL_PATTERN, CREDENTIAL_REPLACEMENT)


def quote_ident(c: Column | str) -> Column:
    """``"name"`` with inner double quotes doubled."""
    return F.concat(F.lit('"'), F.replace(_col(c), F.lit('"'), F.lit('""')), F.lit('"'))


def quote_literal(c: Column | str) -> Column:
    """SQL string literal: ``'value'`` with inner single quotes doubled."""
    return F.concat(F.lit("'"), F.replace(_col(c), F.lit("'"), F.lit("''")), F.lit("'"))


def fmt_half_even(c: Column | str) -> Column:
    """a double shown with no decimals, ties to even (like ``f"{x:.0f}"``)."""
    return F.call_function("format_number", _col(c).cast("double"), F.lit("0"))


def trunc_int(c: Column | str) -> Column:
    """truncate toward zero and show as an integer (like ``int(x)``). Values
    beyond 38 digits, infinities and NaN are shown as the double is written."""
    d = _col(c).cast("double")
    small = F.when(F.abs(d) < F.lit(9.0e18), d)  # a branch that does not apply must not overflow
    large = F.when((F.abs(d) >= F.lit(9.0e18)) & (F.abs(d) < F.lit(1.0e37)), d)
    return F.coalesce(small.cast("bigint").cast("string"),
                      large.cast("decimal(38,0)").cast("string"), d.cast("string"))
