"""H1: query fingerprint.

The text is cut into quoted parts (``'literals'``, ``"identifiers"``), comments
(``--`` to the end of the line, ``/* */``) and the rest. The rest is lower-cased
and its runs of blanks collapse to one space; quoted parts are kept as written;
comments count as a blank, so an apostrophe in one starts no literal. The
re-joined, trimmed text is hashed with SHA-256 (hex). Same query in another
case or spacing -> same hash; a different literal -> a different hash.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# An unclosed quote or comment runs to the end of the text. Quantifiers are
# possessive, so long parts need no backtracking.
QUOTED = r"""'[^']*+(?:''[^']*+)*+(?:'|\z)|"[^"]*+(?:""[^"]*+)*+(?:"|\z)"""
COMMENT = r"--[^\n]*+|/\*(?s:.*?)(?:\*/|\z)"
PLAIN = r"""(?:[^'"/-]++|-(?!-)|/(?!\*))++"""


def normalize_query(c: Column | str) -> Column:
    text = F.col(c) if isinstance(c, str) else c
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{QUOTED}|{COMMENT}|{PLAIN}"), F.lit(0))
    shown = F.transform(parts, lambda p: F.when(p.startswith("'") | p.startswith('"'), p)
                        .when(p.startswith("--") | p.startswith("/*"), F.lit(" "))
                        .otherwise(F.regexp_replace(F.lower(p), r"\s+", " ")))
    # blanks on both sides of a comment are one blank
    joined = F.aggregate(shown, F.lit(""), lambda acc, p: F.when(
        acc.endswith(" ") & p.startswith(" "), F.concat(acc, F.substring(p, F.lit(2), F.length(p)))).otherwise(F.concat(acc, p)))
    return F.trim(joined)


def query_hash(c: Column | str) -> Column:
    return F.sha2(normalize_query(c), 256)
