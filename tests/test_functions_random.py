"""Scalar functions against plain-Python versions on random inputs."""

import hashlib
import random
import re

from checkup.functions import query_hash, redact_credentials

ALPHA = "abcXYZ019:/@ '\t\n.-_"


def _rand(rnd, n):
    return "".join(rnd.choice(ALPHA) for _ in range(rnd.randrange(n)))


REDACTED = [  # written by hand
    ("", ""),
    ("postgres://u:secret@h/db", "postgres://u:***@h/db"),
    ("a://u:p@h and b://v:q@k", "a://u:***@h and b://v:***@k"),
    ("https://u:p:q@host", "https://u:***@host"),
    ("pg://u:@h", "pg://u:***@h"),
    ("no scheme u:p@h", "no scheme u:p@h"),
    ("pg://host:5432/db", "pg://host:5432/db"),
    ("pg://:p@h", "pg://:p@h"),
    ("pg://u/x:p@h", "pg://u/x:p@h"),
]


def py_fingerprint(s):
    parts = s.split("'")
    out = [" ".join(re.split(r"[ \t\n\x0b\f\r]+", p.lower())) if i % 2 == 0 else p for i, p in enumerate(parts)]
    return hashlib.sha256("'".join(out).strip(" ").encode()).hexdigest()


def test_redact_by_hand(spark):
    df = spark.createDataFrame([(t,) for t, _ in REDACTED], "t string")
    assert [r.r for r in df.select(redact_credentials("t").alias("r")).collect()] == [w for _, w in REDACTED]


def test_fingerprint_of_quoted_names_and_comments(spark):
    same = [("SELECT a -- don't\nFROM t", "select A -- other\n from T"), ("select /* it's */ 1", "SELECT 1"),
            ("select a-b / c", "SELECT  A-B / C"), ("x 'it''s  Y' z", "X 'it''s  Y' Z")]
    other = [('select "Foo"', 'select "foo"'), ("select 'A'", "select 'a'"), ("a 'x  y'", "a 'x y'"), ("select 'a", "select 'b")]
    df = spark.createDataFrame([(a, b) for a, b in same + other] + [("SELECT '" + "x" * 50000 + "'", "Q" * 50000)], "a string, b string")
    got = [(r.x == r.y) for r in df.select(query_hash("a").alias("x"), query_hash("b").alias("y")).collect()]
    assert got == [True] * len(same) + [False] * (len(other) + 1)


def test_fingerprint_matches_python(spark):
    rnd = random.Random(5)
    words = ["SELECT", "select", "From", "t", "WHERE", "a", "=", "'Lit  X'", "'q'", "1", "  ", "\n", "\t"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.h for r in df.select(query_hash("t").alias("h")).collect()]
    assert got == [py_fingerprint(t) for t in texts]
    # same query in other case / spacing -> same hash
    a = spark.createDataFrame([("SELECT a FROM t WHERE b = 'X'",), ("select  a\nfrom T where B = 'X' ",)], "t string")
    h = [r.h for r in a.select(query_hash("t").alias("h")).collect()]
    assert h[0] == h[1]
