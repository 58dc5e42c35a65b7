from itertools import combinations

import numpy as np
import pyarrow as pa

from checkup.llm.common import components
from checkup.llm.jaccard_join import one_of_each, similarity_components
from checkup.llm.shingles import shingle_sets
from tests.llm.helpers import ascii_lower, ascii_words, docs_of, near_copies, smallest_reachable


def shingles(text):
    w = ascii_words(ascii_lower(text or ""))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def hard_texts():
    """Near copies, a large group of them, and a chain whose ends differ."""
    base = [f"a{i}" for i in range(80)]
    texts = near_copies(1, 8, 5) + [" ".join(base[:k] + ["x" + str(k)] + base[k + 1:]) for k in range(40)]
    cur = [f"c{i}" for i in range(100)]
    for k in range(8):  # each step changes four words at the front
        texts.append(" ".join(cur))
        cur = cur[4:] + [f"n{k}_{j}" for j in range(4)]
    return texts


def test_components_equal_brute_force(spark):
    texts = hard_texts()
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a, b in combinations(range(len(texts)), 2) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = smallest_reachable(range(len(texts)), links)
    df = docs_of(spark, texts)
    # extra columns whose names clash with the operator's own
    clash = df.withColumnRenamed("lang", "d").withColumnRenamed("source", "key").withColumnRenamed("n_chars", "n")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similarity_components(clash).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in range(len(texts))}
    assert len(set(want.values())) < len(texts) - 40


def test_repeated_rows_nulls_and_one_of_each(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (9, None), (3, "x " * 5000), (8, "A b c d e f")]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, n int, d int, keys int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similarity_components(df).collect()), key=str)
    assert got == sorted([(7, 2, 7), (7, 2, 7), (None, 2, 7), (9, 0, 9), (3, 1, 3), (8, 2, 7)], key=str)
    kept = one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 7, 9, None]


def test_empty_table(spark):
    assert similarity_components(docs_of(spark, [])).collect() == []


def test_shingles_of_sliced_columns_and_nulls():
    col = pa.array(["skip me", "A b\tc\nd e F", None, "", "a b C d e f", "é ö"])
    sets = shingle_sets(col.slice(1))
    assert [len(s) for s in sets] == [2, 0, 0, 2, 1]
    assert np.array_equal(sets[0], sets[3])


def test_components_of_a_star_and_a_path(spark):
    edges = [(1, i) for i in range(2, 40)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in components(df).collect()}
    assert got == {i: 1 for i in range(1, 40)} | {100 + i: 100 for i in range(31)}
    assert components(df.limit(0)).count() == 0
