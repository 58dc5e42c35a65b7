import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from checkup.llm.knn_join import best, products, top_products
from checkup.llm.license_scan import TEMPLATES, license_rows, needed, template_words
from checkup.llm.shard_shuffle import shard_rows, shuffled, write_shards
from tests.llm.helpers import ascii_lower, docs_of


@pytest.mark.parametrize("n", [0, 7, 40, 205])
def test_shards_hold_every_record_once(spark, n):
    texts = [None if i == 3 else "é" * (i % 11) for i in range(n)]
    rows = shard_rows(docs_of(spark, texts), bucket_bytes=700).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == [
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)]
    sizes = Counter(r.shard for r in rows)
    assert not n or max(sizes.values()) - min(sizes.get(s, 0) for s in range(40)) <= 1
    for s, k in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(k))
    assert {r.law for r in rows} <= {"rows"} and all(r.grown_shard is None for r in rows)


def test_shuffle_mixes_and_one_hot_record_spreads(spark):
    df = docs_of(spark, ["same text"] * 3000).withColumn("doc_id", F.lit(1)).withColumnRenamed("lang", "bucket")
    placed = shuffled(df, 10, bucket_bytes=2000)
    assert placed.count() == 3000 and set(placed.select("record.*").columns) == set(df.columns)
    order = [r.record.doc_id for r in shuffled(docs_of(spark, ["x"] * 2000), 1, bucket_bytes=3000).orderBy("slot").collect()]
    assert sorted(order) == list(range(2000))
    assert abs(np.corrcoef(order, range(2000))[0, 1]) < 0.1
    plan = shard_rows(docs_of(spark, ["a"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_written_shards(spark, workdir):
    write_shards(shuffled(docs_of(spark, [f"t{i}" for i in range(90)]), 8, bucket_bytes=200), f"{workdir}/shards")
    back = spark.read.parquet(f"{workdir}/shards")
    assert back.count() == 90 and back.select("shard").distinct().count() == 8


def test_rows_stem_from_written_shards(spark, monkeypatch):
    paths = []
    monkeypatch.setattr("checkup.llm.shard_shuffle.write_shards", lambda p, path: paths.append(path) or write_shards(p, path))
    rows = shard_rows(docs_of(spark, [f"t{i}" for i in range(90)]), 8, bucket_bytes=200)
    files = rows.inputFiles()
    assert len(paths) == 1 and files and all(f"/{paths[0].split("/")[-1]}/shard=" in f for f in files)
    back = {(r.shard, r.slot, r.record.doc_id) for r in spark.read.parquet(paths[0]).collect()}
    assert {(r.shard, r.slot, r.doc_id) for r in rows.collect()} == back and len(back) == 90


def plain_words(text):
    out, cur = [], ""
    for c in ascii_lower(text or "") + " ":
        if c.isascii() and not (c.isdigit() or "a" <= c <= "z"):
            if cur:
                out.append(cur)
            cur = ""
        else:
            cur += c
    return out


def plain_license(text):
    words = plain_words(text)
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    spots, base = [], set()
    for p, label in phrases.items():
        ps = p.split()
        for i in range(len(words)):
            if words[i:i + len(ps)] == ps:
                spots.append(i)
                base.add(label)
    found, score = set(), 0.0
    for label, notice in TEMPLATES:
        t, n = set(plain_words(notice)), len(plain_words(notice))
        for i in range(len(words)):
            block = set(words[i:i + n + n // 8])
            if 10 * len(block & t) >= 9 * len(t) and (label != "lgpl" or "lesser" in block):
                found.add(label)
                score = max(score, len(block & t) / len(t))
    return (len(words), len(spots), min(spots, default=None), max(spots, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | found)), score)


def test_licenses_equal_brute_force(spark):
    long = [t for _, t in TEMPLATES if len(t) > 120]
    wrapped = [t[:len(t) // 2].rsplit(" ", 1)[0] + "\n" + t[len(t) // 2:].split(" ", 1)[-1] for t in long]
    texts = [None, "", "MIT License, mit-license MIT  license", "cc by by cc cc-by", "Released under the\nMIT License."]
    texts += [f"intro\nmore words here {t} and after\nend é中 license" for _, t in TEMPLATES] + wrapped
    texts += ["word " * 30000 + "Licensed under CC BY-NC 4.0", "released under the license", "the and of " * 50, texts[2]]
    clash = docs_of(spark, texts).withColumnRenamed("lang", "token").withColumnRenamed("source", "block")
    got = {r.doc_id: tuple(r)[1:] for r in license_rows(clash).collect()}
    want = {i: plain_license(t) for i, t in enumerate(texts)}
    assert {i: g[:6] for i, g in got.items()} == {i: w[:6] for i, w in want.items()}
    assert all(abs(got[i][6] - want[i][6]) < 1e-12 for i in want)
    assert any("bsd" in g[5] for g in got.values())
    small = {r.doc_id: tuple(r)[1:] for r in license_rows(clash, stretch=7).collect()}
    assert small == got
    assert license_rows(docs_of(spark, [])).collect() == []
    assert license_rows(docs_of(spark, ["mit license"] * 2)).count() == 2
    assert needed(7) == 7 and needed(20) == 18
    plan = license_rows(clash)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licenses_in_any_wrapping(spark):
    mit, gpl, lgpl = (next(t for label, t in TEMPLATES if label == name and len(t) > 120) for name in ("mit", "gpl", "lgpl"))
    by_nc_nd = next(t for label, t in TEMPLATES if label == "cc-by-nc-nd")
    rnd = np.random.default_rng(5)
    bag = [w for _, t in TEMPLATES for w in plain_words(t)]
    spread = " ".join(w for word in bag for w in (word, *["filler"] * 30))  # all words, far apart, on one line
    texts = [f"intro\n{textwrap.fill(t, n)}\nend" for t in (mit, gpl, lgpl) for n in (60, 72, 80, 10_000)]
    texts += [spread, by_nc_nd, " ".join(rnd.choice(["alpha", "beta", "gamma"], 5_000)) + " " + mit]
    got = {r.doc_id: tuple(r)[1:] for r in license_rows(docs_of(spark, texts)).collect()}
    assert [got[i][5] for i in range(len(texts))] == ["mit"] * 4 + ["gpl"] * 4 + ["lgpl"] * 4 + ["", "cc-by,cc-by-nc-nd", "mit"]
    assert all(got[i][6] == 1.0 for i in range(12)) and got[12][6] == 0.0
    assert all(got[i] == plain_license(t) for i, t in enumerate(texts))


def brute_top(rows, k, every):
    whole = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = [(i, list(v)) for i, v in {(i, tuple(v)) for i, v in whole}]
    out = []
    for q, v in whole:
        if q % every == 0:
            scored = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, cell int, v double")


def test_top_k_equals_brute_force(spark):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(6, 12)) * 2
    rows = [(i, (centres[rnd.integers(6)] + rnd.normal(size=12) * 0.3).astype(np.float32).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[5][1]) for i in range(300)]  # one hot vector
    rows += [(2000, None), (2020, [1.0] * 11 + [None]), (2040, [float("nan")] * 12), (2060, [float("inf")] * 12),
             (None, [0.0] * 12), (rows[0][0], rows[0][1]), (2080, [0.0] * 12), (2100, [1.0, 2.0])]
    df = vectors(spark, rows)
    got = sorted(tuple(r) for r in top_products(df, k=5, n_pivots=16, query_block=7, data_block=50).collect())
    assert got == brute_top(rows, 5, 20)


def test_top_k_edges(spark):
    assert top_products(vectors(spark, [])).collect() == []
    few = [(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [3.0, 4.0])]
    assert sorted(tuple(r) for r in top_products(vectors(spark, few)).collect()) == brute_top(few, 20, 20)
    assert top_products(vectors(spark, [(1, [1.0])])).collect() == []


def test_a_vector_is_sent_once_to_a_group_of_cells(spark, monkeypatch):
    from checkup.llm import knn_join

    kept, write = {}, knn_join.stored
    monkeypatch.setattr(knn_join, "stored", lambda df, name: kept.setdefault(name, write(df, name)))
    rnd = np.random.default_rng(8)
    rows = [(i, rnd.normal(size=16).astype(np.float32).tolist()) for i in range(1500)]  # all directions: no bound excludes anything
    for query_block, groups in ((5, 1), (1, 5)):
        kept.clear()
        got = sorted(tuple(r) for r in top_products(vectors(spark, rows), k=4, n_pivots=40, query_block=query_block).collect())
        assert got == brute_top(rows, 4, 20)
        assert kept["knn-cells"].select("cell").distinct().count() == 40
        sent = kept["knn-sent"]
        assert sent.count() <= 1500 * 2 * groups  # not 40 times each vector
        assert groups <= sent.select("grp").distinct().count() <= 2 * groups


def test_top_k_with_many_stretches_and_wide_components(spark, monkeypatch):
    monkeypatch.setattr("checkup.llm.knn_join.STRETCHES", 2)
    rnd = np.random.default_rng(9)
    for scale in (1, 1000, 10**6):  # components of two, four and eight bytes
        rows = [(i, (rnd.integers(-3, 4, size=6) * scale).astype(float).tolist()) for i in range(700)]  # many ties
        got = sorted(tuple(r) for r in top_products(vectors(spark, rows), k=6, n_pivots=9, query_block=3, data_block=20).collect())
        assert got == brute_top(rows, 6, 20)


def test_cells_in_groups():
    from checkup.llm.knn_join import _groups

    assert _groups({0: 3, 1: 25, 2: 4, 3: 6, 4: 1}, [0, 2, 1, 3, 4], 10) == (
        [[0, 2], [1], [1], [1], [3, 4]], {0: 0, 2: 0, 1: 1, 3: 4, 4: 4}, {0: 1, 2: 1, 1: 3, 3: 1, 4: 1})


def test_products_are_exact_for_large_components():
    q, x = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 3.0], [2.0**30, -5.0]])
    assert products(q, x).tolist() == [[2**60 + 3, 2**63 - 1]]
    ids, _, score = best(np.array([1]), q, np.array([2, 1]), x, 3)
    assert ids.tolist() == [1] and score.tolist() == [2**60 + 3]
