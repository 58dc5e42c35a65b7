import os

import corpus_pipeline as C
from tests.llm.helpers import SCHEMA, docs_of, near_copies

from .test_quality import corpus


def test_stages_in_order_and_their_effects(spark, workdir):
    texts, labels = corpus(80)
    texts += [texts[1], texts[2] + " changed end", None, "", texts[5] + "\npassword = hunter2hunter2"]
    sf = workdir
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    assert [n for n, _ in C.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "secret_scans", "best_fit_packing"]
    for name, stage in C.STAGES:
        out = os.path.join(workdir, name)
        stage(spark, docs, sf).write.parquet(out)
        docs = spark.read.parquet(out)
        seen[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    clean = {i for i, q, _ in labels if q == 1}
    kept = {r.doc_id for r in seen["quality_rules"].collect()}
    assert clean <= kept and not kept & {i for i, q, _ in labels if q == 0} and 82 not in kept
    after = {r.doc_id: r.text for r in seen["line_dedup"].collect()}
    assert 80 not in after and clean <= set(after)
    masked = {r.doc_id: r for r in seen["secret_scans"].collect()}
    assert all("hunter2" not in r.text and r.n_chars == len(r.text) for r in masked.values())
    assert {r.doc_id for r in docs.collect()} == set(masked)


def test_stages_on_odd_input(spark, workdir):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{workdir}/labels.parquet")
    docs_of(spark, [None, ""] + near_copies(5, 2, 3, 70)).write.parquet(f"{workdir}/documents.parquet")
    out = C.run(spark, workdir)
    assert out.columns[0] == "doc_id" and 1 <= out.select("doc_id").distinct().count() <= 6
