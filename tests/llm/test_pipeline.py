"""The stages do what their operators do, one after the other, and every decision takes effect."""

from pyspark.sql import functions as F
from test_text_dedup import brute_first, components, lines_left

import corpus_pipeline as P
from maskloom.llm.common import materialize


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf), "t")
        seen[name] = (before, docs)
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns

    before, after = seen["toxicity"]
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in after.collect()}
    clean = [d for d, y in label.items() if y == 0]
    assert sum(d in kept for d in clean) / len(clean) > 0.97

    before, after = seen["line_dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert {r.doc_id: r.text for r in after.collect()} == {d: t for d, t in lines_left(rows).items() if t is None or t.strip() or not dict(rows)[d].strip()}

    before, after = seen["jaccard_join"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert {r.doc_id for r in after.collect()} == {d for d, n, c in components(rows) if d == c}

    before, after = seen["suffix_array_dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    left = {d: t.decode("utf-8", "ignore") for (d, _), t in zip(rows, brute_first(rows, P.REPEAT_BYTES))}
    kept = {r.doc_id: (r.text, r.n_chars) for r in after.collect()}
    assert {d: t for d, (t, _) in kept.items()} == {d: left[d] for d, t in rows if left[d].strip() or not (t or "").strip()}
    assert all(n == len(t) for t, n in kept.values())

    before, after = seen["best_fit_packing"]
    assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == {r.doc_id for r in before.collect()}
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
    assert P.run(spark, sf).count() == after.count()


def test_empty_documents_and_repeated_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "a b c d e f g", "en", "s", 13), (3, "a b c d e f g", "en", "s", 13), (None, "a b c d e f g", "en", "s", 13)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for given, kept in ((rows, 3), ([], 0)):
        docs = spark.createDataFrame(given, schema)
        for name, stage in P.STAGES[:-1]:
            docs = materialize(stage(spark, docs, str(tmp_path)), "t")
        assert docs.count() == kept
        assert P.pack(spark, docs, str(tmp_path)).count() == kept
