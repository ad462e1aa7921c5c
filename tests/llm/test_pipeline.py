"""The stages of corpus_pipeline.py, each on its own input, against brute force."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from trialgrid.llm.common import stored

from .test_texts import base_personal, contamination, near

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(stored(stage(spark, steps[-1], SF), name))
        assert steps[-1].columns == names
    rows = [s.select("doc_id", "text").collect() for s in steps]
    assert Counter(rows[1]) == Counter(r for r in rows[0] if r.text and any(c.isalpha() for c in r.text))
    kept = {doc for doc, _, _, keep in near(rows[1], 80) if keep}
    assert sorted(r.doc_id for r in rows[2]) == sorted(kept)
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    assert sorted(r.doc_id for r in rows[3]) == sorted(c[0] for c in contamination(rows[2], items) if not c[-1])
    assert sorted(r.doc_id for r in rows[4]) == sorted(r.doc_id for r in rows[3])
    assert not any(base_personal(r.text) for r in rows[4])
    pieces = corpus_pipeline.STAGES[-1][1](spark, steps[-1], SF).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in rows[4]}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "start", "length").collect())) == sorted((p.doc_id, p.start, p.length) for p in pieces)


def test_odd_rows(spark, odd_documents, no_documents):
    """Every stage on nulls, empty and long texts, repeated rows and columns with names that the operators use inside."""
    extra = {c: F.lit(c) for c in ("rid", "key", "score", "lang_pred", "stays", "spans", "base", "n_words", "best", "root", "contaminated", "w", "__rid", "__rid_", "__lang", "__score", "found_lang", "found_score", "doc")}
    for docs in (odd_documents.drop("rid", "key", "score", "n_words").withColumns(extra), no_documents.withColumns(extra)):
        rows = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            columns = docs.columns
            docs = stored(stage(spark, docs, SF), name)
            assert docs.columns == columns
            assert all(r[c] == c for r in docs.collect() for c in extra)
        assert (docs.count() > 0) == (rows > 0)
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0) == (rows > 0)


def test_personal_data_adds_no_column(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cd"), (2, None)], "doc_id long, text string")
    assert corpus_pipeline.personal_data(spark, docs, SF).columns == docs.columns
