"""Counts of n-grams take all trusted documents."""

import inspect

import numpy as np

from tidemark.llm import quality


def test_all_trusted_documents_are_counted_sent_or_joined(spark):
    docs = spark.createDataFrame([(k, f"text {k % 7} of {k}") for k in range(60)] + [(None, "no id"), (3, "again"), (8, None)], "doc_id long, text string")
    trusted = spark.createDataFrame([(k,) for k in range(0, 60, 2)] + [(2,), (None,), (999,)], "doc_id long")
    (raw, good), (raw2, good2) = quality.ngram_counts(docs, trusted), quality.ngram_counts(docs, trusted, sent=5)
    assert (raw == raw2).all() and (good == good2).all()
    own = quality.ngram_counts(docs.where("doc_id % 2 = 0"), trusted)[0]
    assert (good == own).all() and 0 < good.sum() < raw.sum() and np.isfinite(quality.log_ratios(raw, good)).all()
    assert "most_trusted" not in inspect.signature(quality.ngram_counts).parameters
