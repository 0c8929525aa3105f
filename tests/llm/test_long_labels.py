"""Labelled texts of any length take part in the fits, whole."""

import random

import numpy as np

from strandline.llm import quality, quality_rules, toxicity

rng = random.Random(5)


def corpus(spark, label, long_text):
    """300 labelled texts, the first of 300,000 characters; bad ones hold a word of their own."""
    texts = [" ".join(rng.choices("one two three four five six".split(), k=80)) + (" vile vile vile" if i % 3 == 0 else "") for i in range(300)]
    texts[3] = long_text
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0) if label == "toxic" else int(i % 3 > 0)) for i in range(300)], f"doc_id long, {label} int")
    return docs, labels


def test_long_texts_change_the_models(spark):
    short, long = "one two three", "#### | " * 43_000
    assert len(long) > 300_000
    for module in (quality, quality_rules):
        models = [module.fit(*corpus(spark, "quality", t)) for t in (short, long)]
        assert models[0] != models[1], module.__name__
    made = [toxicity.fit(*corpus(spark, "toxic", t), epochs=2) for t in (short, "awful " * 50_000)]
    assert not np.allclose(made[0].table, made[1].table)


def test_strongest_windows_hold_the_maxima():
    m = toxicity._start(3)
    words = np.random.default_rng(1).integers(0, toxicity.BUCKETS, (3 * toxicity.LONG + 5, 3)).astype(np.int32)
    few = toxicity.strongest(m, words)
    assert len(few) < 400
    assert (m.pooled(few) >= m.pooled(words) - 1e-5).all()
