"""Rare words and pairs tell in the toxicity model."""

from __future__ import annotations

import random

import numpy as np
import xxhash

from driftline.llm import toxicity

WORDS = [f"word{i}" for i in range(60)]


def test_pairs_of_ordinary_words_and_words_after_one_word_count(spark):
    r, rows = random.Random(0), []
    for i in range(1500):
        w, toxic = r.choices(WORDS, k=50), i % 4 == 0
        for _ in range(4):  # the same words in either class; only their order tells
            w[r.randrange(50)] = "cloud river" if toxic else "river cloud"
        rows.append((i, " ".join(w), int(toxic)))
    rows.append((5000, "onlyafter zzword", 1))
    train = spark.createDataFrame([x for x in rows if x[0] % 3], "doc_id long, text string, label int")
    test = spark.createDataFrame([x for x in rows if x[0] % 3 == 0], "doc_id long, text string, label int")
    model = toxicity.fit(train)
    got = {x["doc_id"]: x["score"] for x in toxicity.toxicity_scores(test, model).collect()}
    truth = {i: y for i, _, y in rows if i % 3 == 0}
    assert sum((got[i] >= 0.7) == bool(y) for i, y in truth.items()) / len(truth) > 0.95
    seen = {w for i, t, _ in rows if i % 3 for w in t.split()}
    known = np.isin(np.array([xxhash.xxh64_intdigest(w.encode()) for w in WORDS], np.uint64), model.hashes)
    assert known.all() and len(seen) - 2 <= len(model.hashes) <= len(seen)
