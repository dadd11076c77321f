"""Kneser-Ney scores against counts and formulas written out, and odd tables."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from driftline.llm import toxicity

WORDS = [f"w{i}" for i in range(25)]


def rows(n, seed=0):
    r, out = random.Random(seed), []
    for i in range(n):
        words, toxic = r.choices(WORDS, weights=range(1, 26), k=r.randint(1, 40)), i % 3 == 0
        if toxic:
            words[r.randrange(len(words))] = r.choice(["vile", "rotten"])
        out.append((i, " ".join(words), int(toxic)))
    return out


def discounts(counts):
    n = [sum(1 for c in counts if c == k) for k in range(5)]
    if not all(n[1:]):
        return [0, 0.75, 0.75, 0.75]
    y = n[1] / (n[1] + 2 * n[2])
    raw = [0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
    return [0] + [min(max(d, 0.1), top) for d, top in zip(raw[1:], (0.98, 1.9, 2.9), strict=True)]


def plain_ratios(train):
    """Log-likelihood ratios of words, and of words after words, from the definition."""
    times = [defaultdict(int), defaultdict(int)]  # pair -> occurrences
    for _, text, y in train:
        w = ["<s>", *text.split()]
        for p in zip(w, w[1:], strict=False):
            times[y][p] += 1
    pairs = sorted({p for c in times for p in c})
    known = sorted({b for _, b in pairs})
    c = [{p: times[y].get(p, 0) for p in pairs} for y in (0, 1)]
    words = [{w: sum(1 for p in pairs if p[1] == w and c[y][p]) for w in known} for y in (0, 1)]
    left = {w: sum(1 for p in pairs if p[1] == w) for w in known}
    inner = [p for p in pairs if p[0] != "<s>"]
    shared = lambda w: (left.get(w, 0) + 1) / (sum(left.values()) + len(known) + 1)

    def one(y):
        off, total = discounts(list(words[y].values())), max(sum(words[y].values()), 1)
        less = {w: max(n - off[min(n, 3)], 0) for w, n in words[y].items()}
        free = 1 - sum(less.values()) / total
        return lambda w: less.get(w, 0) / total + free * shared(w)

    def after(counts, least):
        off = discounts(list(counts.values()))
        total = defaultdict(float)
        for (a, _), n in counts.items():
            total[a] += n
        total = {a: max(total[a], least.get(a, 0)) + 1 for a in known}
        high = {p: max(n - off[min(n, 3)], 0) / total[p[0]] for p, n in counts.items()}
        rest = {a: max(1 - sum(h for p, h in high.items() if p[0] == a), 1e-3) for a in known}
        return high, rest

    p = [one(0), one(1)]
    both, free = after({q: c[0][q] + c[1][q] for q in inner}, left)
    own = [after({q: c[y][q] for q in inner}, words[y]) for y in (0, 1)]

    def pair(y, a, b):
        high, rest = own[y]
        return high[a, b] + rest[a] * (both[a, b] + free[a] * p[y](b))

    word = {w: math.log(p[1](w) / p[0](w)) for w in known}
    return word, {q: math.log(pair(1, *q) / pair(0, *q)) for q in inner}, {a: math.log(own[1][1][a] / own[0][1][a]) for a in known}, math.log(p[1]("?") / p[0]("?"))


def test_ratios_equal_the_formulas_written_out(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PAIR_SHARES", (1.0,))
    train = rows(240)
    df = spark.createDataFrame(train, "doc_id long, text string, label int")
    seen = {}
    real = toxicity.build
    monkeypatch.setattr(toxicity, "build", lambda w, p: seen.setdefault("model", real(w, p)))
    monkeypatch.setattr(toxicity, "FIT_ROWS", 8_000)
    toxicity.fit(df)
    model = seen["model"]
    # the rows that gave counts are those of the low hashes
    from pyspark.sql import functions as F

    u = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30))
    most = int(8_000 / 11_000 * (1 << 30))
    chosen = [tuple(r) for r in df.filter(u < most).collect()]
    assert 100 < len(chosen) < 240
    word, pair, after, unknown = plain_ratios(chosen)
    at = {w: int(np.searchsorted(model.hashes, np.uint64(xxhash.xxh64_intdigest(w.encode())))) for w in word}
    for w, x in word.items():
        assert model.word[at[w]] == pytest.approx(x, abs=1e-9)
        assert model.after[at[w]] == pytest.approx(after[w], abs=1e-5)
    assert model.word[-1] == pytest.approx(unknown, abs=1e-9)
    assert len(model.pairs) == len(pair)
    size = len(model.hashes) + 1
    for (a, b), x in pair.items():
        i = int(np.searchsorted(model.pairs, at[a] * size + at[b]))
        assert model.pair[i] == pytest.approx(x, abs=1e-4)
    ids = np.array([at["w20"], at["w24"], len(model.hashes)])
    x = word["w24"] if ("w20", "w24") not in pair else pair["w20", "w24"]
    each = [word["w20"], x if ("w20", "w24") in pair else x + after["w20"], unknown + after["w24"]]
    assert model.measure(ids, 0.0, 1.0) == pytest.approx(np.mean(each), abs=1e-4)
    assert model.measure(ids, 2.0, 1.0) == pytest.approx(math.log(np.mean(np.exp(2 * np.array(each)))) / 2, abs=1e-4)


def test_repeated_rows_other_columns_and_long_texts(spark):
    train = spark.createDataFrame([(*r, "clash", 1.0) for r in rows(300)], "doc_id long, text string, label int, score string, u double")
    model = toxicity.fit(train)
    again = toxicity.fit(train.select("doc_id", "text"), train.select("doc_id", "label").union(train.select("doc_id", "label")))
    assert (again.power, again.share) == (model.power, model.share) and np.allclose(again.weights, model.weights)
    long = "w1 w2 " * 100_000 + "vile"
    odd = [(1, "w1 vile", "a"), (1, "w1 vile", "a"), (None, "w1 vile", "b"), (2, None, "c"), (3, "", "d"), (4, "...", "e"), (5, long, "f")]
    test = spark.createDataFrame(odd, "doc_id long, text string, label string")
    got = toxicity.toxicity_scores(test, model).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, None)}) == 1
    assert len({r["score"] for r in got if r["doc_id"] in (2, 3, 4)}) == 1
    kept = toxicity.keep_below(test, model, threshold=2.0)
    assert kept.columns == test.columns and kept.count() == 7
    assert toxicity.toxicity_scores(test.limit(0), model).count() == 0 and toxicity.keep_below(test.limit(0), model).count() == 0


def test_pairs_stay_whatever_the_size(spark, sf):
    from driftline.llm.common import table
    from pyspark.sql import functions as F

    labels = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(table(spark, sf, "documents"), labels)
    assert model.share > 0 and len(model.pairs) == len(model.pair) > 1000


def test_too_many_pairs_shrink_the_sample_not_the_model(spark, monkeypatch):
    df = spark.createDataFrame(rows(300), "doc_id long, text string, label int")
    whole = toxicity.fit(df)
    monkeypatch.setattr(toxicity, "MODEL_PAIRS", len(whole.pairs) - 1)
    less = toxicity.fit(df)
    assert 0 < len(less.pairs) < len(whole.pairs)
    monkeypatch.setattr(toxicity, "FIT_BYTES", 100)
    assert len(toxicity.fit(df).pairs) < len(less.pairs)


def test_the_driver_holds_keys_and_ratios_of_pairs_alone(spark):
    import tracemalloc

    r = random.Random(4)
    df = spark.createDataFrame([(i, " ".join(f"w{r.randrange(2_000)}" for _ in range(500)), i % 2) for i in range(1_600)], "doc_id long, text string, label int")
    tracemalloc.start()
    try:
        model = toxicity.fit(df)
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    # all counts at once and what is made of them were 76 bytes a pair and more
    assert len(model.pairs) > 400_000 and peak < 32 * len(model.pairs)
    assert (np.diff(model.pairs) > 0).all() and np.isfinite(model.pair).all()
