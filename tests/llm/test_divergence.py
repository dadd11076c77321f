"""The audit against shares of every term in every group."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import pytest

from driftline.llm import divergence
from driftline.llm.queries import ORACLE_SQL, op13_divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, p long"
WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain(rows):
    docs = [(lang or "", source or "", [w.translate(LOWER) for w in WORD.findall(text or "")]) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        kept = {t for t, n in Counter(t for *_, w in own for t in set(w)).items() if n >= 10}
        counts = {s: Counter(t for _, x, w in own if x == s for t in w if t in kept) for s in {d[1] for d in own}}
        share = lambda n: {t: 1 + 10**9 * (n[t] + 2) // (sum(n.values()) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(n) for s, n in counts.items()}, share(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(x, sum(f(p[s][t], p[x][t]) for t in kept)) for x in counts if x != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, *x, i + 1) for i, x in enumerate(items) if part == "pair" or i < 10]
    return sorted(out)


@pytest.fixture
def rows():
    r, words = random.Random(1), [f"w{'abcdefghijklmnop'[i % 16]}{'xyz'[i % 3]}{'é' * (i % 4)}{chr(97 + i % 26)}" for i in range(90)]
    out = []
    for i in range(260):
        some = r.choices(words, [1 / (1 + k) for k in range(90)], k=r.randrange(0, 40))
        text = r.choice([" ", "-7", " ", "\n"]).join(x.upper() if r.random() < 0.2 else x for x in some)
        out.append((i, r.choice([text, text, text, None, ""]), r.choice(["a", "a", "b", None, "rare"]) if i % 9 else "a", r.choice(["s", "t", None, f"u{i % 5}"]), "x", 1))
    return out + out[:30] + [(999, "only one", "lone", "s", None, None), (None, None, None, None, None, None)]


def test_audit_equals_all_terms_of_all_groups(spark, rows):
    got = divergence.divergence(spark.createDataFrame(rows, SCHEMA))
    assert sorted(tuple(r) for r in got.collect()) == plain(rows)


def test_pieces_and_flushes_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 16)
    monkeypatch.setattr(divergence, "HELD", 5)
    found = {}
    batch = spark.createDataFrame(rows, SCHEMA).filter("lang is not null and source is not null and text is not null").select("lang", "source", "text").toArrow().to_batches()
    for b in divergence._counted(iter(batch)):
        for lang, source, term, n, d in zip(*(c.to_pylist() for c in b.columns)):
            x = found.setdefault((lang, source, term), [0, 0])
            x[0] += n
            x[1] += d
    want = {}
    for _, text, lang, source, *_ in rows:
        if None not in (text, lang, source):
            for t, n in Counter(w.translate(LOWER) for w in WORD.findall(text)).items():
                x = want.setdefault((lang, source, t), [0, 0])
                x[0] += n
                x[1] += 1
    assert found == want


def test_long_text_and_empty_table(spark):
    long = "Ab c " * 400_000
    got = divergence.divergence(spark.createDataFrame([(1, long, "a", "s", None, None)] * 10 + [(2, "c", "a", "t", None, None)], SCHEMA))
    assert sorted(tuple(r) for r in got.collect()) == plain([(1, long, "a", "s")] * 10 + [(2, "c", "a", "t")])
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, total = 3 * 10**13, 10**15
    assert spark.range(1).select(divergence._share(F.lit(n), F.lit(total))).first()[0] == 1 + 10**9 * (n + 2) // total


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(ORACLE_SQL["op13_divergence"])
    got = op13_divergence(spark, sf).select(*[d[0] for d in want.description]).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
