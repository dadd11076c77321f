"""Findings stay with their rows, however the input was made."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from driftline.llm import secrets

ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")


def corpus(n=400):
    r = random.Random(4)
    shared = ["AKIA" + "".join(r.choices("ABCDEFGHJK0123456789", k=16)) for _ in range(3)]
    rows = []
    for i in range(n):
        text = f"row {i} " + "x" * r.randrange(40)
        if i % 7 == 0:
            text += " key " + "AKIA" + "".join(r.choices("ABCDEFGHJK0123456789", k=16)) + " end"
        elif i % 11 == 0:
            text += " key " + shared[i % 3] + " end"
        rows.append((i, text, f"s{i % 9}", i % 5, "w" * r.randrange(300)))
    return rows


def plain(rows):
    owners = {}
    for _, text, source, *_ in rows:
        for m in ACCESS.findall(text):
            owners.setdefault(m, set()).add(source)
    return {i: ACCESS.sub(lambda m: m[0] if len(owners[m[0]]) >= 3 else "[secret]", text) for i, text, *_ in rows}


@pytest.mark.parametrize("way", ["plain", "sorted", "distinct", "wide"])
def test_masks_stay_with_their_rows(spark, way):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, x int, wide string").repartition(7)
    df = {"plain": df, "sorted": df.orderBy(F.xxhash64("doc_id")), "distinct": df.dropDuplicates(["doc_id"]), "wide": df.repartition(5, "wide")}[way]
    got = secrets.redact_live(secrets.secret_findings(df))
    assert got.columns == [*df.columns, "secrets"]
    assert {r["doc_id"]: r["text"] for r in got.collect()} == plain(rows)


def test_clashing_columns_and_odd_rows(spark):
    rows = [(1, None, None, 1), (1, "", "a", 2), (None, "token=abcdef123456", "a", 3), (None, "token=abcdef123456", "a", 3), (5, "y " * 50_000 + "secret: Zk9f-Qm2x7", "b", 4)]
    schema = "doc_id long, text string, source string, secrets int"
    df = spark.createDataFrame(rows, schema).withColumns({n: F.lit(7) for n in ("x", "hash", "key", "__row", "__own", "copied", "__spans_text", "__found", "repo")})
    got = secrets.secret_findings(df)
    assert sorted(got.columns) == sorted(df.columns) and got.count() == 5
    assert all(r["x"] == r["__row"] == r["__found"] == 7 for r in got.collect())
    assert sorted(len(r["secrets"]) for r in got.collect()) == [0, 0, 1, 1, 1]
    assert secrets.secret_findings(df.limit(0)).count() == 0
    kept = secrets.secret_findings(df, out="told")
    assert kept.columns == [*df.columns, "told"]
