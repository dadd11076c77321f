"""Private keys are told apart by their bodies and masked whole."""

from __future__ import annotations

import base64
import random

from driftline.llm import secrets


def key(seed, kind="RSA ", end=True, newline="\n", head=""):
    body = base64.b64encode(random.Random(seed).randbytes(600)).decode()
    lines = [body[i : i + 64] for i in range(0, len(body), 64)]
    return newline.join([f"-----BEGIN {kind}PRIVATE KEY-----", *([head] if head else []), *lines, *([f"-----END {kind}PRIVATE KEY-----"] * end)])


def test_different_keys_of_many_sources_are_masked_whole(spark):
    rows = [(i, f"before\n{key(i)}\nafter", f"s{i}") for i in range(5)]
    rows += [(10 + i, f"before\n{key(99)}\nafter", f"s{i}") for i in range(3)]  # one key that three sources share
    rows += [
        (20, "x " + key(20, "ENCRYPTED ") + " y " + key(21, "") + " z", "s1"),
        (22, "x " + key(22, newline="\\n") + " z", "s1"),
        (23, "x " + key(23, head="Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n") + " z", "s1"),
        (24, "x " + key(24, end=False), "s1"),
        (25, "-----BEGIN PRIVATE KEY-----" * 3000 + "-" * 30_000 + "a-" * 30_000 + "\nwords " * 3000, "s1"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in secrets.redact_live(secrets.secret_findings(df)).collect()}
    assert all(got[i] == "before\n[secret]\nafter" for i in range(5))
    assert all(got[10 + i] == rows[5 + i][1] for i in range(3))
    assert got[20] == "x [secret] y [secret] z"
    assert got[22] == got[23] == "x [secret] z"
    assert got[24] == "x [secret]"
    assert got[25].endswith("words ")
