"""The other operators against brute force, round trips and held-out accuracy, and on odd input."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from driftline.llm import hilbert, language, packing, simhash, templates, tokens, toxicity, warc
from driftline.llm.common import scratch_path
from driftline.llm.components import components

WORDS = "red blue fish bird runs slow over under stone river cloud seven window paper light north".split()


def words(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def docs_of(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + more)


# ---- SimHash


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(prints, ids):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {i: min(g) for g in groups.values() for i in g}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "two words", "Über ÉCOLE a\x0bb\x1cc d e f", words(1, 700), "x " * 3000])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_simhash_components_equal_brute_force(spark, monkeypatch):
    base = words(5, 300).split()
    texts = [None, "", " ", words(1, 50), words(1, 50), words(2, 50), words(3, 2)]
    for i in range(80):  # near copies that differ in a word or two
        own = list(base)
        for k in range(1 + i % 3):
            own[(7 * i + k) % 300] = f"w{i}"
        texts.append(" ".join(own))
    ids = random.Random(0).sample(range(1000), len(texts))
    want = plain_components([plain_fingerprint(t) for t in texts], ids)
    df = docs_of(spark, list(zip(ids, texts, strict=True)), "").withColumn("fp", F.lit("clash"))
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_digest(df).collect()}
    assert got == want
    # large shards are split further and lose nothing
    distinct = simhash.fingerprints(df).select("fp").distinct()
    small = components(simhash.fingerprint_links(distinct, shard=4))
    whole = components(simhash.fingerprint_links(distinct))
    key = lambda d: sorted((r["node"], r["root"]) for r in d.collect())
    assert key(small) == key(whole) and len(key(whole)) > 10


def test_vantage_tree_finds_all_near():
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 2**63, 20, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (1500, 4)).astype(np.uint64)
    points = np.unique(centre[rng.integers(0, 20, 1500)] ^ np.bitwise_xor.reduce(flips, axis=1))
    tree = simhash.VantageTree(points, leaf=16)
    for x in points[::37]:
        assert sorted(tree.near(x, 3)) == np.flatnonzero(np.bitwise_count(points ^ x) <= 3).tolist()


def test_simhash_odd_tables(spark):
    assert simhash.simhash_digest(docs_of(spark, [])).count() == 0
    got = simhash.simhash_digest(docs_of(spark, [(None, "a"), (4, "a"), (4, "a"), (9, None)])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in got) == [(-1, 4), (4, 4), (4, 4), (9, 9)]
    kept = simhash.keep_one(docs_of(spark, [(None, "a"), (4, "a"), (5, "a"), (9, None)]))
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 4, 9]


def test_components_of_a_long_chain_and_a_hub(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 50)}


# ---- tokens


def test_tokens_equal_whole_text_encoding(spark):
    from tokenizers import Tokenizer

    odd = [None, "", "  ", "Hello, World! it's 3.5%... Ünïcödé é  x y", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>.b", "x" * 500 + "., " + "don't'll!!", "ΣΑΣ. İ ǅ ﬁ", words(3, 2000)]
    rows = [(i * 3, t) for i, t in enumerate(odd)]
    t = Tokenizer.from_file(tokens.default_tokenizer())
    at, want = 0, {}
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    got = tokens.token_digest(docs_of(spark, rows[::-1])).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want
    assert tokens.token_digest(docs_of(spark, [])).count() == 0


def test_token_files_allow_selective_reads(spark):
    import pyarrow.parquet as pq

    path = scratch_path(spark, "t")
    tokens.write_tokens(docs_of(spark, [(i, words(i, 30)) for i in range(200)] + [(None, "a"), (7, "b")]), path)
    read = tokens.read_tokens(spark, path)
    assert read.count() == 202 and [r["start"] for r in read.orderBy("start").limit(1).collect()] == [0]
    plan = read.filter("doc_id = 5").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("\n") if "/data" in x)
    assert "tokens:array" not in scan and "EqualTo(doc_id,5)" in scan
    part = next(f for f in __import__("glob").glob(path.removeprefix("file:") + "/data/*.parquet"))
    meta = pq.ParquetFile(part).metadata.row_group(0)
    by = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in by["doc_id"].encodings and "RLE_DICTIONARY" in by["tokens.list.element"].encodings
    assert by["doc_id"].has_column_index and by["doc_id"].has_offset_index


# ---- packing


def check_packing(lengths, capacities, got):
    bins = {}
    for r in got:
        bins.setdefault(r["bin_id"], []).append(r)
    pieces = {}
    for own in bins.values():
        own.sort(key=lambda r: r["bin_offset"])
        at = 0
        for r in own:
            assert r["bin_offset"] == at
            at += r["n_tokens"]
            pieces.setdefault(r["doc_id"], []).append((r["piece"], r["piece_start"], r["n_tokens"]))
        assert {r["capacity"] for r in own} == {min(c for c in capacities if c >= at)}
    for doc, n in lengths.items():
        own = sorted(pieces[doc])
        assert [p for p, _, _ in own] == list(range(len(own))) and sum(k for _, _, k in own) == n
        assert all(s == p * max(capacities) for p, s, _ in own)
    return sum(min(c for c in capacities if c >= sum(r["n_tokens"] for r in b)) for b in bins.values())


def test_packing_is_whole_and_tight(spark):
    r = random.Random(1)
    lengths = {i: r.choice([3, 50, 50, 64, 100, 1000, r.randint(1, 300)]) for i in range(600)}
    df = spark.createDataFrame(list(lengths.items()), "doc_id long, n_tokens long").repartition(5)
    capacities = (64, 128, 256)
    used = check_packing(lengths, capacities, packing.pack(df, capacities=capacities).collect())
    total = sum(lengths.values())
    assert used <= 1.02 * total
    again = packing.pack(df.repartition(3), capacities=capacities)
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(again) == key(packing.pack(df, capacities=capacities))


def test_packing_is_not_worse_than_first_fit_by_brute_force():
    capacities, overhead = (8, 16), 1
    for seed in range(30):
        r = random.Random(seed)
        sizes = [r.randint(1, 16) for _ in range(12)]
        slots = packing.plan({k: sizes.count(k) for k in set(sizes)}, capacities, overhead)
        cost, seen = 0, set()
        for s in slots:
            n = sum(1 for x in sizes if x == s.length)
            assert s.first + s.copies <= n
            if s.base not in seen:
                seen.add(s.base)
        bins = []
        for x in sorted(sizes, reverse=True):
            fit = next((b for b in bins if sum(b) + x <= 16), None)
            fit.append(x) if fit else bins.append([x])
        plain = sum(min(c for c in capacities if c >= sum(b)) + overhead for b in bins)
        used = {}
        for s in slots:
            times = (min([t.first for t in slots if t.length == s.length and t.first > s.first], default=sizes.count(s.length)) - s.first) // s.copies
            for i in range(times):
                used[s.base + i] = s.capacity
        cost = sum(c + overhead for c in used.values())
        assert cost <= plain + 8


def test_packing_odd_tables(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, -4), (None, 5), (4, 5), (4, 5)], "doc_id long, n_tokens long")
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in packing.pack(df).collect()) == [(-1, 5), (4, 5), (4, 5)]
    assert packing.pack(df.limit(0)).count() == 0


# ---- templates

QUESTION = "In a small town Alice bought 12 apples for 30 dollars and gave Bob half of them before lunch on Monday morning"


def test_templates_catch_copies_and_new_parameters(spark):
    other = QUESTION.replace("Alice", "Carol").replace("12", "97").replace("30", "44.5").replace("Bob", "Dan")
    broken = "In a small town Alice bought 12 apples and gave Alice 12 more apples because Alice wanted 12 apples for the whole week"
    bench = spark.createDataFrame([(1, QUESTION), (2, broken), (3, None), (4, "too short")], "item_id long, text string")
    inconsistent = broken.replace("Alice bought 12", "Alice bought 15").replace("gave Alice 12", "gave Bob 17").replace("because Alice wanted 12", "because Eve wanted 19")
    rows = [(1, f"intro words here {QUESTION} and more"), (2, f"x {other}."), (3, inconsistent), (4, "nothing of the kind " * 9), (5, None), (6, ""), (None, QUESTION), (1, "clean row of the same id")]
    got = templates.decontamination_report(docs_of(spark, rows), bench).collect()
    flagged = {(r["doc_id"], r["item_id"], r["exact"]) for r in got if r["contaminated"]}
    assert len(got) == len(rows)
    assert {(1, 1, True), (2, 1, False), (None, 1, True)} == flagged
    kept = templates.remove_contaminated(docs_of(spark, rows), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6]
    assert templates.decontamination_report(docs_of(spark, rows), bench.limit(0)).filter("contaminated").count() == 0
    assert templates.decontamination_report(docs_of(spark, []), bench).count() == 0


def test_templates_without_the_hash_filter_give_the_same(spark, monkeypatch):
    bench = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    df = docs_of(spark, [(1, QUESTION), (2, words(1, 200))])
    a = templates.decontamination_report(df, bench).collect()
    monkeypatch.setattr(templates, "FILTER_HASHES", 0)
    assert sorted(templates.decontamination_report(df, bench).collect()) == sorted(a)


def test_template_tokens():
    assert templates.template("The 3.5 kg Bob's $ 7 $")[0] == [templates.NAME, templates.NUMBER, templates.UNIT, templates.NAME, "$", templates.NUMBER, templates.UNIT]


# ---- WARC


def test_warc_round_trip_and_revisits(spark):
    long = "é" * 200
    rows = [(5, "http://a/", long), (3, "http://b/\r\nX: y", long), (9, None, long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", "x" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.warc_digest(df).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        payload = (html or "").encode()
        r = got[page]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if page in (5, 9) else ("response", None))
    assert warc.warc_digest(df.limit(0)).count() == 0


def test_every_split_size_finds_each_record_once():
    r = random.Random(2)
    parts, starts, at = [], [], 0
    for i in range(40):
        body = bytes(r.randrange(256) for _ in range(r.randrange(400))) + warc.MAGIC * 3 + warc.member(b"not a record")
        starts.append(at)
        parts.append(warc.member(warc.record(i, "http://x/", body, "0" * 64)))
        at += len(parts[-1])
    data = b"".join(parts)
    read = lambda pos, n: data[pos : pos + n]
    for split in (97, 500, 4096, len(data), 10 * len(data)):
        got = [x.offset for s in range(0, len(data), split) for x in warc.read_range(read, len(data), s, s + split)]
        assert got == starts


def test_a_record_inside_a_stored_payload_is_not_one():
    inner = warc.member(warc.record(7, "http://in/", b"inner" * 30, "0" * 64))
    c = zlib.compressobj(0, zlib.DEFLATED, 31)
    outer = c.compress(warc.record(1, "http://out/", inner + b"tail", "0" * 64)) + c.flush()
    data = outer + warc.member(warc.record(2, "http://next/", b"x", "0" * 64))
    at = data.index(inner)
    got = list(warc.read_range(lambda p, n: data[p : p + n], len(data), at - 5, len(data)))
    assert [x.headers["warc-record-id"] for x in got] == ["<urn:page:2>"]


# ---- neighbours


def test_hilbert_curve_is_a_walk():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = hilbert.hilbert_keys(side, 3)
    assert sorted(keys) == list(range(512))
    path = side[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def brute(ids, x, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


@pytest.mark.parametrize(("least", "slice_"), [(hilbert.LEAST, hilbert.SLICE), (36, 3)])
def test_neighbours_recall_and_ties(spark, monkeypatch, least, slice_):
    monkeypatch.setattr(hilbert, "SLICE", slice_)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 24)).astype(np.float32)
    x[100:400] = x[100]  # copies
    ids = np.arange(1500)
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    bad = [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [None] * 24), (2080, [1.0]), (None, x[0].tolist()), (0, x[0].tolist())]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = {}
    for r in hilbert.nearest(df.withColumn("rep", F.lit(1)), least=least).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(ids, x.astype(float), 20)
    assert set(got) == set(want)
    hit = 0
    for q, own in got.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert all(s == pytest.approx(float(x[q].astype(float) @ x[v].astype(float)), abs=1e-9) for _, v, s in own)
        hit += len({v for _, v, _ in own} & {v for v, _ in want[q]})
    assert hit / (20 * len(want)) >= 0.9
    assert [v for _, v, _ in got[120]] == [v for v, _ in want[120]]  # copies: the smallest ids
    assert hilbert.nearest(df.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>")
    assert hilbert.nearest(few).count() == 4


# ---- models

STEMS = {"en": "the of and to in that was for on are with his they".split(), "de": "der die und das nicht ein ich ist auch für über".split(), "fr": "le la les et que est pas une dans être été".split()}


def test_language_held_out_accuracy_and_odd_texts(spark):
    r = random.Random(0)
    rows = [(i, " ".join(r.choice(STEMS[lang]) for _ in range(r.randint(4, 60))), lang) for i, lang in enumerate(list(STEMS) * 120)]
    train = spark.createDataFrame([x for x in rows if x[0] % 5] + [(9000, None, "en"), (9001, "the", None)], "doc_id long, text string, lang string")
    test = spark.createDataFrame([x for x in rows if x[0] % 5 == 0] + [(7000, None, "en"), (7001, "123 !?", "en"), (7002, "", "en"), (7003, "the of " * 40_000, "en")], "doc_id long, text string, lang string")
    model = language.fit(train)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(test, model).collect()}
    truth = {i: lang for i, _, lang in rows if i % 5 == 0}
    assert sum(got[i][0] == lang for i, lang in truth.items()) / len(truth) > 0.97
    assert [got[i][0] for i in (7000, 7001, 7002, 7003)] == ["und", "und", "und", "en"]
    assert all(0 <= s <= 1 for _, s in got.values()) and (model.weights == 0).mean() > 0.5
    assert {r["lang_pred"] for r in language.identify(test, language.fit(train.limit(0))).collect()} == {"und"}


def test_toxicity_held_out_accuracy_and_odd_texts(spark):
    r = random.Random(0)
    bad = ["vile", "rotten", "filth"]
    rows = []
    for i in range(1500):
        w = [r.choice(WORDS) + r.choice(["", "s", "ed", "ly"]) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                w[r.randrange(60)] = r.choice(bad)
        rows.append((i, " ".join(w), int(toxic)))
    train = spark.createDataFrame([x for x in rows if x[0] % 3] + [(9000, None, 1), (9001, "", 0), (9002, "x", None)], "doc_id long, text string, label int")
    model = toxicity.fit(train)
    test = spark.createDataFrame([x for x in rows if x[0] % 3 == 0] + [(7000, None, 0), (7001, "", 0), (7002, "...", 0), (7003, "red fish " * 60_000, 0)], "doc_id long, text string, label int")
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(test, model).collect()}
    truth = {i: y for i, _, y in rows if i % 3 == 0}
    assert sum((got[i] >= 0.7) == bool(y) for i, y in truth.items()) / len(truth) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[7000] == got[7001] == got[7002]
    kept = {r["doc_id"] for r in toxicity.keep_below(test, model).collect()}
    assert kept == {i for i, s in got.items() if s < 0.7}
    assert {r["score"] for r in toxicity.toxicity_scores(test, toxicity.fit(train.limit(0))).collect()} == {0.5}


def test_new_words_are_encoded_in_few_calls_with_the_same_ids(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 300)
    monkeypatch.setattr(tokens, "AT_ONCE", 2000)
    monkeypatch.setattr(tokens, "TOGETHER", 50)
    known = tokens.WordIds(tokens.default_tokenizer())
    plain, calls = known.encode, []
    known.encode = lambda *a, **k: calls.append(a) or plain(*a, **k)
    texts = [" ".join(f"w{i}x{k}{'.,'[: k % 3]} Ünë{i}" for k in range(20)) for i in range(40)]
    texts += [None, "", " \n", "...", "a.,", "no break   space", "<|endoftext|> A<|endoftext|>b Word", "x" * 200 + "!", "é ퟿ 你好,世界"]
    want = [np.array(plain(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for _ in range(2):
        assert list(known.texts(texts)) == want
    # a call for each word before: more than 800
    assert len(calls) < 150


def test_plain_words_ask_the_model_alone_with_the_same_ids(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 300)
    known = tokens.WordIds(tokens.default_tokenizer())
    plain, calls = known.encode, []
    known.encode = lambda *a, **k: calls.append(a) or plain(*a, **k)
    part = ["wort", "ÇIÓN", "straße", "ǅ", "ﬁn", "ét", "İs", "KelvinK", "n'", "'ll", "d's", "x9"]
    texts = [" ".join(f"{a}{b}{sign}" for b in part[:4] for sign in ("", ".", "?!", "$$$", "'", "''")) for a in part]
    texts += [" ".join(f"{a}{b}" for b in part) for a in part] + [" ".join(f"q{'abcdefghij'[i % 10] * (i // 10 + 1)}." for i in range(400))]
    texts += ["A<| É<|endoftext|>é. naïve<|", "a.b. c<|startoftext|>.", "é" * 100 + "###" * 40, "\x1cab ab\x1f. a b."]
    want = [np.array(plain(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for _ in range(2):
        assert list(known.texts(texts)) == [known.text(t) for t in texts] == want
    calls.clear()
    assert list(known.texts([" ".join(f"nouveau{a}{b}" for a in "abcdefghé" for b in "abcdefghé")]))[0] and not calls
