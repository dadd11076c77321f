"""The near-duplicate stage against brute force over all pairs of five-word shingle sets."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from driftline.llm import jaccard

VOCABULARY = [f"w{i}" for i in range(400)]


def plain_set(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} - {""}


def plain_kept(rows):
    """doc_ids that stay: the least of each component of similarity 0.8 or more."""
    sets = [(i, plain_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a == b or len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i in root if find(i) == i}


def planted(seed=0):
    """Texts with copies of 0.6 to 1.0 similarity, chains of them, short and wordless texts."""
    r, rows = random.Random(seed), []
    for _ in range(60):
        text = r.choices(VOCABULARY, k=r.choice([12, 40, 120, 300]))
        for _ in range(r.choice([1, 2, 2, 3, 5])):
            rows.append((len(rows), " ".join(text)))
            text = list(text)  # the next is a copy of this one: similarities fall along the chain
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                text[r.randrange(len(text))] = r.choice(VOCABULARY)
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", " \n", "one", "ONE", "a b c d", "a b c d e", "A b  c d e", "a b c d e f"])]
    r.shuffle(rows)
    return rows


def kept_of(stage, spark, rows):
    return {r["doc_id"] for r in stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}


def test_the_stage_equals_brute_force(spark):
    rows = planted()
    want = plain_kept(rows)
    assert len(want) < len({t for _, t in rows}) - 20  # there are near copies
    assert kept_of(corpus_pipeline.drop_near_duplicates, spark, rows) == want


def family(seed=1):
    """Texts of one frame, most under 0.8 alike but many with common bands, and some copies of theirs over it."""
    r, rows = random.Random(seed), []
    frame = r.choices(VOCABULARY, k=150)
    for _ in range(60):
        text = list(frame)
        at = r.randrange(120)
        text[at : at + 20] = [f"x{r.randrange(10**6)}" for _ in range(20)]
        for _ in range(r.choice([1, 1, 2])):
            rows.append((len(rows), " ".join(text)))
            text = [*text, r.choice(VOCABULARY)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("group", [2, 5, 256])
def test_large_bands_are_dealt_anew_without_loss(spark, monkeypatch, group):
    monkeypatch.setattr(jaccard, "GROUP", group)
    for rows in (family(), planted(3)):
        assert kept_of(corpus_pipeline.drop_near_duplicates, spark, rows) == plain_kept(rows)


def test_blocks_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_BYTES", 4000)
    rows = family(2)
    assert kept_of(corpus_pipeline.drop_near_duplicates, spark, rows) == plain_kept(rows)


def test_recall_on_the_tables_is_whole(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert kept_of(corpus_pipeline.drop_near_duplicates, spark, rows) == plain_kept(rows)


def test_a_band_that_holds_several_components_is_searched():
    import numpy as np
    import pyarrow as pa

    base = np.arange(100, dtype=np.uint64)
    near, far = np.append(base[:95], np.uint64(500)), base + np.uint64(1000)
    names = ["key", "low", "high", "block", "component", "node", "own"]

    def links(rows):
        batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows]) for k in range(6)] + [pa.array([r[6].tobytes() for r in rows])], names)
        return [set(zip(*(b.column(i).to_pylist() for i in range(2)), strict=True)) for b in jaccard._search(0.8)([batch])]

    assert links([(1, 0, 0, 0, 7, 7, base), (1, 0, 0, 0, 8, 8, far), (1, 0, 0, 0, 9, 9, near), (2, 0, 0, 0, 8, 8, far)]) == [{(9, 7)}]
    assert links([(1, 0, 1, 0, 7, 7, base), (1, 0, 1, 1, 9, 9, near)]) == [{(9, 7)}]
    assert links([(1, 0, 1, 0, 7, 7, base), (1, 0, 1, 0, 9, 9, near)]) == []


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "a"), (4, "a"), (5, "a"), (9, None), (9, "b c")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in jaccard.keep_one(df).collect()) == [(-1, "a"), (4, "a"), (9, ""), (9, "b c")]
    assert jaccard.keep_one(df.limit(0)).count() == 0


def boilerplate(n, common=200, own=40):
    r = random.Random(7)
    line = " ".join(r.choices(VOCABULARY, k=common))
    return [(i, f"{line} " + " ".join(f"own{i}x{k}" for k in range(own))) for i in range(n)]


def test_a_pair_is_met_under_one_shingle_and_no_alike_pair_is_lost():
    r = random.Random(5)
    sets, wanted = [], set()
    for i in range(60):
        base = set(r.sample(range(1000), 60))
        for _ in range(r.randrange(1, 4)):
            sets.append(sorted((base - set(r.sample(sorted(base), r.randrange(0, 9)))) | set(r.sample(range(1000), r.randrange(0, 9)))))
    often = {s: sum(s in x for x in sets) for s in range(1000)}
    ranked = [sorted(x, key=lambda s: (often[s], s)) for x in sets]
    prefix = [x[: len(x) - -(-len(x) * 4 // 5) + 1] for x in ranked]
    for i, a in enumerate(sets):
        wanted |= {(j, i) for j in range(i) if len(set(a) & set(sets[j])) >= 0.8 * len(set(a) | set(sets[j]))}
    met = []
    for key in range(1000):
        own = [i for i, p in enumerate(prefix) if key in p]
        at = [prefix[i].index(key) for i in own]
        before = [jaccard.np.sort(jaccard.np.array(prefix[i][:p], jaccard.np.int64)) for i, p in zip(own, at)]
        sizes = jaccard.np.array([len(sets[i]) for i in own])
        for x, y in jaccard.pairs_to_compare(sizes, jaccard.np.array(at, jaccard.np.int64), before, jaccard.np.zeros(len(own)), True, 0.8):
            met.append(tuple(sorted((own[x], own[y]))))
    assert len(met) == len(set(met)) and wanted and wanted <= set(met)


def test_boilerplate_makes_no_large_groups(spark):
    df = spark.createDataFrame(boilerplate(600), "doc_id long, text string")
    sets = df.select("text").mapInArrow(jaccard._sets, "node long, own binary")
    nodes = sets.select("node", jaccard.F.col("node").alias("component"))
    rare = jaccard._by_rare_shingles(nodes, sets, 0.8)
    assert jaccard._sizes(rare.filter("often > 1"), sets).count() == 0
    assert jaccard.keep_one(df).count() == 600


def pair_of(r, a, b, both):
    """Two sets of a and b shingles, as many as `both` in common."""
    import numpy as np

    x = np.array([r.randrange(1 << 63) for _ in range(a + b - both)], np.uint64)
    return np.sort(x[:a]), np.sort(np.concatenate([x[:both], x[a:]]))


def test_candidates_are_simhash_fingerprints_that_share_a_shard():
    import numpy as np
    import pyarrow as pa

    r = random.Random(11)
    sets = [x for a, b, both in ((4, 5, 4), (12, 15, 12), (80, 100, 80), (450, 450, 400)) for _ in range(60) for x in pair_of(r, a, b, both)]
    few = sets[-1][:9]
    bits = np.unpackbits(jaccard.fingerprint(few).view(np.uint8))
    each = np.array([np.unpackbits(jaccard.fingerprint(few[i : i + 1]).view(np.uint8)) for i in range(9)])
    assert (bits == (each.sum(axis=0) * 2 > 9)).all()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets)), pa.int64()), pa.array([jaccard.fingerprint(x).tobytes() for x in sets], pa.binary())], ["node", "print"])
    shards = sorted((row for b in jaccard._to_shards([batch]) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda x: x[0])
    assert {s >> jaccard.PART for s, _ in shards} == set(range(jaccard.PARTS))
    held = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*shards, strict=True)], ["shard", "members"])
    found = {p for b in jaccard._candidates([held]) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    assert found == {(i + 1, i) for i in range(0, len(sets), 2)}


def test_the_tree_finds_what_brute_force_finds(monkeypatch):
    import numpy as np

    monkeypatch.setattr(jaccard, "ASKED", 7)
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, (40, 4), np.uint64)
    points = base[r.integers(0, 40, 300)]
    for _ in range(30):  # some bits of each are turned
        points[np.arange(300), r.integers(0, 4, 300)] ^= np.uint64(1) << r.integers(0, 63, 300).astype(np.uint64)
    apart = np.bitwise_count(points[:, None] ^ points[None]).sum(axis=2, dtype=int)
    for reach in (20, 40, 82):
        want = {(i, j) for i, j in zip(*np.nonzero(apart <= reach), strict=True) if i < j}
        for leaf in (4, 50, 1000):
            tree = jaccard.Tree(points, reach, leaf)
            got = [p for at in range(0, 300, 7) for i, j in tree.near(np.arange(at, min(at + 7, 300))) for p in zip(i.tolist(), j.tolist(), strict=True)]
            assert len(got) == len(set(got))
            # of pairs, those are left out whose first two words alone differ in more than five eighths of reach
            some = np.bitwise_count(points[:, None, :2] ^ points[None, :, :2]).sum(axis=2, dtype=int) <= reach * 5 // 8
            assert set(got) == {p for p in want if some[p]}
        nodes = r.permutation(300)
        member, least = jaccard.shard_links(nodes, points, reach)
        root = {int(n): int(n) for n in nodes}
        for _ in range(300):
            before = dict(root)
            for i, j in want:
                if some[i, j]:
                    a, b = int(nodes[i]), int(nodes[j])
                    root[a] = root[b] = min(root[a], root[b])
            if root == before:
                break
        assert dict(zip(member.tolist(), least.tolist(), strict=True)) == {n: m for n, m in root.items() if n != m}


def test_only_the_rarest_shingles_of_a_large_group_become_rows(spark):
    import numpy as np

    rows = boilerplate(60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = df.select("text").mapInArrow(jaccard._sets, "node long, own binary")
    nodes = sets.select("node", jaccard.F.col("node").alias("component"))
    prefixes = {r["node"]: r for r in jaccard._rare_prefixes(nodes, sets, 0.8).collect()}
    known = [jaccard.shingles(t) for _, t in rows]
    often = np.bincount((np.concatenate(known) >> np.uint64(64 - jaccard.COUNTERS)).astype(np.int64))
    want = {}
    for own in known:
        first = sorted(own.tolist(), key=lambda s: (often[s >> 64 - jaccard.COUNTERS], s))
        want[np.uint64(jaccard.node_of(own)).astype(np.int64)] = first[: len(own) - -(-len(own) * 4 // 5) + 1]
    assert {n: np.frombuffer(r["prefix"], np.uint64).tolist() for n, r in prefixes.items()} == want
    made = [r for n, r in prefixes.items() for r in [(k, n) for k in np.frombuffer(r["prefix"], np.int64).tolist()]]
    rare = jaccard._by_rare_shingles(nodes, sets, 0.8).select("key", "node").collect()
    shared = [(k, n) for k, n in made if often[np.int64(k).astype(np.uint64) >> np.uint64(64 - jaccard.COUNTERS)] > 1]
    assert sorted((r["key"], r["node"]) for r in rare) == sorted(shared)
    assert len(shared) < len(made) < sum(map(len, known)) / 4


def test_candidates_of_a_block_need_no_rounds(spark, monkeypatch):
    from driftline.llm import components

    r = random.Random(4)
    rows = [(r.randrange(-300, 300), r.randrange(-300, 300)) for _ in range(220)] + [(i, i % 7) for i in range(1000, 1200)] * 3 + [(5, 5), (None, 1)]
    links = spark.createDataFrame(rows, "a long, b long")
    want = {tuple(x) for x in components.components(links).collect()}
    for block in (50, 300):  # several blocks, whose stars are joined by rounds or by another block
        got = [tuple(x) for x in components.components(links, block=block).collect()]
        assert len(got) == len(want) and set(got) == want
    assert components.components(links.limit(0), block=50).count() == 0

    def none(links):
        raise AssertionError("a round over links that one block holds")

    monkeypatch.setattr(components, "_large_star", none)
    assert {tuple(x) for x in components.components(links, block=1 << 18).collect()} == want
    assert kept_of(corpus_pipeline.drop_near_duplicates, spark, planted()) == plain_kept(planted())
