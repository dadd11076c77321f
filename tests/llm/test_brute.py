"""Decontamination and language identification against plain versions, and clashing columns of every operator."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from driftline.llm import hilbert, jaccard, language, packing, templates, tokens

PLAIN = "the old mill stood by a quiet river where people came each spring to trade wool and listen to long stories about far places".split()


def window_texts(tokens_, values, size):
    return [(" ".join(tokens_[i : i + size]), [v for v in values[i : i + size] if v is not None]) for i in range(len(tokens_) - size + 1)]


UNITS = {"km", "kg", "days"}


def plain_tokens(text):
    """(template tokens, values, words) of plain English text with the units used here."""
    words = re.findall("[A-Za-z]+|[0-9]+", text)
    kinds = []
    for i, w in enumerate(words):
        unit = i > 0 and words[i - 1].isdigit() and w.lower() in UNITS
        kinds.append("#" if w.isdigit() else "unit" if unit else "Name" if w[0].isupper() else None)
    return [w if k is None else f"<{k}>" for w, k in zip(words, kinds, strict=True)], [k and w for w, k in zip(words, kinds, strict=True)], words


def plainly_accepted(windows):
    """Windows of the same values, or of values that go where most windows send them; names also come from where most come."""
    same = [[x.lower() for x in a] == [y.lower() for y in b] for a, b in windows]
    pairs = [p for a, b in windows for p in zip(a, b, strict=True)]
    sure = {p for (a, b), s in zip(windows, same, strict=True) if s for p in zip(a, b, strict=True)}
    to = lambda x: max((p for p in pairs if p[0] == x), key=lambda p: (pairs.count(p), p in sure, p[1]))
    back = lambda y: max((p for p in pairs if p[1] == y), key=lambda p: (pairs.count(p), p in sure, p[0]))
    fits = lambda p: to(p[0]) == p and (p[1][0].islower() or p[1][0].isdigit() or back(p[1]) == p)
    return [s or all(map(fits, zip(a, b, strict=True))) for (a, b), s in zip(windows, same, strict=True)]


def plain_coverage(text, item):
    """Share of an item's windows in a text, by looking at every window and every place; values judged along each shift."""
    best = 0.0
    forms = []
    for fold in (False, True):
        sides = []
        for t in (item, text):
            toks, vals, words = plain_tokens(t)
            if fold:
                vals = [None if k == "<Name>" else v for k, v in zip(toks, vals, strict=True)]
                toks = [w.lower() if v is None else k for k, v, w in zip(toks, vals, words, strict=True)]
            sides.append((toks, vals))
        forms.append(sides)
    n = len(forms[0][0][0])
    size = min(templates.WINDOW, n)
    total, found, named_total, named_found = n - size + 1, set(), 0, set()
    raw = [[w.lower() for w in plain_tokens(t)[2]] for t in (item, text)]
    by_shift = {}
    for fold, sides in zip((False, True), forms, strict=True):
        (a, av), (b, bv) = sides
        for i in range(total):
            enough = sum(v is None for v in av[i : i + size]) >= templates.LITERAL
            named_total += not fold and enough
            for j in range(len(b) - size + 1):
                if enough:
                    hit = a[i : i + size] == b[j : j + size] and sum(v is None for v in bv[j : j + size]) >= templates.LITERAL
                else:
                    hit = fold and raw[0][i : i + size] == raw[1][j : j + size]
                if hit:
                    fill = lambda v, at: [x for x in v[at : at + size] if x is not None]
                    by_shift.setdefault(j - i, []).append((i, fold, fill(av, i), fill(bv, j)))
    for rows in by_shift.values():
        for (i, fold, _, _), good in zip(rows, plainly_accepted([(x, y) for _, _, x, y in rows]), strict=True):
            if good:
                found.add(i)
                if not fold:
                    named_found.add(i)
    best = max(len(found) / total, len(named_found) / named_total if named_total else 0.0)
    return best if best >= templates.COVERAGE else None


def test_decontamination_equals_brute_force(spark):
    r = random.Random(8)
    names, units = ["Alice", "Bob", "Carol", "Dan"], ["km", "kg", "days"]

    def item(k):
        words = [r.choice(PLAIN) for _ in range(k)]
        for _ in range(k // 5):
            words[r.randrange(k)] = r.choice([str(r.randrange(2, 90)), r.choice(names), f"{r.randrange(2, 90)} {r.choice(units)}"])
        return " ".join(words)

    items = [(i, item(r.choice([2, 5, 9, 14, 22]))) for i in range(25)] + [(90, "12 + 35 - 7 = 40"), (91, "Alice 12 Bob 15 Carol 19 Dan 23")]
    docs = []
    for i in range(70):
        base = r.choice(items)[1].split()
        change = r.randrange(4)
        if change == 1:
            base = [str(r.randrange(2, 90)) if w.isdigit() else r.choice(names) if w in names else w for w in base]
        if change == 2:
            base[r.randrange(len(base))] = "zebra"
        text = " ".join([*r.choices(PLAIN, k=9), *base, *r.choices(PLAIN, k=9)])
        docs.append((i, text.upper() if change == 3 else text))
    got = {}
    for x in templates.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect():
        got.setdefault(x["doc_id"], []).append(x["coverage"])
    want = {d: [c for _, t in items if (c := plain_coverage(text, t)) is not None] for d, text in docs}
    assert {d for d, c in want.items() if c} == set(got)
    assert all(max(got[d]) == max(c) for d, c in want.items() if c) and len(got) > 40


def test_one_template_of_many_items_costs_a_row_a_document(spark):
    rows = [(i, f"A train leaves the station at {i + 3} miles per hour and another follows {2 * i + 7} minutes later so find when they meet again") for i in range(60)]
    bench, docs = spark.createDataFrame(rows, "item_id long, text string"), spark.createDataFrame([(i, f"intro {t} outro") for i, t in rows], "doc_id long, text string")
    found = templates.contaminated(docs, bench).collect()
    assert len(found) == 60 and all(r["exact"] and r["item_id"] == r["doc_id"] and r["n_items"] == 60 for r in found)


STEM = "find the sum of all the numbers that"


def test_a_stem_of_many_items_costs_no_pairs(spark, monkeypatch):
    """Items that only share an opening are compared where more than the opening stands."""
    r = random.Random(5)
    tails = [" ".join(r.choice(PLAIN) for _ in range(24)) for _ in range(120)]
    bench = spark.createDataFrame([(i, f"{STEM} {t}") for i, t in enumerate(tails)], "item_id long, text string")
    rows = [(i, f"intro {STEM} {tails[i] if i < 40 else ' '.join(reversed(tails[i].split()))} outro") for i in range(120)]
    seen, real = {}, templates.materialize

    def counted(df, name, tag=""):
        seen[name] = real(df, name, tag)
        return seen[name]

    monkeypatch.setattr(templates, "materialize", counted)
    found = templates.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted((x["doc_id"], x["item_id"], x["exact"]) for x in found) == [(i, i, True) for i in range(40)]
    assert seen["met-templates"].count() < 100 and seen["judged-windows"].count() < 100 * 2 * 25  # of 14,400 pairs
    want = {i: [k for k, t in enumerate(tails) if plain_coverage(text, f"{STEM} {t}") is not None] for i, text in rows[30:50]}
    assert want == {i: [x["item_id"] for x in found if x["doc_id"] == i] for i in want}


def test_items_that_consist_of_a_shared_stem_are_all_found(spark):
    """Where the shared windows alone bring the coverage, every item is held."""
    stem = "find the sum of all the numbers that satisfy these conditions when the first of them is even and"
    bench = spark.createDataFrame([(i, f"{stem} {w} {v}") for i, (w, v) in enumerate(zip(PLAIN[:9], PLAIN[9:18]))], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"intro {stem} outro"), (None, f"{stem} {PLAIN[0]} {PLAIN[9]}")], "doc_id long, text string")
    found = templates.contaminated(docs, bench).collect()
    assert len(found) == 18 and sorted(x["item_id"] for x in found if x["doc_id"] == 1) == list(range(9))
    assert [x["item_id"] for x in found if x["exact"]] == [0]


def plain_ngrams(text):
    out = {}
    low = text.lower()
    for k in range(language.ORDERS):
        for i in range(len(low) - k):
            h = 0
            for ch in low[i : i + k + 1]:
                h = (h ^ ord(ch)) * 0x9E3779B97F4A7C15 % 2**64
                h ^= h >> 29
            at = (h >> 20) % language.BUCKETS + k * language.BUCKETS
            out[at] = out.get(at, 0) + 1
    return out


def test_ngrams_and_probabilities_equal_the_formulas_written_out(spark, monkeypatch):
    monkeypatch.setattr(language, "CHUNK", 7)
    for text in ("", "a", "Über alles, ÉCOLE", "abc" * 40):
        at, n = language.ngrams(text)
        assert dict(zip(at.tolist(), n.tolist(), strict=True)) == plain_ngrams(text)
    r = random.Random(1)
    stems = {"en": "the and of to".split(), "fr": "le la les et".split()}
    rows = [(i, " ".join(r.choices(stems[x], k=12)), x) for i, x in enumerate(["en", "fr"] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"u": F.lit(1), "at": F.lit("clash"), "score": F.lit(2)})
    model = language.fit(df)
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language.identify(df, model).collect()}
    for i, text, _ in rows:
        grams = plain_ngrams(text)
        x = {k: (1 + np.log(n)) * model.idf[k] for k, n in grams.items()}
        norm = np.sqrt(sum(v * v for v in x.values()))
        z = sum(v / norm * model.weights[k] for k, v in x.items()) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i][0] == model.languages[int(p.argmax())] and abs(got[i][1] - p.max()) < 1e-9
    tied = language.Model(["de", "en"], model.idf, np.zeros((len(model.idf), 2)))
    twice = language.identify(df.limit(3).union(df.limit(3)), tied).collect()
    assert len(twice) == 6 and {x["lang_pred"] for x in twice} == {"de"}
    assert language.identify(df.limit(0), model).count() == 0


CLASH = ("part", "n", "rep", "hash", "keys", "__id", "local_start", "bin_id", "score", "node", "tokens")


def test_clashing_columns_change_nothing(spark):
    docs = spark.createDataFrame([(i, f"some words of text number {i} and {i}") for i in range(20)], "doc_id long, text string")
    more = docs.withColumns({c: F.lit("clash") for c in CLASH})
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(tokens.token_digest(more)) == key(tokens.token_digest(docs))
    lengths = packing.token_lengths(docs)
    assert key(packing.pack(lengths.withColumns({c: F.lit("clash") for c in ("piece", "part", "rank", "n", "bin_id")}))) == key(packing.pack(lengths))
    bench = spark.createDataFrame([(1, "some words of text number 3 and 3")], "item_id long, text string")
    assert key(templates.decontamination_report(more, bench)) == key(templates.decontamination_report(docs, bench))
    kept = templates.remove_contaminated(more, bench)
    assert kept.columns == more.columns and kept.count() < 20
    assert jaccard.keep_one(more).columns == more.columns
    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i)]) for i in range(40)], "vec_id long, embedding array<double>")
    assert key(hilbert.nearest(vectors.withColumns({c: F.lit("clash") for c in CLASH}))) == key(hilbert.nearest(vectors))
