"""Columns with a dot in their name pass every operator, and change nothing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from driftline.llm import hilbert, jaccard, language, packing, pii, secrets, simhash, templates, tokens, toxicity, warc

DOTTED = ("text.part", "doc_id.old", "a.b.c")


def rows(df) -> list[str]:
    return sorted(map(str, df.collect()))


def dotted(df):
    return df.withColumns({c: F.lit(c) for c in DOTTED})


@pytest.fixture(scope="module")
def docs(spark):
    texts = [f"some ordinary words of text number {i % 7} and mail a{i}@b.org, token = abcdef{i:04d}" for i in range(20)]
    return spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize(
    "digest",
    [pii.pii_digest, secrets.secret_digest, tokens.token_digest, simhash.simhash_digest, packing.token_lengths],
    ids=lambda f: f.__name__,
)
def test_digests(docs, digest):
    assert rows(digest(dotted(docs))) == rows(digest(docs))


@pytest.mark.parametrize("tabled", [pii.pii_spans, secrets.secret_findings, simhash.keep_one, jaccard.keep_one], ids=lambda f: f"{f.__module__}.{f.__name__}")
def test_tables_keep_them(docs, tabled):
    got, plain = tabled(dotted(docs)), tabled(docs)
    assert set(DOTTED) <= set(got.columns)
    assert rows(got.select(*[F.col(f"`{c}`") for c in plain.columns])) == rows(plain)


def test_models(spark, docs):
    more = dotted(docs)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, label int")
    assert rows(toxicity.toxicity_scores(more, toxicity.fit(more, dotted(labels)))) == rows(toxicity.toxicity_scores(docs, toxicity.fit(docs, labels)))
    assert rows(language.identify(more, language.fit(more))) == rows(language.identify(docs, language.fit(docs)))


def test_others(spark, docs):
    bench = spark.createDataFrame([(1, "some ordinary words of text number 3 and mail")], "item_id long, text string")
    assert rows(templates.decontamination_report(dotted(docs), dotted(bench))) == rows(templates.decontamination_report(docs, bench))
    assert set(DOTTED) <= set(templates.remove_contaminated(dotted(docs), bench).columns)
    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i)]) for i in range(40)], "vec_id long, embedding array<double>")
    assert rows(hilbert.nearest(dotted(vectors))) == rows(hilbert.nearest(vectors))
    pages = spark.createDataFrame([(i, f"http://x/{i}", "<p>" + "abc " * (i % 3 * 40)) for i in range(9)], "page_id long, url string, html string")
    assert rows(warc.warc_digest(dotted(pages))) == rows(warc.warc_digest(pages))
    lengths = packing.token_lengths(docs)
    assert rows(packing.pack(dotted(lengths))) == rows(packing.pack(lengths))
