"""Source divergence audit: how far the sources of a language lie apart in their use of terms, exactly.

Each group (language, source), and each language, gives each kept term a share p of SCALE, smoothed by two
occurrences; two shares p and q differ by f = (p-q)^2 / (p+q), rounded down. A pair of sources sums f over
all kept terms, most of which one or both of them lack. By inclusion and exclusion over their supports,

    sum f  =  sum over A of f(p, b0)  +  sum over B of f(a0, q)  +  (V - |A| - |B|) f(a0, b0)
              +  sum over A and B of  f(p, q) - f(p, b0) - f(a0, q) + f(a0, b0)

where a0 and b0 are the constant shares of absent terms. The first two sums are priced from a histogram of
each group's shares; the last one runs over posting lists joined on the term, and holds terms of both only.
A posting list has a row a source, however many documents there are; the sums of pairs are taken where the
joins run, so that a pair of sources leaves a task as one row. Words are counted in the tasks that read the
texts before anything is shuffled. Everything is integer arithmetic.

Odd input: null texts, languages and sources are ''; groups without a kept term have rows in every pair;
rows of one doc_id count each; a language without kept terms has pairs of value 0 and no terms; empty tables
give no rows. Long texts are counted a piece at a time, with their distinct words held once.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, small_side

SCALE = 1_000_000_000
LEAST_DOCUMENTS = 10
TOP_TERMS = 10
#: Distinct terms that a task counts before it hands them on, and bytes of a text that it cuts in words at once.
HELD = 200_000
PIECE = 1 << 20
#: Of a text's bytes, letters without A-Z and all bytes of non-ASCII characters stay; the others part words.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, d): occurrences and documents of each term."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("d", pa.int64())])
    times: defaultdict[tuple, Counter] = defaultdict(Counter)
    within: defaultdict[tuple, Counter] = defaultdict(Counter)

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), n in times.items():
            d = within[lang, source]
            own = pa.array(list(n), pa.binary()).cast(pa.string())
            counts = [pa.array(n.values(), pa.int64()), pa.array([d[t] for t in n], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(n)).cast(pa.string()), pa.repeat(source, len(n)).cast(pa.string()), own, *counts], schema=schema)
        times.clear()
        within.clear()

    for batch in slices(batches):
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2).cast(pa.binary()), strict=True):
            flat, seen, at = text.as_py().translate(_LETTERS), set(), 0
            n = times[lang, source]
            while at < len(flat):
                cut = flat.find(b" ", at + PIECE)
                words = flat[at : cut if cut >= 0 else len(flat)].split()
                n.update(words)
                seen.update(words)
                at = cut if cut >= 0 else len(flat)
            within[lang, source].update(seen)
        if sum(map(len, times.values())) >= HELD:
            yield from flushed()
    yield from flushed()


def _share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / total), in 64 bits where they do."""
    n, total = n + 2, total
    long = F.call_function("div", F.lit(SCALE) * n, total)
    wide = F.call_function("div", n.cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), total.cast("decimal(20,0)"))
    return (F.when(n <= (1 << 62) // SCALE, long).otherwise(wide) + 1).cast("long")


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def postings(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, term, n, lang_n, first: occurrences of kept terms in each group and in its language; first: once for each (lang, term)."""
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c)
    found = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).alias("text")).mapInArrow(
        _counted, "lang string, source string, term string, n long, d long"
    )
    # dealt by (lang, term): what follows needs no other shuffle
    counts = found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    all_sources = Window.partitionBy("lang", "term")
    return counts.select(
        "lang",
        "source",
        "term",
        "n",
        F.sum("n").over(all_sources).alias("lang_n"),
        F.sum("d").over(all_sources).alias("lang_d"),
        (F.col("source") == F.min("source").over(all_sources)).alias("first"),
    ).filter(F.col("lang_d") >= least).drop("lang_d")


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", tag: str = "") -> DataFrame:
    """lang, source, part, item, value, rank: sources by distance ('pair'), and the terms that a source uses beyond its language ('term', TOP_TERMS)."""
    raw = materialize(postings(docs, text, lang, source), "postings", tag)
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    every = docs.groupBy(blank(lang).alias("lang"), blank(source).alias("source")).agg(F.count(F.lit(1)).alias("_rows")).drop("_rows")
    sums = raw.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("support"), F.sum(F.col("first").cast("long")).alias("firsts"))
    zero = F.lit(0).cast("long")
    own = every.join(sums, ["lang", "source"], "left").select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("n", "support", "firsts")])
    langs = own.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("firsts").alias("v"))
    joined = own.join(langs, "lang")
    groups = materialize(
        joined.select(
            "lang",
            "source",
            "support",
            "v",
            (F.col("n") + 2 * F.col("v")).alias("total"),
            (F.col("lang_total") + 2 * F.col("v")).alias("lang_total"),
            F.when(F.col("v") > 0, _share(zero, F.col("n") + 2 * F.col("v"))).alias("absent"),
        ),
        "groups",
        tag,
    )
    few = small_side(groups)
    shares = raw.join(few, ["lang", "source"]).select(
        "lang",
        "source",
        "term",
        _share(F.col("n"), F.col("total")).alias("p"),
        _share(F.col("lang_n"), F.col("lang_total")).alias("q"),
        F.col("absent").alias("p0"),
    )
    shares = materialize(shares, "shares", tag)

    # one-sided terms, from histograms of shares
    others = few.select("lang", F.col("source").alias("item"), F.col("absent").alias("q0"))
    histogram = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("terms"))
    sided = (
        histogram.join(others, "lang")
        .filter(F.col("source") != F.col("item"))
        .groupBy("lang", "source", "item")
        .agg(F.sum(F.col("terms") * _apart(F.col("p"), F.col("q0"))).alias("value"))
    )
    sided = sided.unionAll(sided.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    # terms of both, from posting lists
    a = shares.select("lang", "term", "source", "p", "p0")
    b = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    p, q, p0, q0 = map(F.col, ("p", "q", "p0", "q0"))
    both = (
        a.join(b, ["lang", "term"])
        .filter(F.col("source") < F.col("item"))
        .groupBy("lang", "source", "item")
        .agg(F.sum(_apart(p, q) - _apart(p, q0) - _apart(p0, q) + _apart(p0, q0)).alias("value"))
    )
    # each overlap counts for either side
    both = both.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("s"), "value")
    # terms of neither
    g = groups.select("lang", "source", "v", "support", "absent")
    other = few.select("lang", F.col("source").alias("item"), F.col("support").alias("item_support"), F.col("absent").alias("q0"))
    neither = g.join(other, "lang").filter(F.col("source") != F.col("item")).select(
        "lang", "source", "item", F.coalesce((F.col("v") - F.col("support") - F.col("item_support")) * _apart(F.col("absent"), F.col("q0")), zero).alias("value")
    )
    pairs = (
        neither.unionAll(sided)
        .unionAll(both.select("lang", "s.source", "s.item", "value"))
        .groupBy("lang", "source", "item")
        .agg(F.sum("value").alias("value"))
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    )
    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(ordered))
    terms = shares.filter(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= TOP_TERMS)
    return pairs.unionAll(terms)


SQL = r"""
    WITH docs AS (
        SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
        FROM documents
    ), words AS (
        SELECT i, lang, source, translate(unnest(found), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs
    ), kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT i) >= 10),
    counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
    totals AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
    groups AS (
        SELECT g.lang, g.source, coalesce(s.n, 0) AS n
        FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL) s ON s.lang = g.lang AND s.source = g.source
    ), shares AS (
        SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
               CAST(1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (g.n + 2 * t.v) AS BIGINT) AS p,
               CAST(1 + (1000000000 * (k.n + 2)) // (t.n + 2 * t.v) AS BIGINT) AS q
        FROM groups g JOIN kept k ON k.lang = g.lang JOIN totals t ON t.lang = g.lang
        LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
    ), sums AS (
        SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
        FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ), parts AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        UNION ALL
        SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM shares WHERE n > 0 AND p > q
    ), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
    SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
