"""Regular-expression spans as DataFrame expressions: matches with code-point offsets, no Python.

Spark has no "all match positions" function. regexp_extract_all gives the matches and split, with
the same pattern, the text between them; the running total of both lengths gives the offsets. Every
pattern used here starts at the first place of a run (look-behind or \\G) and loops possessively, so
one pass costs time in proportion to the text and never recurses, however long the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Running totals go over blocks of this many elements, so that n matches cost n * BLOCK, not n * n.
BLOCK = 128
#: Code points either side of a match in which context words count.
CONTEXT = 40


@dataclass(frozen=True)
class Kind:
    """A kind of span. keep: predicate on (match); cut: the part of a match that counts, from its start."""

    name: str
    pattern: str
    keep: Callable[[Column], Column] | None = None
    cut: Callable[[Column], Column] | None = None
    value: Callable[[Column], Column] | None = None
    base: bool = True
    prior: float = 1.0
    context: str = ""
    boost: float = 0.0
    least: float = 0.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_totals(steps: Column) -> Column:
    """Inclusive running totals of an array of longs."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(steps) / F.lit(BLOCK)).cast("int") - 1),
        lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)),
    )

    def totals(block: Column, first: Column) -> Column:
        return F.slice(
            F.aggregate(block, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))),
            2,
            BLOCK,
        )

    whole = F.aggregate(
        blocks,
        F.array(F.lit(0).cast("long")),
        lambda acc, block: F.concat(
            acc, F.array(F.element_at(acc, -1) + F.aggregate(block, F.lit(0).cast("long"), lambda s, x: s + x))
        ),
    )
    many = F.flatten(F.zip_with(blocks, F.slice(whole, 1, F.size(blocks)), totals))
    one = totals(steps, F.lit(0).cast("long"))
    return F.when(F.size(steps) == 0, F.array().cast("array<bigint>")).when(F.size(steps) <= BLOCK, one).otherwise(many)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """The digits of match pass the Luhn check."""
    return let(
        F.reverse(digits(match)),
        lambda d: F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))),
            F.lit(0),
            lambda s, i: s
            + let(
                (F.ascii(F.substr(d, i, F.lit(1))) - 48) * F.when(i % 2 == 0, 2).otherwise(1),
                lambda x: F.when(x > 9, x - 9).otherwise(x),
            ),
        )
        % 10
        == 0,
    )


def mod97(code: Column) -> Column:
    """The remainder that ISO 7064 MOD 97-10 asks for, of an account number without spaces, is 1."""
    moved = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))
    return let(
        moved,
        lambda m: F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.length(m), F.lit(1))),
            F.lit(0),
            lambda r, i: let(
                F.ascii(F.substr(m, i, F.lit(1))),
                lambda c: F.when(c >= 65, r * 100 + c - 55).otherwise(r * 10 + c - 48) % 97,
            ),
        )
        == 1,
    )


def with_spans(df: DataFrame, text: Column, kinds: list[Kind], out: str) -> DataFrame:
    """df with the column out: array<struct<start, rank, end, kind, value, score>> by start, then rank.

    rank is the place of the kind in kinds, value the match (or the part that kind.value takes).
    No shuffle; empty array where nothing is found; a null text counts as empty. Columns of df stay,
    but one of the name out, which is replaced.
    """
    none = F.array().cast("array<string>")
    (own,) = fresh(df, "__spans")
    whole = f"{own}_text"
    df = df.withColumn(whole, F.coalesce(text, F.lit("")))
    t = F.col(whole)
    names = []
    found = {}
    for k in kinds:
        some = t.rlike(k.pattern)
        hits, gaps = f"{own}_{k.name}_hits", f"{own}_{k.name}_gaps"
        found[hits] = F.when(some, F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0))).otherwise(none)
        found[gaps] = F.when(some, F.split(t, k.pattern, -1)).otherwise(none)
        names += [hits, gaps]
    df = df.withColumns(found)

    def of(rank: int, k: Kind) -> Column:
        hits, gaps = F.col(f"{own}_{k.name}_hits"), F.col(f"{own}_{k.name}_gaps")
        n = F.size(hits)
        steps = F.zip_with(hits, F.slice(gaps, 1, n), lambda h, g: (F.length(h) + F.length(g)).cast("long"))
        rows = F.arrays_zip(
            hits.alias("h"),
            running_totals(steps).alias("e"),
            F.slice(gaps, 1, n).alias("b"),
            F.slice(gaps, 2, n).alias("a"),
        )
        if k.keep is not None:
            rows = F.filter(rows, lambda x: k.keep(x["h"]))

        def span(x: Column) -> Column:
            start = x["e"] - F.length(x["h"])
            kept = k.cut(x["h"]) if k.cut else x["h"]
            near = F.lower(F.concat_ws(" ", F.right(x["b"], F.lit(CONTEXT)), F.left(x["a"], F.lit(CONTEXT))))
            score = F.lit(k.prior)
            if k.context:
                score = F.least(F.lit(1.0), score + F.when(near.rlike(k.context), k.boost).otherwise(0.0))
            return F.struct(
                start.alias("start"),
                F.lit(rank).alias("rank"),
                (start + F.length(kept)).alias("end"),
                F.lit(k.name).alias("kind"),
                (k.value(kept) if k.value else kept).alias("value"),
                score.cast("double").alias("score"),
            )

        spans = F.transform(rows, span)
        if k.least > k.prior or k.cut:
            spans = F.filter(spans, lambda s: (s["score"] >= k.least) & (s["end"] > s["start"]))
        kind_of = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string,score:double>>"
        return F.when(n > 0, spans).otherwise(F.array().cast(kind_of))

    return df.withColumn(out, F.sort_array(F.concat(*[of(i, k) for i, k in enumerate(kinds)]))).drop(
        *names, whole
    )


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest_columns(spans: Column, kinds: list[Kind]) -> list[Column]:
    """n_<kind> of each base kind, base_sha256 and spans."""
    base = [i for i, k in enumerate(kinds) if k.base]

    def count(rank: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long").alias(f"n_{kinds[rank].name}")

    counts = [count(i) for i in base]
    only = F.filter(spans, lambda s: s["rank"] <= max(base))
    return [*counts, F.sha2(joined(only).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans")]
