"""Credentials in text, told apart by how many owners share them.

Patterns propose candidates; a hash of each candidate is counted over all distinct repositories and
owners of the corpus. One that many owners hold is a copied example; one that few hold, and that
looks random, is live. DataFrame functions only.

Results for odd input: a null text counts as empty; a null repository or owner counts as one named "";
repeated rows give a row each and count once per owner; an empty table gives no rows; texts are searched
whole, however long; further columns, whatever their names, stay beside the added one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, small_side
from .spans import Kind, digest_columns, let, with_spans

#: Fixed patterns of the base kinds, written so that a run is entered at its first place only.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
#: Kinds that the method adds.
#: From the first line through the END line; of a key cut off before it, the lines that may be its body.
PEM = (
    r"-----BEGIN (?:[A-Z]{2,12} ){0,3}PRIVATE KEY-----"
    r"(?:[^-]{0,20000}+(?:-(?!----)[^-]{0,2000}+){0,40}+-----END (?:[A-Z]{2,12} ){0,3}PRIVATE KEY-----"
    r"|(?:[\s\\rn]*+(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+(?:[\s\\rn]++[A-Za-z0-9+/=]{16,}+)*+)"
)
JWT = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
CODE_HOST = r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}+"
CHAT = r"(?<![A-Za-z0-9_])xox[abprs]-[A-Za-z0-9-]{10,}+"

PLACEHOLDER = r"(?i)example|changeme|placeholder|your[_-]?|dummy|xxxx|1234567|\.\.\."
#: Distinct owners or repositories from which on a candidate is a copied example.
SHARED = 3
#: Distinct characters that a live-looking value has at least.
VARIETY = 6


def _assigned(match: Column) -> Column:
    return F.regexp_extract(match, ASSIGN, 1)


def _key_body(match: Column) -> Column:
    """A key without its first and last line, headers, line breaks and blanks; the match where nothing is left."""
    body = F.regexp_replace(match, r"-----[A-Z ]*+-----|(?:Proc-Type|DEK-Info):[^\r\n\\]*+", "")
    body = F.regexp_replace(body, r"\\[nr]|\s", "")
    return let(body, lambda b: F.when(b == "", match).otherwise(b))


KINDS = [
    Kind("assign", ASSIGN, keep=lambda m: F.length(_assigned(m)) >= 6, value=_assigned),
    Kind("access", ACCESS),
    Kind("hex", HEX),
    Kind("pem", PEM, value=_key_body, base=False),
    Kind("jwt", JWT, base=False),
    Kind("codehost", CODE_HOST, base=False),
    Kind("chat", CHAT, base=False),
]


def _distinct_characters(value: Column) -> Column:
    return F.size(F.array_distinct(F.split(value, "")))


def _random_looking(value: Column) -> Column:
    return let(value, lambda v: ~v.rlike(PLACEHOLDER) & (_distinct_characters(v) >= VARIETY))


def owner_counts(candidates: DataFrame) -> DataFrame:
    """hash, owners, repos of (hash, owner, repo) rows: distinct counts, pre-aggregated before each shuffle."""
    by_pair = candidates.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = by_pair.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    by_repo = by_pair.groupBy("hash", "repo").agg(F.count("*").alias("n"))
    owners = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.lit(0).cast("long").alias("repos"))
    repos = by_repo.groupBy("hash").agg(F.lit(0).cast("long").alias("owners"), F.count("*").alias("repos"))
    return owners.unionByName(repos).groupBy("hash").agg(F.max("owners").alias("owners"), F.max("repos").alias("repos"))


def secret_findings(
    docs: DataFrame,
    text: str = "text",
    repo: str = "source",
    owner: str = "source",
    shared: int = SHARED,
    tag: str = "",
    out: str = "secrets",
    keep: list[str] | None = None,
) -> DataFrame:
    """docs, or its columns keep, with out: array<struct<start, rank, end, kind, value, score, class>>, class live or example.

    A candidate whose hash at least `shared` distinct owners or repositories hold is an example, and
    so is one that does not look random. Rows and their spans are written to the shared folder once, with
    a key: what is read of them later has the same keys, however docs was made. Only hashes are counted,
    and only rows with candidates are joined. A hot hash has one row on the counted side, so the join's
    large side can be split. A column of the name out is replaced.
    """
    key, spans, who, found = fresh(docs, "__row", "__own", "__who", "__found")
    base = with_spans(docs, F.col(f"`{text}`"), KINDS, spans)
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    base = base.withColumns({key: F.monotonically_increasing_id(), who: F.struct(name(repo).alias("repo"), name(owner).alias("owner"))})
    kept = [F.col(f"`{c}`") for c in keep or docs.columns if c.lower() != out.lower()]
    base = materialize(base.select(*kept, key, spans, who), "secret-spans", tag)
    single = base.filter(F.size(spans) > 0).select(
        F.col(key).alias("key"), F.col(f"{who}.repo").alias("repo"), F.col(f"{who}.owner").alias("owner"), F.explode(spans).alias("s")
    )
    single = single.withColumn("hash", F.sha2(F.col("s.value").cast("binary"), 256))
    counts = owner_counts(single.select("hash", "owner", "repo"))
    copied = counts.filter((F.col("owners") >= shared) | (F.col("repos") >= shared)).select("hash", F.lit(True).alias("copied"))
    copied = materialize(copied, "secret-copied", tag)
    known = F.when(F.col("copied") | ~_random_looking(F.col("s.value")), F.lit("example")).otherwise(F.lit("live"))
    told = (
        single.join(small_side(copied), "hash", "left")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.col("s").withField("class", known))).alias(found))
        .withColumnRenamed("key", f"{key}_of")
    )
    told = materialize(told, "secret-classes", tag)
    none = F.array().cast(told.schema[found].dataType)
    # rows without candidates stay where they are
    clean = base.filter(F.size(spans) == 0).select(*kept, none.alias(out))
    hit = base.filter(F.size(spans) > 0).join(small_side(told), F.col(key) == F.col(f"{key}_of"))
    return clean.union(hit.select(*kept, F.col(found).alias(out)))


def secret_digest(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repo: str = "source", owner: str = "source", tag: str = ""
) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans, and how many are live or examples.

    A table of documents tells one thing of where a text comes from, its source: it stands for the
    repository and for its owner, so that both counts are of sources there.
    """
    column = lambda c, name: F.col(f"`{c}`").alias(name)
    rows = docs.select(column(doc_id, "doc_id"), column(text, "text"), column(repo, "repo"), column(owner, "owner"))
    found = secret_findings(rows, "text", "repo", "owner", tag=tag, keep=["doc_id"])
    spans = F.col("secrets")
    of = lambda name: F.size(F.filter(spans, lambda s: s["class"] == name)).cast("long").alias(f"n_{name}")
    counted = [of("live"), of("example")]
    return found.select("doc_id", *digest_columns(spans, KINDS), *counted)


def redact_live(docs: DataFrame, text: str = "text", secrets: str = "secrets", mask: str = "[secret]") -> DataFrame:
    """docs with each live span of text replaced by mask (overlapping spans by one), other text untouched."""
    t, live = F.col(f"`{text}`"), F.filter(F.col(secrets), lambda s: s["class"] == "live")
    merged = F.aggregate(
        live,
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] < F.try_element_at(acc, F.lit(-1))["end"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        F.try_element_at(acc, F.lit(-1))["start"].alias("start"),
                        F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    out = F.aggregate(
        merged,
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done")),
        lambda acc, s: F.struct(
            s["end"].alias("at"),
            F.concat(
                acc["done"],
                F.substr(t, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                F.lit(mask),
            ).alias("done"),
        ),
        lambda acc: F.concat(acc["done"], F.substr(t, (acc["at"] + 1).cast("int"))),
    )
    return docs.withColumn(text, F.when(F.size(live) > 0, out).otherwise(t))
