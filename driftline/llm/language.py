"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties, on a bounded
sample of labelled rows; the temperature is then fitted on sampled rows that were left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Labelled rows of each language that the model is fitted on, in expectation; a quarter of them give the temperature.
ROWS_PER_LANGUAGE = 1_500
#: Hash buckets of the n-grams of each order, and the orders.
BUCKETS = 1 << 14
ORDERS = 3
#: Characters hashed at once of a long text.
CHUNK = 1 << 16
#: Languages at most; of a column with more, whatever it holds are no languages.
MOST_LANGUAGES = 1_000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.0005, 2
UNKNOWN = "und"


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of text, lower case, and how often each occurs."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    counts = np.zeros(ORDERS * BUCKETS, np.int64)
    for at in range(0, len(codes), CHUNK):
        own = codes[at : at + CHUNK + ORDERS - 1].astype(np.uint64)
        h = np.zeros(len(own), np.uint64)
        for k in range(ORDERS):
            if len(own) <= k:
                break
            h = (h[: len(own) - k] ^ own[k:]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            first = h[:CHUNK]  # n-grams that begin in this chunk
            counts += np.bincount((first >> np.uint64(20)).astype(np.int64) % BUCKETS + k * BUCKETS, minlength=len(counts))
    found = np.flatnonzero(counts)
    return found, counts[found]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # [buckets, languages]
    temperature: float = 1.0

    def vector(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The L2-normalised TF-IDF vector of ngrams() of a text, sparse."""
        x = (1 + np.log(n)) * self.idf[at]
        return at, x / max(np.sqrt((x * x).sum()), 1e-12)

    def probabilities(self, text: str) -> np.ndarray:
        at, x = self.vector(*ngrams(text))
        return softmax(x @ self.weights[at] / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(own: list[tuple[np.ndarray, np.ndarray]], languages: list[str], held: np.ndarray) -> Model:
    """The calibrated model of ngrams() of texts; held: rows that give the temperature only."""
    names = sorted(set(languages))
    places = {x: i for i, x in enumerate(names)}
    y = np.array([places[x] for x in languages])
    df = np.zeros(ORDERS * BUCKETS)
    for (at, _), h in zip(own, held, strict=True):
        df[at] += not h
    model = Model(names, np.log((1 + (~held).sum()) / (1 + df)) + 1, np.zeros((len(df), len(names))))
    vectors = [model.vector(*x) for x in own]
    z, n, w = (np.zeros_like(model.weights) for _ in range(3))
    order = np.flatnonzero(~held)
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in rng.permutation(order):
            at, x = vectors[i]
            own_z, own_n = z[at], n[at]
            own_w = np.where(
                np.abs(own_z) > L1, -(own_z - np.sign(own_z) * L1) / ((BETA + np.sqrt(own_n)) / ALPHA + L2), 0.0
            )
            p = softmax(x @ own_w)
            p[y[i]] -= 1
            g = x[:, None] * p
            more = own_n + g * g
            z[at] = own_z + g - (np.sqrt(more) - np.sqrt(own_n)) / ALPHA * own_w
            n[at] = more
    w = np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    model.weights = w
    rows = np.flatnonzero(held) if held.any() else order
    if len(rows):
        logits = np.array([vectors[i][1] @ w[vectors[i][0]] for i in rows])
        tries = np.exp(np.linspace(np.log(0.05), np.log(20), 61))
        loss = [-np.log(softmax(logits / t)[np.arange(len(rows)), y[rows]] + 1e-12).mean() for t in tries]
        model.temperature = float(tries[int(np.argmin(loss))])
    return model


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang, u) -> (lang, u, at, n): the n-gram buckets of each text and their counts."""
    for batch in slices(batches):
        found = [ngrams(t.as_py()) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), batch.column(2)]
            + [pa.array([x[i].astype(np.int32) for x in found], pa.list_(pa.int32())) for i in (0, 1)],
            ["lang", "u", "at", "n"],
        )


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """The model of labelled rows with a text and a language.

    Of each language ROWS_PER_LANGUAGE rows in expectation (all, if fewer), chosen by a hash of
    doc_id: the sample is bounded whatever the table. n-grams are counted on the executors; their
    buckets, at most ORDERS * BUCKETS for a text however long, come to the driver. Rows repeated under
    one doc_id are chosen together. Without rows the model knows no language and every text is und; more
    than MOST_LANGUAGES languages are an error.
    """
    rows = labelled.select(
        F.col(f"`{text}`").cast("string").alias("text"),
        F.col(f"`{lang}`").cast("string").alias("lang"),
        F.pmod(F.xxhash64(F.col(f"`{doc_id}`"), F.lit("language")), F.lit(1 << 30)).alias("u"),
    ).filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    numbers = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(numbers) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    width = {r["lang"]: int(min(1.0, ROWS_PER_LANGUAGE / r["n"]) * (1 << 30)) for r in numbers}
    chosen: Column = F.lit(False)
    if width:
        chosen = F.col("u") < F.element_at(F.create_map(*[F.lit(x) for pair in width.items() for x in pair]), F.col("lang"))
    found = rows.filter(chosen).mapInArrow(_counted, "lang string, u long, at array<int>, n array<int>").toArrow()
    if not found.num_rows:
        return Model([], np.ones(ORDERS * BUCKETS), np.zeros((ORDERS * BUCKETS, 0)))
    u, langs = found["u"].to_numpy(), found["lang"].to_pylist()
    grams = [tuple(np.asarray(x.values) for x in pair) for pair in zip(found["at"], found["n"], strict=True)]
    order = sorted(range(len(u)), key=lambda i: (u[i], langs[i], grams[i][0].tobytes(), grams[i][1].tobytes()))
    held = u[order] % 4 == 0
    if held.all():
        held[:] = False
    return train([grams[i] for i in order], [langs[i] for i in order], held)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (calibrated probability) of each row, from its whole text.

    und, with score 0, for texts that are null or have no letter, and for all by a model without
    languages; ties go to the first language by name; repeated rows give a row each; an empty table
    gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{doc_id}`").alias("doc_id"))
    sent = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in slices(batches):
            names, scores = [], np.zeros(batch.num_rows)
            for i, item in enumerate(batch.column(0)):
                found = item.as_py()
                if not found or not own.languages or not any(map(str.isalpha, found)):
                    names.append(UNKNOWN)
                    continue
                p = own.probabilities(found)
                best = int(p.argmax())
                names.append(own.languages[best])
                scores[i] = min(1.0, p[best])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
