"""Class-conditional Kneser-Ney language models: how much likelier toxic than ordinary a text is.

One interpolated bigram model for each label, of Kneser-Ney's adjusted counts: pairs, the highest order,
by their occurrences, words once for each distinct word before them, so that a word of one copied
passage weighs as much as one. All words and pairs of the sample count, rare ones discounted (modified
Kneser-Ney, discounts from counts of counts). What a class's discounts set free
goes to counts that both classes share: of words to the continuation counts over both, of pairs to the
pair counts over both and from there to the words, so that an expression too rare to tell is worth
nearly the same to either.

A text's score is the length-normalised comparison of both: the power mean over its words of the
likelihood ratio, on a log scale. Power 0 is the mean log-likelihood ratio; a larger one lets a few
telling words in a long text count. The power, how far pairs move the ratio of their second word, and a
slope and an offset are all chosen on labelled rows that gave no counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, small_side

#: Labelled rows of each class from which the counts are taken, in expectation.
FIT_ROWS = 8_000
#: Labelled rows of each class on which the score is calibrated, in expectation.
CALIBRATION_ROWS = 3_000
#: Bytes of text of each class, and distinct word pairs of the model (24 bytes each), that bound the sample too: of longer texts it has fewer rows.
FIT_BYTES = 64 << 20
MODEL_PAIRS = 1 << 23
#: Parts in which pairs come to the driver, a power of two.
PARTS = 16
#: Powers of the mean, and shares of what a pair tells beyond its second word, that the calibration chooses from.
POWERS = (0.0, 1.0, 2.0, 4.0)
PAIR_SHARES = (0.25, 0.5, 1.0)
#: Words remembered by a worker between texts.
REMEMBERED = 1 << 19
THRESHOLD = 0.7

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Ids(dict):
    """word -> place in the sorted hashes of known words, or their number for others."""

    def __init__(self, hashes: np.ndarray):
        super().__init__()
        self.hashes = hashes

    def __missing__(self, word: str) -> int:
        h = np.uint64(xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")))
        i = int(np.searchsorted(self.hashes, h))
        i = i if i < len(self.hashes) and self.hashes[i] == h else len(self.hashes)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = i
        return i


def power_mean(ratios: np.ndarray, power: float) -> float:
    """Log of the power mean of likelihood ratios given by their logs: their plain mean at power 0, their maximum far on."""
    if power == 0:
        return float(ratios.mean())
    top = ratios.max()
    return float(top + np.log(np.exp(power * (ratios - top)).mean()) / power)


@dataclass
class Model:
    hashes: np.ndarray  # known words, ascending
    word: np.ndarray  # log-likelihood ratio of each word, the last of unknown words
    after: np.ndarray  # what the word before adds where the pair isn't known
    pairs: np.ndarray  # known pairs, ascending
    pair: np.ndarray  # log-likelihood ratio of the second word of each pair
    power: float = 0.0
    share: float = 0.0
    weights: np.ndarray | None = None  # offset and slope of the calibration

    def ratios(self, ids: np.ndarray, share: float) -> np.ndarray:
        """The log-likelihood ratio of each word: of itself, and for `share` what the word before makes of it."""
        each = self.word[ids]
        if share and len(ids) > 1 and len(self.pairs):
            key = ids[:-1] * np.int64(len(self.hashes) + 1) + ids[1:]
            at = np.searchsorted(self.pairs, key)
            at[at == len(self.pairs)] = 0
            each[1:] += share * np.where(self.pairs[at] == key, self.pair[at] - each[1:], self.after[ids[:-1]])
        return each

    def measure(self, ids: np.ndarray, power: float | None = None, share: float | None = None) -> float:
        """The length-normalised comparison of a text; 0 of one without words."""
        if not len(ids):
            return 0.0
        return power_mean(self.ratios(ids, self.share if share is None else share), self.power if power is None else power)

    def score(self, measures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + self.weights[1] * measures, -30, 30)))


@dataclass
class Pairs:
    """The pair counts of a model, which come to the driver a range of first words at a time."""

    n: int
    times: dict[str, list[int]]  # of c0, c1 and both: how many pairs have a count of 1, 2, 3 and 4
    parts: Iterator[dict[str, np.ndarray]]  # key, c0, c1; ascending by key, all pairs of a first word in one part


def _discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2, 3 and more, from how many counts are 1, 2, 3 and 4."""
    n = np.asarray(n, float)
    if (n == 0).any():
        return np.array([0, 0.75, 0.75, 0.75])
    y = n[0] / (n[0] + 2 * n[1])
    found = [0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return np.clip(found, [0, 0.1, 0.1, 0.1], [0, 0.98, 1.9, 2.9])


def build(words: dict[str, np.ndarray], pairs: Pairs) -> Model:
    """The models from adjusted counts; of pairs only key and ratio are held whole, 12 bytes each.

    words: h (hash, ascending), c0, c1 (distinct words before it in each class), left (over both).
    pairs: key (place of the first word * (words + 1) + place of the second, ascending), c0, c1 (occurrences
    in each class: counts of the highest order are raw).
    """
    hashes, size = words["h"], len(words["h"])
    shared = (np.append(words["left"], 0) + 1.0) / (words["left"].sum() + size + 1.0)
    least = {k: np.append(words[w], 0).astype(float) for k, w in (("both", "left"), ("c0", "c0"), ("c1", "c1"))}
    word, own_p, after = [], [], [np.ones(size + 1, np.float32) for _ in (0, 1)]
    for c in (0, 1):
        count = least[f"c{c}"]
        off = _discounts(np.bincount(np.minimum(words[f"c{c}"], 5), minlength=6)[1:5])
        less = np.maximum(count - off[np.minimum(count, 3).astype(int)], 0)
        total = max(count.sum(), 1.0)
        p = less / total + (1 - less.sum() / total) * shared
        word.append(np.log(p))
        own_p.append(p.astype(np.float32))
    offs = {k: _discounts(n).astype(np.float32) for k, n in pairs.times.items()}
    key, pair, at = np.empty(pairs.n, np.int64), np.empty(pairs.n, np.float32), 0
    for part in pairs.parts:
        if not len(part["key"]):
            continue
        a, b = np.divmod(part["key"], np.int64(size + 1))
        lo, hi = int(a[0]), int(a[-1]) + 1
        a -= lo

        def discounted(kind: str, own: np.ndarray, a=a, lo=lo, hi=hi) -> tuple[np.ndarray, np.ndarray]:
            """Share of each pair among those of its first word, and what the discounts leave of each first word."""
            less = np.maximum(own - offs[kind][np.minimum(own, 3)], 0).astype(np.float32)
            # pairs without a count of their own are one event after each word
            total = np.maximum(np.bincount(a, own, hi - lo), least[kind][lo:hi]) + 1.0
            less /= total.astype(np.float32)[a]
            return less, np.maximum(1 - np.bincount(a, less, hi - lo), 1e-3).astype(np.float32)

        both, rest = discounted("both", part["c0"] + part["c1"])
        ratio = []
        for c in (0, 1):
            high, low = discounted(f"c{c}", part[f"c{c}"])
            after[c][lo:hi] = low
            ratio.append(np.log(high + low[a] * (both + rest[a] * own_p[c][b])))
        key[at : at + len(a)], pair[at : at + len(a)] = part["key"], ratio[1] - ratio[0]
        at += len(a)
    return Model(hashes, word[1] - word[0], np.log(after[1]) - np.log(after[0]), key[:at], pair[:at])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) -> (a, b, label, n): the word pairs of the batch, as hashes, and how often each occurs; zero before a text."""
    for batch in slices(batches):
        seen: dict[str, int] = {}

        def hash_of(word: str, seen=seen) -> int:
            return seen.get(word) or seen.setdefault(word, xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")))

        for label in (0, 1):
            rows = []
            for text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own == label and (h := [hash_of(w) for w in words_of(text)]):
                    padded = np.array([0, *h], np.uint64)
                    rows.append(np.column_stack((padded[:-1], padded[1:])))
            if rows:
                found = np.concatenate(rows)
                found = found[np.lexsort(found.T[::-1])]
                first = np.flatnonzero(np.append(True, (found[1:] != found[:-1]).any(axis=1)))
                n, found = np.diff(np.append(first, len(found))), found[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(found[:, i]).view(np.int64)) for i in range(2)]
                    + [pa.array(np.full(len(found), label, np.int32)), pa.array(n.astype(np.int64))],
                    ["a", "b", "label", "n"],
                )


def _taken(counts: DataFrame, keys: list[str]) -> dict[str, np.ndarray]:
    found = counts.select(*[F.col(c) if c in keys else F.col(c).cast("int") for c in counts.columns]).toArrow()
    return {c: found[c].to_numpy() for c in found.column_names}


def _pairs(counts: DataFrame, hashes: np.ndarray) -> Pairs:
    """The pairs of known words; a range of hashes is fetched when the one before is done with."""

    def parts() -> Iterator[dict[str, np.ndarray]]:
        for i in range(PARTS):
            part = _taken(counts.filter(F.shiftrightunsigned("a", 64 - PARTS.bit_length() + 1) == i), ["a", "b"])
            first, second = part["a"].view(np.uint64), part["b"].view(np.uint64)
            a, b = np.searchsorted(hashes, first), np.searchsorted(hashes, second)
            known = np.flatnonzero((a < len(hashes)) & (b < len(hashes)))
            known = known[(hashes[a[known]] == first[known]) & (hashes[b[known]] == second[known])]
            key = a[known] * np.int64(len(hashes) + 1) + b[known]
            order = np.argsort(key)
            yield {"key": key[order]} | {c: part[c][known][order] for c in ("c0", "c1")}

    kinds = {"c0": F.col("c0"), "c1": F.col("c1"), "both": F.col("c0") + F.col("c1")}
    got = counts.agg(F.count("*").alias("n"), *[F.count_if(own == i).alias(f"{k}{i}") for k, own in kinds.items() for i in range(1, 5)]).first()
    return Pairs(got["n"], {k: [got[f"{k}{i}"] for i in range(1, 5)] for k in kinds}, parts())


def _share(u: Column, numbers: dict, most: float, at: float, cap: int) -> Column:
    """Rows of label whose u lies in [at, at + width) of the unit interval, width: most, or less for a class of many rows or long texts."""
    out = F.lit(False)
    for c, (n, size) in numbers.items():
        lo, hi = at, at + min(most, cap / n, FIT_BYTES / max(size, 1))
        out = out | ((F.col("label") == c) & (u >= int(lo * (1 << 30))) & (u < int(hi * (1 << 30))))
    return out


def fit(
    docs: DataFrame, labels: DataFrame | None = None, text: str = "text", label: str = "label", doc_id: str = "doc_id", tag: str = ""
) -> Model:
    """The calibrated model of docs' labelled rows (label 0 or 1; others, nulls included, are left out).

    labels: doc_id, label; without it they are columns of docs. Of each class, FIT_ROWS rows in
    expectation, chosen by a hash of doc_id, give counts and CALIBRATION_ROWS others the calibration; all
    there are, if fewer. A doc_id labelled both ways counts as either; repeated labels count once, rows
    repeated under one doc_id all do; a null doc_id has no label. Without rows of both classes every score
    is a half. Ids and lengths alone are joined with labels; of the chosen ones the texts are read. The sample
    is bounded in bytes too, by FIT_BYTES of each class in expectation, and is halved, by another hash of
    doc_id, until its distinct pairs are MODEL_PAIRS at most; the model holds every word and pair of its
    sample. The counts are made on the executors and come to the driver.
    """
    labels = docs if labels is None else labels
    known = labels.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{label}`").cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & F.col("__id").isNotNull()).distinct()
    size = F.octet_length(F.col(f"`{text}`").cast("string"))
    ids = docs.select(F.col(f"`{doc_id}`").alias("__id"), size.alias("size")).filter(F.col("__id").isNotNull()).groupBy("__id").agg(F.sum("size").alias("size")).join(known, "__id")
    ids = materialize(ids.withColumn("u", F.pmod(F.xxhash64("__id", F.lit("toxicity")), F.lit(1 << 30))), "toxicity-ids", tag)
    sums = ids.groupBy("label").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))
    numbers = {r["label"]: (r["n"], r["size"]) for r in sums.collect()}
    part = FIT_ROWS / (FIT_ROWS + CALIBRATION_ROWS)
    counted = _share(F.col("u"), numbers, part, 0.0, FIT_ROWS)
    chosen = ids.withColumns({"counts": counted, "v": F.pmod(F.xxhash64("__id", F.lit("halves")), F.lit(1 << 30))}).filter(F.col("counts") | _share(F.col("u"), numbers, 1 - part, part, CALIBRATION_ROWS))
    rows = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").cast("string").alias("text"))
    sample = materialize(rows.join(small_side(chosen.select("__id", "label", "counts", "v")), "__id").drop("__id"), "toxicity-fit", tag)
    counting, kept = sample.filter("counts"), 1 << 30
    while True:
        pairs = (
            counting.filter(F.col("v") < kept).select("text", "label").mapInArrow(_occurrences, "a long, b long, label int, n long")
            .groupBy("a", "b")
            .agg(*[F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in (0, 1)])
        )
        pairs = materialize(pairs, "toxicity-pairs", tag)
        if pairs.count() <= MODEL_PAIRS:
            break
        kept >>= 1
    words = pairs.groupBy("b").agg(F.count_if(F.col("c0") > 0).alias("c0"), F.count_if(F.col("c1") > 0).alias("c1"), F.count("*").alias("left"))
    words = _taken(words, ["b"])
    words["h"] = words.pop("b").view(np.uint64)
    order = np.argsort(words["h"])
    words = {k: v[order] for k, v in words.items()}
    model = build(words, _pairs(pairs.filter(F.col("a") != 0), words["h"]))
    sent = pairs.sparkSession.sparkContext.broadcast(model)
    ways = [(power, share) for share in PAIR_SHARES for power in POWERS]
    found = _measured(sample.filter("NOT counts").select("text", "label"), sent, ways).select("label", "f").toPandas()
    sent.destroy()
    y = found["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        model.weights = np.zeros(2)
        return model
    x, prior = np.stack(found["f"].to_numpy()), numbers[1][0] / (numbers[0][0] + numbers[1][0])
    tried = [calibrate(x[:, i], y, prior) for i in range(len(ways))]
    # a likelier toxic text never scores less
    best = min(range(len(ways)), key=lambda i: (tried[i][0][1] < 0, tried[i][1], i))
    (model.power, model.share), model.weights = ways[best], tried[best][0]
    return model


def calibrate(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Offset and slope of a logistic regression on x, and its loss; rows weighted so that the classes stand as in all labelled rows."""
    scale = max(float(x.std()), 1e-9)
    d, w = np.column_stack([np.ones(len(x)), x / scale]), np.zeros(2)
    weight = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        g = d.T @ (weight * (q - y)) + 0.1 * w
        step = np.linalg.solve((d * (weight * q * (1 - q))[:, None]).T @ d + 0.1 * np.eye(2), g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    q = np.clip(1 / (1 + np.exp(-np.clip(d @ w, -30, 30))), 1e-12, 1 - 1e-12)
    return w / [1, scale], float(-(weight * np.where(y == 1, np.log(q), np.log(1 - q))).mean())


def _ids(batches: Iterator[pa.RecordBatch], own: Model, at: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The batches in slices, with the word places of each text in column at."""
    ids = Ids(own.hashes)
    for batch in slices(batches):
        words = (words_of(t.as_py()) for t in batch.column(at))
        yield batch, [np.fromiter(map(ids.__getitem__, w), np.int64, len(w)) for w in words]


def _measured(rows: DataFrame, sent, ways: list[tuple[float, float]]) -> DataFrame:
    """label, f: the measures of each text (text, label) for each (power, share)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch, found in _ids(batches, own, 0):
            f = [[own.measure(i, power, share) for power, share in ways] for i in found]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(f, pa.list_(pa.float64()))], ["label", "f"])

    return rows.mapInArrow(run, "label int, f array<double>")


def toxicity_scores(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score of each row: the probability that its whole text, however long, is labelled toxic.

    Null, empty and wordless texts score what the calibration says of no evidence; repeated rows and
    null ids give a row each; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{doc_id}`").alias("doc_id"))
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch, found in _ids(batches, own, 0):
            scores = own.score(np.array([own.measure(i) for i in found], float))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(scores)], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def keep_below(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text scores threshold or more; all columns as they are, whatever their names, no shuffle.

    Null, empty and wordless texts are kept or not as toxicity_scores() scores them; of repeated rows all
    or none go.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch, found in _ids(batches, own, at):
            scores = own.score(np.array([own.measure(i) for i in found], float))
            yield batch.filter(pa.array(scores < threshold))

    # under numbers, as Spark takes a dot in a name for a path here
    names = [f"c{i}" for i in range(len(docs.columns))]
    numbered = docs.toDF(*names)
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)
