"""Best-fit packing of documents into sequences of several permitted lengths.

Which lengths go together depends on how many pieces there are of each length only, so the packing
is planned on the driver from a histogram with at most one entry for each length up to the largest
capacity, whatever the number of documents. The plan is a list of patterns (a bin's contents by
length, and how many bins have them); executors then look up the place of each piece by its length
and its rank among pieces of that length.

Planning takes the longest piece left, fills a bin of each capacity that holds it with the best fit
(always the longest piece that still goes in), opens the one of least cost for each token in it, and
repeats the pattern while its pieces last. A bin is at last cut down to the least capacity that
holds its contents.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices
from .tokens import default_tokenizer, word_ids

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: What a sequence costs besides its tokens and padding, in tokens.
OVERHEAD = 16


@dataclass(frozen=True)
class Slot:
    """Pieces of one length in the bins of one pattern: ranks first .. first + bins * copies - 1."""

    length: int
    first: int
    copies: int
    base: int  # the pattern's first bin
    capacity: int
    offset: int  # of the first copy in a bin


def plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> list[Slot]:
    """Slots for all pieces; every length must be 1 to the largest capacity."""
    sizes = sorted(set(capacities))
    left = {k: n for k, n in histogram.items() if n > 0}
    if left and not 1 <= min(left) <= max(left) <= sizes[-1]:
        raise ValueError("lengths must be between 1 and the largest capacity")
    lengths, ranks, slots, base = sorted(left), dict.fromkeys(left, 0), [], 0
    while lengths:
        longest, best = lengths[-1], None
        for capacity in sizes[bisect_right(sizes, longest - 1) :]:
            pattern, room, top = {longest: 1}, capacity - longest, len(lengths)
            while room and (top := bisect_right(lengths, room, 0, top)):
                k = lengths[top - 1]
                top -= 1
                n = min(room // k, left[k] - pattern.get(k, 0))
                if n > 0:
                    pattern[k] = pattern.get(k, 0) + n
                    room -= n * k
            cost = (sizes[bisect_right(sizes, capacity - room - 1)] + overhead) / (capacity - room)
            if best is None or cost <= best[0]:
                best = cost, capacity - room, pattern
        _, filled, pattern = best
        times = min(left[k] // n for k, n in pattern.items())
        capacity, offset = sizes[bisect_right(sizes, filled - 1)], 0
        for k, n in pattern.items():
            slots.append(Slot(k, ranks[k], n, base, capacity, offset))
            ranks[k] += n * times
            left[k] -= n * times
            offset += n * k
            if not left[k]:
                lengths.pop(bisect_right(lengths, k) - 1)
        base += times
    return slots


def token_lengths(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens of each row, with one token for the end of the document.

    Null and empty texts have that one token; very long texts are encoded whole; repeated rows and null
    ids give a row each; an empty table gives no rows; other columns are not read.
    """
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in slices(batches):
            n = [len(words.text(t.as_py())) // 4 + 1 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long")


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds part and rank, the number of rows of the same length before in this part; rows come sorted by length."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        length = batch.column(3).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.append(True, length[1:] != length[:-1]))
        sizes = np.diff(np.append(starts, len(length)))
        rank = np.arange(len(length)) - np.repeat(starts, sizes)
        if length[0] == last:
            rank[: sizes[0]] += seen
        last, seen = length[-1], int(rank[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(rank.astype(np.int64))],
            ["doc_id", "piece", "piece_start", "n_tokens", "part", "rank"],
        )


def pack(
    lengths: DataFrame,
    doc_id: str = "doc_id",
    n_tokens: str = "n_tokens",
    capacities: tuple[int, ...] = CAPACITIES,
    overhead: int = OVERHEAD,
    tag: str = "",
) -> DataFrame:
    """doc_id, piece, piece_start, n_tokens, bin_id, capacity, bin_offset: a row for each piece of a document.

    Documents longer than the largest capacity are cut into pieces of that size and a rest. Rows of
    null or no length have no piece; repeated rows and null ids are packed like any other; an empty
    table gives no rows; other columns are not read. Pieces of equal length are ranked by doc_id.
    """
    most = max(capacities)
    size = F.col(f"`{n_tokens}`").cast("long")
    rows = lengths.select(F.col(f"`{doc_id}`").alias("doc_id"), size.alias("n")).filter(F.col("n") > 0)
    # ranges are taken from a sample and then dealt: two reads, of the lengths and not of the texts
    pieces = (
        materialize(rows, "lengths", tag)
        .select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / most).cast("int") - 1)).alias("piece"))
        .select(
            "doc_id",
            "piece",
            (F.col("piece").cast("long") * most).alias("piece_start"),
            F.least(F.lit(most).cast("long"), F.col("n") - F.col("piece").cast("long") * most).alias("n_tokens"),
        )
    )
    kind = pieces.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, piece int, piece_start long, n_tokens long"
    ranked = materialize(
        pieces.repartitionByRange("n_tokens", "doc_id", "piece")
        .sortWithinPartitions("n_tokens", "doc_id", "piece")
        .mapInArrow(_ranked, f"{fields}, part int, rank long"),
        "ranked-pieces",
        tag,
    )
    # a length lies in neighbouring parts: at most one row for each part and each length
    counts = ranked.groupBy("n_tokens", "part").agg(F.count("*").alias("n")).orderBy("n_tokens", "part").toPandas()
    before = counts.groupby("n_tokens")["n"].cumsum() - counts["n"]
    slots = plan({int(k): int(n) for k, n in counts.groupby("n_tokens")["n"].sum().items()}, capacities, overhead)
    slots.sort(key=lambda s: (s.length, s.first))
    sent = ranked.sparkSession.sparkContext.broadcast(
        (
            counts["n_tokens"].to_numpy(np.int64) << 32 | counts["part"].to_numpy(np.int64),
            before.to_numpy(np.int64),
            np.array([s.length << 44 | s.first for s in slots], np.int64),
            np.array([[s.first, s.copies, s.base, s.capacity, s.offset] for s in slots], np.int64).reshape(-1, 5),
        )
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, first, keys, table = sent.value
        for batch in batches:
            length, part, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4, 5))
            rank = rank + first[np.searchsorted(starts, length << 32 | part)]
            slot = table[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            at = rank - slot[:, 0]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:4],
                    pa.array(slot[:, 2] + at // slot[:, 1]),
                    pa.array(slot[:, 3]),
                    pa.array(slot[:, 4] + at % slot[:, 1] * length),
                ],
                ["doc_id", "piece", "piece_start", "n_tokens", "bin_id", "capacity", "bin_offset"],
            )

    return ranked.mapInArrow(place, f"{fields}, bin_id long, capacity long, bin_offset long")
