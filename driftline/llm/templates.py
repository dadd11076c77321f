"""Benchmark decontamination by template windows.

Numbers, units and names of a text become typed placeholders, so that a question with other numbers
or names has the same template. Windows of template tokens are hash-joined with those of the
benchmark, and the values that fill the placeholders are compared along each alignment: windows count
whose values follow the mapping that most of the alignment gives. A second form of each window knows
no case and no names, so that texts in capitals or in title case are found as well; of windows with
few words (numbers, short items), only verbatim copies are.

Benchmark items of one template and one pattern of repeated values are joined as one: their placeholders
are variables, numbered as they first occur, and a window that many of them have is one row. A template
with many questions and many documents so costs a row a document, not one for each pair. Which windows
hold the very values of a question, and which whole questions stand there, is looked up by hashes of the
values.

Templates that only share some windows, such as a common opening, meet a document only if it holds one of
the rarest windows of theirs that no document with the coverage asked can do without. Of the pairs found
so, all windows are then joined.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, slices, small_side

#: Tokens of a window; shorter items have one window of all their tokens.
WINDOW = 8
#: Tokens of a window that are words, not placeholders, at least; windows of fewer match verbatim only.
LITERAL = 4
#: Share of an item's windows that a document holds, from which on it is contaminated.
COVERAGE = 0.3
#: Benchmark windows up to which their hashes go to each worker (16 MB); beyond it all windows are joined.
FILTER_HASHES = 2_000_000
#: Units, as a word after a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec min h hr hrs ms day days week weeks month months year years "
    "hour hours minute minutes second seconds meter meters metre metres mile miles foot feet inch inches gram grams "
    "kilogram kilograms liter liters litre litres dollar dollars cent cents euro euros pound pounds percent degrees".split()
)
_TOKEN = re.compile(r"[0-9]+(?:[.,:/][0-9]+)*|[^\W\d_]+(?:['’-][^\W\d_]+)*|[%$€£]")
NUMBER, UNIT, NAME = "\x00n", "\x00u", "\x00p"
#: Forms of a window.
NAMED, FOLDED, VERBATIM = range(3)


def template(text: str | None) -> tuple[list[str], list[str | None]]:
    """Template tokens of text, and the value of each that is a placeholder (None for words).

    Every word with a capital first letter counts as a name, at the start of a sentence as well, so
    that whether it is one does not depend on what stands around it.
    """
    tokens: list[str] = []
    values: list[str | None] = []
    for word in _TOKEN.findall(text or ""):
        if word[0].isdigit():
            token = NUMBER
        elif tokens and tokens[-1] == NUMBER and (word in "%$€£" or word.casefold() in UNITS):
            token = UNIT
        elif word[0].isupper():
            token = NAME
        else:
            token = word.lower()
        tokens.append(token)
        values.append(word if token[0] == "\x00" else None)
    return tokens, values


def _mix(x: np.ndarray) -> np.ndarray:
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x


#: Kinds of characters: of words, of numbers, signs of units, what may join two letters or two digits, and letters that fold to several.
_LETTER, _DIGIT, _SIGN, _HYPHEN, _POINT, _SEVERAL = range(1, 7)


class _Characters:
    """Of each code point: its kind, a hash of its folded form, whether it is a capital, a digit; looked up 256 at a time as they occur."""

    def __init__(self):
        n = 0x110000
        self.kind, self.value = np.zeros(n, np.uint8), np.zeros(n, np.uint64)
        self.capital, self.digit, self.known = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n >> 8, bool)

    def points(self, text: str) -> np.ndarray:
        at = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        for block in np.unique((at >> 8)[~self.known[at >> 8]]).tolist():
            self._learn(block << 8)
        return at

    def _learn(self, begin: int) -> None:
        folds = np.zeros(256, np.uint64)
        for i in range(256):
            c = chr(begin + i)
            fold = c.casefold()
            folds[i] = ord(fold[0])
            if _TOKEN.fullmatch(c):
                self.kind[begin + i] = _DIGIT if c in "0123456789" else _SIGN if c in "%$€£" else _LETTER if len(fold) == 1 else _SEVERAL
                self.capital[begin + i], self.digit[begin + i] = c.isupper(), c.isdigit()
            else:
                self.kind[begin + i] = _HYPHEN * (c in "'’-") + _POINT * (c in ".,:/")
        self.value[begin : begin + 256] = _mix(_mix(folds + np.uint64(1)))
        self.known[begin >> 8] = True


_characters = _Characters()
_power = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _power
    if len(_power) < n:
        _power = np.full(2 * n, 0xC2B2AE3D27D4EB4F, np.uint64)
        _power[0] = 1
        _power = np.cumprod(_power)
    return _power


def _word_hash(folded: str) -> np.uint64:
    at = _characters.points(folded)
    return _mix(_mix((_characters.value[at] * _powers(len(at))[: len(at)]).sum(keepdims=True)))[0]


def _words_at_once(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """What _words() gives, without a string for each word; None where a letter folds to several."""
    of = _characters
    b = of.points(text.replace("ß", "ss"))
    kind = of.kind[b]
    if (kind == _SEVERAL).any():
        return None
    for joint, part in ((_HYPHEN, _LETTER), (_POINT, _DIGIT)):
        at = np.flatnonzero(kind[1:-1] == joint) + 1
        kind[at[(kind[at - 1] == part) & (kind[at + 1] == part)]] = part
    kind[kind > _SIGN] = 0
    first = kind > 0
    first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _SIGN)
    held = np.flatnonzero(kind)
    begin = np.flatnonzero(first[held])
    if not len(begin):
        return np.zeros(0, np.uint64), *[np.zeros(0, bool)] * 3
    length = np.diff(begin, append=len(held))
    place = np.arange(len(held)) - np.repeat(begin, length)
    raw = np.add.reduceat(of.value[b[held]] * _powers(int(length.max()))[place], begin)
    start = b[held[begin]]
    return _mix(_mix(raw)), of.digit[start], of.kind[start] == _SIGN, of.capital[start] & ~of.digit[start]


class _Words(dict):
    """word -> its place in kind (a digit, a sign of a unit, a capital first letter) and in the hashes of its forms."""

    def __init__(self):
        super().__init__()
        self._clear(1 << 12)

    def _clear(self, room: int) -> None:
        self.clear()
        self.kind, self.raw = np.zeros(room, np.uint8), np.zeros(room, np.uint64)

    def __missing__(self, word: str) -> int:
        i = len(self)
        if i == len(self.raw):
            self.kind, self.raw = (np.concatenate((x, np.zeros_like(x))) for x in (self.kind, self.raw))
        self.kind[i] = 1 if word[0].isdigit() else 2 * (word in "%$€£") + 4 * word[0].isupper()
        self.raw[i] = _word_hash(word.casefold())
        self[word] = i
        return i


#: Characters up to which a text is looked at at once (some 50 bytes each); the words of longer ones are looked up, with the same result.
AT_ONCE = 1 << 20


def _words(text: str, seen: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of text: the hash of its folded form, whether it is a number, the sign of a unit, begins with a capital."""
    found = _words_at_once(text) if len(text) <= AT_ONCE else None
    if found is not None:
        return found
    if len(seen) >= 1 << 19:
        seen._clear(1 << 12)
    words = _TOKEN.findall(text)
    i = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
    kind = seen.kind[i]
    return seen.raw[i], kind == 1, kind == 2, kind & 4 > 0


_UNIT_HASHES = np.sort(np.array([_word_hash(u) for u in UNITS], np.uint64))


def _is_unit(raw: np.ndarray) -> np.ndarray:
    return _UNIT_HASHES[np.searchsorted(_UNIT_HASHES, raw) % len(_UNIT_HASHES)] == raw


_PLACEHOLDERS = np.array([xxhash.xxh64_intdigest(t) for t in (NUMBER, UNIT, NAME)], np.uint64)


def _rolled(h: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hashes of all windows of `size`, put together of windows of one, two, four words and so on."""
    n = len(h) - size + 1
    out = np.full(n, size + 256 * seed, np.uint64)
    at, span = 0, 1
    while True:
        if size & span:
            out ^= h[at : at + n]
            out = _mix(out)
            at += span
        if 2 * span > size:
            return out
        h = _mix(h[:-span] * np.uint64(0xD6E8FEB86659FD93) ^ h[span:])
        span *= 2


def _enough(literal: np.ndarray, size: int) -> np.ndarray:
    """Which windows of `size` hold LITERAL words at least."""
    total = np.concatenate(([0], np.cumsum(literal)))
    return total[size:] - total[:-size] >= LITERAL


def window_hashes(text: str, sizes: list[int], seen: _Words) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(size, form, hashes, where they begin) of the windows of a text's words.

    NAMED: numbers, units and names are placeholders; windows of LITERAL other words only. FOLDED:
    names are words without case; all windows, those of fewer than LITERAL words with their numbers
    and units as they are, so that they match verbatim only.
    """
    raw, number, sign, capital = _words(text, seen)
    unit = np.zeros(len(raw), bool)
    unit[1:] = number[:-1] & ~number[1:]
    unit[unit] = sign[unit] | _is_unit(raw[unit])
    name = capital & ~unit
    folded = np.where(number, _PLACEHOLDERS[0], np.where(unit, _PLACEHOLDERS[1], raw))
    named = np.where(name, _PLACEHOLDERS[2], folded)
    word = ~(number | unit)
    for size in sizes:
        if size < 1 or len(raw) < size:
            continue
        at = np.flatnonzero(_enough(word & ~name, size))
        if len(at):
            yield size, NAMED, _rolled(named, size, NAMED)[at].view(np.int64), at
        h, few = _rolled(folded, size, FOLDED), np.flatnonzero(~_enough(word, size))
        if len(few):
            h[few] = _rolled(raw, size, VERBATIM)[few]
        yield size, FOLDED, h.view(np.int64), np.arange(len(h))


def _hash(parts: list) -> int:
    h = xxhash.xxh64_intdigest(repr(parts).encode("utf-8", "surrogatepass"))
    return h - (h >> 63 << 64)


#: What _hash() gives of no values.
EMPTY = _hash([])


def _filling(values: list[str | None], at: int, size: int) -> list[str]:
    return [v for v in values[at : at + size] if v is not None]


def _folded(tokens: list[str], values: list[str | None]) -> list[str | None]:
    """The values of FOLDED windows: names are words there."""
    return [v if t in (NUMBER, UNIT) else None for t, v in zip(tokens, values, strict=True)]


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> the windows of each item.

    template: a number for items of the same NAMED windows and pattern of values. slots: the variables
    that fill the window; filled: a hash of the values that do; whole: of all the item's FOLDED windows.
    windows and named_windows count all places and the NAMED ones.
    """
    seen = _Words()
    for batch in slices(batches):
        rows = []
        for own, item in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = item.as_py()
            tokens, values = template(text)
            variables = {v: str(i) for i, v in enumerate(dict.fromkeys(v for v in values if v is not None))}
            pattern = [v if v is None else variables[v] for v in values]
            of = {NAMED: (values, pattern), FOLDED: (_folded(tokens, values), _folded(tokens, pattern))}
            found = list(window_hashes(text or "", [min(WINDOW, len(tokens))], seen))
            rows_of = [
                (h, at, size, form, _hash([v.casefold() for v in _filling(of[form][0], at, size)]))
                for size, form, hashes, places in found
                for h, at in zip(hashes.tolist(), places.tolist(), strict=True)
            ]
            whole = _hash([(at, h, filled) for h, at, _, form, filled in rows_of if form == FOLDED])
            named = [(h.tolist(), at.tolist()) for _, form, h, at in found if form == NAMED]
            class_ = _hash([len(tokens), named, pattern]) if named else whole
            for h, at, size, form, filled in rows_of:
                rows.append(
                    (own, class_, whole, h, at, size, form == NAMED, len(named[0][1]) if named else 0, len(tokens) - size + 1)
                    + (_filling(of[form][1], at, size), filled)
                )
        kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
        kinds += [pa.list_(pa.string()), pa.int64()]
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        names = ["id", "template", "whole", "hash", "at", "size", "named", "named_windows", "windows", "slots", "filled"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _windows(sizes: list[int], known):
    """(id, text) -> windows of a document; known: hashes that go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Words()
        keep = None if known is None else known.value
        if keep is not None:  # most windows are told from it by some bits already
            mask = np.int64((1 << max(16, (16 * len(keep)).bit_length())) - 1)
            near = np.zeros(mask + 1, bool)
            near[keep & mask] = True
        for batch in slices(batches):
            ids, hashes, places, lengths, slots, filled = [], [], [], [], [], []
            for own, item in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = item.as_py()
                values = None
                for size, form, h, at in window_hashes(text or "", sizes, seen):
                    if keep is not None:
                        maybe = near[h & mask]
                        h, at = h[maybe], at[maybe]
                        i = np.searchsorted(keep, h)
                        i[i == len(keep)] = 0
                        hit = keep[i] == h
                        h, at = h[hit], at[hit]
                    if not len(h):
                        continue
                    if values is None:
                        tokens, values = template(text)
                        folded = _folded(tokens, values)
                    found = [_filling(values if form == NAMED else folded, a, size) for a in at.tolist()]
                    ids += [own] * len(h)
                    hashes += h.tolist()
                    places += at.tolist()
                    lengths += [size] * len(h)
                    slots += found
                    filled += [_hash([v.casefold() for v in x]) if x else EMPTY for x in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(hashes, pa.int64()), pa.array(places, pa.int64())]
                + [pa.array(lengths, pa.int32()), pa.array(slots, pa.list_(pa.string())), pa.array(filled, pa.int64())],
                ["id", "hash", "at", "size", "slots", "filled"],
            )

    return run


def equal(a: list[str], b: list[str]) -> bool:
    return [v.casefold() for v in a] == [v.casefold() for v in b]


def accepted(windows: list[tuple[list[str], list[str]]], same: list[bool] | None = None) -> list[bool]:
    """Which windows of an alignment, (the item's values or variables, the document's values), count.

    Those of the same values always do; others if each of their values goes to the value that most windows
    give it and, of names, comes from the one that most windows give back. Several numbers may become one.
    """
    same = [equal(a, b) for a, b in windows] if same is None else same
    forth: dict[str, Counter] = defaultdict(Counter)
    back: dict[str, Counter] = defaultdict(Counter)
    held = set()
    for (a, b), own in zip(windows, same, strict=True):
        for x, y in zip(a, b, strict=True):
            forth[x][y] += 1
            back[y][x] += 1
            if own:
                held |= {(x, y), (y, x)}
    most = lambda of: {k: max(n, key=lambda v: (n[v], (k, v) in held, v)) for k, n in of.items()}
    to, from_ = most(forth), most(back)
    return [
        own or all(to[x] == y and (not y[0].isupper() or from_[y] == x) for x, y in zip(a, b, strict=True))
        for (a, b), own in zip(windows, same, strict=True)
    ]


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, template, found, named_windows, windows) of alignments -> a row for each window that counts.

    whole: of alignments that hold all FOLDED windows, their hash as _items() makes it.
    """
    for batch in slices(batches):
        rows, of = [], []
        for i, (found, total) in enumerate(zip(batch.column(2), batch.column(4).to_pylist(), strict=True)):
            found = found.as_py()
            folded = sorted((w["place"], w["hash"], w["filled"]) for w in found if not w["named"])
            whole = _hash(folded) if len(folded) == total else None
            for w, good in zip(found, accepted([(w["a"], w["b"]) for w in found], [w["same"] for w in found]), strict=True):
                if good:
                    of.append(i)
                    rows.append((w["place"], w["named"], whole))
        take = batch.take(pa.array(of, pa.int64()))
        place, named, whole = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [take.column(0), take.column(1), pa.array(place, pa.int64()), pa.array(named, pa.bool_()), pa.array(whole, pa.int64())]
            + [take.column(3), take.column(4)],
            ["id", "template", "place", "named", "whole", "named_windows", "windows"],
        )


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))


def _spared(total: Column, coverage: float) -> Column:
    """Of `total` places, how many of the rarest a document can't miss all of and still hold the coverage."""
    least = F.greatest(F.lit(1), F.ceil(total * F.lit(coverage) - F.lit(1e-9)))
    return total - least + 1


def with_rare(windows: DataFrame, coverage: float) -> DataFrame:
    """windows with rare: whether a document that holds the window has to be compared with the template.

    A document of the coverage asked holds so many places of a template (or NAMED ones) that it can't miss
    all rare ones. Places whose windows few templates share come first, so that a window of many templates
    is rare only in those that consist of such windows for the most part.
    """
    shared = windows.select("template", "hash", "size").distinct().groupBy("hash", "size").agg(F.count("*").alias("__n"))
    place = F.max("__n").over(Window.partitionBy("template", "item_at"))
    any_form = F.dense_rank().over(Window.partitionBy("template").orderBy("__place", "item_at"))
    one_form = F.dense_rank().over(Window.partitionBy("template", "named").orderBy("__n", "item_at"))
    ranked = windows.join(shared, ["hash", "size"]).withColumn("__place", place).withColumns({"__any": any_form, "__one": one_form})
    rare = (F.col("__any") <= _spared(F.col("windows"), coverage)) | (F.col("named") & (F.col("__one") <= _spared(F.col("named_windows"), coverage)))
    return ranked.select(*windows.columns, rare.alias("rare"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    coverage: float = COVERAGE,
    tag: str = "",
) -> DataFrame:
    """doc_id, item_id, coverage, exact, n_items: a row for each document and template of the benchmark that it holds.

    coverage is the share of the template's windows found (of all, or of those in NAMED form if that is
    more) with accepted() values; n_items tells how many items have the template. exact tells that an item
    stands there as a whole, but for case: item_id is it, the least if there are several, and else the least
    of the template. Null and empty texts hold nothing; texts are read whole, however long; rows of one
    doc_id are judged together, a null doc_id like any other; items of equal text are items of one
    template, repeated ones one; items of fewer than LITERAL words are found wherever their words stand in
    a row; an empty table on either side gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    kinds = [_rows(d, k, t).schema["id"].dataType.simpleString() for d, k, t in ((docs, doc_id, text), (benchmark, item_id, item_text))]
    of = "template long, whole long, hash long, at long, size int, named boolean, named_windows long, windows long, slots array<string>, filled long"
    items = _rows(benchmark, item_id, item_text).filter(F.col("text").isNotNull()).mapInArrow(_items, f"id {kinds[1]}, {of}")
    items = materialize(items, "item-windows", tag)
    members = items.groupBy("template").agg(F.min("id").alias("item_id"), F.count_distinct(F.struct("id")).alias("n_items"))
    members = materialize(members, "item-templates", tag)
    wholes = materialize(items.groupBy("template", "whole").agg(F.min("id").alias("own_id")), "item-texts", tag)
    shared = ["template", "hash", "size", "named", "named_windows", "windows"]
    windows = items.select(*shared, F.col("at").alias("item_at"), F.col("slots").alias("item_slots")).distinct()
    windows = materialize(with_rare(windows, coverage), "template-windows", tag)
    values = materialize(items.select("template", "hash", F.col("at").alias("item_at"), "filled").distinct(), "item-values", tag)
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most WINDOW of them
    hashes, known = items.select("hash").distinct(), None
    if hashes.limit(FILTER_HASHES + 1).count() <= FILTER_HASHES:
        found = hashes.toPandas()["hash"].to_numpy(np.int64)
        found.sort()
        known = spark.sparkContext.broadcast(found if len(found) else np.zeros(1, np.int64))
    hits = _rows(docs, doc_id, text).filter(F.col("text").isNotNull()).mapInArrow(
        _windows(sizes, known), f"id {kinds[0]}, hash long, at long, size int, slots array<string>, filled long"
    )
    if known is None:
        hits = hits.join(hashes, "hash", "left_semi")
    hits = materialize(hits, "document-windows", tag)
    rare = windows.filter("rare").select("template", "hash", "size").distinct()
    met = materialize(hits.join(small_side(rare), ["hash", "size"]).select("id", "template").distinct(), "met-templates", tag)
    met = met.withColumnRenamed("id", "__id").join(small_side(windows.drop("rare")), "template").withColumnsRenamed({"hash": "__hash", "size": "__size"})
    held_by = F.col("id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash")) & (F.col("size") == F.col("__size"))
    pairs = hits.join(met, held_by).drop("__id", "__hash", "__size")
    pairs = pairs.join(small_side(values.withColumn("same", F.lit(True))), ["template", "hash", "item_at", "filled"], "left")
    # an alignment of document and template, whose values are judged together
    same = F.coalesce("same", F.lit(False)).alias("same")
    window = F.struct(F.col("item_at").alias("place"), "hash", "named", "filled", same, F.col("item_slots").alias("a"), F.col("slots").alias("b"))
    aligned = (
        pairs.groupBy("id", "template", (F.col("at") - F.col("item_at")).alias("shift"))
        .agg(F.collect_set(window).alias("found"), F.max("named_windows").alias("named_windows"), F.max("windows").alias("windows"))
        .drop("shift")
    )
    judged = aligned.mapInArrow(
        _judge, f"id {kinds[0]}, template long, place long, named boolean, whole long, named_windows long, windows long"
    )
    judged = materialize(judged, "judged-windows", tag)
    of_named = F.count_if("named") / F.nullif(F.max("named_windows"), F.lit(0))
    held = (
        judged.groupBy("id", "template", "place")
        .agg(*[F.max(c).alias(c) for c in ("named", "named_windows", "windows")])
        .groupBy("id", "template")
        .agg(F.greatest(F.count("*") / F.max("windows"), of_named).alias("coverage"))
        .filter(F.col("coverage") >= coverage)
    )
    there = judged.filter(F.col("whole").isNotNull()).select("id", "template", "whole").distinct().join(small_side(wholes), ["template", "whole"])
    there = there.groupBy("id", "template").agg(F.min("own_id").alias("own_id"), F.lit(True).alias("exact"))
    there = there.withColumnsRenamed({"id": "__id", "template": "__template"})
    return (
        held.join(small_side(members), "template")
        .join(there, F.col("id").eqNullSafe(F.col("__id")) & (F.col("template") == F.col("__template")), "left")
        .select(
            F.col("id").alias("doc_id"),
            F.when(F.col("exact"), F.col("own_id")).otherwise(F.col("item_id")).alias("item_id"),
            "coverage",
            F.coalesce("exact", F.lit(False)).alias("exact"),
            "n_items",
        )
    )


def decontamination_report(docs: DataFrame, benchmark: DataFrame, tag: str = "") -> DataFrame:
    """doc_id, contaminated, n_items, item_id and coverage of the best item, exact: a row for each row.

    The best is the one of the highest coverage, of equals a whole one, then the least id. n_items counts
    the items of all templates found; columns of docs other than doc_id and text are not read.
    """
    best = F.struct((-F.col("coverage")).alias("c"), (~F.col("exact")).alias("x"), F.col("item_id").alias("i"))
    found = contaminated(docs, benchmark, tag=tag).groupBy("doc_id").agg(F.sum("n_items").alias("n_items"), F.min(best).alias("b"))
    found = found.withColumnRenamed("doc_id", "__id")
    rows = docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return rows.select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.col("b.i").alias("item_id"),
        F.coalesce(-F.col("b.c"), F.lit(0.0)).alias("coverage"),
        F.coalesce(~F.col("b.x"), F.lit(False)).alias("exact"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", tag: str = "") -> DataFrame:
    """docs without those that hold a benchmark item; of rows with one doc_id, all or none go. Ids alone are looked up where few are found."""
    (gone_id,) = fresh(docs, "__id")
    gone = contaminated(docs, benchmark, doc_id, text, tag=tag).select(F.col("doc_id").alias(gone_id)).distinct()
    gone = small_side(materialize(gone, "contaminated", tag))
    return docs.join(gone, F.col(f"`{doc_id}`").eqNullSafe(F.col(gone_id)), "left_anti")
