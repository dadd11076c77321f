"""Token ids in Parquet: dictionary and delta encoded columns, small row groups, page indexes.

A token set is a folder with data/ (doc_id, part, local_start, n_tokens, tokens, in ascending doc_id
order) and parts/ (a row for each data part: where its ids begin in the whole sequence). Ids are a
list column with a dictionary, which packs a vocabulary under 65,536 into two bytes or less; the
whole-number columns are delta encoded. Row groups and pages are small and carry column indexes, so
a reader of metadata, or of a range of documents, reads those pages only.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_path, slices

END_ID = 1
ROW_GROUP_BYTES = 16 << 20
PAGE_ROWS = 2_000
#: Words whose ids a worker remembers, twice over: a full generation becomes the old one.
REMEMBERED = 400_000
#: Longer words are encoded each time.
LONGEST = 64
#: Words that are encoded at once, and characters of texts whose new words are.
TOGETHER = 1_000
AT_ONCE = 1 << 14
#: Marks that end a word and never join what stands before them.
MARKS = frozenset(b".,;:!?")
_ID = attrgetter("id")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """word (UTF-8) -> its ids as little-endian unsigned 32-bit integers.

    For tokenizers that lower-case, drop white space and never join what it separates, as word_bpe
    does: the ids of a text are then those of its words, one after the other, and each word needs
    encoding once. A mark after a letter or digit is a token of its own there as well. Of a word of
    plain letters (see _letters) the tokenizer's steps before its model would change nothing, so that
    the model alone is asked, in a third of the time; signs at its end are looked up by themselves.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.old: dict[bytes, bytes] = {}
        tokenizer = Tokenizer.from_file(path)
        self.encode, self.model = tokenizer.encode, tokenizer.model
        self.letters, signs = _letters(tokenizer)
        self.same = all(chr(c) == read for c, read in self.letters.items() if c < 128)
        self.plain = re.compile(f"([{''.join(map(chr, self.letters))}]+)([{re.escape(signs)}]*)" if self.letters else "(?!)()()")
        self.waiting: list[bytes] | None = None  # within texts(): new words that learn() is to encode together

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None and (found := self.plain.fullmatch(word.decode("utf-8").lower())):
            core, signs = found.groups()
            ids = self._signed(core, signs) if signs else self._of_model(core)
        elif ids is None and _marked(word):
            return self[word[:-1]] + self[word[-1:]]
        elif ids is None and self.waiting is not None:
            self.waiting.append(word)
            return b""
        elif ids is None:
            ids = self._whole(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self._turn()
            self[word] = ids
        return ids

    def _of_model(self, core: str) -> bytes:
        ids = [*map(_ID, self.model.tokenize(core if core.isascii() and self.same else core.translate(self.letters)))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _signed(self, core: str, signs: str) -> bytes:
        end = signs.encode()
        ids = self.get(end) or self.old.get(end) or self._whole(end)
        if len(end) <= LONGEST:
            self[end] = ids
        return self[core.encode()] + ids

    def _whole(self, word: bytes) -> bytes:
        return np.array(self.encode(word.decode("utf-8"), add_special_tokens=False).ids, "<u4").tobytes()

    def _turn(self) -> None:
        self.old = dict(self)
        self.clear()

    def learn(self, words: Iterable[bytes]) -> None:
        """Encode the words not yet known, many in one call, which takes little more than half the time of a call for each."""
        bare = {}
        for word in words:
            while _marked(word):
                word = word[:-1]
            if len(word) <= LONGEST and word not in self and word not in self.old:
                bare[word] = None
        new = list(bare)
        for at in range(0, len(new), TOGETHER):
            some = new[at : at + TOGETHER]
            found = self.encode([w.decode("utf-8") for w in some], is_pretokenized=True, add_special_tokens=False)
            raw = np.array(found.ids, "<u4").tobytes()
            ends = (4 * np.searchsorted(found.word_ids, np.arange(len(some) + 1))).tolist()
            if len(self) + len(some) > REMEMBERED:
                self._turn()
            self.update(zip(some, [raw[s:e] for s, e in zip(ends, ends[1:], strict=False)], strict=True))

    def text(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, _split(text)))

    def texts(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """text() of each; the new words of some AT_ONCE characters that are not plain letters are encoded together."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text or "")
            if size >= AT_ONCE:
                yield from self._known(held)
                held, size = [], 0
        yield from self._known(held)

    def _known(self, texts: list[str | None]) -> list[bytes]:
        self.waiting, found, again = [], [], []
        for i, text in enumerate(texts):
            n = len(self.waiting)
            found.append(self.text(text))
            if len(self.waiting) > n:
                again.append(i)
        new, self.waiting = self.waiting, None
        self.learn(new)
        for i in again:
            found[i] = self.text(texts[i])
        return found


def _letters(tokenizer) -> tuple[dict[int, str], str]:
    """What the model reads for each of the lower-case letters that the steps before it leave whole, and signs that these steps part from letters before.

    Asked of the tokenizer's own normalizer and pre-tokenizer, for all pairs of letters; none if some pair is parted.
    """
    if tokenizer.pre_tokenizer is None:
        return {}, ""

    def pieces(text: str) -> list[str]:
        text = tokenizer.normalizer.normalize_str(text) if tokenizer.normalizer else text
        return [piece for piece, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    letters = [c for c in map(chr, range(256)) if c.isalpha() and c.islower()]
    reads = {ord(c): got[0] for c in letters if len(got := pieces(c)) == 1}
    pairs = "".join(chr(a) + chr(b) for a in reads for b in reads)
    if pieces(pairs) != [pairs.translate(reads)]:
        return {}, ""
    return reads, "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and len(pieces(f"a{c}")) == len(pieces(f"a{c}{c}")) == 2)


def _marked(word: bytes) -> bool:
    return len(word) > 1 and word[-1] in MARKS and word[-2] < 128 and chr(word[-2]).isalnum()


def _split(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8")
    if b"<|" not in raw:  # special tokens are told by their case
        raw = raw.lower()
    # bytes.split takes ASCII white space only; whatever other space there is stays in a word, for the tokenizer
    return raw.split()


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The tokenizer's words, kept by the worker process from task to task."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(path), np.array([end_id], "<u4").tobytes()
        part, at = TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            raw = [ids + end for ids in words.texts(t.as_py() for t in batch.column(1))]
            n = np.array([len(r) // 4 for r in raw], np.int64)
            ends = np.cumsum(n)
            offsets = pa.array(np.append(0, ends).astype(np.int32))
            tokens = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(at + ends - n), pa.array(n), tokens],
                ["doc_id", "part", "local_start", "n_tokens", "tokens"],
            )
            at += int(n.sum())

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    doc_id: str = "doc_id",
    text: str = "text",
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_rows: int = PAGE_ROWS,
) -> None:
    """Encode every whole text of docs, append end_id, and write a token set to path.

    Null and empty texts are the end id alone; rows of equal doc_id stand side by side, in an order
    of their texts, and a null doc_id before all others; a very long text is one row like any other, of
    up to 2 ** 31 - 1 ids; an empty table gives an empty set; other columns, whatever their names, are not
    written. One shuffle, of the texts, by ranges of doc_id.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    encoded = (
        rows.repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .mapInArrow(
            _encode(tokenizer or default_tokenizer(), end_id),
            f"doc_id {kind}, part int, local_start long, n_tokens long, tokens array<int>",
        )
    )
    writer = (
        encoded.write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary", "true")
    )
    for column in ("doc_id", "local_start", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.parquet(f"{path}/data")
    # reads two columns of a few bytes a document; one row a part is left for the window
    sums = spark.read.parquet(f"{path}/data").groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = F.sum("part_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums.select("part", "part_tokens", F.coalesce(before, F.lit(0)).cast("long").alias("part_start")).coalesce(
        1
    ).write.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, tokens of a token set.

    parts has one row for each part, as many as the writing tasks, and is broadcast.
    """
    parts = F.broadcast(spark.read.parquet(f"{path}/parts").select("part", "part_start"))
    return (
        spark.read.parquet(f"{path}/data")
        .join(parts, "part")
        .select("doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "tokens")
    )


def with_crc32(tokens: DataFrame) -> DataFrame:
    """tokens (doc_id, start, n_tokens, tokens) with ids_crc32 in place of tokens."""
    keep = [c for c in tokens.columns if c != "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            values, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy().tolist()
            crc = [zlib.crc32(values[s:e].data) for s, e in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(crc, pa.int64())], [*keep, "ids_crc32"])

    ordered = tokens.select("tokens", *keep)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema.fields[1:])
    return ordered.mapInArrow(run, f"{fields}, ids_crc32 long")


def token_digest(docs: DataFrame, tag: str = "") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, of a token set written to the shared folder and read back."""
    path = scratch_path(docs.sparkSession, "tokens", tag)
    write_tokens(docs, path)
    return with_crc32(read_tokens(docs.sparkSession, path))
