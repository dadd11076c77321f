"""NPZ archives as a data source: a table of named runs, an archive for each, columns in one or two roots.

Writing: rows (name, columns) come sorted by name within partitions, and all rows of a name in one. A task
writes each archive under a name of its own attempt and tells its rows and SHA-256 in its commit message; the
driver's commit moves nothing but names the archives of the attempts that count in `manifest.json`, which is
written last. Until then there is no table; whatever failed attempts left is in no manifest. Columns of the
option `hidden` go to archives of the root `hidden_path` under the same manifest, whose public side tells
only their hashes: both roots become visible together.

Reading: a partition for each (archive, range of rows), of the columns asked for only. With `verify` an archive is
opened whole first: its hash, members and their lengths must be the manifest's, or the error names it.
"""

from __future__ import annotations

import hashlib
import io
import json
import sys
import uuid
import zipfile
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "manifest.json"
#: Rows of a partition.
ROWS = 1 << 20

# workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _place(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path.rstrip("/")
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].strip("/")
    return fs.FileSystem.from_uri(path.rstrip("/"))


def _bytes(path: str) -> bytes:
    where, at = _place(path)
    with where.open_input_file(at) as f:
        return f.read()


def _save(path: str, data: bytes) -> None:
    where, at = _place(path)
    where.create_dir(at.rpartition("/")[0], recursive=True)
    with where.open_output_stream(at) as f:
        f.write(data)


class Rows(InputPartition):
    def __init__(self, entry: dict, start: int, stop: int) -> None:
        self.entry, self.start, self.stop = entry, start, stop


class Written(WriterCommitMessage):
    def __init__(self, entries: list[dict]) -> None:
        self.entries = entries


class NpzReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.options, self.schema = options, schema

    def partitions(self) -> list[InputPartition]:
        told = json.loads(_bytes(f"{self.options['path']}/{MANIFEST}"))
        rows = int(self.options.get("rows", ROWS))
        return [Rows(e, at, min(at + rows, e["rows"])) for e in told["archives"] for at in range(0, e["rows"], rows)] or [Rows({}, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        e = partition.entry
        if not e:
            return
        names = [f.name for f in self.schema.fields]
        verify = self.options.get("verify", "false").lower() == "true"
        columns: dict[str, np.ndarray] = {}
        for root, file, digest, members in ((self.options["path"], e["file"], e["sha256"], e["columns"]), (self.options.get("hidden_path"), e.get("hidden_file"), e.get("hidden_sha256"), e.get("hidden_columns", []))):
            wanted = [c for c in members if c in names]
            if not root or not file or not wanted and not (verify and partition.start == 0):
                continue
            data = _bytes(f"{root}/{file}")
            try:
                if verify and hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError("its hash is not the manifest's")
                with np.load(io.BytesIO(data), allow_pickle=False) as archive:
                    for c in members if verify else wanted:
                        found = archive[c]
                        if found.shape != (e["rows"],):
                            raise ValueError(f"member {c} has shape {found.shape}, not ({e['rows']},)")
                        columns[c] = found
            except (ValueError, KeyError, OSError, EOFError, zipfile.BadZipFile) as problem:
                raise ValueError(f"{root}/{file}: {problem}") from problem
        size = partition.stop - partition.start
        out = []
        for f in self.schema.fields:
            if f.name == "name":
                out.append(pa.array([e["name"]] * size, pa.string()))
            elif f.name in columns:
                x = columns[f.name][partition.start : partition.stop]
                out.append(pa.array(x, from_pandas=x.dtype.kind == "f"))  # NaN stands for a missing number
            else:
                out.append(pa.nulls(size))
        from pyspark.sql.pandas.types import to_arrow_type

        yield pa.RecordBatch.from_arrays([x.cast(to_arrow_type(f.dataType)) for x, f in zip(out, self.schema.fields, strict=True)], names)


class NpzWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.options, self.names = options, [f.name for f in schema.fields]
        self.hidden = [c.strip() for c in options.get("hidden", "").split(",") if c.strip()]

    def write(self, iterator) -> Written:
        attempt, entries = uuid.uuid4().hex, []
        for k, (name, rows) in enumerate(groupby(iterator, lambda r: r["name"])):
            own = list(rows)
            entry = {"name": name, "rows": len(own)}
            columns = [c for c in self.names if c != "name"]
            for prefix, root, some in (("", self.options["path"], [c for c in columns if c not in self.hidden]), ("hidden_", self.options.get("hidden_path"), [c for c in columns if c in self.hidden])):
                if prefix and not some:
                    continue
                data = io.BytesIO()
                np.savez(data, **{c: np.array([np.nan if r[c] is None else r[c] for r in own]) for c in some})
                file = f"part-{attempt}-{k}.npz"
                _save(f"{root}/{file}", data.getvalue())
                entry |= {f"{prefix}file": file, f"{prefix}sha256": hashlib.sha256(data.getvalue()).hexdigest(), f"{prefix}columns": some}
            entries.append(entry)
        return Written(entries)

    def commit(self, messages: list[Written | None]) -> None:
        entries = sorted((e for m in messages if m for e in m.entries), key=lambda e: str(e["name"]))
        if len({e["name"] for e in entries}) < len(entries):
            raise ValueError("a name's rows came in several partitions or places: sort them by name")
        where, at = _place(self.options["path"])
        if where.get_file_info(f"{at}/{MANIFEST}").is_file:
            raise ValueError(f"{self.options['path']} is written already")
        _save(f"{self.options['path']}/{MANIFEST}", json.dumps({"archives": entries}, sort_keys=True).encode())

    def abort(self, messages: list[Written | None]) -> None:
        for e in (e for m in messages if m for e in m.entries):
            for root, file in ((self.options["path"], e["file"]), (self.options.get("hidden_path"), e.get("hidden_file"))):
                if root and file:
                    where, at = _place(f"{root}/{file}")
                    where.delete_file(at)


class NpzSource(DataSource):
    """Format `npz`; options path, hidden, hidden_path, rows, verify."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        raise ValueError("give a schema: an archive tells no SQL types")

    def reader(self, schema: StructType) -> DataSourceReader:
        return NpzReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("archives are written once")
        if "name" not in [f.name for f in schema.fields]:
            raise ValueError("a column `name` tells the archives apart")
        return NpzWriter(dict(self.options), schema)


def write_archives(df, path: str, hidden: tuple[str, ...] = (), hidden_path: str | None = None) -> None:
    """df (name, numeric columns) as archives; rows of a name keep no order but by time, if there is such a column."""
    df.sparkSession.dataSource.register(NpzSource)
    out = df.repartition("name").sortWithinPartitions("name", *[c for c in df.columns if c == "time"])
    how = out.write.format("npz").mode("append").option("path", path)
    if hidden:
        how = how.option("hidden", ",".join(hidden)).option("hidden_path", hidden_path)
    how.save()


def read_archives(spark, path: str, schema: str, hidden_path: str | None = None, rows: int = ROWS, verify: bool = False):
    """The columns of schema; those that no archive at hand holds are null."""
    spark.dataSource.register(NpzSource)
    how = spark.read.format("npz").schema(schema).option("path", path).option("rows", rows).option("verify", str(verify).lower())
    return (how.option("hidden_path", hidden_path) if hidden_path else how).load()
