"""A set of record files as a data source with a commit: ``spark.read.format("records")`` and ``df.write.format("records")``.

Each task writes a file of its own under a name that no reader looks at, and says what it wrote. The commit moves the files in and then writes the manifest, which names
every file with its rows and its SHA-256; an abort removes them. A reader plans a partition a file of the manifest and checks its hash, so it
sees a whole write or none, whatever tasks were killed, repeated or run twice.

Options: ``path``; ``form``, json (a JSON object a line; default) or csv (with a header, all columns as text); ``columns``, the csv's columns in their order; ``empty``, what stands for null in
a csv. JSON has no NaN: a row with one fails its task. The folder must be one that all machines share.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST, WAITING = "_manifest.json", "_waiting"


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _plain(v):
    """A row's value as JSON has it."""
    if isinstance(v, float) and not math.isfinite(v):
        raise ValueError("JSON has no NaN or infinity")
    if hasattr(v, "asDict"):
        return {k: _plain(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v if v is None or isinstance(v, (bool, int, float, str)) else str(v)


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int
    sha256: str


@dataclass
class FilePartition(InputPartition):
    name: str
    sha256: str


class RecordWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        self.path, self.form, self.empty = options["path"], options.get("form", "json"), options.get("empty", "")
        self.columns = options["columns"].split(",") if options.get("columns") else schema.names
        self.schema, self.overwrite, self.write_id = schema, overwrite, uuid.uuid4().hex
        if missing := set(self.columns) - set(schema.names):
            raise ValueError(f"no columns {', '.join(sorted(missing))}")

    def write(self, iterator: Iterator) -> Written:
        files, path = _files(self.path)
        context = TaskContext.get()
        name = f"{WAITING}/{self.write_id}/part-{context.partitionId():05}-{context.attemptNumber()}"
        files.create_dir(f"{path}/{WAITING}/{self.write_id}", recursive=True)
        rows, digest = 0, hashlib.sha256()
        with files.open_output_stream(f"{path}/{name}") as out:
            for row in iterator:
                if self.form == "csv":
                    line = io.StringIO()
                    csv.writer(line, lineterminator="\n").writerow([self.empty if row[c] is None else row[c] for c in self.columns])
                    data = line.getvalue().encode()
                else:
                    data = (json.dumps(_plain(row), allow_nan=False, sort_keys=True) + "\n").encode()
                digest.update(data)
                out.write(data)
                rows += 1
        return Written(name, rows, digest.hexdigest())

    def commit(self, messages: list) -> None:
        files, path = _files(self.path)
        old = _manifest(self.path)
        kept = [] if self.overwrite or old is None else old["files"]
        new = []
        for m in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.name):
            name = f"part-{self.write_id}-{m.name.rsplit('/', 1)[1].split('-')[1]}"
            files.move(f"{path}/{m.name}", f"{path}/{name}")
            new.append({"name": name, "rows": m.rows, "sha256": m.sha256})
        state = {"status": "complete", "form": self.form, "columns": self.columns, "schema": self.schema.jsonValue(), "files": kept + new, "rows": sum(f["rows"] for f in kept + new)}
        files.create_dir(path, recursive=True)
        with files.open_output_stream(f"{path}/{MANIFEST}.{self.write_id}") as out:
            out.write(json.dumps(state, allow_nan=False, indent=1).encode())
        files.move(f"{path}/{MANIFEST}.{self.write_id}", f"{path}/{MANIFEST}")  # from here on the write is seen
        for f in (old or {"files": []})["files"] if self.overwrite else []:
            files.delete_file(f"{path}/{f['name']}")
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        files, path = _files(self.path)
        waiting = f"{path}/{WAITING}/{self.write_id}"
        if files.get_file_info(waiting).type != fs.FileType.NotFound:
            files.delete_dir(waiting)


def _manifest(path: str) -> dict | None:
    from pyarrow import fs

    files, at = _files(path)
    if files.get_file_info(f"{at}/{MANIFEST}").type == fs.FileType.NotFound:
        return None
    with files.open_input_stream(f"{at}/{MANIFEST}") as f:
        return json.loads(f.read())


class RecordReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.schema = options["path"], schema
        state = _manifest(self.path)
        if state is None:
            raise FileNotFoundError(f"{self.path} has no {MANIFEST}: nothing was committed there")
        self.form, self.columns, self.files, self.empty = state["form"], state["columns"], state["files"], options.get("empty", "")

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(f["name"], f["sha256"]) for f in self.files]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        if partition is None or not getattr(partition, "name", None):
            return
        files, path = _files(self.path)
        with files.open_input_stream(f"{path}/{partition.name}") as f:
            data = f.read()
        if hashlib.sha256(data).hexdigest() != partition.sha256:
            raise ValueError(f"{partition.name} is not what was committed")
        if self.form == "csv":
            for row in csv.reader(io.StringIO(data.decode(), newline="")):
                own = dict(zip(self.columns, row, strict=True))
                yield tuple(None if own.get(c) in (None, self.empty) else own[c] for c in self.schema.names)
        else:
            for line in data.decode().split("\n"):
                if line:
                    own = json.loads(line)
                    yield tuple(own.get(c) for c in self.schema.names)


class Records(DataSource):
    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> StructType | str:
        state = _manifest(self.options["path"])
        if state is None:
            raise FileNotFoundError(f"{self.options['path']} has no {MANIFEST}: nothing was committed there")
        if state["form"] == "csv":
            return ", ".join(f"`{c}` string" for c in state["columns"])
        return StructType.fromJson(state["schema"])

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Records)
