"""Tar shards of samples as a data source, for batch and stream reads and for writes.

    spark.dataSource.register(TarSource)
    spark.read.format("tarshards").load(path)          shard, key, name, ext, data
    spark.read.format("tarshards").option("errors", "rows").load(path)          and error
    spark.readStream.format("tarshards").option("resample", seed).load(path)
    df.write.format("tarshards").option("per_shard", 5000).mode("overwrite").save(path)

A shard that is no tar file or ends too early gives the members before the fault. With "errors" as "rows" a row with
a null key then says what is wrong, with "fail" the read fails; by default a line on the task's standard output
does. Errors of the store are no faults of the shard: the task fails and is run again.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.batches import parts
from .readers import braces

#: Bytes that a task reads at most (a shard isn't divided) and, of small inputs, at least; tasks that small inputs are
#: divided among; what opening a file counts as; a block of a tar file.
TASK_BYTES, LEAST_BYTES, TASKS, OPEN_BYTES, BLOCK = 128 << 20, 1 << 20, 64, 1 << 14, 512

#: Bytes and members after which a reading task passes a batch on.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 10_000

SCHEMA = "shard string, key string, name string, ext string, data binary"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"/{path}")


def listed(path: str) -> list[tuple[str, int]]:
    """Tar files of a folder, a file, or a pattern with numeric ranges, with their sizes; ascending."""
    from pyarrow import fs

    found = []
    for p in braces(path):
        f, at = _fs(p)
        info = f.get_file_info(at)
        if info.type == fs.FileType.Directory:
            found += [(x.path, x.size) for x in f.get_file_info(fs.FileSelector(at)) if x.path.endswith(".tar")]
        elif info.type == fs.FileType.File:
            found.append((at, info.size))
    return sorted(found)


def shards(path: str) -> list[str]:
    return [p for p, _ in listed(path)]


def grouped(files: list[tuple[str, int]], most: int) -> list[list[str]]:
    """Files in their order, in groups of about `most` bytes; a file is read by one task."""
    out, size = [], 0
    for path, n in files:
        if not out or size + n + OPEN_BYTES > most:
            out.append([])
            size = 0
        out[-1].append(path)
        size += n + OPEN_BYTES
    return out


def split_name(name: str) -> tuple[str, str]:
    """Key and extension: before and after the first dot of the base name."""
    folder, _, base = name.rpartition("/")
    key, _, ext = base.partition(".")
    return (f"{folder}/{key}" if folder else key), ext


class _Tail(io.RawIOBase):
    """A stream that is read once, and its last bytes."""

    def __init__(self, raw):
        self.raw, self.last = raw, b""

    def read(self, n: int = -1) -> bytes:
        data = self.raw.read(n) if n >= 0 else self.raw.read()
        self.last = (self.last + data)[-BLOCK:]
        return data


def members(path: str, errors: str = "skip") -> Iterator[tuple]:
    """Members of a shard, one at a time; with errors as "rows" each with a last field, null but for faults."""
    f, at = _fs(path)
    more = (None,) if errors == "rows" else ()
    # an error of the store passes: only what tarfile says about the bytes is a fault of the shard
    with f.open_input_stream(at) as raw:
        tail = _Tail(raw)
        try:
            with tarfile.open(fileobj=tail, mode="r|") as tar:
                for m in tar:
                    if m.isfile():
                        key, ext = split_name(m.name)
                        yield (at, key, m.name, ext, tar.extractfile(m).read(), *more)
            while tail.read(1 << 20):
                pass
            if tail.last.strip(b"\0") or len(tail.last) < BLOCK:
                raise tarfile.ReadError("no end mark")
        except (tarfile.TarError, EOFError) as e:
            if errors == "fail":
                raise
            if errors == "rows":
                yield (at, None, None, None, None, f"{type(e).__name__}: {e}")
            else:
                print(f"{path}: {e}")


def in_batches(rows: Iterable[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of `members` as batches of about BATCH_BYTES, as data are of any size."""
    held: list[tuple] = []
    size = 0

    def passed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "data" else pa.string()) for n, c in zip(names, zip(*held, strict=True), strict=True)], names)

    for row in rows:
        held.append(row)
        size += len(row[4] or b"")
        if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
            yield passed()
            held.clear()
            size = 0
    if held:
        yield passed()


def columns(errors: str) -> list[str]:
    return [c.split()[0] for c in SCHEMA.split(", ")] + (["error"] if errors == "rows" else [])


@dataclass
class Shard(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    files: list


class TarReader(DataSourceReader):
    def __init__(self, path: str, errors: str, most: int):
        self.path, self.errors, self.most = path, errors, most

    def partitions(self):
        files = listed(self.path)
        # fewer bytes a task where there are few, so that all cores have some
        most = min(self.most, max(LEAST_BYTES, sum(n + OPEN_BYTES for _, n in files) // TASKS))
        return [Shard(g) for g in grouped(files, most)] or [Shard([])]

    def read(self, partition: Shard):
        yield from in_batches((m for path in partition.paths for m in members(path, self.errors)), columns(self.errors))


class TarStream(DataSourceStreamReader):
    """An endless stream: each micro-batch is some shards drawn with replacement, by offset and seed."""

    def __init__(self, path: str, seed: int, at_once: int, errors: str):
        self.path, self.seed, self.at_once, self.errors = path, seed, at_once, errors
        self.made = 0

    def initialOffset(self):
        return {"n": 0}

    def latestOffset(self):
        self.made += self.at_once
        return {"n": self.made}

    def partitions(self, start: dict, end: dict):
        import random

        known = shards(self.path)
        self.made = max(self.made, end["n"])
        return [Shard([random.Random(f"{self.seed}-{i}").choice(known)]) for i in range(start["n"], end["n"])] if known else []

    def read(self, partition: Shard):
        yield from in_batches((m for path in partition.paths for m in members(path, self.errors)), columns(self.errors))

    def commit(self, end: dict): ...


class TarWriter(DataSourceArrowWriter):
    """Rows with key and data (ext: data if there is none) become shards of at most per_shard keys; each
    task writes its own files under temporary names, which the commit puts in place. A row's shard, if
    it has a number for one, names its file; where a shard's rows came in several files (from several
    tasks, out of order, or of too many keys), each further one is named after its place among them. Overwriting
    replaces the tar files that were there, once all new ones are written."""

    def __init__(self, path: str, schema: StructType, per_shard: int, overwrite: bool):
        self.path, self.names, self.per_shard, self.overwrite = path, schema.names, per_shard, overwrite

    def write(self, iterator):
        from pyspark import TaskContext

        task = TaskContext.get()
        f, at = _fs(self.path)
        f.create_dir(at, recursive=True)
        files: list[tuple[str, str]] = []
        tar = out = last = here = None
        keys = 0
        for r in (r for part in parts(iterator) for r in part.to_pylist()):
            shard = str(r["shard"]) if r.get("shard") is not None and str(r["shard"]).isdigit() else None
            if r["key"] != last:
                keys, last = keys + 1, r["key"]
            if tar is None or keys > self.per_shard or shard != here:
                if tar:
                    tar.close()
                    out.close()
                here, keys = shard, 1
                name = f"{at}/{int(shard):06d}" if shard else f"{at}/{task.partitionId():06d}-{len(files):04d}"
                temp = f"{name}.{task.taskAttemptId()}-{len(files)}.tmp"
                files.append((temp, name))
                out = f.open_output_stream(temp)
                tar = tarfile.open(fileobj=out, mode="w|")
            info = tarfile.TarInfo(f"{r['key']}.{r.get('ext') or 'data'}")
            data = r["data"].encode() if isinstance(r["data"], str) else bytes(r["data"])
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
        if tar:
            tar.close()
            out.close()
        return Written(files)

    def commit(self, messages):
        from pyarrow import fs

        f, at = _fs(self.path)
        old = shards(self.path) if f.get_file_info(at).type == fs.FileType.Directory else []
        if self.overwrite:
            for path in old:
                f.delete_file(path)
            old = []
        used = {x.removesuffix(".tar") for x in old}
        following: dict[str, int] = {}
        for m in messages:
            for temp, name in m.files if m else []:
                free = name
                while free in used:
                    following[name] = following.get(name, 0) + 1
                    free = f"{name}-{following[name]:04d}"
                used.add(free)
                f.move(temp, f"{free}.tar")

    def abort(self, messages):
        from pyarrow import fs

        f, _ = _fs(self.path)
        for m in messages:
            for temp, _ in m.files if m else []:
                if f.get_file_info(temp).type == fs.FileType.File:
                    f.delete_file(temp)


class TarSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tarshards"

    def schema(self) -> str:
        return f"{SCHEMA}, error string" if self._errors() == "rows" else SCHEMA

    def _errors(self) -> str:
        errors = self.options.get("errors", "skip")
        if errors not in ("skip", "rows", "fail"):
            raise ValueError(f"errors is skip, rows or fail, not {errors}")
        return errors

    def reader(self, schema: StructType) -> TarReader:
        return TarReader(self.options["path"], self._errors(), int(self.options.get("bytes_per_task", TASK_BYTES)))

    def streamReader(self, schema: StructType) -> TarStream:
        return TarStream(self.options["path"], int(self.options.get("resample", 0)), int(self.options.get("shards_at_once", 1)), self._errors())

    def writer(self, schema: StructType, overwrite: bool) -> TarWriter:
        return TarWriter(self.options["path"], schema, int(self.options.get("per_shard", 5000)), overwrite)
