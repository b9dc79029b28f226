"""Token-id files: a concatenated id array with Elias-Fano encoded document boundaries.

A file holds consecutive documents in ascending (doc_id, tie) order, FILE_IDS ids or FILE_DOCS
documents, whichever it reaches first:

    ids         n_tokens ids, 2 bytes each if the vocabulary allows, else 4, little-endian
    ends        Elias-Fano sequence of the documents' end offsets
    doc_ids     Elias-Fano sequence of doc_id - first_doc_id (null doc_ids, which come first, are counted)
    tail        16 longs that say where all this is, then the magic word

An Elias-Fano sequence of n values below u takes about n * (2 + log2(u / n)) bits: the low
log2(u / n) bits stand in a packed array, the rest is unary coded in a bit vector. `select` finds
the i-th one through a stored directory: ones before every super-block of 64 blocks (32 bits each)
and, from there on, before every block of 64 bytes (16 bits each). The value at an index costs two
binary searches and one block, and neither writer nor reader holds a table of 64-bit offsets.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, new_path, written
from .tokens import END_ID, default_vocab, pieces

MAGIC = b"CLTOKEF2"
TAIL_LONGS = 16
#: Bytes of a block of the bit vector, and blocks of a super-block (so that counts in it fit 16 bits).
BLOCK, BLOCKS = 64, 64
#: A file is closed when it holds so many ids or documents; ends then fit 32 bits, as no text has 2^31.
FILE_IDS, FILE_DOCS = 1 << 25, 1 << 20
#: Ids and documents that a reader holds at once.
IDS_AT_ONCE, DOCS_AT_ONCE = 1 << 20, 1 << 12


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit integers."""

    def __init__(self, n: int, low_bits: int, lows: np.ndarray, highs: np.ndarray, supers: np.ndarray, steps: np.ndarray):
        self.n, self.low_bits, self.lows, self.highs, self.supers, self.steps = n, low_bits, lows, highs, supers, steps

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        """values: of any unsigned type, read in chunks."""
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = min(63, max(0, (top // max(n, 1)).bit_length() - 1))
        lows = np.zeros((n * low_bits + 7) // 8, np.uint8)
        size = (int(values[-1]) >> low_bits) + n if n else 0
        highs = np.zeros((size + 7) // 8, np.uint8)
        last = 0
        for i in range(0, n, 8192):  # a multiple of 8, so chunks' low bits end at whole bytes
            v = np.asarray(values[i : i + 8192]).astype(np.uint64)
            if int(v[0]) < last or (v[1:] < v[:-1]).any():
                raise ValueError("values must not decrease")
            last = int(v[-1])
            bits = np.empty((len(v), low_bits), np.uint8)
            for k in range(low_bits):
                bits[:, k] = (v >> np.uint64(k)) & np.uint64(1)
            packed = np.packbits(bits.ravel(), bitorder="little")
            lows[i * low_bits // 8 : i * low_bits // 8 + len(packed)] = packed
            at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(i, i + len(v))
            np.bitwise_or.at(highs, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        ones = np.bitwise_count(np.pad(highs, (0, -len(highs) % (BLOCK * BLOCKS))).reshape(-1, BLOCKS, BLOCK)).sum(2, dtype=np.uint32)
        supers = np.concatenate([[0], np.cumsum(ones.sum(1))])[:-1].astype("<u4")
        steps = (np.cumsum(ones, axis=1) - ones).astype("<u2").ravel()
        return cls(n, low_bits, lows, highs, supers, steps)

    def select(self, i: np.ndarray) -> np.ndarray:
        """The values at the indexes i."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        if len(i) == 0:
            return np.zeros(0, np.uint64)
        if i.min() < 0 or i.max() >= self.n:
            raise IndexError("no such index")
        pos = np.empty(len(i), np.int64)
        above = np.searchsorted(self.supers, i, side="right") - 1
        for s in np.unique(above):
            there = np.flatnonzero(above == s)
            rest = i[there] - int(self.supers[s])
            steps = self.steps[s * BLOCKS : (s + 1) * BLOCKS]
            block = np.searchsorted(steps, rest, side="right") - 1
            for b in np.unique(block):
                of = block == b
                start = (int(s) * BLOCKS + int(b)) * BLOCK
                bits = np.flatnonzero(np.unpackbits(self.highs[start : start + BLOCK], bitorder="little"))
                pos[there[of]] = start * 8 + bits[rest[of] - int(steps[b])]
        out = (pos - i).astype(np.uint64) << np.uint64(self.low_bits)
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            out |= ((self.lows[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(k)
        return out

    def bytes(self) -> bytes:
        return b"".join(x.tobytes() for x in (self.lows, self.highs, self.supers, self.steps))

    def shape(self) -> list[int]:
        return [self.n, self.low_bits, len(self.lows), len(self.highs), len(self.supers)]

    @classmethod
    def read(cls, raw: bytes, n: int, low_bits: int, lows: int, highs: int, supers: int) -> EliasFano:
        at = np.cumsum([0, lows, highs, 4 * supers, 2 * BLOCKS * supers]).tolist()
        parts = [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
        return cls(n, low_bits, *(np.frombuffer(x, t) for x, t in zip(parts, (np.uint8, np.uint8, "<u4", "<u2"), strict=True)))

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.lows, self.highs, self.supers, self.steps))


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Writer:
    """One file: ids are streamed out; ends (32 bits each) and doc_ids are kept until close()."""

    def __init__(self, path: str, width: int):
        self.fs, self.path = _files(path)
        self.width, self.n_tokens, self.n_null = width, 0, 0
        self.ends, self.doc_ids = array("I"), array("q")
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temp = f"{self.path}.{np.random.default_rng().integers(1 << 62):x}.tmp"
        self.out = self.fs.open_output_stream(self.temp)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.out.write(ids.astype("<u2" if self.width == 2 else "<u4").tobytes())
        self.n_tokens += len(ids)
        self.ends.append(self.n_tokens)
        if doc_id is None:
            self.n_null += 1
        else:
            self.doc_ids.append(doc_id)

    @property
    def full(self) -> bool:
        return self.n_tokens >= FILE_IDS or len(self.ends) >= FILE_DOCS

    def close(self) -> None:
        """Puts the file in place under its name at once; a second attempt of a task replaces it by the same."""
        ends = EliasFano.encode(np.frombuffer(self.ends, np.uint32))
        first = self.doc_ids[0] if self.doc_ids else 0
        # differences of signed longs wrap to the unsigned ones meant, however far apart they are
        docs = EliasFano.encode(np.frombuffer(self.doc_ids, np.int64).view(np.uint64) - np.array(first, np.int64).view(np.uint64))
        self.out.write(ends.bytes() + docs.bytes())
        tail = [self.width, self.n_tokens, self.n_null, first, *ends.shape(), *docs.shape()]
        self.out.write(np.array(tail + [0] * (TAIL_LONGS - len(tail)), "<i8").tobytes() + MAGIC)
        self.out.close()
        self.fs.move(self.temp, self.path)


class Reader:
    """Random access to the documents of a file."""

    def __init__(self, path: str):
        fs, at = _files(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        tail = self.file.read_at(TAIL_LONGS * 8 + 8, size - TAIL_LONGS * 8 - 8)
        if tail[-8:] != MAGIC:
            raise ValueError(f"{path} isn't a token file")
        t = [int(x) for x in np.frombuffer(tail[:-8], "<i8")]
        self.width, self.n_tokens, self.n_null, self.first = t[:4]
        body = self.width * self.n_tokens
        raw = self.file.read_at(size - len(tail) - body, body)
        self.ends = EliasFano.read(raw, *t[4:9])
        self.docs = EliasFano.read(raw[self.ends.nbytes :], *t[9:14])
        self.n_docs = self.ends.n

    def bounds(self, i: int) -> tuple[int, int]:
        """Where document i starts and ends in the id array."""
        return (int(self.ends.select(i - 1)[0]) if i else 0), int(self.ends.select(i)[0])

    def ids(self, start: int, end: int) -> np.ndarray:
        raw = self.file.read_at((end - start) * self.width, start * self.width)
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4").astype(np.uint32)

    def names(self, i: int, j: int) -> list[int | None]:
        """doc_ids of documents i to j - 1."""
        null = max(0, min(j, self.n_null) - i)
        known = self.docs.select(np.arange(max(i, self.n_null), max(j, self.n_null)) - self.n_null)
        return [None] * null + (known + np.array(self.first, np.int64).view(np.uint64)).view(np.int64).tolist()

    def spans(self) -> Iterator[tuple[list[int | None], np.ndarray]]:
        """doc_ids and bounds (one more) of DOCS_AT_ONCE documents, by select."""
        start = 0
        for i in range(0, self.n_docs, DOCS_AT_ONCE):
            j = min(self.n_docs, i + DOCS_AT_ONCE)
            at = np.concatenate([[start], self.ends.select(np.arange(i, j)).astype(np.int64)])
            yield self.names(i, j), at
            start = int(at[-1])

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids), one document in memory."""
        for names, at in self.spans():
            for name, a, b in zip(names, at[:-1].tolist(), at[1:].tolist(), strict=True):
                yield name, a, self.ids(a, b)

    def digests(self) -> Iterator[tuple[list[int | None], np.ndarray, list[int]]]:
        """Per DOCS_AT_ONCE documents doc_ids, bounds and the crc32 of each one's 32-bit ids, IDS_AT_ONCE in memory."""
        for names, at in self.spans():
            crc = [0] * len(names)
            k = 0
            for a in range(int(at[0]), int(at[-1]), IDS_AT_ONCE):
                b = min(int(at[-1]), a + IDS_AT_ONCE)
                raw = memoryview(self.ids(a, b).astype("<u4").tobytes())
                while k < len(names) and at[k] < b:
                    x, y = max(int(at[k]), a), min(int(at[k + 1]), b)
                    crc[k] = zlib.crc32(raw[4 * (x - a) : 4 * (y - a)], crc[k])
                    if at[k + 1] > b:  # goes on in the next part
                        break
                    k += 1
            yield names, at, crc


MANIFEST = "part int, no int, file string, docs long, tokens long"


def write_token_files(docs: DataFrame, path: str, vocab: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encodes every text of docs (doc_id, text), appends end_id, and writes files under path.

    Rows are range-partitioned and sorted by (doc_id, hash of the text), nulls first, so the files
    in order are one array over all documents. Null and empty texts give just end_id; repeated rows
    are documents of their own; any doc_id of 64 bits will do; other columns are ignored. An empty
    table gives no files. Returns the manifest: no (order of the file, from 0), file, docs, tokens
    and start (tokens of the files before).
    """
    vocab = vocab or default_vocab()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache, out, no = pieces(vocab), None, 0
        width = 2 if max(cache.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        part = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([no], pa.int32()), pa.array([f"{path}/tokens-{part:06d}-{no:04d}.cltok"]), pa.array([len(out.ends)]), pa.array([out.n_tokens])], ["part", "no", "file", "docs", "tokens"])

        for b in lean(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                out = out or Writer(f"{path}/tokens-{part:06d}-{no:04d}.cltok", width)
                out.add(doc_id, np.frombuffer(cache.ids(text.as_py()) + end, "<u4"))
                if out.full:
                    yield closed()
                    out, no = None, no + 1
        if out:
            yield closed()

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    made = written(rows.mapInArrow(write, MANIFEST), "manifest")
    sums, base = [], (0, 0)  # one row a partition
    for r in made.groupBy("part").agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens")).orderBy("part").collect():
        sums.append((r.part, *base))
        base = base[0] + r.files, base[1] + r.tokens
    before = spark.createDataFrame(sums, "part int, files long, before long")
    placed = made.join(F.broadcast(before), "part")
    placed = placed.alias("m").join(made.select("part", F.col("no").alias("o"), F.col("tokens").alias("t")).alias("e"), (F.col("m.part") == F.col("e.part")) & (F.col("o") < F.col("no")), "left")
    placed = placed.groupBy("m.part", "no", "file", "docs", "tokens", "files", "before").agg(F.coalesce(F.sum("t"), F.lit(0)).alias("within"))
    return placed.select((F.col("files") + F.col("no")).alias("no"), "file", "docs", "tokens", (F.col("before") + F.col("within")).alias("start"))


READ = "doc_id long, start long, n_tokens long, ids_crc32 long, file string, file_start long"


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (over all files), n_tokens, ids_crc32, file, file_start; one task a file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for names, at, crc in Reader(name).digests():
                    cols = [pa.array(names, pa.int64()), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array([name] * len(names)), pa.array(at[:-1])]
                    yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in READ.split(", ")])

    files = manifest.count()
    return manifest.repartitionById(max(1, files), F.col("no").cast("int")).select("file", "start").mapInArrow(read, READ)


def token_binary(docs: DataFrame, path: str | None = None, vocab: str | None = None) -> DataFrame:
    """Writes the token files of docs and returns what reading them back gives (see read_token_files)."""
    return read_token_files(write_token_files(docs, path or new_path(docs.sparkSession, "tokens"), vocab))
