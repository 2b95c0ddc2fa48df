"""Token-ID output: Arrow files of fixed-size-list batches, and their zero-copy reader.

A file holds one stream of ids cut into rows of `length` ids (`input_ids`) with a validity
`mask`; every batch but the last has `rows` rows, so the batch, row and slot of an id follow
from its position alone and a memory-mapped file is read without copying.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.llm.common import documents, keyed_text, shared_folder, slices, stored, windows
from talus.llm.pieces import WINDOW, ByteEncoder

#: Ids in a row, and rows in a batch (4 MB of 16-bit ids).
LENGTH, ROWS = 2048, 1024
#: Appended to every document.
END_ID = 0

INDEX = "doc_id long, file string, part int, at long, n_tokens long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long, file string, at long"


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def id_type(vocabulary: int) -> pa.DataType:
    """The narrowest unsigned type that holds every id."""
    return pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()


def open_folder(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and path of a shared folder, also on remote stores that pyarrow knows."""
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class SequenceWriter:
    """Appends packed ids and writes whole batches of rows; holds one batch at most."""

    def __init__(self, sink, kind: pa.DataType, length: int = LENGTH, rows: int = ROWS):
        self.kind, self.length, self.rows = kind, length, rows
        self.schema = pa.schema(
            [("input_ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))],
            metadata={"length": str(length), "rows": str(rows)},
        )
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n = 0

    def append(self, ids: np.ndarray) -> int:
        """Add ids and return the position of the first."""
        at = self.n
        self.held.append(ids)
        self.n += len(ids)
        self.n_held += len(ids)
        if self.n_held >= self.length * self.rows:
            self._flush(last=False)
        return at

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, self.kind.to_pandas_dtype())
        whole = self.length * self.rows
        while len(ids) >= whole:
            self._write(ids[:whole], whole)
            ids = ids[whole:]
        if last and len(ids):
            n = len(ids)
            room = -(-n // self.length) * self.length
            self._write(np.concatenate([ids, np.zeros(room - n, ids.dtype)]), n)
            ids = ids[:0]
        self.held, self.n_held = [ids.copy()], len(ids)

    def _write(self, ids: np.ndarray, n_valid: int) -> None:
        mask = pa.array(np.arange(len(ids)) < n_valid)
        lists = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(ids, self.kind), mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        self._flush(last=True)
        self.writer.close()


class SequenceReader:
    """Random access to rows and to ranges of ids; whole batches are views of the mapped file."""

    def __init__(self, uri: str):
        fs, path = open_folder(uri)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        meta = self.file.schema.metadata
        self.length, self.rows = int(meta[b"length"]), int(meta[b"rows"])
        self.number, self.ids = -1, np.empty(0)

    def _batch(self, k: int) -> np.ndarray:
        if k != self.number:
            column = self.file.get_batch(k).column(0)
            self.number, self.ids = k, column.flatten().to_numpy(zero_copy_only=True)
        return self.ids

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of row k."""
        batch = self.file.get_batch(k // self.rows)
        r = k % self.rows
        ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)[r * self.length : (r + 1) * self.length]
        mask = batch.column(1).flatten().slice(r * self.length, self.length).to_numpy(zero_copy_only=False)
        return ids, mask

    def range(self, at: int, n: int):
        """The ids at [at, at + n), batch by batch."""
        whole = self.length * self.rows
        while n > 0:
            k, slot = divmod(at, whole)
            part = self._batch(k)[slot : slot + n]
            yield part
            at, n = at + len(part), n - len(part)

    def close(self) -> None:
        self.number, self.ids, self.file = -1, np.empty(0), None
        self.source.close()


_ENCODERS: dict[tuple[str, str], ByteEncoder] = {}


def _encoder(path: str, dtype: str) -> ByteEncoder:
    if (path, dtype) not in _ENCODERS:
        _ENCODERS[path, dtype] = ByteEncoder(path, dtype)
    return _ENCODERS[path, dtype]


def write_token_files(
    docs: DataFrame, folder: str, path: Callable[[], str] = _default_path, end_id: int = END_ID, length: int = LENGTH, rows: int = ROWS
) -> DataFrame:
    """Encode all texts into files under `folder`, in ascending id order over the files; returns their stored index.

    One index row per input row: null text gives the end id alone, null ids come first, repeated
    rows repeat (equal ids in any order), an empty table gives no file and no row.  Each task
    writes under a name of its own and renames at the end; the index names only files of tasks
    that Spark committed, so a lost executor or a second attempt leaves no half-read file behind.
    """

    def run(batches):
        tokenizer_path = path()
        from talus.llm.pieces import library_tokenizer

        key = ("size", tokenizer_path)
        if key not in _SIZES:
            _SIZES[key] = library_tokenizer(tokenizer_path).get_vocab_size()
        kind = id_type(_SIZES[key])
        dtype = np.dtype(kind.to_pandas_dtype()).newbyteorder("<")
        encoder = _encoder(tokenizer_path, dtype.str)
        end = np.array([end_id], dtype=dtype).tobytes()
        part = TaskContext.get().partitionId()
        fs, top = open_folder(folder)
        fs.create_dir(top, recursive=True)
        name = f"ids-{part:06d}-{uuid.uuid4().hex}.arrow"
        sink = writer = None
        try:
            for batch in slices(windows(batches, WINDOW), limit=WINDOW):
                if writer is None:
                    sink = fs.open_output_stream(f"{top}/.{name}")
                    writer = SequenceWriter(sink, kind, length, rows)
                at, n = [], []
                for packed in encoder.encode(batch.column(1).to_pylist()):
                    ids = np.frombuffer(packed + end, dtype=dtype)
                    at.append(writer.append(ids))
                    n.append(len(ids))
                size = batch.num_rows
                columns = [batch.column(0), pa.array([f"{folder}/{name}"] * size), pa.array([part] * size, pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "file", "part", "at", "n_tokens"])
        finally:
            if writer is not None:
                writer.close()
                sink.close()
        if writer is not None:
            fs.move(f"{top}/.{name}", f"{top}/{name}")

    # Rows that share an id are told apart by their texts, so that they need not meet in one file.
    place = ["doc_id", F.xxhash64("text")]
    ordered = keyed_text(docs).repartitionByRange(*place).sortWithinPartitions(*place)
    return stored(ordered.mapInArrow(run, INDEX), "token-index")


_SIZES: dict = {}


def read_token_files(index: DataFrame) -> DataFrame:
    """Read every document's ids back through the files: start over all files, length and CRC-32."""
    files = index.groupBy("file", "part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a file: its window runs over as many rows as there were tasks, never over documents.
    bases = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = index.join(bases, "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "file", "at")

    def run(batches):
        reader, name = None, None
        for batch in batches:
            crcs = []
            for file, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "n_tokens"))):
                if file != name:
                    if reader:
                        reader.close()
                    reader, name = SequenceReader(file), file
                crc = 0
                for ids in reader.range(at, n):
                    crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                crcs.append(crc)
            columns = [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crcs, pa.int64()), batch.column("file"), batch.column("at")]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "file", "at"])
        if reader:
            reader.close()

    return placed.mapInArrow(run, RESULT)


def token_files(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the files and read them back; see `write_token_files` for nulls, repeats and empty tables."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/token-ids-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(docs, folder, **options))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir)).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op4_token_files": op4_token_files}
ORACLES: dict[str, str] = {}
