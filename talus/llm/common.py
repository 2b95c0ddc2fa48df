"""Shared plumbing of the corpus operators: tables, shared storage, byte-bounded batches."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.session import shared_folder

#: Texts handed to one inner step of an Arrow function, in UTF-8 bytes.
STEP_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), under fixed names, whatever else the table holds."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    schema = df.schema
    del df
    # Spark drops shuffle files when their owner is collected on the driver: say so now that they are done with.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


#: Rows of the heavy side of `split_join` at most, and rows of a key up to which it is never heavy.
HEAVY, LIGHT = 20_000, 1000


def split_join(left: DataFrame, right: DataFrame, on: list[str], weight: str) -> DataFrame:
    """Inner join by equal columns whose task sizes do not follow the most frequent key.

    `right` is a stored table with one row a key, whose column `weight` (not returned) tells the
    rows of `left` with that key.  Keys of over `LIGHT` rows that hold over 1 in `HEAVY` of all
    rows, which can be no more than `HEAVY` keys, are broadcast; all others are joined by a shuffle.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    limit = max(LIGHT, total // HEAVY)
    heavy, light = right.where(F.col(weight) > limit).drop(weight), right.where(F.col(weight) <= limit).drop(weight)
    if not heavy.limit(1).count():
        return left.join(light, on)
    rest = left.join(F.broadcast(heavy.select(*on)), on, "left_anti")
    return left.join(F.broadcast(heavy), on).unionByName(rest.join(light, on))


def unused(df: DataFrame, *bases: str) -> list[str]:
    """A name for each base that no column of `df` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for base in bases:
        name = base
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def windows(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Join record batches up to about `limit` bytes, whatever number of rows a session hands over at a time."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > limit:
            yield pa.concat_batches(held) if len(held) > 1 else held[0]
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


def by_bytes(texts: list[str], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs [a, b) of about `limit` characters, at least one text each."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def give_back() -> None:
    """Return free memory to the system: a worker outlives its task, and what its allocators hold back would add
    to what the next task needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches by the bytes of one string or binary column, so that peak memory follows bytes, not rows."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        if batch.nbytes <= limit:
            yield batch
            continue
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        a, size = 0, 0
        for i, s in enumerate(sizes):
            s = s or 0
            if size and size + s > limit:
                yield batch.slice(a, i - a)
                a, size = i, 0
            size += s
        yield batch.slice(a)
    give_back()
