"""Removal of byte strings that occur more than once, by suffix arrays of shards.

A string of `width` bytes is sent to the shard that the least hash among its `anchor`-byte
substrings picks (its minimizer), so equal strings meet whatever document and place they are
in.  Neighbouring strings with one minimizer travel together as a segment.  Minimizers that
occur once need no comparison; equal segments of a minimizer are counted, not expanded; the
different segments of a minimizer go to one shard, whose suffix array finds the repeated
strings.  Where a minimizer has more different segments than a shard shall hold, its segments
are cut anew by the minimizers of longer anchors, until groups fit; the last anchor is the
string itself, whose group is one segment.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import documents, give_back, slices, split_join, stored, unused
from talus.llm.suffix_array import repeated_windows

#: Bytes of a string, and of the substrings whose least hash picks its shard: at first, and for groups too large.
WIDTH, ANCHORS = 200, (64, 136, 176, 192, 200)
#: Bytes of segments in a shard, about; different segments of a minimizer up to which they are one group.
SHARD_BYTES, CROWD = 1 << 19, 2000
#: Window starts hashed at a time.
STEP = 1 << 17

_ODD = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        step = [np.full(max(n, 2 * STEP), x, np.uint64) for x in (_ODD, pow(_ODD, -1, 1 << 64))]
        _POWERS[:] = [np.cumprod(x) for x in step]
    return _POWERS[0][:n], _POWERS[1][:n]


def minimizers(data: np.ndarray, width: int = WIDTH, anchor: int = ANCHORS[0]) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a string of `width` bytes the least hash of its `anchor`-byte substrings,
    and whether the first of these has it."""
    n = len(data)
    if n < width:
        return np.empty(0, np.uint64), np.empty(0, bool)
    up, down = _powers(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)])
    x = (sums[anchor:] - sums[:-anchor]) * down[: n - anchor + 1]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    own = x
    span, reach = width - anchor + 1, 1
    while 2 * reach <= span:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    if reach < span:
        more = span - reach
        x = np.minimum(x[: len(x) - more], x[more:])
    return x, own[: len(x)] == x


def _pieces(texts: list[bytes], width: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Batches of (text, offset, bytes) of about `STEP` bytes; long texts are cut so that every start is in one piece."""
    batch, size = [], 0
    for k, t in enumerate(texts):
        for a in range(0, max(len(t) - width + 1, 0), STEP):
            part = t[a : a + STEP + width - 1]
            batch.append((k, a, part))
            size += len(part)
            if size >= STEP:
                yield batch
                batch, size = [], 0
    if batch:
        yield batch


def segments(texts: list[bytes], width: int = WIDTH, anchor: int = ANCHORS[0]) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (text, start, number of strings, minimizer, digest) of all runs of strings with one minimizer.

    The leftmost place of the least hash is the same for a whole run, so two equal strings are
    never of one run, not even in periodic text.
    """
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    for batch in _pieces(texts, width):
        joined = b"".join(p for _, _, p in batch)
        least, leading = minimizers(np.frombuffer(joined, np.uint8), width, anchor)
        sizes = np.array([len(p) for _, _, p in batch])
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(batch)), sizes)[: len(least)]
        inside = np.arange(len(least)) + width <= ends[owner]
        at = np.flatnonzero(inside)
        least, owner, leading = least[at], owner[at], leading[at]
        new = np.ones(len(at), bool)
        new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | leading[:-1]
        first = np.flatnonzero(new)
        if not len(first):
            continue
        n, owner, at = np.diff(np.append(first, len(least))), owner[first], at[first]
        # The digest stands for the length as well.
        seg = np.array([digest(joined[a : a + m + width - 1], m) for a, m in zip(at.tolist(), n.tolist())], np.uint64)
        text, offset = (np.array([p[i] for p in batch], np.int64) for i in (0, 1))
        yield text[owner], at - (ends - sizes)[owner] + offset[owner], n, least[first].astype(np.int64), seg.astype(np.int64)


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`uid, doc_id, data` with unique uids: the ids themselves where they are unique, else stored row numbers."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    odd = rows.groupBy("doc_id").count().where((F.col("count") > 1) | F.col("doc_id").isNull()).limit(1).count()
    if odd:
        # Row numbers differ between runs of a plan; stored once they are settled.
        return stored(rows.withColumn("uid", F.monotonically_increasing_id()), "numbered").select("uid", "doc_id", "text")
    return rows.select(F.col("doc_id").alias("uid"), "doc_id", "text")


RUNS = "uid long, doc_id long, n_bytes long, sha256 string, start long, n int, key long, seg long"
_RUNS_SCHEMA = pa.schema(
    [("uid", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string()), ("start", pa.int64()), ("n", pa.int32()), ("key", pa.int64()), ("seg", pa.int64())]
)


def _cut(width: int, anchor: int):
    def run(batches):
        for batch in slices(batches, 2):
            uids, ids, texts = (c.to_pylist() for c in batch.columns)
            data = [t.encode() for t in texts]
            n = len(data)
            none = [None] * n
            columns = [uids, ids, [len(x) for x in data], [hashlib.sha256(x).hexdigest() for x in data], none, none, none, none]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RUNS_SCHEMA)], schema=_RUNS_SCHEMA)
            for k, *runs in segments(data, width, anchor):
                none = [pa.nulls(len(k), f.type) for f in list(_RUNS_SCHEMA)[1:4]]
                columns = [batch.column(0).take(pa.array(k)), *none, *runs]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type, safe=False) for c, f in zip(columns, _RUNS_SCHEMA)], schema=_RUNS_SCHEMA)

    return run


REFINED = "uid long, start long, n int, key long, seg long, again boolean"
_REFINED_SCHEMA = pa.schema([*[_RUNS_SCHEMA.field(c) for c in ("uid", "start", "n", "key", "seg")], ("again", pa.bool_())])

PARTS = "uid long, start long, again boolean, data binary, shard long"
_PARTS_SCHEMA = pa.schema([("uid", pa.int64()), ("start", pa.int64()), ("again", pa.bool_()), ("data", pa.binary()), ("shard", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _listed(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row numbers and fields of the structs of a column of lists; a null list is empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    fields = {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}
    return np.repeat(np.arange(len(column)), sizes), fields


def _compared(batch: pa.RecordBatch, width: int, crowd: int, crowded: bool) -> tuple[np.ndarray, dict[str, np.ndarray], list[bytes]]:
    """Row numbers, fields and bytes of the segments of several kinds, in groups of up to or of more than `crowd`;
    of equal ones only one."""
    row, m = _listed(batch.column("marks"))
    kinds = m["kinds"]
    pick = np.flatnonzero((kinds > 1) & ((kinds > crowd) == crowded) & (m["stands"] | ~m["again"]))
    row, m = row[pick], {k: v[pick] for k, v in m.items()}
    texts = batch.column("text")
    data = {i: texts[i].as_py().encode() for i in np.unique(row).tolist()}
    return row, m, [data[i][a : a + n + width - 1] for i, a, n in zip(row.tolist(), m["start"].tolist(), m["n"].tolist())]


def _extract(width: int, n_shards: int, crowd: int):
    """The bytes of the segments whose minimizers are one group, with the shard that takes the group."""

    def run(batches):
        for batch in slices(batches, 1):
            row, m, data = _compared(batch, width, crowd, False)
            columns = [batch.column(0).take(pa.array(row)), m["start"], m["again"], data, m["key"] % n_shards]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PARTS_SCHEMA)], schema=_PARTS_SCHEMA)

    return run


def _refine(width: int, anchor: int, crowd: int):
    """The segments of larger groups, cut anew; their minimizers are told apart by those before."""

    def run(batches):
        for batch in slices(batches, 1):
            row, m, data = _compared(batch, width, crowd, True)
            for k, start, n, key, seg in segments(data, width, anchor):
                key = (key.astype(np.uint64) ^ (m["key"][k].astype(np.uint64) * np.uint64(_ODD))).astype(np.int64)
                columns = [batch.column(0).take(pa.array(row[k])), m["start"][k] + start, n, key, seg, m["again"][k]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type, safe=False) for c, f in zip(columns, _REFINED_SCHEMA)], schema=_REFINED_SCHEMA)

    return run


FOUND = "uid long, a long, b long"
_FOUND_SCHEMA = pa.schema([("uid", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last position of each run of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]


def _compare(width: int):
    def run(table: pa.Table) -> pa.Table:
        """Runs of repeated strings of a shard's segments, but for segments that are repeated as a whole."""
        rows = table.to_pylist()
        out = []
        for r, repeated in zip(rows, repeated_windows([r["data"] for r in rows], width)):
            if not r["again"]:
                out += [(r["uid"], r["start"] + a, r["start"] + b) for a, b in _spans(repeated)]
        give_back()
        return pa.Table.from_batches([_batch(out, _FOUND_SCHEMA)])

    return run


def removed_spans(batch: pa.RecordBatch, sizes: np.ndarray, width: int) -> dict[int, list[tuple[int, int]]]:
    """By row the maximal byte runs [a, b) covered by the strings that start in repeated segments or within found starts."""
    row, m = _listed(batch.column("marks"))
    whole = m["again"]
    more, f = _listed(batch.column("found"))
    # All texts on one line, a byte apart.
    base = np.concatenate([[0], np.cumsum(sizes + 1)])
    row = np.concatenate([row[whole], more])
    a = base[row] + np.concatenate([m["start"][whole], f["a"]])
    b = base[row] + np.concatenate([m["start"][whole] + m["n"][whole] - 1, f["b"]]) + width
    by = np.argsort(a)
    a, b = a[by], np.maximum.accumulate(b[by])
    new = np.flatnonzero(np.append(True, a[1:] > b[:-1])) if len(a) else np.empty(0, np.int64)
    a, b = a[new], b[np.append(new[1:], len(b)) - 1] if len(new) else b
    row = np.searchsorted(base, a, "right") - 1
    out: dict[int, list[tuple[int, int]]] = {}
    for i, x, y in zip(row.tolist(), (a - base[row]).tolist(), (b - base[row]).tolist()):
        out.setdefault(i, []).append((x, y))
    return out


def _whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans shrunk to character borders, for texts that must stay UTF-8."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


CHANGED = "uid long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
_CHANGED_SCHEMA = pa.schema([("uid", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _remove(width: int, with_text: bool):
    def kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
        edges = [0, *(x for s in spans for x in s), len(data)]
        return b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2])])

    def run(batches):
        for batch in slices(batches, 1):
            data = [t.encode() for t in batch.column("text").to_pylist()]
            uids, rows = batch.column("uid").to_pylist(), []
            for i, spans in removed_spans(batch, np.array([len(x) for x in data], np.int64), width).items():
                left = kept(data[i], spans)
                shown = kept(data[i], _whole_characters(data[i], spans)).decode() if with_text else None
                rows.append((uids[i], len(data[i]) - len(left), len(spans), hashlib.sha256(left).hexdigest(), shown))
            yield _batch(rows, _CHANGED_SCHEMA)

    return run


def _marked(runs: DataFrame) -> DataFrame:
    """The repeated ones of `uid, start, n, key, seg, again`, with what is known of their groups.

    `again`: the segment occurs more than once (known of some before); `stands`: it is the one
    of its equals that is compared; `kinds`: different segments of its minimizer.
    """
    weight = F.when(F.col("again"), 2).otherwise(1)
    # Counts meet by minimizer, not rows: all but the repeated minimizers end here.
    shared = runs.groupBy("key").agg(F.sum(weight).alias("total"), F.count(F.lit(1)).alias("rows"), F.min("seg").alias("a"), F.max("seg").alias("b"))
    shared = stored(shared.where(F.col("total") > 1).select("key", "rows", (F.col("a") != F.col("b")).alias("mixed")), "repeats-keys")
    place = F.xxhash64("uid", "start")
    runs = stored(split_join(runs, shared, ["key"], "rows"), "repeats-shared")
    # Copies of a segment become one row with a count; a minimizer's different segments are counted.
    kinds = runs.groupBy("key", "seg").agg(F.sum(weight).alias("copies"), F.count(F.lit(1)).alias("rows"), F.min(place).alias("holder"), F.max("mixed").alias("mixed"))
    kinds = stored(kinds.select("key", "seg", "rows", "mixed", "holder", (F.col("copies") > 1).alias("whole")), "repeats-kinds")
    many = stored(kinds.where("mixed").groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).withColumn("rows", F.col("kinds")), "repeats-many")
    alone = kinds.where(~F.col("mixed")).withColumn("kinds", F.lit(1).cast("long"))
    kinds = stored(split_join(kinds.where("mixed").withColumnRenamed("rows", "copies"), many, ["key"], "rows").withColumnRenamed("copies", "rows").unionByName(alone).drop("mixed"), "repeats-flagged")
    marked = split_join(runs.drop("mixed"), kinds, ["key", "seg"], "rows")
    return marked.select("uid", "start", "n", "key", "kinds", "again", "whole", (place == F.col("holder")).alias("stands"))


class Repeats:
    """The steps of the operator on one table."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, anchors: tuple[int, ...] = ANCHORS, crowd: int = CROWD, shard_bytes: int = SHARD_BYTES):
        if anchors[-1] != width or list(anchors) != sorted(anchors):
            raise ValueError("anchors grow up to the width, where no group has two segments")
        self.docs = _identified(docs, id_col, text_col)
        self.width = width
        cut = stored(self.docs.select("uid", "doc_id", "text").mapInArrow(_cut(width, anchors[0]), RUNS), "repeats-runs")
        #: One narrow row a document: size and digest of its whole text.
        self.whole = cut.where(F.col("key").isNull()).select("uid", "doc_id", "n_bytes", "sha256")
        runs = cut.where(F.col("key").isNotNull()).select("uid", "start", "n", "key", "seg", F.lit(False).alias("again"))
        texts, found = self.docs, []
        for anchor in anchors[1:] + (None,):
            flags = _marked(runs)
            if found:
                # Of the first cut these are read from the marks of the texts.
                found.append(stored(flags.where(F.col("whole") & ~F.col("again")).select("uid", F.col("start").alias("a"), (F.col("start") + F.col("n") - 1).alias("b")), "repeats-found"))
                flags = flags.where(F.col("kinds") > 1)
            again = (F.col("again") | F.col("whole")).alias("again")
            marks = flags.groupBy("uid").agg(F.collect_list(F.struct("start", "n", "key", again, "stands", "kinds")).alias("marks"))
            # Texts with at least one flagged run.
            marked = stored(texts.select("uid", "text").join(marks, "uid"), "repeats-marked")
            if texts is self.docs:
                self.marked = marked
            each = marked.select(F.explode("marks").alias("m")).where((F.col("m.kinds") > 1) & (F.col("m.stands") | ~F.col("m.again")))
            sums = each.agg(F.sum(F.when(F.col("m.kinds") <= crowd, F.col("m.n") + width)).alias("bytes"), F.count_if(F.col("m.kinds") > crowd).alias("crowded")).first()
            n_shards = max(1, -(-(sums["bytes"] or 0) // shard_bytes))
            parts = marked.mapInArrow(_extract(width, n_shards, crowd), PARTS)
            found.append(stored(parts.groupBy("shard").applyInArrow(_compare(width), FOUND), "repeats-found"))
            if anchor is None or not sums["crowded"]:
                break
            texts = marked.where(F.exists("marks", lambda m: m["kinds"] > crowd))
            runs = stored(texts.mapInArrow(_refine(width, anchor, crowd), REFINED), "repeats-refined")
        spans = found[0]
        for more in found[1:]:
            spans = spans.unionByName(more)
        self.spans = spans.groupBy("uid").agg(F.collect_list(F.struct("a", "b")).alias("found"))

    def changed(self, with_text: bool = False) -> DataFrame:
        """uid, sizes, digest (and text) of every document that loses bytes."""
        rows = self.marked.join(self.spans, "uid", "left").select("uid", "text", "marks", "found")
        return rows.mapInArrow(_remove(self.width, with_text), CHANGED)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`doc_id, n_bytes, n_removed, n_spans, kept_sha256` of every row.

    Every byte covered by a string of `width` bytes that also starts elsewhere, in this or
    another row, is removed; strings are judged on the input.  Null text is empty; texts
    shorter than `width` lose nothing; repeated rows are documents of their own, so they remove
    each other; a null id keeps its row; an empty table gives none; other columns are ignored.
    """
    found = Repeats(docs, id_col, text_col, **options)
    changed = found.changed().select("uid", "n_removed", "n_spans", "kept_sha256")
    return found.whole.join(changed, "uid", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows, with all their columns, without the repeated strings of their texts.

    Removed spans are shrunk to whole characters, so that the texts stay UTF-8.  Ids are taken as
    unique; where they are not, the rows are numbered first.  A row of null text keeps it.
    """
    schema = docs.schema
    marker, kept = unused(docs, "row", "kept")
    if docs.groupBy(id_col).count().where((F.col("count") > 1) | F.col(id_col).isNull()).limit(1).count():
        docs = stored(docs.withColumn(marker, F.monotonically_increasing_id()), "numbered")
    else:
        docs = docs.withColumn(marker, F.col(id_col).cast("long"))
    changed = Repeats(docs, marker, text_col, **options).changed(with_text=True).select(F.col("uid").alias(marker), F.col("kept_text").alias(kept))
    joined = docs.join(stored(changed, "repeats-changed"), marker, "left")
    return joined.withColumn(text_col, F.coalesce(kept, text_col)).select(*schema.names)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))


QUERIES = {"op3_substring_dedup": op3_substring_dedup}
ORACLES: dict[str, str] = {}
