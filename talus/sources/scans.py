"""Binary scans and labels, their writers, method parameters and toy samples."""

from __future__ import annotations

import struct
import uuid
import zlib
from functools import reduce
from operator import and_
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "sequence string, scan_id long, point_id long, x float, y float, z float, i float"
LABELS = "sequence string, scan_id long, point_id long, label long, instance long"


def _names(path: str) -> tuple[str | None, int]:
    """Sequence (the folder after `sequences`) and scan number of a file's path."""
    parts = path.split("/")
    sequence = parts[parts.index("sequences") + 1] if "sequences" in parts[:-1] else None
    stem = parts[-1].rsplit(".", 1)[0]
    return sequence, int(stem) if stem.isdigit() else zlib.crc32(stem.encode())


def _files(spark: SparkSession, paths: str | list[str], extension: str) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    odd = [p for p in paths if "." in p.rsplit("/", 1)[-1] and not p.endswith(extension) and "*" not in p]
    if odd:
        raise ValueError(f"files must end in {extension}: {odd[0]}")
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{extension}").option("recursiveFileLookup", "true").load(paths).select("path", "content")


def read_scans(spark: SparkSession, paths: str | list[str], n_columns: int = 4) -> DataFrame:
    """Scans of little-endian floats, `n_columns` a point; the row number in its file is the point's id."""

    def run(batches):
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                if len(content) % (4 * n_columns):
                    raise ValueError(f"{path}: not a whole number of points")
                v = np.frombuffer(content, "<f4").reshape(-1, n_columns)
                sequence, scan = _names(path)
                n = len(v)
                i = v[:, 3] if n_columns > 3 else np.zeros(n, np.float32)
                columns = [pa.array([sequence] * n, pa.string()), pa.array(np.full(n, scan), pa.int64()), pa.array(np.arange(n), pa.int64())]
                columns += [pa.array(np.ascontiguousarray(c)) for c in (v[:, 0], v[:, 1], v[:, 2], i)]
                yield pa.RecordBatch.from_arrays(columns, names=["sequence", "scan_id", "point_id", "x", "y", "z", "i"])

    return _files(spark, paths, ".bin").mapInArrow(run, POINTS)


def read_labels(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Labels of unsigned 32 bits: semantic below, instance above."""

    def run(batches):
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                v = np.frombuffer(content, "<u4")
                sequence, scan = _names(path)
                n = len(v)
                columns = [pa.array([sequence] * n, pa.string()), pa.array(np.full(n, scan), pa.int64()), pa.array(np.arange(n), pa.int64())]
                columns += [pa.array((v & 0xFFFF).astype(np.int64)), pa.array((v >> 16).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["sequence", "scan_id", "point_id", "label", "instance"])

    return _files(spark, paths, ".label").mapInArrow(run, LABELS)


def labelled_scans(points: DataFrame, labels: DataFrame, check: bool = True) -> DataFrame:
    """Points with their labels, by sequence, scan and point; a scan whose files differ in length raises.

    File numbers repeat from sequence to sequence: `unique_scans` numbers the scans of several ones.
    """
    alike = lambda a, b, names: reduce(and_, [a[c].eqNullSafe(b[c]) for c in names])
    scan = ["sequence", "scan_id"]
    if check:
        a = points.groupBy(*scan).agg(F.count(F.lit(1)).alias("n_points"))
        b = labels.groupBy(*scan).agg(F.count(F.lit(1)).alias("n_labels"))
        n = a.join(b, alike(a, b, scan), "full").select(F.coalesce(a["sequence"], b["sequence"]).alias("sequence"), F.coalesce(a["scan_id"], b["scan_id"]).alias("scan_id"), "n_points", "n_labels")
        odd = n.where(~F.col("n_points").eqNullSafe(F.col("n_labels"))).limit(1).collect()
        if odd:
            raise ValueError(f"sequence {odd[0]['sequence']}, scan {odd[0]['scan_id']}: {odd[0]['n_points']} points, {odd[0]['n_labels']} labels")
    return points.join(labels, alike(points, labels, [*scan, "point_id"])).select(*[points[c] for c in points.columns], labels["label"], labels["instance"])


def unique_scans(frame: DataFrame) -> DataFrame:
    """The frame with scan ids that tell sequences apart: the file number and, above it, the sequence's own number
    plus one, or a hash where it has none.

    Operators group by `scan_id` alone; without a sequence the id stays as it is.
    """
    number = F.when(F.col("sequence").rlike(r"^\d{1,6}$"), F.col("sequence").cast("long") + 1)
    high = F.coalesce(number, F.pmod(F.xxhash64("sequence"), F.lit(1 << 30)) + (1 << 20))
    return frame.withColumn("scan_id", F.when(F.col("sequence").isNull(), F.col("scan_id")).otherwise(high * (1 << 32) + F.col("scan_id")))


def sequence_files(spark: SparkSession, folder: str, start: int = 0, end: int | None = None, step: int = 1, extension: str = ".bin") -> list[str]:
    """The sorted files of a folder that Spark can list, sliced; pass them to a reader, which then opens only those.

    Spark does not list files without a byte.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{extension}").load(folder).select("path")
    return sorted(r["path"] for r in found.collect())[start:end:step]


def load_parameters(path: str) -> dict:
    """Parameters of a method from YAML, nested keys flattened, without `name`."""
    import yaml

    out: dict = {}

    def add(node: dict) -> None:
        for key, value in node.items():
            if isinstance(value, dict):
                add(value)
            elif key != "name":
                out[key] = value

    add(yaml.safe_load(Path(path).read_text()) or {})
    return out


def label_config(spark: SparkSession, path: str) -> DataFrame:
    """A label configuration as a table, a row a label; colours are stored blue first.

    `content` is the label's share of all points, `learn_id` its class (0 where it has none), whose
    own label is `learn_label` and which learning may ignore; `is_ground` as `points.is_ground`.
    """
    import yaml

    from talus.operators.points import GROUND_LABELS

    spec = yaml.safe_load(Path(path).read_text())
    maps = {k: spec.get(k) or {} for k in ("learning_map", "learning_map_inv", "learning_ignore", "content", "color_map")}
    rows = []
    for label, name in spec["labels"].items():
        b, g, r = maps["color_map"].get(label, (0, 0, 0))
        learn = int(maps["learning_map"].get(label, 0))
        back = maps["learning_map_inv"].get(learn)
        ignored = bool(maps["learning_ignore"].get(learn, False))
        share = maps["content"].get(label)
        rows.append((int(label), str(name), learn, None if back is None else int(back), ignored, None if share is None else float(share), int(label in GROUND_LABELS), int(r), int(g), int(b)))
    return spark.createDataFrame(rows, "label int, name string, learn_id int, learn_label int, ignored boolean, content double, is_ground int, r int, g int, b int")


def label_splits(spark: SparkSession, path: str) -> DataFrame:
    """The configuration's `split` as a table: split, sequence (two digits, as in the folders' names)."""
    import yaml

    spec = yaml.safe_load(Path(path).read_text())
    rows = [(str(name), f"{int(s):02d}") for name, sequences in (spec.get("split") or {}).items() for s in sequences]
    return spark.createDataFrame(rows, "split string, sequence string")


def las_bytes(xyz: np.ndarray, labels: np.ndarray | None = None, colours: np.ndarray | None = None, scale: float = 0.001) -> bytes:
    """A LAS 1.2 file of coordinates: labels as user data (their lowest byte), colours (red, green, blue) in point format 2."""
    low, high = (xyz.min(0), xyz.max(0)) if len(xyz) else (np.zeros(3), np.zeros(3))
    kind, size = (0, 20) if colours is None else (2, 26)
    head = struct.pack("<4sHH16sBB32s32sHHHIIBHI5I", b"LASF", 0, 0, b"\0" * 16, 1, 2, b"talus", b"talus", 1, 2026, 227, 227, 0, kind, size, len(xyz), len(xyz), 0, 0, 0, 0)
    head += struct.pack("<12d", *([scale] * 3), *low, *[v for pair in zip(high, low) for v in pair])
    # Intensity, flags and class stay 0, then user data and the source's number.
    fields = [("p", "<i4", 3), ("intensity", "<u2"), ("flags", "u1"), ("cls", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2")]
    record = np.zeros(len(xyz), dtype=fields + ([("rgb", "<u2", 3)] if colours is not None else []))
    record["p"] = np.floor((xyz - low) / scale + 0.5)
    if labels is not None:
        record["user"] = np.asarray(labels) & 0xFF
    if colours is not None:
        record["rgb"] = colours
    return head + record.tobytes()


def write_las(points: DataFrame, folder: str, label: str | None = None, colour: tuple[str, str, str] | None = None) -> DataFrame:
    """Writes a LAS file a scan into a shared folder (of any file system that Arrow knows); one task works on one scan.

    Returns `scan_id, path, n_points`; evaluating it writes.  A file appears under its name when it
    is whole, so tasks that are run again replace it.
    """
    extra = ([label] if label else []) + list(colour or ())

    def run(table: pa.Table) -> pa.Table:
        from pyarrow import fs

        scan = np.asarray(table.column("scan_id"))[0]
        order = np.argsort(np.asarray(table.column("point_id")), kind="stable")
        column = lambda c: np.asarray(table.column(c))[order]
        xyz = np.stack([column(c).astype(float) for c in "xyz"], axis=1)
        colours = np.stack([column(c) for c in colour], axis=1) if colour else None
        data = las_bytes(xyz, column(label).astype(np.int64) if label else None, colours)
        system, top = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(top, recursive=True)
        path, part = f"{top}/{scan}.las", f"{top}/.{scan}-{uuid.uuid4().hex}"
        with system.open_output_stream(part) as sink:
            sink.write(data)
        system.move(part, path)
        return pa.table({"scan_id": pa.array([scan], pa.int64()), "path": [path], "n_points": pa.array([len(xyz)], pa.int64())})

    rows = points.select("scan_id", "point_id", "x", "y", "z", *extra)
    return rows.groupBy("scan_id").applyInArrow(run, "scan_id long, path string, n_points long")


#: The scores of a report, in order, by the names of their columns.
REPORTED = (("F1", "f1"), ("Recall", "recall"), ("Precision", "precision"), ("Accuracy", "acc"), ("Jaccard", "jaccard"))


def score_reports(scores: DataFrame, matrices: DataFrame, method: str) -> DataFrame:
    """`scan_id, method, report`: the scores of each scan and its confusion matrix, a line a row, as text.

    `scores` are those of `metrics.binary_scores` by scan; `matrices` has scan_id, truth, pred, n.
    """
    line = matrices.groupBy("scan_id", "truth").agg(F.array_sort(F.collect_list(F.struct("pred", "n"))).alias("cells"))
    line = line.select("scan_id", F.struct("truth", F.array_join(F.transform("cells", lambda c: c["n"].cast("string")), " ").alias("text")).alias("line"))
    grid = line.groupBy("scan_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["text"]), "\n").alias("grid"))
    told = [F.concat(F.lit(f"{title} "), F.round(c, 6).cast("string")) for title, c in REPORTED]
    text = F.concat_ws("\n", F.concat(F.lit("Scan "), F.col("scan_id").cast("string")), *told, F.lit("Confusion"), "grid")
    return scores.join(grid, "scan_id", "left").select("scan_id", F.lit(method).alias("method"), text.alias("report"))


def write_reports(reports: DataFrame, path: str) -> None:
    """Adds reports or scores as JSON lines, a folder a scan, so that the results of many runs gather in one place."""
    reports.write.partitionBy("scan_id").mode("append").json(path)


def gathered_reports(spark: SparkSession, path: str, method: str) -> DataFrame:
    """All reports of a method, in order of scan: `scan_id, report`."""
    found = spark.read.schema("method string, report string, scan_id long").json(path)
    return found.where(F.col("method") == method).select("scan_id", "report").orderBy("scan_id")


#: Names of the toy samples.
TOYS = ("circles", "moons", "blobs", "varied", "aniso")


def toy_samples(spark: SparkSession, kind: str, samples: int, max_points: int, noise: float = 0.05, deviation: float = 0.1, labelled: float = 0.1, random_length: bool = True, seed: int = 0) -> DataFrame:
    """`sample_id, point_id, x, y, cls, is_labelled`: seeded planar samples, one a group, each from its own generator."""
    if kind not in TOYS:
        raise ValueError(f"unknown sample {kind!r}; known: {', '.join(TOYS)}")

    def draw(sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rng = np.random.default_rng([seed, sample])
        n = int(rng.integers(max_points // 2, max_points + 1)) if random_length else max_points
        if kind == "circles":
            y = np.arange(n) % 2
            t = rng.uniform(0, 2 * np.pi, n)
            p = np.stack([np.cos(t), np.sin(t)], 1) * np.where(y, 0.5, 1.0)[:, None] + rng.normal(0, noise, (n, 2))
        elif kind == "moons":
            y = np.arange(n) % 4
            t = rng.uniform(0, np.pi, n)
            upper = np.stack([np.cos(t), np.sin(t)], 1)
            lower = np.stack([1 - np.cos(t), 0.5 - np.sin(t)], 1)
            p = np.where((y % 2 == 0)[:, None], upper, lower) + np.where(y >= 2, 2.0, 0.0)[:, None] + rng.normal(0, noise, (n, 2))
        else:
            grid = np.array([(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)], float)
            centres = grid[rng.permutation(9)[: 9 if kind == "blobs" else 3]]
            y = np.arange(n) % len(centres)
            spread = deviation * (np.array([1.0, 2.5, 0.5])[y % 3] if kind == "varied" else 1.0)
            p = centres[y] + rng.normal(0, 1, (n, 2)) * np.reshape(spread, (-1, 1))
            if kind == "aniso":
                p = p @ np.array([[0.6, -0.6], [-0.4, 0.8]])
        known = np.zeros(n, bool)
        for c in np.unique(y):
            own = np.flatnonzero(y == c)
            known[rng.permutation(own)[: max(int(len(own) * labelled), 1)]] = True
        return p, y, known

    def run(batches):
        for batch in batches:
            for sample in batch.column(0).to_pylist():
                p, y, known = draw(sample)
                n = len(p)
                columns = [np.full(n, sample), np.arange(n), np.ascontiguousarray(p[:, 0]), np.ascontiguousarray(p[:, 1]), y.astype(np.int64), known]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sample_id", "point_id", "x", "y", "cls", "is_labelled"])

    return spark.range(samples).mapInArrow(run, "sample_id long, point_id long, x double, y double, cls long, is_labelled boolean")
