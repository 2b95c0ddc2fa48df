"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 21, 21 and 22 bits.  Two fingerprints at
distance 2 or less agree in at least one segment (pigeonhole), and differ by at most two bits
in the next one.  Padded to 23 bits, that one is decoded to the perfect (23, 12) Golay code
together with all its one-bit neighbours: one to six codeword indices.  Words at distance 2 or
less have a common neighbour, hence a common index.  A key is an exact segment with an index
of the next; equal keys are joined and verified by the true distance.  Keys of many fingerprints
are refined by an index of the third segment, which a pair at distance 2 or less shares too.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import documents, keyed_text, slices, split_join, stored, unused
from talus.operators.components import star_components

#: Words in a shingle, seed of its XXH64, and differing bits up to which fingerprints link.
SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Distinct fingerprints of a key up to which the key is joined with itself; larger ones are refined,
#: and what even the last index leaves larger goes by midpoints, an exact way without pairs.
BUCKET = 32
#: Shingles counted at a time.
STEP = 1 << 15

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

# ---- fingerprints --------------------------------------------------------------------------


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash; a bit is set if set in over half of all shingle hashes; no word: 0."""
    import xxhash

    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) < shingle:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    ones = np.zeros(64, np.int64)
    for a in range(0, len(starts), STEP):
        places = zip(starts[a : a + STEP].tolist(), ends[a : a + STEP].tolist())
        digests = b"".join(map(xxhash.xxh64_digest, [line[i:j] for i, j in places], repeat(seed)))
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, fp` (the fingerprint's bits as a signed long) of every row.

    Null text has no words and fingerprint 0; repeated rows and null ids are rows like any others;
    an empty table gives none.
    """

    def run(batches):
        for batch in slices(batches):
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


# ---- the Golay code ------------------------------------------------------------------------

#: Fixed value: generator polynomial of the (23, 12) Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


class Golay:
    """Decoder of all 23-bit words to the index of the one codeword within distance 3, by syndromes."""

    def __init__(self):
        every = np.arange(1 << 11, dtype=np.uint32)
        self.low = self._remainder(every)
        self.high = self._remainder(np.arange(1 << 12, dtype=np.uint32) << np.uint32(11))
        bits = np.uint32(1) << np.arange(23, dtype=np.uint32)
        single = self.syndrome(bits)
        self.error = np.zeros(1 << 11, np.uint32)
        self.error[single] = bits
        for i in range(23):
            for j in range(i):
                self.error[single[i] ^ single[j]] = bits[i] | bits[j]
                k = np.arange(j)
                self.error[single[i] ^ single[j] ^ single[k]] = bits[i] | bits[j] | bits[k]

    @staticmethod
    def _remainder(words: np.ndarray) -> np.ndarray:
        words = words.copy()
        for k in range(22, 10, -1):
            words = np.where(words >> np.uint32(k) & np.uint32(1), words ^ np.uint32(GENERATOR << (k - 11)), words)
        return words

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & np.uint32(0x7FF)] ^ self.high[words >> np.uint32(11)]

    def index(self, words: np.ndarray) -> np.ndarray:
        """The codeword's 12 upper bits, which tell it apart from all others."""
        return (words ^ self.error[self.syndrome(words)]) >> np.uint32(11)

    def indices(self, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """All indices of each word and of its neighbours in `width` bits: row numbers and distinct indices."""
        flips = np.concatenate([[0], 1 << np.arange(width)]).astype(np.uint32)
        all_ = np.sort(self.index(words[:, None] ^ flips[None, :]), axis=1)
        new = np.ones(all_.shape, bool)
        new[:, 1:] = all_[:, 1:] != all_[:, :-1]
        return np.nonzero(new)[0], all_[new]


#: Offset and width of the segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
_GOLAY: list[Golay] = []


def _golay() -> Golay:
    """One decoder for each worker process."""
    if not _GOLAY:
        _GOLAY.append(Golay())
    return _GOLAY[0]


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of fingerprints: number and bits of an exact segment, index of the next."""
    parts = [((fps >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.uint32) for a, n in SEGMENTS]
    rows, keys = [], []
    for k in range(3):
        nxt = (k + 1) % 3
        row, index = _golay().indices(parts[nxt], SEGMENTS[nxt][1])
        rows.append(row)
        keys.append((np.int64(k) << 34) | (parts[k][row].astype(np.int64) << 12) | index.astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def third_indices(fps: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and refined keys of fingerprints with their keys: with the index of the segment that is not in the key."""
    rows, keys = [], []
    for k in range(3):
        own = np.flatnonzero(key >> np.int64(34) == k)
        a, n = SEGMENTS[(k + 2) % 3]
        row, index = _golay().indices(((fps[own] >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.uint32), n)
        rows.append(own[row])
        # The key fills 36 bits, the index 12.
        keys.append((key[own[row]] << np.int64(12)) | index.astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches):
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for a in range(0, len(fps), 1 << 13):
            row, key = fuzzy_keys(fps[a : a + (1 << 13)].astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[a : a + (1 << 13)][row])], names=["key", "fp"])


def _refined(batches):
    for batch in batches:
        keys, fps = (c.to_numpy() for c in batch.columns)
        for a in range(0, len(fps), 1 << 13):
            some = fps[a : a + (1 << 13)]
            row, key = third_indices(some.astype(np.uint64), keys[a : a + (1 << 13)])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(some[row])], names=["key", "fp"])


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


# ---- linking -------------------------------------------------------------------------------


def links(distinct: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Edges `u, v` between distinct fingerprints `fp` that connect all at `distance` 2 or less.

    Keys of at most `bucket` fingerprints are joined with themselves and verified; larger ones are
    refined by the third segment's index first.  Where that still leaves more, no pairs are made:
    every fingerprint names the 65 words within one bit of it, and those that share such a
    midpoint, which are at most two bits apart by construction, link to the least of them.  That
    is exact, and its rows grow with the fingerprints alone.
    """
    if distance != 2:
        raise ValueError("segments and midpoints are laid out for a distance of 2")

    def shared(keyed: DataFrame, name: str) -> DataFrame:
        """Fingerprints of the keys that several have, with their number."""
        counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        counts = stored(counts.withColumn("rows", F.col("n")), name)
        return stored(split_join(keyed, counts, ["key"], "rows"), name)

    def verified(members: DataFrame) -> DataFrame:
        small = members.where(F.col("n") <= bucket)
        a, b = small.select("key", F.col("fp").alias("u")), small.select("key", F.col("fp").alias("v"))
        near = (F.col("u") < F.col("v")) & (differing(F.col("u"), F.col("v")) <= distance)
        return a.join(b, "key").where(near).select("u", "v")

    members = shared(distinct.select("fp").mapInArrow(_keyed, "key long, fp long"), "simhash-keys")
    pairs = verified(members)
    crowded = members.where(F.col("n") > bucket)
    if not crowded.limit(1).count():
        return pairs.distinct()
    finer = shared(stored(crowded.select("key", "fp").mapInArrow(_refined, "key long, fp long"), "simhash-finer"), "simhash-finer")
    pairs = pairs.unionByName(verified(finer))
    crowded = finer.where(F.col("n") > bucket).select("fp").distinct()
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    middles = crowded.select("fp", F.explode(F.concat(F.array("fp"), bits)).alias("middle"))
    least = middles.groupBy("middle").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("middle", "v")
    stars = middles.join(least, "middle").where(F.col("fp") != F.col("v")).select(F.col("fp").alias("u"), "v")
    return pairs.unionByName(stars).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, fp, component_id` of every row; the component is the least doc_id reachable.

    Rows of equal fingerprints form one class before any linking, so copies are never expanded
    into pairs.  Null text and text without words have fingerprint zero and link like any other;
    repeated rows repeat; a null id keeps its row and takes no part in the least id; an empty
    table gives none; other columns are ignored.
    """
    fps = stored(fingerprints(docs, id_col, text_col), "simhash")
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "simhash-classes")
    linked = star_components(links(classes), lambda df: stored(df, "simhash-links"))
    rooted = classes.join(linked.select(F.col("node").alias("fp"), "component"), "fp", "left")
    rooted = stored(rooted.select("fp", "first_id", "copies", F.coalesce("component", "fp").alias("root")), "simhash-roots")
    least = stored(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("classes")), "simhash-least")
    found = stored(split_join(rooted, least, ["root"], "classes").select("fp", "copies", "component_id"), "simhash-found")
    return split_join(fps, found, ["fp"], "copies").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that stand for their component: those of its least id.

    Rows that repeat an id count as one document, of which one row stays; rows of null id stay.
    """
    chosen = simhash_components(docs, id_col, text_col).select("doc_id", "component_id").where(F.col("doc_id") == F.col("component_id"))
    (name,) = unused(docs, "kept")
    chosen = stored(chosen.select(F.col("doc_id").alias(name)).distinct(), "simhash-kept")
    kept = docs.join(chosen, F.col(id_col).cast("long") == F.col(name), "left_semi")
    if docs.groupBy(id_col).count().where((F.col("count") > 1) & F.col(id_col).isNotNull()).limit(1).count():
        kept = kept.dropDuplicates([id_col])
    return kept.unionByName(docs.where(F.col(id_col).isNull()))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
ORACLES: dict[str, str] = {}
