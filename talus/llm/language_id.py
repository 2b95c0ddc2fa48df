"""Language identification with error-correcting output codes.

Every language has a codeword; one binary n-gram classifier for each bit predicts the codeword's
bits of a text, and the codeword of least loss, bits weighted by how well their classifiers did
on the sample, names the language.  A small lead over the second codeword flags ambiguity.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.llm.common import documents, slices

#: Bound of the labelled sample: rows of each language, the first in a hashed order of ids.
SAMPLE_ROWS = 400
#: More languages than this are refused, which bounds the sample as a whole.
MAX_LANGUAGES = 512
#: Hashed byte n-grams of orders 1 to 3 fall into this many features (a power of two).
FEATURES = 1 << 14
#: Lead over the second codeword, as a share of 0 to 1, below which a text is ambiguous.
MARGIN = 0.05
#: The language of a text that is null or has no letter.
UNKNOWN = "und"

#: Bytes that are kept: letters of ASCII and all bytes of other characters; the rest are blanks.
_KEEP = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


#: Bytes counted, and rows of counts decoded, at a time.
STEP, ROWS = 1 << 20, 128


def has_letter(text: str) -> bool:
    """Whether any character is a letter; numerals, fractions and marks are none."""
    return any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """Counts of the hashed byte 1- to 3-grams of the lower-cased text, runs of other bytes as one blank.

    Long texts are counted piece by piece; each n-gram belongs to the piece in which it starts.
    """
    data = b" ".join(text.lower().encode().translate(_KEEP).split())
    line = np.frombuffer(b" " + data + b" ", np.uint8)
    shift = np.uint32(32 - int(math.log2(FEATURES)))
    total = np.zeros(FEATURES, np.int64)
    for a in range(0, len(line), STEP):
        b = line[a : a + STEP + 2].astype(np.uint32)
        two = (b[:-1] << np.uint32(8)) | b[1:]
        three = (two[:-1] << np.uint32(8)) | b[2:]
        for x in (b + np.uint32(1 << 24), two + np.uint32(1 << 25), three):
            total += np.bincount((x[:STEP] * np.uint32(2654435761)) >> shift, minlength=FEATURES)
    return total


def codewords(n: int) -> np.ndarray:
    """Codewords of n languages, +1 and -1: the exhaustive code to 7 languages, else the best of seeded random codes."""
    if n <= 7:
        width = max(1, 2 ** (n - 1) - 1)
        # Column k, read as bits over the languages after the first, is k; the first language is all +1.
        code = np.array([[1 if i == 0 or not (k >> (i - 1)) & 1 else -1 for k in range(1, width + 1)] for i in range(n)])
        return code.reshape(n, width)
    rng, width, best, best_distance = np.random.default_rng(10), int(math.ceil(10 * math.log2(n))), None, -1
    for _ in range(50):
        code = rng.choice([-1, 1], (n, width))
        code = code[:, np.abs(code.sum(0)) < n]
        distance = ((code.shape[1] - code @ code.T) // 2 + code.shape[1] * np.eye(n, dtype=int)).min()
        if distance > best_distance:
            best, best_distance = code, distance
    return best


#: A text's features: their numbers and their counts.
Sparse = tuple[np.ndarray, np.ndarray]


class EcocModel:
    """Binary log-odds classifiers, one a bit, and their loss-weighted decoding."""

    def __init__(self, languages: list[str], samples: dict[str, list[Sparse]]):
        """samples: the sampled texts of each language."""
        self.languages = languages
        self.code = codewords(len(languages)) if languages else np.empty((0, 0))
        if len(languages) < 2:
            return
        shares = []
        for language in languages:
            total = np.full(FEATURES, 0.1)
            for at, n in samples[language]:
                total[at] += n
            shares.append(total / total.sum())
        shares = np.array(shares)
        columns = []
        for bit in self.code.T:
            columns.append(np.log(shares[bit > 0].mean(0)) - np.log(shares[bit < 0].mean(0)))
        self.weights = np.array(columns).T.astype(np.float32)
        # A bit counts by the log-odds of its error on the sample, languages weighed alike.
        right = np.zeros(self.code.shape[1])
        for k, language in enumerate(languages):
            margins = np.array([8 * (n @ self.weights[at]) / n.sum() for at, n in samples[language]])
            right += (np.sign(margins) == self.code[k]).mean(0) / len(languages)
        error = np.clip(1 - right, 1e-3, 0.499)
        self.bit_weights = np.log((1 - error) / error)
        self.bit_weights /= self.bit_weights.sum()

    def margins(self, rows: np.ndarray) -> np.ndarray:
        """Mean log-odds per n-gram for each bit, scaled so that clear texts pass 1."""
        n = np.maximum(rows.sum(1, keepdims=True), 1)
        return 8 * (rows @ self.weights) / n

    def decode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the nearest codeword, its share of belief from 0 to 1, and whether that is ambiguous."""
        if len(self.languages) == 1:
            return np.zeros(len(rows), int), np.ones(len(rows)), np.zeros(len(rows), bool)
        z = self.margins(rows)[:, None, :] * self.code[None, :, :]
        losses = (np.logaddexp(0, -z) * self.bit_weights).sum(2)
        order = np.argsort(losses, axis=1, kind="stable")
        belief = np.exp(-4 * (losses - losses.min(1, keepdims=True)))
        belief /= belief.sum(1, keepdims=True)
        every = np.arange(len(rows))
        first, second = belief[every, order[:, 0]], belief[every, order[:, 1]]
        return order[:, 0], np.clip(first, 0, 1), first - second < MARGIN


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text is 2 modulo 4; a null id counts as the empty text (0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> EcocModel:
    """Fit on a bounded sample: of each language the first `sample_rows` texts in a hashed order.

    Rows that are held out, of null text or of null language are not learned from.  The order
    hashes id and text together, so null and repeated ids are no ties; rows that repeat both take
    places in the order but are learned once.  No row of two languages at least: a model that knows one language, or none.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    order = Window.partitionBy("lang").orderBy("h")
    # The rank filter runs before the shuffle as well (WindowGroupLimit): hashes travel, texts do not.
    chosen = rows.select("lang", "h", F.row_number().over(order).alias("k")).where(F.col("k") <= sample_rows)
    limits = chosen.groupBy("lang").agg(F.max("h").alias("last")).limit(MAX_LANGUAGES + 1).collect()
    if len(limits) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; raise the bound of the sample knowingly")
    languages = sorted(r["lang"] for r in limits)
    if len(languages) < 2:
        return EcocModel(languages, {})
    within = F.lit(False)
    for r in limits:
        within = within | ((F.col("lang") == r["lang"]) & (F.col("h") <= F.lit(r["last"])))

    def sparse(batches):
        for batch in slices(batches):
            rows = [counts(t) for t in batch.column(1).to_pylist()]
            at = [np.flatnonzero(r) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x.astype("<i4").tobytes() for x in at], pa.binary()),
                    pa.array([r[x].astype("<i4").tobytes() for x, r in zip(at, rows)], pa.binary()),
                ],
                names=["lang", "at", "n"],
            )

    # At most `sample_rows` different hashes a language are at or below its last one.
    sample = rows.where(within).dropDuplicates(["lang", "h"]).select("lang", "text")
    samples: dict[str, list[Sparse]] = {x: [] for x in languages}
    for r in sample.mapInArrow(sparse, "lang string, at binary, n binary").collect():
        samples[r["lang"]].append((np.frombuffer(r["at"], "<i4"), np.frombuffer(r["n"], "<i4").astype(np.float32)))
    return EcocModel(languages, samples)


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"


def predict(docs: DataFrame, model: EcocModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language, belief and ambiguity of every text.

    One row per input row.  A null text, one without a letter, or any text when nothing was
    learned, is `und` with score 0.  Repeated rows repeat, an empty table gives none, and
    columns other than id and text are never read.
    """
    languages = model.languages

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            known = [i for i, t in enumerate(texts) if languages and t and has_letter(t)]
            names, scores, doubts = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
            for a in range(0, len(known), ROWS):
                some = known[a : a + ROWS]
                rows = np.array([counts(texts[i]) for i in some], np.float32)
                for i, k, s, d in zip(some, *(x.tolist() for x in model.decode(rows))):
                    names[i], scores[i], doubts[i] = languages[k], s, d
            columns = [batch.column(0), batch.column(2), pa.array(names), pa.array(scores, pa.float64()), pa.array(doubts)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    return rows.mapInArrow(run, PREDICTED)


def accepted(docs: DataFrame, model: EcocModel, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is known and not ambiguous; no row moves.

    Rows of null text or without a letter go, and all rows where nothing was learned; repeated
    rows and null ids are judged by their texts like any others; an empty table stays empty.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches, at):
            texts = batch.column(at).to_pylist()
            known = [i for i, t in enumerate(texts) if model.languages and t and has_letter(t)]
            keep = [False] * len(texts)
            for a in range(0, len(known), ROWS):
                some = known[a : a + ROWS]
                _, _, doubts = model.decode(np.array([counts(texts[i]) for i in some], np.float32))
                for i, doubt in zip(some, doubts.tolist()):
                    keep[i] = not doubt
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def language_id(docs: DataFrame, **columns) -> DataFrame:
    """Fit on the labelled rows that are not held out and predict all rows."""
    model = fit(docs, **columns)
    return predict(docs, model, **{k: v for k, v in columns.items() if k in ("id_col", "text_col")})


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


QUERIES = {"op10_language_id": op10_language_id}
ORACLES: dict[str, str] = {}
