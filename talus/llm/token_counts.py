"""Token counts: library encoding inside Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from talus.llm.common import documents, keyed_text, slices, windows
from talus.llm.pieces import WINDOW, WordCounter

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: A text with more tokens than this is over the limit.
LIMIT = 2048

_COUNTERS: dict[str, WordCounter] = {}


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def counter(path: str) -> WordCounter:
    """One counter, with its cache, for each worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = WordCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: Callable[[], str] = _default_path, limit: int = LIMIT) -> DataFrame:
    """Bytes and tokens of every text.

    One row per input row: null text counts as empty (0 tokens), repeated rows repeat, a null id
    stays null, an empty table gives none, other columns are ignored.  Batches are cut by bytes;
    texts are cut at blanks and line feeds, which no token spans, so a long text costs no more
    memory than its pieces.
    """

    def run(batches):
        count = counter(path())
        for batch in slices(windows(batches, WINDOW), limit=WINDOW):
            texts = batch.column(1).to_pylist()
            n = count.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pc.binary_length(batch.column(1)).cast(pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([k > limit for k in n], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return keyed_text(docs).mapInArrow(run, SCHEMA)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLES: dict[str, str] = {}
