"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece holds a white-space marker after another character, none crosses the border before a
run of markers, and merges on one side never depend on the other.  Texts are therefore cut into marked
words; each distinct word of a window is segmented once, and its ids and decoded text are joined back
by position.  A line feed that occurs in no piece is a border as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from talus.llm.common import documents, give_back, keyed_text, slices, windows
from talus.llm.pieces import Cache

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
ENCODED = "doc_id long, n_tokens long, ids array<int>, decoded string"
#: The marker that stands for a blank (fixed value).
MARK = "▁"
#: Chunks that a worker keeps (about 300 bytes each), and bytes of texts whose chunks are looked up together.
CACHE_CHUNKS, WINDOW = 100_000, 4 << 20


class ChunkTable:
    """Segments texts as the library does with an end id; falls back to whole texts where chunks are not independent."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())]
        self.end = self.library.eos_id()
        self.mark = self.library.piece_to_id(MARK)
        self.feeds = not any("\n" in p for p in pieces)
        self.chunked = not any(MARK in p.lstrip(MARK) for p in pieces) and self._plain(pieces)
        self.table = Cache(self._segment, CACHE_CHUNKS)

    def _plain(self, pieces: list[str]) -> bool:
        """Whether texts are normalised by nothing but one leading marker and markers for blanks.

        Each character of the vocabulary is normalised by the library and compared; so are runs of blanks.
        """
        letters = sorted(set("".join(pieces)) - {MARK})
        probes = ["  a  b  ", " ", " 　\t\n\r", "ﬁＡéé", *("".join(letters[a : a + 500]) for a in range(0, len(letters), 500))]
        special = [p for i, p in enumerate(pieces) if self.library.is_control(i) or self.library.is_unknown(i)]
        same = all(self.library.normalize(p) == MARK + p.replace(" ", MARK) for p in probes)
        return same and self.mark != self.library.unk_id() and not any(MARK in p or " " in p for p in special)

    def _entries(self, ids: list[list[int]], skip: int) -> Iterator[tuple[int, str, str]]:
        for x, text in zip(ids, self.library.decode(ids) if ids else []):
            yield len(x) - skip, " ".join(map(str, x[skip:])), text

    def _segment(self, chunks: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, ids in decimal and decoded text of each chunk.

        The library puts a marker before whatever it is given: before a marked word, whose own it is, and
        before a chunk that follows a line feed, where it is a piece of its own and is dropped again.
        """
        out: dict[str, tuple[int, str, str]] = {}
        after = [c for c in chunks if c[:1] == "\n"]
        out.update(zip(after, self._entries(self.library.encode(after, num_threads=1), 1) if after else ()))
        marked = [c for c in chunks if c and c[0] != "\n"]
        ids = self.library.encode(marked, num_threads=1) if marked else []
        out.update((c, (n, x, " " + text)) for c, (n, x, text) in zip(marked, self._entries(ids, 0)))
        # A lone marker: the library gives nothing for an empty text.
        out[""] = (1, str(self.mark), " ")
        return [out[c] for c in chunks]

    def chunks(self, text: str) -> list[str]:
        """Marked words without their first marker, and what follows a line feed with it."""
        if self.feeds:
            text = text.replace("\n", " \n")
        words = text.replace(MARK, " ").split(" ")
        if "" not in words:
            return words
        out, blanks = [], ""
        for k, w in enumerate(words):
            if self.feeds and w[:1] == "\n":
                # The blank before a line feed was put there; the ones before it are markers of their own.
                if blanks:
                    out.append(blanks[1:])
                out.append(w)
                blanks = ""
            elif w:
                out.append(blanks + w)
                blanks = ""
            else:
                blanks += " "
        return [*out, blanks[1:]] if blanks else out

    def whole(self, text: str) -> tuple[int, str, str]:
        ids = self.library.encode(text, num_threads=1)
        return len(ids) + 1, " ".join(map(str, [*ids, self.end])), self.library.decode([*ids, self.end])

    def texts(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids with the end id, ids in decimal and decoded text of each text."""
        if not self.chunked:
            return [self.whole(t) for t in texts]
        wanted: set[str] = set()
        # Cut twice rather than held: a window costs the memory of its distinct chunks.
        for t in texts:
            if t:
                wanted.update(self.chunks(t))
        self.table.learn(wanted)
        get, end, out = self.table.__getitem__, str(self.end), []
        for t in texts:
            if not t:
                out.append((1, end, ""))
                continue
            n, ids, decoded = zip(*map(get, self.chunks(t)))
            # The marker before the text itself is dropped in decoding.
            out.append((sum(n) + 1, f"{' '.join(ids)} {end}", "".join(decoded)[1:]))
        self.table.trim()
        return out


_MODELS: dict[str, ChunkTable] = {}


def model(path: str) -> ChunkTable:
    """One table for each worker process."""
    if path not in _MODELS:
        _MODELS[path] = ChunkTable(path)
    return _MODELS[path]


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _mapped(docs: DataFrame, path: Callable[[], str], schema: str, columns: Callable) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        table = model(path())
        for batch in slices(windows(batches, WINDOW), limit=WINDOW):
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns(table.texts(batch.column(1).to_pylist()))], names=names)
        table.table.clear()
        give_back()

    return keyed_text(docs).mapInArrow(run, schema)


def piece_encode(docs: DataFrame, path: Callable[[], str] = _default_path) -> DataFrame:
    """Ids, the end id last, and decoded text of every text.

    One row per input row: null text is empty (the end id alone, decoded as nothing), repeated rows
    repeat, a null id stays null, an empty table gives none, other columns are ignored.
    """

    def columns(got):
        ids = [np.array(x[1].split(), np.int32) for x in got]
        return pa.array([x[0] for x in got], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([x[2] for x in got], pa.string())

    return _mapped(docs, path, ENCODED, columns)


def piece_digest(docs: DataFrame, path: Callable[[], str] = _default_path) -> DataFrame:
    """Number of ids and digests of the ids and of the decoded text; rows as in `piece_encode`."""

    def columns(got):
        sha = hashlib.sha256
        return (
            pa.array([x[0] for x in got], pa.int64()),
            pa.array([sha(x[1].encode()).hexdigest() for x in got], pa.string()),
            pa.array([sha(x[2].encode()).hexdigest() for x in got], pa.string()),
        )

    return _mapped(docs, path, SCHEMA, columns)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digest(documents(spark, sf_dir))


QUERIES = {"op11_sentencepiece": op11_sentencepiece}
ORACLES: dict[str, str] = {}
