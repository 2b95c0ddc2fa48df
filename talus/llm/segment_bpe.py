"""BPE encoding and decoding with segment trees over the ranks of adjacent pairs.

The leaf of a symbol holds the rank of the pair that it opens (infinite: not mergeable) and its
position; a node holds the least of its children, so the root yields the leftmost pair of
lowest rank.  A merge changes three leaves, each updated upwards in logarithmic time, until the
root is infinite.  Words of like length run together: one row of a matrix is one word's tree.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from talus.llm.common import documents, give_back, keyed_text, slices
from talus.llm.pieces import Cache, byte_symbols, library_tokenizer

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Symbols of a word up to which its tree is a row of a matrix; longer words get a tree of their own.
WIDEST = 64
#: Pieces that a worker keeps decoded and encoded (about 350 bytes each), and words likewise.
CACHE_PIECES = 120_000
#: Bytes of texts whose pieces are looked up at a time: their values are held besides the cache.
STEP = 1 << 20

#: Marks that often close a word; any others take the general way.
MARKS = ".,"

_INF = np.int64(1) << 60


class PairTable:
    """Rank and result of every mergeable pair in an open-addressing table, looked up by whole arrays."""

    def __init__(self, pairs: np.ndarray, results: np.ndarray, n_ids: int):
        self.n_ids = n_ids
        self.bits = max(4, int(np.ceil(np.log2(4 * len(pairs) + 1))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, -1, np.int32)
        self.results = np.full(1 << self.bits, -1, np.int32)
        keys = pairs[:, 0].astype(np.int64) * n_ids + pairs[:, 1]
        self.exact = {int(k): (r, int(x)) for r, (k, x) in enumerate(zip(keys, results))}
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            # Of those that want an empty slot, the first of each slot gets it; the rest move on.
            _, first = np.unique(at[left], return_index=True)
            won = left[first][self.keys[at[left[first]]] == -1]
            self.keys[at[won]], self.ranks[at[won]], self.results[at[won]] = keys[won], won, results[won]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and results of pairs; -1 for those that never merge."""
        keys = left.astype(np.int64) * self.n_ids + right
        at = self._slot(keys)
        seen = self.keys[at]
        open_ = np.flatnonzero((seen != keys) & (seen != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at[open_]]
            open_ = open_[(seen != keys[open_]) & (seen != -1)]
        return self.ranks[at], self.results[at]


class SegmentTreeBpe:
    """A byte-level BPE with word ends, read from a tokenizer file; lower case, white space dropped."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = vocab | self.special
        self.names = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.names[i] = name
        suffix = model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.final = np.array([vocab[s + suffix] for s in symbols], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = np.array([(vocab[a], vocab[b]) for a, b in merges], np.int64).reshape(-1, 2)
        self.table = PairTable(pairs, np.array([vocab[a + b] for a, b in merges], np.int32), len(self.names))
        self.split_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.path, self.library = path, None
        self.byte_of = {c: b for b, c in enumerate(symbols)}
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
        self.known = Cache(self._encode_words, CACHE_PIECES)
        self.pieces = Cache(self._encode_pieces, CACHE_PIECES)

    # ---- merging ----

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, given as its UTF-8 bytes."""
        out: list[list[int]] = [[]] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            width = 1
            while width < len(w):
                width *= 2
            by_width.setdefault(width, []).append(i)
        for width, rows in by_width.items():
            if width > WIDEST:
                for i in rows:
                    out[i] = self._merge_long(words[i], width)
            else:
                for a in range(0, len(rows), 1 << 14):
                    some = rows[a : a + (1 << 14)]
                    for i, ids in zip(some, self._merge_rows([words[i] for i in some], max(width, 2))):
                        out[i] = ids
        return out

    def _merge_rows(self, words: list[bytes], width: int) -> list[list[int]]:
        count = len(words)
        size = np.fromiter(map(len, words), np.int64, count)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(count, width)
        place = np.arange(width)
        ids = self.inner[raw]
        every = np.arange(count)
        ids[every, size - 1] = self.final[raw[every, size - 1]]
        after = np.where(place + 1 < size[:, None], place + 1, -1)
        before = np.broadcast_to(place - 1, (count, width)).copy()
        tree = np.full((count, 2 * width), _INF, np.int64)
        result = np.full((count, width), -1, np.int32)
        rank, new = self.table.find(ids[:, :-1].ravel(), ids[:, 1:].ravel())
        rank, new = rank.reshape(count, -1), new.reshape(count, -1)
        mergeable = (rank >= 0) & (after[:, :-1] >= 0)
        tree[:, width:-1] = np.where(mergeable, rank.astype(np.int64) * width + place[:-1], _INF)
        result[:, :-1] = new
        at = width
        while at > 1:
            at //= 2
            tree[:, at : 2 * at] = np.minimum(tree[:, 2 * at : 4 * at : 2], tree[:, 2 * at + 1 : 4 * at : 2])
        alive = np.flatnonzero(tree[:, 1] < _INF)
        while len(alive):
            pos = tree[alive, 1] % width
            gone = after[alive, pos]
            follower = after[alive, gone]
            leader = before[alive, pos]
            new_id = result[alive, pos]
            ids[alive, pos] = new_id
            after[alive, pos] = follower
            has_f, has_l = follower >= 0, leader >= 0
            before[alive[has_f], follower[has_f]] = pos[has_f]
            tree[alive, width + gone] = _INF
            self._set_leaf(tree, result, width, alive, pos, new_id, ids[alive, np.where(has_f, follower, 0)], has_f)
            here = np.where(has_l, leader, pos)
            some = np.flatnonzero(has_l)
            if len(some):
                self._set_leaf(tree, result, width, alive[some], leader[some], ids[alive[some], leader[some]], new_id[some], np.ones(len(some), bool))
            nodes = [(width + x) >> 1 for x in (gone, pos, here)]
            while nodes[0][0]:
                for node in nodes:
                    tree[alive, node] = np.minimum(tree[alive, 2 * node], tree[alive, 2 * node + 1])
                nodes = [node >> 1 for node in nodes]
            alive = alive[tree[alive, 1] < _INF]
        keep = np.zeros((count, width), bool)
        live = np.zeros(count, np.int64)
        rows = every
        while len(rows):
            keep[rows, live[rows]] = True
            live[rows] = after[rows, live[rows]]
            rows = rows[live[rows] >= 0]
        flat, ends = ids[keep].tolist(), np.cumsum(keep.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _set_leaf(self, tree, result, width, rows, pos, left, right, valid) -> None:
        rank, new = self.table.find(left, right)
        tree[rows, width + pos] = np.where(valid & (rank >= 0), rank.astype(np.int64) * width + pos, _INF)
        result[rows, pos] = new

    def _merge_long(self, word: bytes, width: int) -> list[int]:
        """One long word with a tree of its own."""
        n, n_ids, exact = len(word), self.table.n_ids, self.table.exact
        raw = np.frombuffer(word, np.uint8)
        ids = self.inner[raw].tolist()
        ids[-1] = int(self.final[raw[-1]])
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        none, inf = (-1, -1), int(_INF)
        found = [exact.get(a * n_ids + b, none) for a, b in zip(ids, ids[1:])] + [none]
        tree = [inf] * (2 * width)
        tree[width : width + n] = [r * width + i if r >= 0 else inf for i, (r, _) in enumerate(found)]
        result = [x for _, x in found]
        for at in range(width - 1, 0, -1):
            tree[at] = min(tree[2 * at], tree[2 * at + 1])

        def put(i: int, value: int) -> None:
            at = width + i
            tree[at] = value
            at >>= 1
            while at:
                least = min(tree[2 * at], tree[2 * at + 1])
                if tree[at] == least:
                    return
                tree[at] = least
                at >>= 1

        def leaf(i: int) -> None:
            j = after[i]
            rank, result[i] = exact.get(ids[i] * n_ids + ids[j], none) if j >= 0 else none
            put(i, rank * width + i if rank >= 0 else inf)

        while tree[1] < inf:
            i = tree[1] % width
            j = after[i]
            ids[i] = result[i]
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            put(j, inf)
            leaf(i)
            if before[i] >= 0:
                leaf(before[i])
        out, i = [], 0
        while i >= 0:
            out.append(ids[i])
            i = after[i]
        return out

    # ---- texts ----

    def split(self, text: str) -> list[str]:
        """The words of a text without special strings: NFC, lower case by character, cut by the pattern.

        Code points that this Python's tables do not know may have a class in the library's: texts
        that hold one are normalised and cut by the library itself.
        """
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in text):
            # Loaded when first needed: most workers never see such a text.
            self.library = self.library or library_tokenizer(self.path)
            text = self.library.normalizer.normalize_str(text)
            return [bytes([self.byte_of[c] for c in w]).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        text = unicodedata.normalize("NFC", text)
        # str.lower() treats a final capital sigma by its context; the library lowers each character alone.
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        return self.words.findall(text)

    def _parts(self, piece: str) -> list[str | int]:
        if not self.split_special or "<|" not in piece:
            return self.split(piece)
        out, a = [], 0
        for m in self.split_special.finditer(piece):
            out += self.split(piece[a : m.start()])
            out.append(self.special[m.group()])
            a = m.end()
        return out + self.split(piece[a:])

    def _encode_words(self, words: list[str]) -> list[tuple[int, str, str]]:
        names = self.names
        return [
            (len(ids), " ".join(map(str, ids)), self.decode(ids, names)) for ids in self.merge([w.encode() for w in words])
        ]

    @staticmethod
    def decode(ids: list[int], names: list[str]) -> str:
        """Without a decoder the library joins the tokens' names by one blank."""
        return " ".join([names[i] for i in ids])

    def _plain(self, piece: str) -> tuple[str, str] | None:
        """Word and closing mark of a piece that is one word with at most one mark; else none."""
        word, mark = (piece[:-1], piece[-1]) if piece and piece[-1] in MARKS else (piece, "")
        if not word.isalpha() or "Σ" in word or not (word.isascii() or unicodedata.is_normalized("NFC", word)):
            return None
        word = word.lower()
        return (word, mark) if word.isalpha() else None

    def _encode_pieces(self, pieces: list[str]) -> list[tuple[int, str, str]]:
        plain = [self._plain(p) for p in pieces]
        parts = {p: self._parts(p) for p, x in zip(pieces, plain) if x is None}
        wanted = {x[0] for x in plain if x}.union(MARKS)
        wanted.update(w for p in parts.values() for w in p if isinstance(w, str))
        self.known.learn(wanted)
        known, out = self.known, []
        marks = {m: known[m] for m in MARKS}
        for p, x in zip(pieces, plain):
            if x:
                n, ids, decoded = got = known[x[0]]
                if x[1]:
                    m = marks[x[1]]
                    got = (n + m[0], f"{ids} {m[1]}", f"{decoded} {m[2]}")
                out.append(got)
            else:
                got = [known[w] if isinstance(w, str) else (1, str(w), self.names[w]) for w in parts[p]]
                out.append((sum([y[0] for y in got]), " ".join([y[1] for y in got]), " ".join([y[2] for y in got])))
        known.trim()
        return out

    def texts(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, ids in decimal and decoded text of each text.

        Blank and line feed part a text for certain: no word, special string or composition spans them.
        """
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        self.pieces.learn(set().union(*cut))
        get = self.pieces.__getitem__
        out = []
        for pieces in cut:
            got = [x for x in map(get, pieces) if x[0]]
            out.append((sum([x[0] for x in got]), " ".join([x[1] for x in got]), " ".join([x[2] for x in got])))
        self.pieces.trim()
        return out


_MODELS: dict[str, SegmentTreeBpe] = {}


def model(path: str) -> SegmentTreeBpe:
    """One model, with its caches, for each worker process."""
    if path not in _MODELS:
        _MODELS[path] = SegmentTreeBpe(path)
    return _MODELS[path]


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


ENCODED = "doc_id long, n_tokens long, ids array<int>, decoded string"


def bpe_encode(docs: DataFrame, path: Callable[[], str] = _default_path) -> DataFrame:
    """Ids and decoded text of every text; one row per input row, null text is empty (no ids)."""

    def run(batches):
        bpe = model(path())
        for batch in slices(batches, limit=STEP):
            got = bpe.texts(batch.column(1).to_pylist())
            ids = [np.array(x[1].split(), np.int32) for x in got]
            columns = [batch.column(0), pa.array([x[0] for x in got], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([x[2] for x in got])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"])

    return keyed_text(docs).mapInArrow(run, ENCODED)


def bpe_digest(docs: DataFrame, path: Callable[[], str] = _default_path) -> DataFrame:
    """Number of ids and digests of the ids and of the decoded text.

    One row per input row: null text is empty (no ids, digests of nothing), repeated rows repeat,
    a null id stays null, an empty table gives none, other columns are ignored.
    """

    def run(batches):
        bpe = model(path())
        sha = hashlib.sha256
        for batch in slices(batches, limit=STEP):
            got = bpe.texts(batch.column(1).to_pylist())
            columns = [
                batch.column(0),
                pa.array([x[0] for x in got], pa.int64()),
                pa.array([sha(x[1].encode()).hexdigest() for x in got]),
                pa.array([sha(x[2].encode()).hexdigest() for x in got]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        # The worker may go on with other operators' tasks.
        bpe.known.clear()
        bpe.pieces.clear()
        give_back()

    return keyed_text(docs).mapInArrow(run, SCHEMA)


def op5_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(documents(spark, sf_dir))


QUERIES = {"op5_bpe_segment_tree": op5_bpe_segment_tree}
ORACLES: dict[str, str] = {}
