"""Exact encoding of texts with a library tokenizer through a bounded cache of word pieces.

A text is cut only where the tokenizer can never merge across: pieces then encode
independently of their neighbours, and frequent pieces are encoded once a worker.
"""

from __future__ import annotations

import gc
import json
import os
import re
from itertools import repeat

import numpy as np
import tiktoken

from talus.llm.common import by_bytes

#: Pieces that a worker keeps (about 200 bytes each; twice as many counts, four times as many lists of ids); those not asked for of late are encoded again when they return.
CACHE_PIECES = 300_000
#: Bytes of texts whose pieces are learned together, whatever Arrow batches they come in.
WINDOW = 8 << 20
#: Characters of texts whose pieces are looked up before what is new among them is learned.
_STEP = 1 << 18


def library_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Cache(dict):
    """Values of pieces in two generations: this one, and the one before, which lookups draw from.

    `learn` makes every wanted piece present, from the older generation if it is there; `trim` retires
    this generation once it holds half the bound, and what was not asked for since goes.  Frequent
    pieces therefore stay, however many rare ones pass.
    """

    def __init__(self, compute, bound: int = CACHE_PIECES):
        super().__init__()
        # The entries live long and hold no cycles: collecting young garbage often only walks over them.
        gc.set_threshold(200_000, 50, 1000)
        self.compute, self.bound, self.old = compute, bound, {}

    def learn(self, wanted: set[str]) -> None:
        lacking = [p for p in wanted if p not in self]
        if self.old:
            back = {p: v for p in lacking if (v := self.old.get(p)) is not None}
            self.update(back)
            lacking = [p for p in lacking if p not in back]
        if lacking:
            self.update(zip(lacking, self.compute(lacking)))

    def trim(self) -> None:
        if len(self) > self.bound // 2:
            self.old = dict(self)
            super().clear()

    def clear(self) -> None:
        super().clear()
        self.old = {}


class WordCounter:
    """Token counts under a tokenizer whose pre-tokenizer drops white space (word BPE).

    Blank and line feed separate words for certain: neither composes under NFC with what
    follows, no word pattern spans them and no special string holds them.  Other white space
    stays inside its piece, which the library then splits itself.
    """

    def __init__(self, path: str):
        self.tokenizer = library_tokenizer(path)
        self.cache = Cache(self._lengths, 2 * CACHE_PIECES)

    def _lengths(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        return [n for a, b in by_bytes(texts, _STEP) for n in self._counts(texts[a:b])]

    def _counts(self, texts: list[str]) -> list[int]:
        words = [t.replace("\n", " ").split(" ") for t in texts]
        self.cache.learn(set().union(*words))
        get = self.cache.__getitem__
        out = [sum(map(get, w)) for w in words]
        self.cache.trim()
        return out


#: A blank between two characters that no tokenizer counts as white space.
_SAFE_BLANK = re.compile(r"(?<=\S) (?=\S)")


#: Characters whose classes all tables of Unicode agree on: visible ASCII and the Latin letters that follow it.
_PLAIN = re.compile(r"[!-~\u00a1-\u00ac\u00ae-\u024f]+")
#: Words that are handed to the rank encoder at a time.
_JOINED = 256
#: The pattern that this pre-tokenizer is defined by (fixed value).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


def rank_encoder(path: str):
    """An encoder by ranks for a vocabulary whose ids above the bytes follow the order of its merges; else none.

    There merging by rank of the pair and by id of its result are the same thing.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")]
    if model.get("type") != "BPE" or spec.get("normalizer") or any(odd) or any(cut.get(k) != v for k, v in plain.items()):
        return None
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    results = [vocab[a + b] for a, b in merges]
    back = {s: b for b, s in enumerate(byte_symbols())}
    added = {x["content"] for x in spec.get("added_tokens", [])}
    if any(a >= b for a, b in zip(results, results[1:])) or any(vocab[s] >= results[0] for s in back):
        return None
    ranks = {bytes(map(back.__getitem__, s)): i for s, i in vocab.items() if s not in added}
    return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}), sorted(added)


#: White space other than blank and line feed (fixed values).
_OTHER = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Runs of white space that a plain split would not keep.
_RUNS = ("  ", " \n", "\n ", "\n\n\n")

def odd(text: str) -> bool:
    """Whether a text's white space is more than single blanks, and one or two line feeds, between other characters."""
    return text[0].isspace() or text[-1].isspace() or any(r in text for r in _RUNS) or _OTHER.search(text) is not None


class ByteEncoder:
    """Ids under a byte-level BPE whose words may begin with one blank.

    A single blank or line feed between two non-blank characters is a safe boundary: the blank
    opens the next word and the line feed is a word of its own, whatever surrounds them; of two line
    feeds each is a word.  A piece is a word that follows a blank, or a line feed with what follows it.
    New words of plain characters go many at a time, parted by line feeds, to an encoder of the same
    ranks, which takes a third of the library's time; all others go to the library.
    """

    def __init__(self, path: str, dtype: str = "<u4"):
        self.tokenizer = library_tokenizer(path)
        self.dtype = np.dtype(dtype)
        self.feed = np.array(self.tokenizer.encode("\n", add_special_tokens=False).ids, self.dtype)
        fast = rank_encoder(path) if len(self.feed) == 1 else None
        self.ranks, self.special = fast or (None, [])
        self.pieces = Cache(self._pieces, 4 * CACHE_PIECES)

    def _ids(self, pieces: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in encoded]

    def _words(self, words: list[str], before: str) -> list[bytes]:
        if self.ranks is None:
            return self._ids([before + w for w in words])
        plain = [w for w in words if _PLAIN.fullmatch(w) and not any(s in w for s in self.special)]
        got: dict[str, bytes] = {}
        size = self.dtype.itemsize
        for a in range(0, len(plain), _JOINED):
            part = plain[a : a + _JOINED]
            ids = self.ranks.encode_to_numpy("\n".join([before + w for w in part]), disallowed_special=())
            packed = ids.astype(self.dtype).tobytes()
            ends = [*(np.flatnonzero(ids == self.feed[0]) * size).tolist(), len(packed)]
            starts = [0, *(e + size for e in ends[:-1])]
            got.update(zip(part, (packed[x:y] for x, y in zip(starts, ends))))
        others = [w for w in words if w not in got]
        got.update(zip(others, self._ids([before + w for w in others])))
        return [got[w] for w in words]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        feed = self.feed.tobytes()
        heads = [p[1:] for p in pieces if p[0] == "\n" and len(p) > 1]
        others = [p for p in pieces if p[0] != "\n"]
        got = {"\n" + w: feed + x for w, x in zip(heads, self._words(heads, ""))}
        got.update(zip(others, self._words(others, " ")))
        got["\n"] = feed
        return [got[p] for p in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed integers."""
        return [x for a, b in by_bytes(texts, _STEP) for x in self._encode(texts[a:b])]

    def _encode(self, texts: list[str]) -> list[bytes]:
        known, size = self.pieces, self.feed.nbytes
        out: list[bytes] = []
        # Texts that hold new pieces wait for them: number, ids by piece, places of new ones, first piece if odd.
        waiting: list[tuple[int, list[bytes], list[tuple[int, str]], str | None]] = []
        new: set[str] = set()
        for t in texts:
            first = None
            if not t:
                out.append(b"")
                continue
            if odd(t):
                first, *keys = _SAFE_BLANK.split(t)
            else:
                # As if it followed a line feed, whose id is dropped again.
                keys = ("\n" + t).replace("\n", " \n").split(" ")[1:]
            # Every piece has an id, so nothing stands for what is new.
            got = list(map(known.get, keys, repeat(b"")))
            places, at = [], -1
            for _ in range(got.count(b"")):
                at = got.index(b"", at + 1)
                places.append((at, keys[at]))
                new.add(keys[at])
            if first is None and not places:
                out.append(b"".join(got)[size:])
                continue
            waiting.append((len(out), got, places, first))
            out.append(b"")
        known.learn(new)
        heads = iter(self._ids([w[3] for w in waiting if w[3] is not None]))
        for n, got, places, first in waiting:
            for at, piece in places:
                got[at] = known[piece]
            packed = b"".join(got)
            out[n] = packed[size:] if first is None else next(heads) + packed
        known.trim()
        return out
