"""SentencePiece chunks, fill-in-middle cuts, source divergence and the piece caches against brute force."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from talus.llm import fill_in_middle, language_id, sentence_pieces, source_divergence
from talus.llm.fill_in_middle import Rules
from talus.llm.pieces import ByteEncoder, Cache, WordCounter, library_tokenizer

PARTS = ["a", "b", " ", "  ", "\n", "\n\n", " \n", "▁", "\t", "é", "中", "\x00", "<s>", "</s>", "<unk>", "the", " of", "\xa0", " ", "ﬁ", "🙂", "⁇", "\r\n", "<P>", "<S", ">"]
SCHEMA = "doc_id long, text string, lang string, source string, n long, form string, output string, term string, value long"


def texts(n=400, seed=5):
    rng = random.Random(seed)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]
    return [*out, "", " ", "\n", "▁", "word " * 30_000, "x" * 50_000, out[3], out[3]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, None, 1, "f", "o", "t", 1) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, (len(rows), None, None, None, 1, "f", "o", "t", 1), (None, "a\nb", None, None, 1, "f", "o", "t", 1)], SCHEMA)


def test_pieces_equal_the_library(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces._default_path())
    got = {(r["doc_id"]): r for r in sentence_pieces.piece_encode(docs).collect()}
    digests = {(r["doc_id"]): r for r in sentence_pieces.piece_digest(docs).collect()}
    source = docs.collect()
    assert len(got) == len(digests) == len(source)
    for r in source:
        ids = library.encode(r["text"] or "", add_eos=True)
        g, d = got[r["doc_id"]], digests[r["doc_id"]]
        assert (g["n_tokens"], list(g["ids"]), g["decoded"]) == (len(ids), ids, library.decode(ids))
        assert d["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert d["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_of_every_code_point():
    table = sentence_pieces.ChunkTable(sentence_pieces._default_path())
    assert table.chunked and table.feeds
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(points), 50_000):
        part = [f"a{c}b {c} {c}\n{c}" for c in points[a : a + 50_000]]
        assert table.texts(part) == [table.whole(t) for t in part]


def test_segmented_once_a_window():
    table = sentence_pieces.ChunkTable(sentence_pieces._default_path())
    asked = []
    compute = table.table.compute
    table.table.compute = lambda chunks: asked.extend(chunks) or compute(chunks)
    table.texts(["one two one", "two one  two\none"])
    assert sorted(asked) == sorted(["one", "two", " two", "\none"])


def test_pieces_of_nothing(docs):
    assert sentence_pieces.piece_encode(docs.limit(0)).count() == 0


def test_cache_keeps_what_is_asked_for():
    asked = collections.Counter()
    cache = Cache(lambda pieces: asked.update(pieces) or [len(p) for p in pieces], bound=100)
    for k in range(200):
        cache.learn({"often", *(f"rare{k}-{i}" for i in range(10))})
        assert cache["often"] == 5
        cache.trim()
    assert asked["often"] == 1 and len(cache) + len(cache.old) <= 120


def test_encoders_equal_the_library():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoder = library_tokenizer(path), ByteEncoder(path)
    assert encoder.ranks is not None
    rng = random.Random(2)
    letters = "abcdeXYZ0123456789.,;:'!?-_<|>§«»ßéÀŁ­̀٠αж中"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    lines = [" ".join(words[a : a + 7]) + rng.choice(["", "\n", "\nmore", "  ", " <|endoftext|> x", "'s"]) for a in range(0, len(words), 7)]
    lines += texts()
    want = [x.ids for x in library.encode_batch_fast(lines, add_special_tokens=False)]
    import numpy as np

    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(lines)] == want
    path = public_tokenizers.path("word_bpe_49k.json")
    want = [len(x.ids) for x in library_tokenizer(path).encode_batch_fast(lines, add_special_tokens=False)]
    assert WordCounter(path).counts(lines) == want


def test_letters_by_definition():
    assert not any(map(language_id.has_letter, ["", "²½", "½ 12", "Ⅷ ①", "_-1", "́"]))
    assert all(map(language_id.has_letter, ["12a", "ª", "é", "中"]))


# Fill-in-middle


def cut(doc_id, text, seed=7, rate=100, spm=50, pattern=r"[^\n]*\n|[^\n]+"):
    units = re.findall(pattern, text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[a : a + 8], 16) for a in range(0, 32, 8)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize(
    "rules, pattern", [(Rules(), r"[^\n]*\n|[^\n]+"), (Rules("word", 60, 30, 9), r"\s+|\S+"), (Rules("char", 90, 80, 1), r"(?s).")]
)
def test_cuts_equal_brute_force(docs, rules, pattern):
    made = fill_in_middle.fill_in_middle(docs, rules).withColumn("back", fill_in_middle.restored())
    got = {r["doc_id"]: r for r in made.collect()}
    forms = set()
    for r in docs.collect():
        text, g = r["text"] or "", got[r["doc_id"]]
        if rules.unit == "word" and re.search("[\x1c-\x1f]", text):
            continue
        want = cut(r["doc_id"], text, rules.seed, rules.rate, rules.spm, pattern)
        assert (g["n"], g["form"], g["prefix_chars"], g["middle_chars"], g["output"]) == want
        assert g["back"] == text
        forms.add(g["form"])
    assert forms == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(docs.limit(0), rules).count() == 0


def test_unknown_unit_is_refused():
    with pytest.raises(ValueError):
        fill_in_middle.transform(1, "ab", Rules("page"))


# Source divergence


def audit(rows, min_docs=3, top=200):
    groups, frequency = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, text in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        groups[lang or "", source or ""].update(words)
        frequency[lang or ""].update(set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in frequency[lang].items() if n >= min_docs)
        sources = [s for x, s in groups if x == lang]

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        whole = shares(sum((groups[lang, s] for s in sources), collections.Counter()))
        by = {s: shares(groups[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum((by[s][t] - by[o][t]) ** 2 // by[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((by[s][t] - whole[t]) ** 2 // whole[t], t) for t in kept if groups[lang, s][t] and by[s][t] > whole[t]]
            for part, found, last in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:last])}
    return out


def divergence_rows():
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("w", "Éa", "ж", "K", "zz") for b in "abcdefgh"]
    rows = [("en", f"s{rng.randint(0, 11)}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for _ in range(300)]
    rows += [("en", "hot", "wa Wa wa-wb_3wc") for _ in range(200)] + [("en", "none", "12 3"), ("en", None, None), (None, "s", "a b"), ("xx", "p", "one"), ("xx", "q", "two")]
    return rows + [("ties", s, "m n o p") for s in ("é", "z", "Z", "a") for _ in range(3)] + rows[:3]


def test_divergence_equals_brute_force(spark):
    rows = divergence_rows()
    df = spark.createDataFrame([(i, t, lang, s, 1, "f", "o", "t", 1) for i, (lang, s, t) in enumerate(rows)], SCHEMA)
    got = [tuple(r) for r in source_divergence.source_divergence(df).collect()]
    assert len(got) == len(set(got)) and set(got) == audit(rows)
    assert source_divergence.source_divergence(df.limit(0)).count() == 0
    few = source_divergence.source_divergence(df, top=2).where("part = 'term'")
    assert few.agg(F.max("rank")).first()[0] == 2


def test_tiles_and_spans_equal_one_tile(spark):
    """Many blocks, chunks and spans, some without any term of a tile's groups, give what one tile gives."""
    rows = divergence_rows()
    df = spark.createDataFrame([(t, lang, s) for lang, s, t in rows], "text string, lang string, source string")
    want = {x for x in audit(rows) if x[2] == "pair"}
    made = source_divergence.Audit(df, chunk=3).pairs(block=2, span=2)
    assert {(r["lang"], r["source"], "pair", r["item"], r["value"], r["rank"]) for r in made.collect()} == want


def test_shares_are_exact_for_large_counts(spark):
    cases = [(n, total, kept) for n in (0, 1, 10**12, 10**15 - 7) for total in (n, n + 3, 10**15) for kept in (1, 7, 10**6) if total >= n]
    df = spark.createDataFrame(cases, "n long, total long, kept long")
    got = [r[0] for r in df.select(source_divergence.share(F.col("n"), F.col("total"), F.col("kept"))).collect()]
    want = [1 + 10**9 * (n + 1) // (total + kept) for n, total, kept in cases]
    assert got == want
    import numpy as np

    assert [int(source_divergence._long_share(np.array([n]), t + k)[0]) for n, t, k in cases] == want
