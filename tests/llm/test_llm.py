"""The corpus operators against brute force on small fixtures, and their defined edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from talus.llm import language_id, license_scan, media, mixing, segment_bpe, simhash, substring_dedup, token_counts, token_files, vp_tree
from talus.llm.pieces import library_tokenizer
from talus.llm.suffix_array import repeated_windows, suffix_array

WORDS = ["the", "Licence", "naïve", "über", "don't", "x1", "ΣΑΣ", "a" * 40, "é", "<|endoftext|>", "中文", "...", "a.\nb"]


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    texts += ["", "  two  blanks ", "tab\there\n\nlines\x85odd\x1c", "z" * 3000, texts[0], texts[0]]
    return texts


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Null text and null source, repeated rows, and extra columns that clash with results and helpers."""
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None][i % 3], 7, 7, 7) for i, t in enumerate(texts)]
    rows += [(len(texts), None, None, None, 7, 7, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int, size int, fp int")


@pytest.fixture(scope="module")
def all_texts(texts):
    return [*texts, ""]


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def ordered(df, key="doc_id"):
    return df.toPandas().sort_values(key).reset_index(drop=True)


def test_media_round_trip(docs, all_texts, empty):
    got = ordered(media.media_digest(media.text_media(docs)))
    want = [media.padded(t.encode()) for t in all_texts]
    assert got["payload_sha256"].tolist() == [hashlib.sha256(p).hexdigest() for p in want]
    assert got["tail_crc32"].tolist() == [zlib.crc32(p[-16:]) for p in want]
    assert got["payload_bytes"].mod(192).eq(0).all() and got["corrected"].all()
    assert media.media_digest(media.text_media(empty)).count() == 0


def test_sniffing_carves_and_rejects(spark):
    p = media.padded(b"BM RIFF .snd")
    parts = {k: f[1](p) for k, f in media.FORMATS.items()}
    blob = b"noise BM" + b"--".join(parts.values()) + b"RIFF\x10\0\0\0WAVE"
    got = media.sniff_blob(blob)
    assert [x.kind for x in got] == list(parts)
    assert [blob[x.at : x.at + x.size] for x in got] == list(parts.values())
    df = spark.createDataFrame([(1, parts["image/png"], "image/gif"), (2, None, "image/gif"), (3, b"", None), (4, parts["image/bmp"][:-1], "image/bmp")], "k long, b binary, d string")
    rows = {r["row_id"]: r for r in media.sniff(df, "k", "b", "d").collect()}
    assert rows[1]["kind"] == "image/png" and rows[1]["corrected"] and rows[2]["kind"] is None and rows[3]["kind"] is None and rows[4]["kind"] is None


def test_vp_tree_is_exact_with_factor_one(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 6)).astype("f4")
    v[50:60] = v[40]
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    rows += [(400, None, 1), (420, [0.0] * 6, 1), (440, [float("nan")] * 6, 1), (None, v[0].tolist(), 1), rows[20]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = vp_tree.nearest(df, F.col("vec_id") % 20 == 0, factor=1.0, shard_rows=100, block_rows=7, leaf=8).toPandas()
    s = v.astype(float) @ v.astype(float).T
    for q in range(0, 400, 20):
        others = np.array([i for i in range(400) if i != q])
        want = others[np.lexsort((others, -np.round(s[q, others], 9)))][:20]
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == want.tolist()
    assert set(got.query_id) == set(range(0, 400, 20))
    few = vp_tree.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0).toPandas()
    assert sorted(few.vec_id) == [1, 2]
    assert vp_tree.nearest(df.limit(0), F.lit(True)).count() == 0
    odd = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError, match="1 to 2 components"):
        vp_tree.nearest(odd, F.lit(True))


def test_vp_tree_prunes_shards_of_clusters(spark):
    """Groups far apart: over a third of all shards are ruled out, and the result is still exact."""
    rng = np.random.default_rng(9)
    centres = np.eye(8)
    v = centres[rng.integers(8, size=1200)] + rng.normal(0, 0.03, (1200, 8))
    lifted = vp_tree._lifted(v, np.linalg.norm(v, axis=1).max())
    top = vp_tree.Top(lifted[:256], 4, np.linalg.norm(v, axis=1).max())
    shard = top.shard(lifted)
    ranges = [top.ranges(s, lifted[shard == s]) if (shard == s).any() else (np.full(4, np.inf), np.full(4, -np.inf)) for s in range(16)]
    order, least = top.order(v[:50], *(np.array(x) for x in zip(*ranges)))
    far = np.sqrt(((lifted[:50, None, :-1] - lifted[None, :, :-1]) ** 2).sum(2) + lifted[None, :, -1] ** 2)
    for s in range(16):
        if (shard == s).any():
            assert (far[:, shard == s].min(1) >= least[:, s] - 1e-9).all()
    kth = np.sort(far, axis=1)[:, 20]
    assert (least > kth[:, None]).mean() > 1 / 3
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = vp_tree.nearest(df, F.col("vec_id") % 20 == 0, factor=1.0, shard_rows=80, block_rows=16, leaf=8).toPandas()
    s = v @ v.T
    for q in range(0, 1200, 20):
        others = np.array([i for i in range(1200) if i != q])
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == others[np.argsort(-s[q, others])][:20].tolist()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_vp_tree_recall(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    key = F.col("vec_id") % 20 == 0
    near = set(map(tuple, vp_tree.nearest(df, key, shard_rows=256).select("query_id", "vec_id").collect()))
    rows = df.toPandas().sort_values("vec_id")
    v, ids = np.array(rows.embedding.tolist(), float), rows.vec_id.to_numpy()
    exact = set()
    for i in np.flatnonzero(ids % 20 == 0):
        s = v @ v[i]
        s[i] = -np.inf
        exact |= {(ids[i], ids[j]) for j in np.lexsort((ids, -s))[:20]}
    assert len(near & exact) >= 0.9 * len(exact)


def removed(texts, width):
    seen = collections.Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        hit = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                hit[i : i + width] = b"\1" * width
        spans = sum(1 for i in range(len(t)) if hit[i] and (i == 0 or not hit[i - 1]))
        out.append((len(t), sum(hit), spans, hashlib.sha256(bytes(x for x, h in zip(t, hit) if not h)).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [2, 2000])
def test_substring_dedup_matches_brute_force(docs, all_texts, crowd):
    got = ordered(substring_dedup.substring_dedup(docs, width=30, anchors=(10, 20, 26, 30), crowd=crowd))
    want = removed([t.encode() for t in all_texts], 30)
    assert [tuple(r) for r in got[["n_bytes", "n_removed", "n_spans", "kept_sha256"]].values.tolist()] == want


def test_substring_dedup_counts_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "q" * 10 + "abcdefgh" * 5), (1, "abcdefgh" * 5), (None, "short")], "doc_id long, text string")
    rows = substring_dedup.substring_dedup(df, width=30, anchors=(10, 30)).collect()
    assert len(rows) == 3 and sorted(r["n_removed"] for r in rows) == [0, 40, 40]
    assert substring_dedup.substring_dedup(df.limit(0)).count() == 0
    kept = substring_dedup.without_repeats(df, width=30, anchors=(10, 30)).collect()
    assert sorted(r["text"] for r in kept) == ["", "q" * 10, "short"]


def removed_by_digest(texts, width):
    """The same by the digests of all strings, for larger fixtures."""
    seen = collections.Counter(hash(t[i : i + width]) for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        hit = np.zeros(len(t) + 1, int)
        for i in range(len(t) - width + 1):
            if seen[hash(t[i : i + width])] > 1:
                hit[i] += 1
                hit[i + width] -= 1
        gone = np.cumsum(hit)[:-1] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((int(gone.sum()), int((np.diff(np.append(0, gone)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_substring_dedup_of_very_long_texts_and_crowded_passages(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghé ") for _ in range(n))
    passage, line, long = word(420), word(230), word(150_000)
    texts = [word(rng.randint(20, 160)) + passage + word(rng.randint(20, 160)) for _ in range(600)]
    texts += [word(90) + line + word(90) for _ in range(300)] + ["same " * 60] * 400
    # A repeat over the border of two pieces, and a long text that holds most of another one.
    texts += [long, word(50) + long[100_000:140_000] + word(50), long[131_000:131_300], "ab" * 70_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    want = removed_by_digest([t.encode() for t in texts], 200)
    for crowd in (40, 100_000):
        got = ordered(substring_dedup.substring_dedup(df, crowd=crowd))
        assert [tuple(r) for r in got[["n_removed", "n_spans", "kept_sha256"]].values.tolist()] == want


def test_without_repeats_keeps_whole_characters(spark):
    shared = "é€𝄞ü" * 30
    rows = [(1, "xé" + shared + "€y", 5, 6), (2, "q" + shared[1:] + "𝄞", 5, 6), (3, None, 5, 6), (4, "", 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, kept int")
    got = {r.doc_id: r for r in substring_dedup.without_repeats(df, width=30, anchors=(10, 30)).collect()}
    assert got[3].text is None and got[4].text == "" and got[1].row == 5 and got[1].kept == 6
    # Only whole characters go, and at most the three bytes before and after a removed run stay.
    for i, text in ((1, rows[0][1]), (2, rows[1][1])):
        n = substring_dedup.substring_dedup(df, width=30, anchors=(10, 30)).where(f"doc_id = {i}").first().n_removed
        left = got[i].text
        assert "\ufffd" not in left and 0 <= n - (len(text.encode()) - len(left.encode())) <= 6


@pytest.mark.parametrize("groups, small", [(32, 512), (3, 1), (7, 1)])
def test_suffix_arrays(monkeypatch, groups, small):
    monkeypatch.setattr("talus.llm.suffix_array.GROUPS", groups)
    monkeypatch.setattr("talus.llm.suffix_array.SMALL", small)
    rng = np.random.default_rng(5)
    for k in range(80):
        t = rng.integers(1, rng.integers(2, 9), rng.integers(0, 120))
        t = np.tile(t[:5], 20) if k % 7 == 0 else t
        assert suffix_array(t, 257).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert repeated_windows([b"abcab", b"", b"xab"], 2)[0].tolist() == [True, False, False, True]


def test_token_files_match_the_library(docs, all_texts, empty, tmp_path):
    tk = library_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [np.array([*tk.encode(t, add_special_tokens=False).ids, 0], "<u4") for t in all_texts]
    got = ordered(token_files.token_files(docs, f"file://{tmp_path}/t", length=16, rows=4))
    assert got["n_tokens"].tolist() == [len(x) for x in ids]
    assert got["start"].tolist() == np.cumsum([0, *map(len, ids)])[:-1].tolist()
    assert got["ids_crc32"].tolist() == [zlib.crc32(x.tobytes()) for x in ids]
    first = got.iloc[0]
    reader = token_files.SequenceReader(first["file"])
    row, mask = reader.sequence(0)
    assert len(row) == 16 and mask.dtype == bool and reader.file.schema.field("input_ids").type.list_size == 16
    assert row[mask][: len(ids[0])].tolist() == ids[0][:16].tolist()
    assert token_files.token_files(empty, f"file://{tmp_path}/e").count() == 0


def test_segment_tree_bpe_matches_the_library(docs, all_texts, empty):
    tk = library_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    got = ordered(segment_bpe.bpe_digest(docs))
    for r, t in zip(got.itertuples(), all_texts):
        ids = tk.encode(t, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert segment_bpe.bpe_digest(empty).count() == 0


def test_segment_tree_bpe_splits_every_code_point_like_the_library():
    tk, m = library_tokenizer(public_tokenizers.path("word_bpe_49k.json")), segment_bpe.SegmentTreeBpe(public_tokenizers.path("word_bpe_49k.json"))
    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE0200), *range(0x10FF00, 0x110000)]]
    rng = random.Random(12)
    texts = [f"a{c}a" for c in points] + ["".join(rng.choices(points, k=6)) for _ in range(20_000)] + ["Ȑ\U0003ec54"]
    for a in range(0, len(texts), 1 << 14):
        some = texts[a : a + (1 << 14)]
        want = [" ".join(map(str, e.ids)) for e in tk.encode_batch_fast(some, add_special_tokens=False)]
        got = m.texts(some)
        assert [(t, x[1]) for t, x in zip(some, got)] == list(zip(some, want))
        assert [x[2] for x in got] == tk.decode_batch([list(map(int, w.split())) for w in want], skip_special_tokens=False)


def test_caches_forget_without_changing_results():
    m = segment_bpe.SegmentTreeBpe(public_tokenizers.path("word_bpe_49k.json"))
    whole = m.texts(corpus())
    m.known.bound = m.pieces.bound = 3
    m.known.clear(), m.pieces.clear()
    assert [m.texts([t])[0] for t in corpus()] == whole


@pytest.fixture(scope="module")
def long_docs(spark):
    """One text beyond every batch and step, an ordinary one, null ids and a repeated id."""
    rng = random.Random(14)
    words = ["the", "quick", "naïve", "über", "don't", "中文", "Licence", "42", "x", "brown."]
    long = " ".join(rng.choices(words, k=1_000_000))
    assert len(long.encode()) > 5 << 20
    rows = [(1, long), (2, "short one"), (None, "no id at all here"), (None, None), (3, "same id"), (3, "another text")]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def test_very_long_texts_and_null_ids(spark, long_docs, tmp_path):
    df, rows = long_docs
    by_text = {t: i for i, t in rows}
    word, byte = (library_tokenizer(public_tokenizers.path(x)) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    ids = {t: word.encode(t or "", add_special_tokens=False).ids for t in by_text}
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])

    def check(got, want):
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)

    sha = lambda b: hashlib.sha256(b).hexdigest()
    check(token_counts.token_counts(df).select("doc_id", "n_tokens").collect(), [(i, len(ids[t])) for i, t in rows])
    check(segment_bpe.bpe_digest(df).select("doc_id", "ids_sha256").collect(), [(i, sha(" ".join(map(str, ids[t])).encode())) for i, t in rows])
    check(media.media_digest(media.text_media(df)).select("doc_id", "payload_sha256").collect(), [(i, sha(media.padded((t or "").encode()))) for i, t in rows])
    files = token_files.token_files(df, f"file://{tmp_path}/long")
    packed = {t: np.array([*byte.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in by_text}
    check(files.select("doc_id", "n_tokens", "ids_crc32").collect(), [(i, len(packed[t]), zlib.crc32(packed[t].tobytes())) for i, t in rows])
    spans = sorted((r.start, r.n_tokens) for r in files.collect())
    assert [a for a, _ in spans] == np.cumsum([0, *[n for _, n in spans]])[:-1].tolist()
    check(simhash.fingerprints(df).collect(), [(i, int(np.uint64(simhash.fingerprint(t or "")).astype(np.int64))) for i, t in rows])
    assert simhash.simhash_components(df).count() == len(rows)
    assert language_id.language_id(df.withColumn("lang", F.lit("en"))).count() == len(rows)
    assert license_scan.license_scan(df).count() == 0
    cut = substring_dedup.substring_dedup(df).select("doc_id", "n_bytes").collect()
    check(cut, [(i, len((t or "").encode())) for i, t in rows])


def test_license_rows_repeat_and_mix_ties_are_settled(spark):
    text = "Released under the MIT License. " + license_scan.TEMPLATES["MIT-permission"]
    df = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (None, text, "a"), (None, text, "b")], "doc_id long, text string, source string")
    got = license_scan.license_scan(df).groupBy("doc_id", "license").count().collect()
    assert {(r.doc_id, r.license) for r in got} >= {(1, "MIT-permission"), (None, "MIT-permission")} and all(r["count"] == 1 for r in got)
    taken = [mixing.mix(df.repartition(n)).orderBy("doc_id", "source_size", "taken").collect() for n in (1, 3)]
    assert taken[0] == taken[1] and len(taken[0]) == 4 and all(r.taken <= 2 * r.size for r in taken[0])


def test_token_counts(docs, all_texts, empty):
    tk = library_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    got = ordered(token_counts.token_counts(docs, limit=20))
    want = [len(tk.encode(t, add_special_tokens=False).ids) for t in all_texts]
    assert got["n_tokens"].tolist() == want
    assert got["n_bytes"].tolist() == [len(t.encode()) for t in all_texts]
    assert got["over_limit"].tolist() == [n > 20 for n in want]
    assert token_counts.token_counts(empty).count() == 0


def test_license_scan_matches_brute_force(spark):
    rng = random.Random(6)
    filler = ["lorem", "ipsum", "dolor", "license", "permission", "the"]
    rows = [(0, None), (1, ""), (2, "MIT License.")]
    for i in range(3, 60):
        words = [rng.choice(filler) for _ in range(rng.randint(0, 60))]
        body = license_scan.words_of(rng.choice(list(license_scan.TEMPLATES.values())))
        for _ in range(rng.randint(0, 2)):
            body[rng.randrange(len(body))] = "changed"
        at = rng.randint(0, len(words))
        rows.append((i, " ".join(words[:at] + body + words[at:])))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, words int, hashes string")
    want = set()
    for i, text in rows:
        w = license_scan.words_of(text or "")
        sh = license_scan._shingles(w)
        for name, template in license_scan.TEMPLATES.items():
            t = license_scan.words_of(template)
            wanted = set(license_scan._shingles(t))
            span = -(-len(t) * 5 // 4) - 4
            most = max((len(wanted & set(sh[p : p + span])) for p in range(len(sh))), default=0)
            if most >= 0.8 * len(wanted):
                want.add((i, name, len(wanted), most))
    got = license_scan.license_scan(df)
    assert {(r["doc_id"], r["license"], r["n_shingles"], r["n_found"]) for r in got.collect()} == want
    assert license_scan.license_scan(df.limit(0)).count() == 0


def test_mix_meets_targets(docs, empty):
    got = mixing.mix(docs).toPandas()
    assert len(got) == docs.count()
    sums = got.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"))
    assert (sums["taken"] == np.floor(sums["target"] + 0.5)).all() and (sums["target"] <= 2 * sums["size"]).all()
    assert (got["taken"] <= 2 * got["size"]).all() and abs(sums["target"].sum() - 1.5 * got["size"].sum()) < 1e-6
    again = mixing.mix(docs.repartition(3)).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == got["taken"].sum()


@pytest.mark.parametrize("bucket", [1, 32])
def test_simhash_components_match_brute_force(spark, bucket, monkeypatch):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (1 << 64) - 1 for b in base for _ in range(12)]
    signed = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), bucket=bucket).collect()
    near = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    assert {tuple(sorted(r)) for r in links} <= near

    def roots(edges):
        up = {f: f for f in signed}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            up[find(a)] = find(b)
        groups = collections.defaultdict(set)
        for f in signed:
            groups[find(f)].add(f)
        return sorted(map(sorted, groups.values()))

    assert roots(map(tuple, links)) == roots(near)


def test_third_index_is_shared_by_all_near_pairs():
    rng = random.Random(13)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for flips in range(3):
        near = [f ^ sum(1 << b for b in rng.sample(range(64), flips)) for f in fps]
        both = np.array(fps + near, np.uint64)
        row, key = simhash.fuzzy_keys(both)
        row2, finer = simhash.third_indices(both[row], key)
        keys = collections.defaultdict(set)
        for r, k in zip(row[row2].tolist(), finer.tolist()):
            keys[r].add(k)
        assert all(keys[i] & keys[i + 300] for i in range(300))


def test_simhash_edges(docs, all_texts, empty):
    got = ordered(simhash.simhash_components(docs))
    assert got["fp"].tolist()[-1] == 0 and got["component_id"].notna().all()
    same = [i for i, t in enumerate(all_texts) if t == all_texts[0]]
    assert got.loc[same, "component_id"].nunique() == 1
    assert (got["component_id"] <= got["doc_id"]).all()
    assert simhash.simhash_components(empty).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == got["component_id"].nunique()


def test_fingerprint_by_definition():
    import xxhash

    for text in ("One two  THREE\nfour five", "only two", "", " \t", "É é"):
        words = [w for w in "".join(c.lower() if c.isascii() else c for c in text).replace("\n", " ").replace("\t", " ").split(" ") if w]
        sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_language_id_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.language_id(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_id_edges(spark, docs, empty):
    got = ordered(language_id.language_id(docs))
    assert got["lang_pred"].iloc[-1] == "und" and set(got["lang_pred"]) <= {"en", "fr", "und"}
    digits = spark.createDataFrame([(1, "123 ...", "en")], "doc_id long, text string, lang string")
    assert language_id.language_id(digits.unionByName(docs.select("doc_id", "text", "lang"))).where("doc_id = 1 and lang_pred = 'und'").count() == 1
    assert language_id.language_id(empty).count() == 0
    one = language_id.language_id(docs.where("lang = 'en' or lang is null")).toPandas()
    assert set(one["lang_pred"]) <= {"en", "und"}


def test_language_sample_is_bounded_for_null_and_repeated_ids(spark, monkeypatch):
    rows = [(None if i % 2 else 7, f"{'hello there' if i % 3 else 'guten tag'} {'x' * (i % 901)}", "de" if i % 3 == 0 else "en") for i in range(6000)]
    seen = {}
    init = language_id.EcocModel.__init__
    monkeypatch.setattr(language_id.EcocModel, "__init__", lambda self, names, samples: (seen.update(samples), init(self, names, samples))[1])
    language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(seen) == {"de", "en"} and all(0 < len(x) <= language_id.SAMPLE_ROWS for x in seen.values())


def test_language_counts_do_not_depend_on_pieces(monkeypatch):
    text = "Straße und 99 Öfen, " * 50
    whole = language_id.counts(text)
    monkeypatch.setattr(language_id, "STEP", 7)
    assert (language_id.counts(text) == whole).all() and whole.sum() > 0


def test_decoding_by_hand(spark):
    """Margins and losses bit by bit, in plain Python, choose the same languages."""
    import math

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(df)
    assert len(model.languages) == 4 and model.code.shape == (4, 7)
    got = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    for r in df.where("text is not null").collect():
        if not any(c.isalpha() for c in r.text):
            assert got[r.doc_id].lang_pred == "und"
            continue
        n = language_id.counts(r.text)
        at = np.flatnonzero(n)
        losses = []
        for word in model.code.tolist():
            loss = 0.0
            for bit, sign in enumerate(word):
                margin = 8 * sum(float(n[i]) * float(model.weights[i, bit]) for i in at) / float(n.sum())
                loss += model.bit_weights[bit] * math.log1p(math.exp(-sign * margin))
            losses.append(loss)
        assert losses[model.languages.index(got[r.doc_id].lang_pred)] <= min(losses) + 1e-5


@pytest.mark.parametrize("n", [2, 4, 7, 12])
def test_codewords_differ(n):
    code = language_id.codewords(n)
    assert len({tuple(r) for r in code.tolist()}) == n and set(np.unique(code)) <= {-1, 1}


def test_stages_keep_columns_that_clash_with_their_helpers(spark):
    names = ["id", "size", "taken", "n", "whole", "part", "copy", "row", "kept", "uid", "fp", "component_id", "key", "marks"]
    text = "some words that repeat " * 12
    rows = [(i, [text + str(i), text, "other words altogether " * 3, None, ""][i % 5], "ab"[i % 2], *range(len(names))) for i in range(10)]
    rows += [(None, text, "a", *range(len(names))), (3, "repeated id", "b", *range(len(names)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    for stage in (simhash.one_of_each, substring_dedup.without_repeats, mixing.mixed):
        got = stage(df)
        assert got.columns == df.columns
        kept = got.collect()
        assert kept and all(list(r)[3:] == list(range(len(names))) for r in kept)
        assert stage(df.limit(0)).count() == 0


def test_pipeline_keeps_columns_and_effects(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    frames = [docs]
    for name, stage in C.STAGES:
        frames.append(C.stored(stage(spark, frames[-1], "/root/testdata/sf0.001"), name))
    assert all(f.columns == docs.columns for f in frames[:-1])
    n = [f.count() for f in frames]
    assert n[0] >= n[1] > n[2] == n[3] and n[4] == n[5]
    words = [f.select(F.sum(mixing.word_count(F.col("text")))).first()[0] for f in frames[3:5]]
    assert abs(words[1] - 1.5 * words[0]) <= 20


def test_each_stage_matches_brute_force_on_its_own_input(spark):
    """Language, copies, repeats, mix and tokens of a small table with odd rows, each judged by plain Python."""
    import corpus_pipeline as C

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(900001, None, "en", "s", 0), (900002, "", "en", "s", 0), (900003, "12 34", None, None, 5), (900004, "é€𝄞 " * 90, "fr", None, 360), (900005, "x" + "é€𝄞 " * 90, "fr", "s", 361)]
    docs = C.stored(docs.unionByName(spark.createDataFrame(odd, docs.schema)), "odd")
    plain = lambda df: sorted(map(tuple, df.select("doc_id", "text").collect()), key=lambda r: (r[0], r[1] or ""))

    kept = C.stored(C.identify_language(spark, docs, ""), "one")
    told = {r.doc_id: r for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    assert plain(kept) == [r for r in plain(docs) if told[r[0]].lang_pred != "und" and not told[r[0]].ambiguous]

    single = C.stored(C.near_dedup(spark, docs, ""), "two")
    rows = plain(docs)
    fps = [simhash.fingerprint(t or "") for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2 and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    # Rows are in order of id, so the least number of a group is its least id.
    assert plain(single) == [rows[i] for i in sorted(set(label))]

    cut = C.stored(C.exact_substrings(spark, docs, ""), "three")
    seen = collections.Counter(hash(t[i : i + 200]) for t in ((t or "").encode() for _, t in rows) for i in range(len(t) - 199))
    want = []
    for i, text in rows:
        t = (text or "").encode()
        hit = np.zeros(len(t) + 1, int)
        for a in range(len(t) - 199):
            if seen[hash(t[a : a + 200])] > 1:
                hit[a] += 1
                hit[a + 200] -= 1
        gone, left, at = np.cumsum(hit) > 0, "", 0
        for c in text or "":
            n = len(c.encode())
            left += "" if gone[at : at + n].all() else c
            at += n
        want.append((i, None if text is None else left))
    assert plain(cut) == want

    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(docs).collect()}
    want = []
    for i, t in rows:
        n, size = taken[i]
        want += [(i, t)] * (n // size if size else 1)
        if size and n % size:
            want.append((i, " ".join([w for w in re.split(r"[\x20\x09-\x0D]+", t) if w][: n % size])))
    assert plain(C.mix_sources(spark, docs, "")) == sorted(want, key=lambda r: (r[0], r[1] or ""))

    tk = library_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r.n_tokens for r in C.encode(spark, docs, "").collect()}
    assert got == {i: len(tk.encode(t or "", add_special_tokens=False).ids) for i, t in rows}


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        docs = C.stored(stage(spark, docs, ""), "empty")
    assert docs.count() == 0


def test_oracle_queries_match_duckdb(spark):
    import duckdb

    from talus.llm import queries as q

    c = duckdb.connect()
    c.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    for name, sql in q.oracle_sql().items():
        a, b = q.queries()[name](spark, "/root/testdata/sf0.001").toPandas(), c.execute(sql).df()
        keys = sorted(b.columns)
        a, b = (x[keys].sort_values(keys).reset_index(drop=True) for x in (a, b))
        pd.testing.assert_frame_equal(a, b, check_dtype=False)
