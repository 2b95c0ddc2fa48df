"""License scans of very long texts against brute force."""

import collections
import math
import random

from talus.llm import license_scan


def _best(words, template):
    """Greatest number of a template's shingles in any window of its length, by a running count."""
    wanted = set(license_scan._shingles(license_scan.words_of(template)))
    span = math.ceil(len(license_scan.words_of(template)) * license_scan.SLACK) - license_scan.SHINGLE + 1
    held, best, shingles = collections.Counter(), 0, license_scan._shingles(words)
    for i, s in enumerate(shingles):
        if s in wanted:
            held[s] += 1
        if i >= span and shingles[i - span] in wanted:
            old = shingles[i - span]
            held[old] -= 1
            if not held[old]:
                del held[old]
        best = max(best, len(held))
    return len(wanted), best


def _text(rng, n):
    """Templates in any order, some with words changed, put in or left out, between words of no license."""
    words = []
    while len(words) < n:
        body = license_scan.words_of(rng.choice(list(license_scan.TEMPLATES.values())))
        for _ in range(rng.choice([0, 0, 1, 3])):
            body[rng.randrange(len(body))] = rng.choice(["other", "license", "the"])
        if rng.random() < 0.3:
            body.insert(rng.randrange(len(body)), "inserted")
        words += body + [rng.choice(["lorem", "ipsum"]) for _ in range(rng.randint(0, 30))]
    return " ".join(words[:n])


def test_a_hundred_thousand_template_words(spark):
    rng = random.Random(4)
    texts = {1: _text(rng, 100_000), 2: _text(rng, 700), 3: "lorem " * 60_000 + license_scan.TEMPLATES["MIT-permission"], 4: "the license " * 50_000}
    for at in (505, 508, 511, 512, 515):
        texts[at] = "lorem " * at + license_scan.TEMPLATES["Apache-2.0-notice"].replace("Licensed", "Given") + " ipsum" * 700
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = set()
    for k, text in texts.items():
        words = license_scan.words_of(text)
        for name, template in license_scan.TEMPLATES.items():
            n, found = _best(words, template)
            if found / n >= license_scan.SIMILARITY:
                want.add((k, name, n, found))
    got = {(r["doc_id"], r["license"], r["n_shingles"], r["n_found"]) for r in license_scan.license_scan(df).collect()}
    assert len({x[1] for x in want if x[0] == 1}) == len(license_scan.TEMPLATES)
    assert got == want
