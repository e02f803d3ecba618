"""Spelling variants against brute force."""

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from fieldglass.llm import spelling

SCHEMA = "doc_id bigint, text string, id string, run string, h bigint, word string, gram string"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_words(rows):
    lower = {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            yield run[: h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def plain_variants(counts):
    near = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if abs(len(a) - len(b)) <= 1 and distance(a, b) == 1:
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), form[w] and counts[form[w]]) for w, n in counts.items()}


def invented_words(seed, size, letters):
    rng = np.random.default_rng(seed)
    words = {"".join(rng.choice(letters, rng.integers(5, 9))) for _ in range(size)}
    for w in sorted(words)[: size // 2]:
        at = int(rng.integers(len(w)))
        words.add([w[:at] + w[at + 1:], w[:at] + str(rng.choice(letters)) + w[at:], w[:at] + str(rng.choice(letters)) + w[at + 1:]][int(rng.integers(3))])
    return {w: int(2 ** rng.integers(2, 12)) for w in sorted(words)}


@pytest.mark.parametrize("letters", [list("ab"), list("abc"), list("abcdeé")])
def test_near_words_and_roots_by_brute_force(spark, letters):
    counts = invented_words(len(letters), 200, letters)
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    out = {tuple(r) for r in spelling.variants(words).collect()}
    assert out == plain_variants(counts)


def test_words_of_documents(spark):
    rows = [
        (1, "Lantern lantern LANTERN lantrn École école ab×cd"), (2, None), (3, ""), (None, "lantern lanterns"), (1, "Lantern lantern"),
        (4, " ".join(f"harbour{'x' * (i % 3)}" for i in range(3000))), (5, "a" * 70_000 + " 1harbour2harbour_harbou"),
    ]
    docs = spark.createDataFrame([(i, t, "clash", "clash", 1, "clash", "clash") for i, t in rows], SCHEMA)
    found = Counter()
    for word, n in spelling.misspelt_counts(docs).collect():
        found[word] += n
    assert found == Counter(plain_words(rows))
    counts = {w: n for w, n in Counter(plain_words(rows)).items() if len(w) >= 5 and n >= 3}
    counted = spelling.counted(spelling.misspelt_counts(docs))
    assert {tuple(r) for r in counted.collect()} == set(counts.items())
    assert {tuple(r) for r in spelling.variants(counted).collect()} == plain_variants(counts)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert spelling.variants(spelling.counted(spelling.misspelt_counts(docs))).collect() == []


def test_rarest_disjoint_is_the_least_of_all_choices():
    rng = np.random.default_rng(3)
    for _ in range(200):
        places = sorted(rng.choice(12, 6, replace=False).tolist())
        weights = rng.integers(1, 50, 6).tolist()
        fits = [c for c in combinations(range(6), 2) if places[c[1]] - places[c[0]] >= 2]
        chosen = spelling.rarest_disjoint(places, weights, 2)
        assert tuple(chosen) in fits and sum(weights[i] for i in chosen) == min(sum(weights[i] for i in c) for c in fits)
