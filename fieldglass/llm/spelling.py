"""Spelling variants: words one edit apart, found through pivotal grams, and the form each goes back to.

A word's bigrams are ordered from rare to frequent. Its prefix are the first three of them; its pivots
are two disjoint ones of the prefix, the rarest such choice by dynamic programming. One edit leaves
untouched a pivot of the word whose prefix ends earlier, with all that stands beyond it, so the other
word has that pivot in its prefix, at a place that the lengths fix. Keys that hold a pivot and the
untouched part are joined with the keys of the other words' prefixes, and the pairs that meet are
verified. Only distinct words take part, after counting.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.tables import discard, keep_once

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH = 5
LEAST_COUNT = 3
ONE_IN = 97  # runs that lose a code point
GRAM = 2
PREFIX = 3  # grams; one edit touches two at most
_LOWER = {code: code + 32 for code in range(ord("A"), ord("Z") + 1)}


def misspelt_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n): every letter run of the whole texts, lower-cased (A-Z only); about one in 97 loses a code point.

    Which runs and which code point follow from the crc32 of `<id>:<run>`. Counts are of one batch of
    texts and still to be summed. A null id counts as an empty one, a null text has no runs.
    """
    run = re.compile(RUN)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: Counter[str] = Counter()
            for name, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                of_text: Counter[str] = Counter()
                for found, n in Counter(run.findall(text)).items():
                    of_text[found.lower() if found.isascii() else found.translate(_LOWER)] += n
                for word, n in of_text.items():
                    h = zlib.crc32(f"{name}:{word}".encode())
                    if h % ONE_IN == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    words[word] += n
            yield pa.record_batch({"word": pa.array(list(words), pa.string()), "n": pa.array(list(words.values()), pa.int64())})

    texts = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    return texts.mapInArrow(count, "word string, n bigint")


def counted(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough, from counts (word, n) of parts of the texts."""
    long = words.where(F.char_length("word") >= least_length)
    return keep_once(long.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count), "vocabulary")


def rarest_disjoint(places: list[int], weights: list[int], k: int = 2) -> list[int]:
    """Indices of k grams that do not overlap and have the least total weight; grams are given by ascending place."""
    n, nothing = len(places), (float("inf"), ())
    best = [(0, ())] * (n + 1)
    for _ in range(k):
        now = [nothing]
        for i in range(n):
            free = i
            while free and places[free - 1] > places[i] - GRAM:
                free -= 1
            total, chosen = best[free]
            now.append(min(now[i], (total + weights[i], (*chosen, i))))
        best = now
    return list(best[n][1])


def gram_frequencies(words: DataFrame) -> dict[str, int]:
    """How many places of the words each bigram has. RUN has 90 lower-cased letters, so there are 8,100 bigrams at most."""
    places = F.sequence(F.lit(1), F.char_length("word") - GRAM + 1)
    grams = words.select(F.explode(F.transform(places, lambda p: F.substring("word", p, F.lit(GRAM)))).alias("gram"))
    return {gram: n for gram, n in grams.groupBy("gram").count().collect()}


def pivot_keys(word: str, a: int, b: int) -> list[str]:
    """The word without the part that one edit changed: up to the first pivot, between the pivots, from the second one on."""
    return [f"<{word[a + GRAM:]}", f"{word[:a + GRAM]}|{word[b:]}", f"{word[:b]}>"]


def prefix_keys(word: str, places: list[int]) -> list[str]:
    """Every key by which another word's pivots can meet the grams at these places of the word."""
    ends = [f"<{word[j:]}" for j in range(1, places[-1] + 1)]
    middles = [f"{word[:x + GRAM]}|{word[y:]}" for x in places for y in places if y >= x + GRAM]
    starts = [f"{word[:j]}>" for j in range(places[0] + GRAM, len(word) + 1)]
    return ends + middles + starts


def signatures(words: DataFrame) -> DataFrame:
    """(word, length, key, pivot): the keys of a word's two pivots, and those of its prefix."""
    frequency = gram_frequencies(words)
    rank = {gram: i for i, (_, gram) in enumerate(sorted((n, gram) for gram, n in frequency.items()))}

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, keys, of_pivot = [], [], []
            for word in batch["word"].to_pylist():
                grams = [word[i:i + GRAM] for i in range(len(word) - GRAM + 1)]
                ranks = [rank[g] for g in grams]
                last = sorted(ranks)[PREFIX - 1]
                # Every place of the last gram belongs to the prefix, so a repeated gram is never missed.
                places = [i for i, r in enumerate(ranks) if r <= last]
                a, b = (places[i] for i in rarest_disjoint(places, [frequency[grams[i]] for i in places]))
                own = [*pivot_keys(word, a, b), *prefix_keys(word, places)]
                words += [word] * len(own)
                keys += own
                of_pivot += [i < 3 for i in range(len(own))]
            yield pa.record_batch({
                "word": pa.array(words, pa.string()), "key": pa.array(keys, pa.string()), "pivot": pa.array(of_pivot, pa.bool_())})

    signed = words.select("word").mapInArrow(sign, "word string, key string, pivot boolean")
    return signed.withColumn("length", F.char_length("word"))


def _halves_agree(a: str, b: str) -> Column:
    """True of every two words that one edit tells apart: they begin or end alike over half of the shorter one."""
    shorter = F.least(F.char_length(a), F.char_length(b))
    half = (shorter / 2).cast("int")
    begin = F.substring(a, F.lit(1), half) == F.substring(b, F.lit(1), half)
    return begin | (F.right(F.col(a), shorter - half) == F.right(F.col(b), shorter - half))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near): distinct words of `word` that differ by one inserted, deleted or replaced code point, in both directions.

    Words need four code points at least, so that a prefix exists.
    """
    signed = keep_once(signatures(words), "grams")
    pivots = signed.where("pivot").select(
        F.col("word").alias("near"), "key", F.explode(F.array(*[F.col("length") + d for d in (-1, 0, 1)])).alias("length"))
    met = signed.where("not pivot").select("word", "key", "length").join(pivots, ["key", "length"])
    met = met.where((F.col("word") != F.col("near")) & _halves_agree("word", "near")).where(F.levenshtein("word", "near", 1) == 1)
    pairs = met.select(F.least("word", "near").alias("word"), F.greatest("word", "near").alias("near")).distinct()
    return pairs.union(pairs.select("near", "word"))


def with_roots(chosen: DataFrame, root: str = "root") -> DataFrame:
    """Rows (word, form, ...) with the end of the chain of forms that starts at the word, by pointer doubling; forms must not run in circles."""
    chain = keep_once(chosen.where("form is not null").select("word", F.col("form").alias("up")), "forms")
    while True:
        step = keep_once(
            chain.join(chain.select(F.col("word").alias("up"), F.col("up").alias("next")), "up", "left")
            .select("word", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "forms")
        discard(chain)
        chain = step.select("word", "up")
        if step.where("moved").isEmpty():
            break
    return chosen.join(chain.withColumnRenamed("up", root), "word", "left").withColumn(root, F.coalesce(root, "word"))


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """Of counted words (word, n) of four code points or more, one row each: word, form, root, n, n_near, form_n.

    A word's form is its near word of largest n, ties to the smallest in code point order, if that n is at
    least `ratio` times the word's own; counts grow along forms, so they end at a root. An empty table gives no rows.
    """
    counts = words.select("word", "n")
    best = near_words(counts).join(counts.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best"))
    taken = -F.col("best.minus") >= ratio * F.col("n")
    chosen = keep_once(counts.join(best, "word", "left").select(
        "word", F.when(taken, F.col("best.near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, -F.col("best.minus")).alias("form_n")), "forms-chosen")
    return with_roots(chosen).select("word", "form", "root", "n", "n_near", "form_n")
