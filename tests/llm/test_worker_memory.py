"""What a Python worker holds while it tokenises texts and reads their trigrams."""

import random
import tracemalloc

import numpy as np

from fieldglass.llm import language, packing
from fieldglass.llm.queries import tokenizer_path


def test_frequent_words_stay_known_and_rare_ones_go(monkeypatch):
    monkeypatch.setattr(packing, "_CACHE", 400)
    encode, learned, plain = packing.WordTokenizer(tokenizer_path()), [], packing.WordTokenizer._learn
    monkeypatch.setattr(packing.WordTokenizer, "_learn", lambda self, words: learned.extend(words) or plain(self, words))
    draw, held = random.Random(2), []
    for _ in range(60):
        text = " ".join(["often", *["".join(draw.choices("abcdefghij", k=7)) for _ in range(100)], "naïve", "often"])
        expected = np.array(encode.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert encode.ids([text]) == [expected]
        held.append(len(encode.words) + len(encode.older))
    assert learned.count("often") == learned.count("naïve") == 1 and max(held) <= 2 * (400 + 102)
    encode.rest()
    assert len(encode.words) + len(encode.older) <= 400 + 102 and encode.ids([text]) == [expected]


def test_trigrams_of_a_block_take_few_copies():
    texts = ["some words of a text " * 100] * (language._BLOCK // 2100)
    language.trigrams(texts[:1])
    tracemalloc.start()
    buckets, places = language.trigrams(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(buckets) == places[-1] == len(texts) * (places[1] - places[0])
    assert peak < 40 * language._BLOCK


def test_trigrams_end_with_their_text():
    texts = ["", "a", "ab", "abc", "  ", "a b", "abcd", "", "é1é"]
    buckets, places = language.trigrams(texts)
    alone = [language.trigrams([t])[0] for t in texts]
    assert [len(a) for a in alone] == list(np.diff(places))
    for i, found in enumerate(alone):
        assert list(found) == list(buckets[places[i]: places[i + 1]])
