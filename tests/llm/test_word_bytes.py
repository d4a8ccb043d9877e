"""Packing: the ids of many words become bytes in one go."""

import random

from corrobora.llm import pieces, queries


def test_words_as_bytes_in_one_go():
    path = queries.vocabulary("byte_bpe_50k.json")
    words = [" " + "".join(random.Random(i).choice("abcdeéßж") for _ in range(1 + i % 12)) for i in range(9000)]
    assert pieces.encode_words(path, words, pieces.ids_as_bytes) == [pieces.ids_as_bytes(x) for x in pieces.encode(path, words)]
