"""Decontamination: of a text only n-grams of the items' words are hashed."""

import random

from corrobora.llm import decontaminate


def test_seeds_of_known_words():
    rng = random.Random(2)
    for _ in range(200):
        items = [[rng.choice("abcdef") for _ in range(rng.randrange(1, 9))] for _ in range(3)]
        words = [rng.choice("abcdefghij") for _ in range(rng.randrange(0, 30))]
        known = {w for x in items for w in x}
        place, seeds = decontaminate.Vocabulary(items, 3).seeds(words)
        every = decontaminate.seeds_of(words, 3)
        assert place.tolist() == [i for i in range(len(every)) if set(words[i : i + 3]) <= known]
        assert seeds.tolist() == every[place].tolist()
