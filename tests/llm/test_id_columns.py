"""Packing: the ids of whole columns, with each different piece looked up once."""

import random

import pyarrow as pa
import pytest

from corrobora.llm import pieces, queries, shared

PIECES = ["ab", "Cd", "é", "Ж", "漢", "1", "½", " ", " ", " ", "  ", "\n", "\n\n", ".", ",", ", ", ".\n", "'s", "'", "\t", "\0", "\xa0", "-", "😀", "́", "<|endoftext|>", "<|"]


def of_columns(ids_of, texts, most=1 << 24):
    return [x for run in shared.in_runs(pa.array(texts, pa.large_string()), most) for x in ids_of(run).to_pylist()]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_columns_as_the_library(name):
    path, rng = queries.vocabulary(name), random.Random(3)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(16))) for _ in range(6000)]
    long = "".join(rng.choice("abcXYZ019.,;/-") for _ in range(40000))
    texts += ["", " ", "\n", long, "x " * 9000 + long, "a1" * 9000 + "<|endoftext|>b.."]
    want = [pieces.ids_as_bytes(x) for x in pieces.encode(path, texts)]
    assert of_columns(pieces.Columns(path, memo=500), texts, 1 << 12) == want  # many runs, and most is forgotten
    assert of_columns(pieces.Columns(path), texts) == want
    assert of_columns(pieces.Columns(path), [""]) == [b""]


def test_letters_that_end_no_word():
    path = queries.vocabulary("byte_bpe_50k.json")
    texts = [f"a{c}b {c}d, x{c}. {c}e, y" for c in map(chr, range(0x20, 0x3000))]
    assert of_columns(pieces.Columns(path), texts) == [pieces.ids_as_bytes(x) for x in pieces.encode(path, texts)]


def test_each_piece_is_looked_up_once(monkeypatch):
    merged, cut, words, texts = pieces.merged, pieces.cut, [], []
    monkeypatch.setattr(pieces, "merged", lambda path, own: words.extend(own) or merged(path, own))
    monkeypatch.setattr(pieces, "cut", lambda text, keep: texts.append(text) or cut(text, keep))
    ids_of = pieces.Columns(queries.vocabulary("byte_bpe_50k.json"))
    column = pa.array(["one two, two three.\nthree one two"] * 500, pa.large_string())
    first = ids_of(column)
    assert sorted(words) == [" one", " three", " two", "one", "three"] and texts == []
    assert ids_of(column).equals(first) and len(words) == 5
    assert len(ids_of.known) <= ids_of.memo and all(len(x) <= 64 for x in ids_of.known.to_pylist())


def test_runs_cover_all_texts():
    texts = pa.array(["a" * (i % 7) for i in range(100)] + ["b" * 90, "", "c"], pa.large_string())
    for most in (1, 10, 50, 1000):
        runs = [x.to_pylist() for x in shared.in_runs(texts, most)]
        assert [x for run in runs for x in run] == texts.to_pylist()
        assert all(sum(map(len, run[:-1])) < 2 * most for run in runs)
