"""Tokenizer files, and cutting a text where no token can reach over the cut."""

from __future__ import annotations

import codecs
import json
import os
import re
import struct
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .shared import HELD, by_bytes

#: White space other than a space or a newline.
_ODD_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
#: Before a space or newline that stands between two visible characters.
_CAREFUL = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: How a byte-level vocabulary cuts a text into words (a fixed pattern).
_BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A comma or full stop before white space with something other than a letter or digit before it.
_SIGN_AFTER_SIGN = re.compile(r"[\W_][.,][ \n]")
#: What the two patterns before and a run of white space are to Arrow, which cuts whole columns.
_CAREFUL_IN = "  | \n|\n[ \n]|[\\x00\t\r\x0b\x0c\x1c-\x1f\x85" + "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]"
_SIGN_AFTER_SIGN_IN = r"[^\pL\pN][.,][ \n]"
#: The letters that stand for the 256 bytes in a byte-level vocabulary: visible Latin-1 for itself, the others from U+0100 on.
_HIDDEN = [*range(33), *range(127, 161), 173]
_LETTERS = "".join(chr(256 + _HIDDEN.index(b) if b in _HIDDEN else b) for b in range(256))
#: Between a letter and what no word goes on with; apostrophes are left out, as they bind what follows.
_INNER = re.compile(r"(?<=[A-Za-z])(?=[0-9.,;:!?()\-/])")
#: A piece is cut inside from this many characters on.
LONG = 1 << 14

@cache
def tokenizer(path: str):
    """The library's tokenizer for a vocabulary file, loaded once in each Python worker."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@cache
def drops_spaces(path: str) -> bool:
    """Whether this vocabulary ignores the space before a word."""
    t = tokenizer(path)
    return t.encode(" a", add_special_tokens=False).ids == t.encode("a", add_special_tokens=False).ids


@cache
def cuts_by_bytes(path: str) -> bool:
    """Whether this vocabulary takes a text as it is and cuts it into words by the byte-level pattern."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    cutter = given["pre_tokenizer"] or {}
    return given["normalizer"] is None and cutter.get("type") == "ByteLevel" and cutter["use_regex"] and not cutter["add_prefix_space"]


def odd_space(text: str) -> bool:
    """Whether `text` has white space other than a space or a newline."""
    return any(c in text for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f") if text.isascii() else _ODD_SPACE.search(text) is not None


def cut(text: str, keep_space: bool) -> list[str]:
    """The pieces of `text`, in order; their tokens, one piece after the other, are the text's tokens.

    Cuts lie at single spaces; some pieces may be empty. With `keep_space` a space goes to the piece behind it, and
    there are cuts around single newlines and commas and full stops before white space; near a run of white space
    there is none, as the pattern takes such a run as a whole. A piece of `LONG` characters or more, which has no such
    space, is cut on between letters and digits or signs, where the patterns of all these vocabularies end a word.
    """
    if not keep_space:
        parts = text.split(" ")
    elif "  " in text or " \n" in text or "\n " in text or "\n\n" in text or "\0" in text or odd_space(text):
        parts = _CAREFUL.split(text)
    else:
        marked = text.replace(" ", "\0 ").replace("\n", "\0\n\0")
        if not _SIGN_AFTER_SIGN.search(text):  # so a comma or full stop ends a word or number, and is one itself
            marked = marked.replace(",\0", "\0,\0").replace(".\0", "\0.\0")
        parts = marked.split("\0")
    if len(text) >= LONG and max(map(len, parts)) >= LONG:
        parts = [x for p in parts for x in (_INNER.split(p) if len(p) >= LONG else (p,))]
    return parts


def encode(path: str, texts: list[str]) -> list[list[int]]:
    """Ids of each text, without any that the library would add around it."""
    t = tokenizer(path)
    if path.endswith(".model"):
        return t.encode(texts, num_threads=1)
    return [x.ids for x in t.encode_batch_fast(texts, add_special_tokens=False)]


def ids_as_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def merged(path: str, words: list[str]) -> tuple[bytes, list[int]]:
    """Ids of words, one after the other as bytes, and where each begins and the last ends; by a byte-level vocabulary, for words of letters with or without a space before.

    Its pattern takes such a word as a whole, so the library's model alone merges the word's bytes, written as letters.
    """
    merge, out, ends = tokenizer(path).model.tokenize, [], [0]
    for at in range(0, len(words), 4000):
        ids, before = [], ends[-1]
        for word in codecs.charmap_decode("\n".join(words[at : at + 4000]).encode(), "strict", _LETTERS)[0].split(_LETTERS[10]):
            ids += [x.id for x in merge(word)]
            ends.append(before + 4 * len(ids))
        out.append(ids_as_bytes(ids))
    return b"".join(out), ends


def encode_words(path: str, words: list[str], value=list) -> list:
    """`value` of the ids of each word, as by `encode`, for such words as `merged` takes."""
    ids, ends = merged(path, words)
    if value is ids_as_bytes:
        return [ids[a:b] for a, b in zip(ends, ends[1:])]
    ids = np.frombuffer(ids, "<u4").tolist()
    return [value(ids[a // 4 : b // 4]) for a, b in zip(ends, ends[1:])]


def cut_column(texts: pa.Array) -> pa.Array:
    """The pieces of each text, as `cut` with `keep_space` makes them but for long ones, which are left whole."""
    marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
    signs = pc.replace_substring(pc.replace_substring(marked, ",\0", "\0,\0"), ".\0", "\0.\0")
    parts = pc.split_pattern(pc.if_else(pc.match_substring_regex(texts, _SIGN_AFTER_SIGN_IN), marked, signs), "\0")
    careful = np.flatnonzero(pc.match_substring_regex(texts, _CAREFUL_IN).to_numpy(zero_copy_only=False))
    if len(careful):
        order = np.arange(len(texts))
        order[careful] = len(texts) + np.arange(len(careful))
        own = pa.array([cut(texts[i].as_py(), True) for i in careful.tolist()], parts.type)
        parts = pa.concat_arrays([parts, own]).take(pa.array(order))
    return parts


class Pieces:
    """Looks up what `value(ids)` is for each piece.

    Two tables hold what came before: when the newer has `memo` pieces it becomes the older one, and what
    only the former older one had is forgotten. So memory has a bound and frequent pieces stay. The values of two
    pieces, added, must be that of both together (a length, or ids as bytes).
    """

    def __init__(self, path: str, value, memo: int = 300_000):
        self.path, self.value, self.memo, self.known, self.older = path, value, memo, {}, {}
        self.whole = path.endswith(".model")  # these see the start of a text, so it stays whole
        self.keep_space = not self.whole and not drops_spaces(path)
        self.by_words = self.keep_space and cuts_by_bytes(path)

    def __call__(self, texts: list[str]) -> list[list]:
        if self.whole:
            return [[self.value(x)] for x in encode(self.path, texts)]
        parts = [cut(t, self.keep_space) for t in texts]
        if len(self.known) > self.memo:
            self.known, self.older = {}, self.known
        known = self.known
        out = [list(map(known.get, ps)) for ps in parts]
        lacking = [[i for i, v in enumerate(vs) if v is None] if None in vs else () for vs in out]
        self.learn({ps[i] for ps, at in zip(parts, lacking) for i in at})
        for ps, vs, at in zip(parts, out, lacking):
            for i in at:
                vs[i] = known[ps[i]]
        return out

    def learn(self, pieces: set[str]) -> None:
        known, older = self.known, self.older
        new, words, several = [], [], []
        for p in pieces.difference(known):
            if p in older:
                known[p] = older[p]
            elif len(p) >= LONG and len(parts := _INNER.split(p)) > 1:
                several.append((p, parts))
            elif not self.by_words:
                new.append(p)
            elif p.removeprefix(" ").isalpha():
                words.append(p)
            elif "<|" not in p and len(found := _BYTE_LEVEL.findall(p)) > 1:  # special strings stay whole
                several.append((p, found))
            else:
                new.append(p)
        if several:  # words of their own, which other pieces have too
            self.learn({x for _, found in several for x in found})
            for p, found in several:
                value = known[found[0]]
                for x in found[1:]:
                    value = value + known[x]
                known[p] = value
        known.update(zip(words, encode_words(self.path, words, self.value), strict=True))
        for a, b in by_bytes(new):
            known.update(zip(new[a:b], map(self.value, encode(self.path, new[a:b])), strict=True))


def binaries(values: list[bytes] | bytes | pa.Buffer, ends: list[int] | np.ndarray | None = None) -> pa.Array:
    """Large binaries from a list, or from bytes and where each begins and the last ends."""
    if ends is None:
        return pa.array(values, pa.large_binary())
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.asarray(ends, np.int64)), pa.py_buffer(values)])


class Columns:
    """Looks up the ids of whole columns of texts, as bytes; each different piece of a column once, and Arrow does the rest.

    The table holds the `memo` pieces that were met last, none of more than 64 bytes, so memory has a bound.
    """

    def __init__(self, path: str, memo: int = 300_000):
        self.path, self.memo = path, memo
        self.known, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def __call__(self, texts: pa.Array) -> pa.Array:
        """Large binaries, for large strings without null."""
        own = Pieces(self.path, ids_as_bytes)
        if not own.keep_space:
            return binaries([b"".join(x) for x in own(texts.to_pylist())])
        parts, n = cut_column(texts), len(self.known)
        coded = pa.concat_arrays([self.known, parts.flatten()]).dictionary_encode()  # so places below n are those of the table
        pieces, at = coded.dictionary, coded.indices[n:]
        new = pieces[n:].to_numpy(zero_copy_only=False)
        words = np.fromiter((own.by_words and p.removeprefix(" ").isalpha() for p in new), bool, len(new))
        others = new[~words].tolist()
        own.learn(set(others))
        order = np.arange(n + len(new))
        order[n:][words], order[n:][~words] = n + np.arange(words.sum()), n + words.sum() + np.arange(len(others))
        ids = [self.ids, binaries(*merged(self.path, new[words].tolist())), binaries([own.known[p] for p in others])]
        ids = pa.concat_arrays(ids).take(pa.array(order))
        every = ids.take(at)
        borders = np.r_[0, np.cumsum(parts.value_lengths().to_numpy())]
        borders = np.frombuffer(every.buffers()[1], np.int64, len(every) + 1, 8 * every.offset)[borders]
        self.keep(pieces, ids, at.to_numpy())
        return binaries(every.buffers()[2] or b"", borders)

    def keep(self, pieces: pa.Array, ids: pa.Array, at: np.ndarray) -> None:
        now = np.zeros(len(pieces), bool)
        now[at] = True
        short = pc.binary_length(pieces).to_numpy() <= 64
        kept = pa.array(np.r_[np.flatnonzero(now & short), np.flatnonzero(~now & short)][: self.memo])
        self.known, self.ids = pieces.take(kept), ids.take(kept)


_pieces: dict = {}


def _clear() -> None:
    _pieces.clear()
    tokenizer.cache_clear()


HELD["packing"] = _clear


def pieces(path: str, value) -> Pieces:
    """The table of this Python worker for a vocabulary and a value, which adds up over the pieces of a text."""
    key = (path, value.__name__)
    if key not in _pieces:
        _pieces[key] = Pieces(path, value)
    return _pieces[key]


def ids_of_columns(path: str) -> Columns:
    """The table of this Python worker for the ids of whole columns by a vocabulary."""
    if path not in _pieces:
        _pieces[path] = Columns(path)
    return _pieces[path]
