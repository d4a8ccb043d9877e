r"""Chat formatting that can be read back: a template, a deterministic parser, and escapes where they are needed.

Grammar of a formatted conversation, turn after turn:

    turn := <|im_start|> ROLE \n TEXT <|im_end|> \n

ROLE ends at the first newline, TEXT at the first `<|im_end|>`; neither holds `<|im_start|>`. Inside ROLE and
TEXT the parser takes one backslash out of every `<\...\|` (a less-than sign, one or more backslashes, a bar); in
ROLE it also reads `\n` and `\\`. The formatter writes a turn as it is, parses it, and compares. Where the parser
refuses it or the turn differs from the source, the turn's texts are escaped, which puts one backslash into every
`<|`, `<\|`, `<\\|`, ... .
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_MARK, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_ROLE_OUT = re.compile(r"\\(n|\\)")


def escape(text: str) -> str:
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """The turns of formatted text: role, content, and where the raw content starts and ends in it."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError(f"no turn at {at}")
        line = text.find("\n", at)
        end = text.find(END, line + 1)
        if line < 0 or end < 0 or not text.startswith("\n", end + len(END)):
            raise ValueError(f"the turn at {at} has no end")
        if text.find(START, at + 1, end) >= 0 or text.find(END, at, line) >= 0:
            raise ValueError(f"a turn starts or ends inside the turn at {at}")
        role = _ROLE_OUT.sub(lambda m: "\n" if m[1] == "n" else "\\", unescape(text[at + len(START) : line]))
        turns.append((role, unescape(text[line + 1 : end]), line + 1, end))
        at = end + len(END) + 1
    return turns


def render(role: str, text: str) -> str:
    """One formatted turn that parses back to exactly this role and text; the grammar lets no control string stand in them."""
    for out_role, out_text in [(role, text), (escape(role.replace("\\", "\\\\").replace("\n", "\\n")), escape(text))]:
        out = f"{START}{out_role}\n{out_text}{END}\n"
        try:
            if [x[:2] for x in parse(out)] == [(role, text)]:
                return out
        except ValueError:
            pass  # what the text says was taken for the template's own marks: escape it
    raise ValueError("a turn could not be escaped")


def _runs(batch: pa.RecordBatch, key: list, last: object) -> Iterator[tuple[object, bool, int, int]]:
    """Rows that follow one another with one key: the key, whether it has just begun, first row, last row plus one."""
    starts = [0, *[i for i in range(1, len(key)) if key[i] != key[i - 1]], len(key)]
    for a, b in zip(starts, starts[1:]):
        if a < b:
            yield key[a], key[a] != last, a, b
            last = key[a]


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk_chars: int = 1 << 20) -> DataFrame:
    """Formatted conversations as rows (conv_id, chunk, formatted, loss_starts, loss_ends).

    A conversation's chunks, one after the other, are its text; a chunk holds whole turns and ends when it
    has `chunk_chars`, so that a huge conversation streams through. Loss spans are code points in the
    chunk, end exclusive, and cover what assistants say. Turns stand in order of turn, then role, then
    text (nulls first); repeated rows count. Null roles and texts are empty. Turns with a null id are one conversation
    of their own; ids of any type stay as they are. Other columns are not read. The rows of a partition are in order
    of conversation, chunk.
    """
    kind = turns.schema[conv_col].dataType.simpleString()
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, id_kind, last, conv, chunk, parts, size, starts, ends = [], None, object(), None, 0, [], 0, [], []

        def flush() -> None:
            nonlocal chunk, parts, size, starts, ends
            if parts:
                out.append((conv, chunk, "".join(parts), starts, ends))
                chunk, parts, size, starts, ends = chunk + 1, [], 0, [], []

        def made() -> pa.RecordBatch:
            spans = pa.list_(pa.int32())
            columns = [pa.array(list(c), k) for c, k in zip(zip(*out), (id_kind, pa.int32(), pa.string(), spans, spans))]
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "chunk", "formatted", "loss_starts", "loss_ends"])

        for batch in batches:
            id_kind = batch.schema.types[0]
            keys, roles, texts = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for key, new, a, b in _runs(batch, keys, last):
                if new:
                    flush()
                    conv, chunk, last = key, 0, key
                for role, text in zip(roles[a:b], texts[a:b]):
                    turn = render(role, text)
                    if role == "assistant":
                        starts.append(size + len(START) + len(role) + 1)
                        ends.append(size + len(turn) - len(END) - 1)
                    parts.append(turn)
                    size += len(turn)
                    if size >= chunk_chars:
                        flush()
                if len(out) >= 2000 or sum(len(x[2]) for x in out[-8:]) > 4 * chunk_chars:
                    yield made()
                    out.clear()
        flush()
        if out:
            yield made()

    return rows.mapInArrow(run, f"conv_id {kind}, chunk int, formatted string, loss_starts array<int>, loss_ends array<int>")


def read_back(chunks: DataFrame) -> DataFrame:
    """What the output of `format_chats` says, one row for each conversation, by parsing it.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn), loss_chars and loss_sha256
    (the unescaped text under the loss spans, joined), formatted_chars. Raises if a loss span is not the
    content of a turn. Chunks must come as `format_chats` leaves them, which keeps them in order; hashes
    are carried from chunk to chunk, so that no conversation is held whole.
    """
    kind = chunks.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out, last, id_kind = None, [], object(), None

        def flush() -> None:
            if state:
                conv, n, h, chars, loss, size = state
                out.append((conv, n, h.hexdigest(), chars, loss.hexdigest(), size))

        def made() -> pa.RecordBatch:
            kinds = (id_kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)]
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            id_kind = batch.schema.types[0]
            keys, texts, starts, ends = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            for key, new, a, b in _runs(batch, keys, last):
                if new:
                    flush()
                    state, last = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], key
                for i in range(a, b):
                    spans = dict(zip(starts[i], ends[i], strict=True))
                    for role, content, x, y in parse(texts[i]):
                        state[1] += 1
                        state[2].update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
                        if x in spans:
                            if spans.pop(x) != y:
                                raise ValueError("a loss span is not a turn's content")
                            state[3] += len(content)
                            state[4].update(content.encode("utf-8", "surrogatepass"))
                    if spans:
                        raise ValueError("a loss span is not a turn's content")
                    state[5] += len(texts[i])
                if len(out) >= 5000:
                    yield made()
                    out.clear()
        flush()
        if out:
            yield made()

    return chunks.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
