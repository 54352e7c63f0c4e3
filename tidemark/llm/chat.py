"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole as `<|im_start|>role<|im_sep|>text<|im_end|>` and a line feed per turn, encoded once with
character offsets, and tokens are put under the loss mask by binary search of the assistants' text spans among the sorted
token spans. Control strings inside roles and texts are escaped reversibly: `<` before pipes gets one pipe more.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.tokens import tokenizer_path

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TRAINED_ROLES = ("assistant",)
#: Characters encoded in one call; turns are never cut, as control strings part all tokens.
ENCODE_CHARS = 1 << 18
_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>\n", re.DOTALL)
_TOKENIZERS: dict = {}


def escape(text: str | None) -> str:
    return re.sub(r"<(\|+)", r"<|\1", text or "")


def unescape(text: str) -> str:
    return re.sub(r"<\|(\|+)", r"<\1", text)


def render(turns: list[tuple[str | None, str | None]]) -> tuple[list[str], list[tuple[int, int]]]:
    """(role, text) turns → their rendered parts and the spans of trained texts in the joined string, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEPARATOR}", escape(text)
        parts.append(f"{head}{body}{END}\n")
        if role in TRAINED_ROLES:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(parts[-1])
    return parts, spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendered conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def _tokenizer(file: str):
    if file not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        made = Tokenizer.from_file(file)
        made.add_special_tokens([AddedToken(s, normalized=False, special=True) for s in (START, SEPARATOR, END)])
        _TOKENIZERS[file] = made
    return _TOKENIZERS[file]


def encode(parts: list[str], tokenizer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, starts and ends (in characters of the joined string) of rendered parts."""
    ids, spans, at, block, held = [], [], 0, [], 0

    def flush():
        nonlocal at, block, held
        text = "".join(block)
        made = tokenizer.encode(text, add_special_tokens=False)
        ids.append(np.array(made.ids, dtype=np.int32))
        spans.append(np.array(made.offsets, dtype=np.int64).reshape(-1, 2) + at)
        at, block, held = at + len(text), [], 0

    for part in parts:
        block.append(part)
        held += len(part)
        if held >= ENCODE_CHARS:
            flush()
    if block:
        flush()
    if not ids:
        return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
    both = np.concatenate(spans)
    return np.concatenate(ids), both[:, 0], both[:, 1]


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tokens that share a character with a span: both lists are sorted, so a span's tokens lie between two binary searches."""
    mask = np.zeros(len(starts), bool)
    if spans:
        s, e = np.array(spans).T
        for first, last in zip(np.searchsorted(ends, s, "right"), np.searchsorted(starts, e, "left"), strict=True):
            mask[first:last] = True
    return mask


def format_conversations(rows: DataFrame, tokenizer_file: str | None = None) -> DataFrame:
    """rows (conv_id, turn, role, text) → per conversation: conv_id, formatted, ids, starts, ends, loss.

    Turns are ordered by (turn, role, text), nulls first; null roles and texts are empty; repeated rows are turns of their own;
    a null conv_id is a conversation. Rows are sorted within partitions and streamed, so a task holds one conversation at a
    time, which its one output row holds anyway.
    """
    file = tokenizer_file or tokenizer_path("byte_bpe_50k.json")
    id_type = rows.schema["conv_id"].dataType.simpleString()
    columns = ["conv_id", "turn", "role", "text"]
    ordered = rows.select(*columns).repartition("conv_id").sortWithinPartitions(*columns).select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(file)
        names = ["conv_id", "formatted", "ids", "starts", "ends", "loss"]
        done: list = []
        held = 0
        key_type = None

        def finish(key, turns):
            nonlocal held
            parts, spans = render(turns)
            ids, starts, ends = encode(parts, tokenizer)
            done.append((key, "".join(parts), ids, starts, ends, loss_mask(starts, ends, spans)))
            held += len(done[-1][1])

        def batch():
            nonlocal done, held
            keys, texts, *lists = zip(*done, strict=True)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.bool_())
            arrays = [pa.array(list(x), pa.list_(k)) for x, k in zip(lists, kinds, strict=True)]
            made = pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(texts, pa.string()), *arrays], names=names)
            done, held = [], 0
            return made

        current, turns = None, []
        for some in batches:
            key_type = some.column(0).type
            for key, role, text in zip(*(some.column(k).to_pylist() for k in range(3)), strict=True):
                if turns and key != current:
                    finish(current, turns)
                    turns = []
                    if held > 1 << 20:
                        yield batch()
                current = key
                turns.append((role, text))
        if turns:
            finish(current, turns)
        if done:
            yield batch()

    schema = f"conv_id {id_type}, formatted string, ids array<int>, starts array<long>, ends array<long>, loss array<boolean>"
    return ordered.mapInArrow(run, schema)


def masked_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[str]:
    """The texts under the mask, unescaped, one per run of masked tokens."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], loss.astype(np.int8), [0]])))
    return [unescape(formatted[starts[a] : ends[b - 1]]) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def digests(output: DataFrame) -> DataFrame:
    """format_conversations' rows → conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    id_type = output.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for k in range(batch.num_rows):
                formatted = batch.column(1)[k].as_py()
                starts, ends, loss = (np.asarray(batch.column(c)[k].values.to_numpy(zero_copy_only=False)) for c in (2, 3, 4))
                turns = parse(formatted)
                text = "".join(masked_texts(formatted, starts, ends, loss))
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
                made.append((len(turns), sha(whole), len(text), sha(text), len(formatted)))
            columns = zip(*made, strict=True) if made else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            arrays = [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    schema = f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return output.select("conv_id", "formatted", "starts", "ends", "loss").mapInArrow(run, schema)
