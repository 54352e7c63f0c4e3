"""Ids of whole texts from a public tokenizer file, inside tasks.

The tokenizer never joins anything across a space or a line feed, so a text's ids are the ids of its space-separated parts
in order. Each worker keeps the parts it has met; only new ones go through the tokenizer.
"""

from __future__ import annotations

import os
from unicodedata import is_normalized

import numpy as np

#: Parts a worker remembers before it starts anew; bounds its memory at about 150 MB.
MEMO_SIZE = 600_000
_ENCODERS: dict[str, "PartEncoder"] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_characters() -> dict[int, str]:
    """Bytes as byte-level vocabularies write them: printable ones as themselves, the others from U+0100 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Parts(dict):
    """Part → ids. Latin words, alone or before a comma or full stop, go to the model itself; all else through the whole chain."""

    def __init__(self, tokenizer):
        super().__init__()
        self._encode, self._model = tokenizer.encode, tokenizer.model.tokenize
        self._cores: dict[str, bytes] = {}
        self._marks = {"": b"", ",": self._whole(","), ".": self._whole(".")}
        self._shown = _byte_characters()

    def _whole(self, part: str) -> bytes:
        return np.array(self._encode(part, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _plain(self, core: str) -> str | None:
        """A word as the model takes it: lower case, bytes as characters; None unless it is made of composed Latin letters."""
        if not core.isalpha():
            return None
        if core.isascii():
            return core.lower()
        lower = "".join([c.lower() for c in core])
        if max(core) > "\u024f" or not lower.isalpha() or not is_normalized("NFC", core):
            return None
        return "".join([self._shown[b] for b in lower.encode()])

    def __missing__(self, part: str) -> bytes:
        if len(self) > MEMO_SIZE:
            self.clear()
            self._cores.clear()
        core, mark = (part[:-1], part[-1]) if part[-1:] in (",", ".") else (part, "")
        word = self._plain(core)
        if word is None:
            ids = self._whole(part)
        else:
            ids = self._cores.get(word)
            if ids is None:
                ids = self._cores[word] = b"".join([t.id.to_bytes(4, "little") for t in self._model(word)])
            ids += self._marks[mark]
        self[part] = ids
        return ids


class PartEncoder:
    """Text → little-endian unsigned 32-bit ids, equal to encode(text, add_special_tokens=False).

    For tokenizers that compose and lower-case and part letters from other characters, as word_bpe_49k.json does.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._parts = _Parts(Tokenizer.from_file(file))

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self._parts.__getitem__, text.replace("\n", " ").split(" "))) if text else b""


def encoder(file: str) -> PartEncoder:
    """The worker's encoder of a file."""
    if file not in _ENCODERS:
        _ENCODERS[file] = PartEncoder(file)
    return _ENCODERS[file]
