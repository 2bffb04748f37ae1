"""Tokenizers by file path, loaded once per Python worker.

The path must be readable where the task runs: an installed package's file,
or a file distributed with ``--files``.
"""

from __future__ import annotations

import base64
import os

import numpy as np

from quarry.llm.pieces import PieceEncoder

_loaded: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: base64 of a token's bytes and its rank, one a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def json_encoder(path: str) -> PieceEncoder:
    """Encoder by the ``tokenizers`` library.  Strings of special tokens that occur in a text are
    ordinary text.  In a byte-level vocabulary a token's string has one character per byte."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        vocab = tok.get_vocab()
        id_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            id_bytes[i] = len(token)

        def encode(texts: list[str]) -> list[np.ndarray]:
            return [np.array(e.ids, np.uint32) for e in
                    tok.encode_batch_fast(texts, add_special_tokens=False)]

        _loaded[path] = PieceEncoder(encode, id_bytes)
        _loaded["strings", path] = [t.content.encode() for t in tok.get_added_tokens_decoder().values()]
    return _loaded[path]


class PlainEncoder:
    """Ids as the library's own call gives them, where a special token's string in a text is that token.  Rows that
    hold such a string are encoded whole, all others by their pieces."""

    def __init__(self, path: str):
        self.pieces, self.path, self.tokenizer = json_encoder(path), path, None
        self.strings = _loaded["strings", path]

    def _rows(self, data: np.ndarray, offs: np.ndarray) -> list[int]:
        raw, rows = data.tobytes(), set()
        for s in self.strings:
            at = raw.find(s)
            while at >= 0:
                row = int(np.searchsorted(offs, at, side="right")) - 1
                if at + len(s) <= offs[row + 1]:
                    rows.add(row)
                    at = raw.find(s, int(offs[row + 1]))
                else:
                    at = raw.find(s, at + 1)
        return sorted(rows)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, bounds = self.pieces.encode(data, offs)
        rows = self._rows(data, offs)
        if not rows:
            return ids, bounds
        if self.tokenizer is None:
            from tokenizers import Tokenizer
            self.tokenizer = Tokenizer.from_file(self.path)
        texts = [data[offs[r]:offs[r + 1]].tobytes().decode() for r in rows]
        whole = dict(zip(rows, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True))
        parts = [np.array(whole[r].ids, np.uint32) if r in whole else ids[bounds[r]:bounds[r + 1]] for r in range(len(offs) - 1)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def plain_encoder(path: str) -> PlainEncoder:
    key = ("plain", path)
    if key not in _loaded:
        _loaded[key] = PlainEncoder(path)
    return _loaded[key]
