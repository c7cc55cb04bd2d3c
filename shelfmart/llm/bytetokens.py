"""Exact ids of a byte-level tokenizer at a cost that follows the different words of a task, not all of them.

The tokenizer cuts a text into chunks before it merges bytes, and a chunk's ids do not depend on its neighbours. In texts
of plain Latin-1 characters the chunks are found by an equal pattern and looked up in a cache of bounded size. New words
that follow a space are encoded many at a time: a chunk's first id, and no other, begins with a space. All other texts go
to the tokenizer as they are.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import numpy as np

CACHE_ENTRIES = 500_000
WORDS_AT_ONCE = 256
SPACE = "Ġ"  # a space, in the vocabulary of a byte-level tokenizer

LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
BLANKS = "\t\n\r\x20"
# How a byte-level tokenizer of this kind cuts a text, for the characters that are not NOT_PLAIN.
CHUNK = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{BLANKS}{LETTERS}{NUMBERS}]+"
    f"|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
)
NOT_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xff]")
SPACED_WORD = re.compile(f" [{LETTERS}]+")


class ByteEncoder:
    """`encode(texts)` gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens[[i for piece, i in vocabulary.items() if piece.startswith(SPACE)]] = True

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4") for x in found]

    def _learn(self, new: Iterable[str]) -> None:
        alone, words = [], []
        for chunk in new:
            (words if SPACED_WORD.fullmatch(chunk) else alone).append(chunk)
        parts = [words[i : i + WORDS_AT_ONCE] for i in range(0, len(words), WORDS_AT_ONCE)]
        for part, ids in zip(parts, self._ids(["".join(p) for p in parts]), strict=True):
            starts = (np.flatnonzero(self.opens[ids]) * ids.itemsize).tolist()
            data = ids.tobytes()
            if len(starts) == len(part):
                pieces = (data[a:b] for a, b in zip(starts, [*starts[1:], len(data)], strict=True))
                self.cache.update(zip(part, pieces, strict=True))
            else:
                alone += part
        self.cache.update((c, ids.tobytes()) for c, ids in zip(alone, self._ids(alone), strict=True))

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        cache = self.cache
        split: list[list[str] | None] = []
        odd: list[str] = []
        for text in texts:
            text = text or ""
            if "<|" in text or NOT_PLAIN.search(text):
                split.append(None)
                odd.append(text)
            else:
                split.append(CHUNK.findall(text))
        chunks = set().union(*[c for c in split if c])
        if len(cache) + len(chunks) > CACHE_ENTRIES:  # only what this batch has in common with the past is kept
            kept = {c: cache[c] for c in chunks if c in cache}
            cache.clear()
            cache.update(kept)
        new = chunks.difference(cache)
        if new:
            self._learn(new)
        others = iter(self._ids(odd))
        return [next(others).tobytes() if c is None else b"".join([cache[k] for k in c]) for c in split]


_encoders: dict[str, ByteEncoder] = {}


def byte_encoder(path: str) -> ByteEncoder:
    """One encoder a worker process, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]
