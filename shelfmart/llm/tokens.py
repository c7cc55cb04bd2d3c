"""Exact tokenizer ids at a cost that follows the different words of a task, not all of them.

The tokenizer's pieces never reach over white space, so the ids of a text are those of its chunks in order. The different
chunks of the texts that are encoded at once are looked up in a cache of bounded size. Texts of plain Latin-1 characters
are lower-cased, as the tokenizer does, and cut between a letter and the punctuation after it, where no piece reaches
over either; words of letters that are new are encoded many at a time, since each ends with the first id that closes a
word.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from shelfmart.llm.common import ranges

CACHE_ENTRIES = 500_000
WORDS_AT_ONCE = 256
BLANK = r"[ \t\n\r]+"
NOT_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xa9\xab-\xb4\xb6-\xb9\xbb-\xff]")
# The last letter of a word and the punctuation that follows it, but for the apostrophe, which may begin a contraction.
WORD_AND_MARK = r"([a-z\xdf-\xf6\xf8-\xff])([!-&(-/:-@\[-`{-~])"
WORD_END = "</w>"


class Encoder:
    """`encode(texts)` gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # Of words that are lower-case letters already, normalizing and splitting by patterns change nothing.
        self.of_words = Tokenizer(self.tokenizer.model)
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.lowered: dict[str, bytes] = {}
        self.raw: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for piece, i in vocabulary.items() if piece.endswith(WORD_END)]] = True

    def _ids(self, texts: list[str], tokenizer=None) -> list[np.ndarray]:
        found = (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4") for x in found]

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that are lower-case letters only."""
        out: dict[str, bytes] = {}
        parts = [words[i : i + WORDS_AT_ONCE] for i in range(0, len(words), WORDS_AT_ONCE)]
        for part, ids in zip(parts, self._ids([" ".join(p) for p in parts], self.of_words), strict=True):
            ends = ((np.flatnonzero(self.closes[ids]) + 1) * ids.itemsize).tolist()
            data = ids.tobytes()
            if len(ends) == len(part) and ends[-1] == len(data):
                pieces = [data[a:b] for a, b in zip([0, *ends], ends)]
            else:
                pieces = [piece.tobytes() for piece in self._ids(part)]
            out.update(zip(part, pieces, strict=True))
        return out

    def _learn(self, cache: dict[str, bytes], new: list[str], plain: bool) -> None:
        words = [c for c in new if c.isalpha()] if plain else []
        alone = [c for c in new if not c.isalpha()] if plain else new
        cache.update((c, ids.tobytes()) for c, ids in zip(alone, self._ids(alone), strict=True))
        cache.update(self._words(words))

    def _encoded(self, texts: list[str], cache: dict[str, bytes], plain: bool) -> list[bytes]:
        """Ids of texts of one kind: only the different chunks of all of them are looked up."""
        column = pa.array(texts, pa.large_string())
        if plain:
            apart = pc.replace_substring_regex(pc.utf8_lower(column), WORD_AND_MARK, r"\1 \2")
            split = pc.ascii_split_whitespace(apart)
        else:
            split = pc.split_pattern_regex(column, BLANK)
        coded = split.values.dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        pieces = [cache.get(c) for c in chunks]
        new = [c for c, piece in zip(chunks, pieces) if piece is None]
        if new:
            if len(cache) + len(new) > CACHE_ENTRIES:  # only what these texts have in common with the past is kept
                cache.clear()
                cache.update((c, piece) for c, piece in zip(chunks, pieces) if piece is not None)
            self._learn(cache, new, plain)
            pieces = [cache[c] if piece is None else piece for c, piece in zip(chunks, pieces)]
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) // 4
        begin, which = np.cumsum(lengths) - lengths, coded.indices.to_numpy()
        data = np.frombuffer(b"".join(pieces), dtype="<u4")[ranges(begin[which], lengths[which])].tobytes()
        ends = np.r_[0, np.cumsum(lengths[which])][split.offsets.to_numpy()] * 4
        return [data[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        texts = [text or "" for text in texts]
        plain = ["<|" not in text and not NOT_PLAIN.search(text) for text in texts]
        found = {
            kind: iter(self._encoded([t for t, p in zip(texts, plain, strict=True) if p == kind], cache, kind))
            for kind, cache in ((False, self.raw), (True, self.lowered))
            if kind in plain
        }
        return [next(found[kind]) for kind in plain]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
