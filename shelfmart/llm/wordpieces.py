"""Word-piece counts by an automaton that never builds a piece.

Greedy longest-match over a word is one walk through a trie of the vocabulary. Where the walk cannot go on, a failure
link leads to the state that is left after the longest matches so far are taken off, and says how many they are. So a
word costs time linear in its length, whatever its pieces are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmart.llm.common import small_batches, table, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_CACHE = 500_000
WORD_START = "▁"  # fixed value: marks pieces that begin a word
ROOT, SUFFIX = 0, 1


class PieceAutomaton:
    """`first` are the pieces that may begin a word, `later` those that may follow."""

    def __init__(self, first: Iterable[str], later: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        whole = [False, False]
        for start, pieces in ((ROOT, first), (SUFFIX, later)):
            for piece in pieces:
                state = start
                for character in piece:
                    following = self.next[state]
                    if character not in following:
                        following[character] = len(self.next)
                        self.next.append({})
                        whole.append(False)
                    state = following[character]
                if piece:
                    whole[state] = True
        # Failure links, and how many pieces are taken off on the way; -1: no piece can be.
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        level = [ROOT, SUFFIX]
        while level:
            below = []
            for parent in level:
                for character, state in self.next[parent].items():
                    below.append(state)
                    if whole[state]:
                        self.fail[state], self.popped[state] = SUFFIX, 1
                        continue
                    at, n = self.fail[parent], self.popped[parent]
                    while at >= 0 and character not in self.next[at]:
                        n += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[state], self.popped[state] = self.next[at][character], n
            level = below

    def count(self, word: str) -> int:
        """Pieces of a word; 0 if it cannot be cut into pieces greedily."""
        following, fail, popped = self.next, self.fail, self.popped
        state = n = 0
        for character in word:
            target = following[state].get(character)
            while target is None:
                n += popped[state]
                state = fail[state]
                if state < 0:
                    return 0
                target = following[state].get(character)
            state = target
        while state != SUFFIX:
            n += popped[state]
            state = fail[state]
            if state < 0:
                return 0
        return n


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """(pieces that begin a word, pieces that follow) of a sentencepiece model; control, byte and unknown pieces and the
    bare word mark are left out."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    usable = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))
    ]
    first = [p[1:] for p in usable if p.startswith(WORD_START) and len(p) > 1]
    return first, [p for p in usable if WORD_START not in p]


class Counter:
    """Counts of whole texts; those of words are kept up to WORD_CACHE."""

    def __init__(self, path: str):
        self.automaton = PieceAutomaton(*vocabulary(path))
        self.known: dict[str, int] = {}

    def counts(self, texts: Iterable[str | None]) -> list[tuple[int, int, int]]:
        """(words, tokens, unknown words) of each text; an unknown word is one token."""
        split = [WORD.findall(t) if t else [] for t in texts]
        words = set().union(*split)
        if len(self.known) + len(words) > WORD_CACHE:
            self.known.clear()
        for word in words.difference(self.known):
            self.known[word] = self.automaton.count(word)
        out = []
        for found in split:
            pieces = np.fromiter(map(self.known.__getitem__, found), dtype=np.int64, count=len(found))
            unknown = int((pieces == 0).sum())
            out.append((len(found), int(pieces.sum()) + unknown, unknown))
        return out


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """`docs` with n_words, n_tokens and n_unknown (words that cannot be cut, one token each).

    Null and empty texts have none. Repeated rows stay. Columns named like the results are replaced. An empty table
    gives no rows.
    """
    names = ["n_words", "n_tokens", "n_unknown"]

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if model_path not in _counters:
            _counters[model_path] = Counter(model_path)
        for texts in batches:
            yield pd.DataFrame(_counters[model_path].counts(texts), columns=names, dtype="int64")

    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in names]
    found = F.pandas_udf(count, "struct<n_words:long,n_tokens:long,n_unknown:long>")
    return docs.select(*kept, found(F.col(text)).alias("_found")).select(*kept, "_found.*")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, tokenizer_path("piece_bpe_32k.model")).drop("text")
