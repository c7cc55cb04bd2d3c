"""Pack token sequences first-fit decreasing in randomised groups of documents, closing the gaps by cuts.

Rows are dealt to groups of bounded size at random, so that each group has the corpus's mix of lengths and is packed
alone by one task. In a group, whole multiples of the capacity fill sequences of their own; the rest of each document
goes, longest first, into the first sequence with room for it, found in a tournament tree over the room that sequences
have left. Sequences that still have room are then filled with cuts of the emptiest ones. At most one of a group stays
open; it is cut into runs whose lengths are powers of two, which need no padding. Rows are dealt by a number that is
stored with them before the shuffle, so a repeated task finds the same groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from shelfmart.llm.bytetokens import byte_encoder
from shelfmart.llm.common import table, tokenizer_path, written

CAPACITY = 2048
END_ID = 1
GROUP_BYTES, GROUP_ROWS = 4 << 20, 8_192  # what a group holds on average
SEED = 11
LOCAL_BITS = 36  # of a sequence's number within its group
TEXTS_AT_ONCE = 256

Piece = tuple[int, int, int]  # row of the group, start, length


class Tournament:
    """Room of the sequences, in a tree whose inner nodes hold the most room below them."""

    def __init__(self, sequences: int, capacity: int):
        self.size = 1 << max(0, (sequences - 1).bit_length())
        self.room = [capacity] * (2 * self.size)

    def place(self, length: int) -> int:
        """Take `length` from the first sequence with so much room and return its number."""
        room, node = self.room, 1
        while node < self.size:
            node *= 2
            if room[node] < length:
                node += 1
        found = node - self.size
        room[node] -= length
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return found


def first_fit_decreasing(lengths: Sequence[int], capacity: int) -> list[list[int]]:
    """Sequences of positions in `lengths`, none of which is over `capacity`."""
    tree = Tournament(len(lengths), capacity)
    sequences: list[list[int]] = []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        at = tree.place(lengths[k])
        if at == len(sequences):
            sequences.append([])
        sequences[at].append(k)
    return sequences


def _close_gaps(sequences: list[list[Piece]], capacity: int) -> None:
    """Fill sequences, the fullest first, with cuts of the emptiest, in place."""
    room = [capacity - sum(n for _, _, n in s) for s in sequences]
    partial = sorted((k for k in range(len(sequences)) if room[k]), key=lambda k: room[k])
    low, high = 0, len(partial) - 1
    while low < high:
        full, donor = partial[low], sequences[partial[high]]
        row, start, length = donor.pop()
        moved = min(room[full], length)
        sequences[full].append((row, start + length - moved, moved))
        room[full] -= moved
        if moved < length:
            donor.append((row, start, length - moved))
        room[partial[high]] += moved
        low += room[full] == 0
        high -= not donor


def _powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces in order, as sequences whose lengths are the powers of two that their sum is made of."""
    total = sum(n for _, _, n in pieces)
    out, waiting = [], pieces[::-1]
    for bit in reversed(range(total.bit_length())):
        need = total & (1 << bit)
        run: list[Piece] = []
        while need:
            row, start, length = waiting.pop()
            taken = min(need, length)
            run.append((row, start, taken))
            if taken < length:
                waiting.append((row, start + taken, length - taken))
            need -= taken
        if run:
            out.append(run)
    return out


def pack_group(lengths: Sequence[int], capacity: int) -> list[list[Piece]]:
    """Sequences of the pieces of documents of these lengths. All are full, or as long as a power of two."""
    whole = [[(k, at, capacity)] for k, n in enumerate(lengths) for at in range(0, n - n % capacity, capacity)]
    rests = [(k, n - n % capacity, n % capacity) for k, n in enumerate(lengths) if n % capacity]
    sequences = [[rests[k] for k in s] for s in first_fit_decreasing([n for _, _, n in rests], capacity)]
    _close_gaps(sequences, capacity)
    out = whole
    for pieces in sequences:
        if pieces:
            out += [pieces] if sum(n for _, _, n in pieces) == capacity else _powers_of_two(pieces)
    return out


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False,
    doc_id: str = "doc_id", text: str = "text", seed: int = SEED,
) -> DataFrame:
    """One row per piece of a document: `doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`, and its
    `ids` (little-endian unsigned 32-bit) with `keep_ids`.

    Null and empty texts are the end id alone. Repeated rows are packed each, and null ids stay null. Long texts are cut
    to the capacity. Other columns are not returned. An empty table gives no rows.
    """
    kind = dict(docs.dtypes)[doc_id]
    # ids travel as text, so that null ids stay null and large ones exact
    rows = docs.select(
        F.col(doc_id).cast("string").alias("k"),
        F.col(text).alias("t"),
        F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)).alias("deal"),
    )
    seen = Observation()
    rows = rows.observe(seen, F.count("*").alias("rows"), F.sum(F.octet_length("t")).alias("bytes"))
    dealt = written(rows, "dealt")
    groups = max(1, -(-(seen.get["bytes"] or 0) // GROUP_BYTES), -(-seen.get["rows"] // GROUP_ROWS))
    end = np.array([end_id], dtype="<u4").tobytes()

    def pack_rows(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        encode = byte_encoder(tokenizer).encode
        texts, ids = batch["t"].tolist(), []
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            ids += [data + end for data in encode(texts[at : at + TEXTS_AT_ONCE])]
        keys = batch["k"].tolist()
        first, out = key[0] << LOCAL_BITS, []
        for number, pieces in enumerate(pack_group([len(data) // 4 for data in ids], capacity), start=first):
            offset = 0
            for row, start, length in pieces:
                part = ids[row][4 * start : 4 * (start + length)]
                out.append(
                    (keys[row], start, length, zlib.crc32(part), len(ids[row]) // 4, number, offset)
                    + ((part,) if keep_ids else ())
                )
                offset += length
        return pd.DataFrame(out, columns=names)

    schema = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    schema += ", ids binary" if keep_ids else ""
    names = [c.split()[0] for c in schema.split(", ")]
    found = dealt.groupBy(F.pmod("deal", F.lit(groups)).alias("group")).applyInPandas(pack_rows, schema)
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def padding(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequences, tokens and padding of a packing. A sequence is padded to `capacity`, but not at a power of two."""
    filled = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.bit_count("n") == 1
    return filled.agg(
        F.count("*").alias("sequences"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(power, 0).otherwise(capacity - F.col("n"))), F.lit(0)).alias("padding"),
    )


def op11_tournament_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
