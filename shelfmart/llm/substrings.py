"""Exact removal of repeated byte strings across documents.

Every window of `LENGTH` bytes has an anchor: its least hashed gram. Equal windows have equal anchors at equal places, so
it is enough to compare windows whose anchors are equal, and anchors are few. Documents are dealt to blocks of bounded
size. A first round finds the anchors that occur in more than one document; a second sends the stretches of text around
those anchors to the anchors' buckets, where the suffixes that begin at the anchors, and what stands before them read
backwards, are sorted and every window learns the smallest document that holds it; a third removes what is covered.

The sort compares suffixes by prefix polynomial hashes: binary search finds how far two of them agree, so a comparison
takes logarithmic time in the window's length. How far neighbours agree, and that they are in order, is told by their
bytes. Two windows with their anchor at one place are equal if their stretches agree as far as they reach on both sides.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmart.llm.common import ranges, small_batches, table, text_bytes

LENGTH, GRAM = 50, 20
BLOCK_BYTES = 3 << 19
BLOCKS_A_BUCKET = 4  # about so many blocks' anchors meet in a bucket
HOT_BLOCKS = 2_000  # an anchor in more blocks sends its windows one by one, to buckets of their own hash
PIECE = 1 << 17  # window starts hashed at once
PLACE_BITS = 18
WINDOWS_AT_ONCE = 200_000  # sorted together, where one anchor has no more
BASE = 0x9E3779B97F4A7C15  # odd, of the polynomial hash modulo 2^64
UNIQUE, REPEATED, HOT = 0, 1, 2
U64 = np.uint64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse modulo 2^64."""
    if n > len(_cache[0]):
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, dtype=U64)
            steps[0] = 1
            _cache[k] = np.multiply.accumulate(steps)
    return _cache[0][:n], _cache[1][:n]


_cache = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


class PrefixHashes:
    """Hashes of any part of a byte array from those of its prefixes."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(data * power[:-1], out=self.prefix[1:])

    def of(self, starts: np.ndarray, lengths) -> np.ndarray:
        return (self.prefix[starts + lengths] - self.prefix[starts]) * self.inverse[starts]

    def grams(self, n: int) -> np.ndarray:
        return (self.prefix[n:] - self.prefix[:-n]) * self.inverse[: len(self.prefix) - n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(29))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xFF51AFD7ED558CCD)
    return x ^ (x >> U64(31))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    reach, out = 1, x
    while 2 * reach <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    return np.minimum(out[: len(out) - (width - reach)], out[width - reach :]) if reach < width else out


@dataclass
class Anchors:
    """Anchors of a block: the document, the first and last start of the windows that have it, its place, its hash."""

    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    place: np.ndarray
    hash: np.ndarray


def _anchors_of(parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """Of some pieces (document, place in it, bytes), together no longer than 2^PLACE_BITS bytes."""
    data = np.frombuffer(b"".join(p[2] for p in parts), dtype=np.uint8)
    lengths = np.array([len(p[2]) for p in parts])
    begins = np.cumsum(lengths) - lengths
    gram = _mixed(PrefixHashes(data).grams(GRAM))
    low = U64((1 << PLACE_BITS) - 1)
    # the place in the low bits makes the leftmost of equal grams the least, and tells where it is
    least = _sliding_min((gram & ~low) | np.arange(len(gram), dtype=U64), LENGTH - GRAM + 1)
    owner = np.repeat(np.arange(len(parts)), np.maximum(lengths - LENGTH + 1, 0))
    counts = np.bincount(owner, minlength=len(parts))
    starts = begins[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = (least[starts] & low).astype(np.int64)
    new = np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]
    at = np.flatnonzero(new)
    end = np.r_[at[1:], len(place)] - 1
    part = owner[at]
    shift = np.array([p[1] for p in parts])[part] - begins[part]
    doc = np.array([p[0] for p in parts])[part]
    # least hashes are small, so they are mixed once more to fall evenly on the buckets
    return doc, starts[at] + shift, starts[end] + shift, place[at] + shift, _mixed(gram[place[at]]) & ~U64(1)


def anchors(texts: list[bytes]) -> Anchors:
    found, parts, size = [], [], 0
    for doc, data in enumerate(texts):
        for at in range(0, len(data) - LENGTH + 1, PIECE):
            part = data[at : at + PIECE + LENGTH - 1]
            if size + len(part) > 1 << PLACE_BITS:
                found.append(_anchors_of(parts))
                parts, size = [], 0
            parts.append((doc, at, part))
            size += len(part)
    if parts:
        found.append(_anchors_of(parts))
    if not found:
        none = np.empty(0, dtype=np.int64)
        return Anchors(none, none, none, none, none.astype(U64))
    return Anchors(*map(np.concatenate, zip(*found)))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Grows with the hash, so that sorted hashes lie bucket after bucket."""
    return ((hashes >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _blobs(values: np.ndarray, bucket: np.ndarray) -> list[tuple[int, bytes]]:
    cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)]
    return [(int(bucket[a]), values[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]


def in_order(rows: pd.DataFrame) -> tuple[pd.DataFrame, list[bytes]]:
    """The rows of a block and their texts in an order that follows from them alone; rows in no order are equal."""
    texts = [(t or "").encode() for t in rows["t"]]
    ids, named = rows["k"].tolist(), rows["named"].tolist()
    order = sorted(range(len(texts)), key=lambda i: (ids[i], named[i], texts[i]))
    return rows.iloc[order].reset_index(drop=True), [texts[i] for i in order]


@dataclass
class Places:
    """Where stretches of a block lie, in the order of its text: the document, the start of the first window, the number
    of windows, and the place of the stretch among those the block sends, -1 where an earlier document of the block has
    it."""

    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray
    stretch: np.ndarray

    def packed(self) -> bytes:
        steps = [np.diff(x, prepend=0).astype("<i4").tobytes() for x in (self.doc, self.start)]
        return zlib.compress(b"".join([*steps, self.count.astype("u1").tobytes(), self.stretch.astype("<i4").tobytes()]), 1)

    @classmethod
    def unpacked(cls, data: bytes) -> Places:
        data = zlib.decompress(data)
        n = len(data) // 13
        doc, start = (np.cumsum(np.frombuffer(data, "<i4", n, at), dtype=np.int64) for at in (0, 4 * n))
        return cls(doc, start, np.frombuffer(data, "u1", n, 8 * n).astype(np.int64), np.frombuffer(data, "<i4", n, 9 * n))

    def covered(self, bits: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Removed runs of each document that has some. `bits` says which windows of a stretch an earlier document has,
        for the least document of the block that has the stretch; any later one repeats that one."""
        marks = np.full(len(self.doc), (1 << 32) - 1, dtype=np.uint32)
        open_ = np.flatnonzero(self.stretch >= 0)
        marks[open_] = bits[self.stretch[open_]]
        some = np.flatnonzero(marks)
        counts = self.count[some]
        nth = ranges(np.zeros(len(some), dtype=np.int64), counts)
        hit = (np.repeat(marks[some], counts) >> nth.astype(np.uint32) & 1).astype(bool)
        at = (np.repeat(self.start[some], counts) + nth)[hit]
        doc = np.repeat(self.doc[some], counts)[hit]
        if not len(at):
            return {}
        new = np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + LENGTH)]
        last = np.r_[new[1:], True]
        runs: dict[int, list[tuple[int, int]]] = {}
        for d, begin, end in zip(doc[new].tolist(), at[new].tolist(), (at[last] + LENGTH).tolist(), strict=True):
            runs.setdefault(d, []).append((begin, end))
        return runs


class Block:
    """The documents of a block that have an id; everything follows from them alone, whatever their order."""

    def __init__(self, rows: pd.DataFrame, buckets: int):
        rows, self.texts = in_order(rows)
        self.buckets = buckets
        self.ids = rows["k"].to_numpy(np.int64)
        self.anchors = anchors([t if n else b"" for t, n in zip(self.texts, rows["named"], strict=True)])
        self.hashes, self.which = np.unique(self.anchors.hash, return_inverse=True)

    def questions(self) -> list[tuple[int, bytes]]:
        """Per bucket: the block's anchors, the lowest bit set where two of its documents have it."""
        ids, bounds = self.ids[self.anchors.doc], np.iinfo(np.int64)
        least, greatest = np.full(len(self.hashes), bounds.max), np.full(len(self.hashes), bounds.min)
        np.minimum.at(least, self.which, ids)
        np.maximum.at(greatest, self.which, ids)
        shared = least != greatest
        return _blobs(self.hashes | shared.astype(U64), _bucket(self.hashes, self.buckets))

    def stretches(self, codes: np.ndarray) -> Places:
        """Finds the stretches of text around repeated anchors, equal ones once, by bucket, and returns the places of
        all. A hot anchor has a stretch for each of its windows."""
        a = self.anchors
        code = codes[self.which]
        chosen = np.flatnonzero(code != UNIQUE)
        hot = code[chosen] == HOT
        each = np.where(hot, a.last[chosen] - a.first[chosen] + 1, 1)
        nth = ranges(np.zeros(len(chosen), dtype=np.int64), each)
        chosen, hot = np.repeat(chosen, each), np.repeat(hot, each)
        doc, start = a.doc[chosen].astype(np.int64), a.first[chosen] + nth
        end = np.where(hot, start, a.last[chosen])
        begins = np.cumsum([0, *map(len, self.texts)])[doc] + start
        text = b"".join(self.texts)
        known: dict[bytes, int] = {}
        number = np.array(
            [
                known.setdefault(b"%c%b" % (place, text[s:e]), len(known))
                for place, s, e in zip((a.place[chosen] - start).tolist(), begins.tolist(), (begins + end - start + LENGTH).tolist())
            ],
            dtype=np.int64,
        )
        keys, me = list(known), self.ids[doc]
        least = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(least, number, me)
        hashes = np.empty(len(keys), dtype=U64)
        hashes[number] = a.hash[chosen]
        for k in np.unique(number[hot]).tolist():
            hashes[k] = int.from_bytes(hashlib.blake2b(keys[k], digest_size=8).digest(), "little")
        bucket = _bucket(hashes, self.buckets)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self.keys = [keys[i] for i in order.tolist()]
        self.least, self.bucket = least[order], bucket[order]
        return Places(doc, start, end - start + 1, np.where(me > least[number], -1, rank[number]))

    def messages(self) -> list[tuple[int, bytes, bytes, bytes]]:
        cuts = np.r_[0, np.flatnonzero(np.diff(self.bucket)) + 1, len(self.bucket)]
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                sizes = np.array([len(k) for k in self.keys[a:b]], dtype=np.uint8)
                out.append((int(self.bucket[a]), self.least[a:b].tobytes(), sizes.tobytes(), b"".join(self.keys[a:b])))
        return out


def answer_anchors(hashes: list[np.ndarray]) -> list[np.ndarray]:
    """For the anchors of several blocks: unique, in more than one document, or in too many blocks to meet in one
    bucket."""
    flat = np.concatenate(hashes)
    plain = flat & ~U64(1)
    values, which, counts = np.unique(plain, return_inverse=True, return_counts=True)
    shared = np.zeros(len(values), dtype=bool)
    shared[which[(flat & U64(1)).astype(bool)]] = True
    code = np.where(counts > HOT_BLOCKS, HOT, np.where(shared | (counts > 1), REPEATED, UNIQUE)).astype(np.uint8)
    return np.split(code[which], np.cumsum([len(h) for h in hashes])[:-1])


def _common(h: PrefixHashes, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many bytes the suffixes at `a` and `b` agree in, up to `most`, by binary search on hashes."""
    found = np.zeros(len(a), dtype=np.int64)
    step = 1 << (most.bit_length() - 1)
    while step:
        ask = np.minimum(found + step, most)
        found = np.where(h.of(a, ask) == h.of(b, ask), ask, found)
        step //= 2
    return found


def _before(data: np.ndarray, h: PrefixHashes, a: np.ndarray, b: np.ndarray, most: int, or_equal: np.ndarray):
    common = _common(h, a, b, most)
    equal = common >= most
    at = np.minimum(common, most - 1)
    return np.where(equal, or_equal, data[a + at] < data[b + at])


def suffix_order(data: np.ndarray, h: PrefixHashes, starts: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """Order of the suffixes within each group (groups lie together), by their first `most` bytes: a stable mergesort
    of all groups at once. In a merge, an item's place is its own and that of the items before it in the other run."""
    n = len(starts)
    order = np.arange(n)
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[begin, n])
    low, high = np.repeat(begin, size), np.repeat(begin + size, size)
    width = 1
    while width < size.max(initial=0):
        at = np.arange(n) - low
        run = at // width
        other = low + (run ^ 1) * width
        stop = np.minimum(other + width, high)
        moving = np.flatnonzero(other < high)
        left, right = other[moving].copy(), stop[moving].copy()
        is_right = (run[moving] & 1).astype(bool)
        mine = starts[order[moving]]
        while (open_ := np.flatnonzero(left < right)).size:
            middle = (left[open_] + right[open_]) // 2
            theirs = starts[order[middle]]
            # an item of the right run comes after equal ones of the left
            first = _before(data, h, theirs, mine[open_], most, is_right[open_])
            left[open_] = np.where(first, middle + 1, left[open_])
            right[open_] = np.where(first, right[open_], middle)
        place = np.arange(n)
        place[moving] = low[moving] + (run[moving] & ~1) * width + (at[moving] - run[moving] * width)
        place[moving] += left - other[moving]
        merged = np.empty_like(order)
        merged[place] = order
        order = merged
        width *= 2
    return order


def least_of_windows(keys: list[bytes], least: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For stretches (a byte with the anchor's place, then the text) and the least document of each: where each one's
    windows begin in the result, and for every window the least document of all stretches that hold it."""
    sizes = np.array([len(k) - 1 for k in keys])
    counts = sizes - length + 1
    first = np.r_[0, np.cumsum(counts)]
    out = np.repeat(least, counts)
    groups: dict[bytes, int] = {}
    group = np.array([groups.setdefault(k[1 + k[0] : 1 + k[0] + GRAM], len(groups)) for k in keys])
    crowded = np.flatnonzero(np.bincount(group, minlength=len(groups))[group] > 1)
    crowded = crowded[np.argsort(group[crowded], kind="stable")]
    new = np.flatnonzero(np.r_[True, group[crowded][1:] != group[crowded][:-1]]) if len(crowded) else crowded
    part = np.cumsum(counts[crowded])[new - 1] // WINDOWS_AT_ONCE if len(crowded) else crowded
    if len(part):
        part[0] = 0
    cuts = [*new[np.flatnonzero(np.r_[True, part[1:] != part[:-1]])].tolist(), len(crowded)] if len(part) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        _settle(keys, crowded[a:b], group, sizes, first, out, length)
    return first, out


def _sorted_rows(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each row of bytes, groups lying together, and in how many bytes a row agrees with the one ranked before
    it, -1 at the beginning of a group."""
    n, most = rows.shape
    order = suffix_order(rows.ravel(), PrefixHashes(rows.ravel()), np.arange(n) * most, group, most)

    def agreement(order):
        one, two = rows[order[:-1]], rows[order[1:]]
        other = one != two
        common = np.where(other.any(axis=1), other.argmax(axis=1), most)
        at = np.minimum(common, most - 1)[:, None]
        rising = np.take_along_axis(one, at, 1) <= np.take_along_axis(two, at, 1)
        within = group[order[1:]] == group[order[:-1]]
        return np.r_[-1, np.where(within, common, -1)], bool((rising[:, 0] | ~within).all())

    common, sound = agreement(order)
    if not sound:  # hashes collided
        order = np.array(sorted(range(n), key=lambda i: (group[i], rows[i].tobytes())))
        common, _ = agreement(order)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    return rank, common


def _bytes_from(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int) -> np.ndarray:
    """Rows of `most` bytes from the starts on, zero beyond their lengths."""
    rows = np.lib.stride_tricks.sliding_window_view(np.r_[text, np.zeros(most, dtype=np.uint8)], most)[starts]
    rows[np.arange(most) >= lengths[:, None]] = 0
    return rows


def _settle(
    keys: list[bytes], crowded: np.ndarray, group: np.ndarray, sizes: np.ndarray, first: np.ndarray, out: np.ndarray,
    length: int,
) -> None:
    """Lower `out` for the windows of the stretches `crowded`, whole groups of equal anchors lying together."""
    size, group = sizes[crowded], np.unique(group[crowded], return_inverse=True)[1]
    text = np.frombuffer(b"".join(keys[k][1:] for k in crowded), dtype=np.uint8)
    place = np.array([keys[k][0] for k in crowded])
    anchor = np.cumsum(size) - size + place
    after, after_common = _sorted_rows(_bytes_from(text, anchor, size - place, length), group)
    before, before_common = _sorted_rows(_bytes_from(text[::-1], len(text) - anchor, place, length - GRAM), group)
    # windows can only be equal where the anchor is at the same place in them
    for at in range(place.max() + 1):
        mine = np.flatnonzero((place >= at) & (place - at <= size - length))
        # which agree up to the window's end, and from its beginning
        right = np.cumsum(after_common < length - at)[after[mine]]
        left = np.cumsum(before_common < at)[before[mine]]
        both = right * (len(size) + 1) + left
        by = np.argsort(both, kind="stable")
        head = np.flatnonzero(np.r_[True, np.diff(both[by]) != 0])
        window = (first[crowded[mine]] + place[mine] - at)[by]
        out[window] = np.repeat(np.minimum.reduceat(out[window], head), np.diff(np.r_[head, len(by)]))


def answer_stretches(messages: list[tuple[np.ndarray, list[bytes]]]) -> list[np.ndarray]:
    """For the stretches of several blocks: which windows of each a smaller document has than the block's least."""
    known: dict[bytes, int] = {}
    numbers = [np.array([known.setdefault(k, len(known)) for k in keys]) for _, keys in messages]
    least = np.full(len(known), np.iinfo(np.int64).max)
    for (mine, _), number in zip(messages, numbers, strict=True):
        np.minimum.at(least, number, mine)
    first, best = least_of_windows(list(known), least)
    out = []
    for (mine, _), number in zip(messages, numbers, strict=True):
        counts = first[number + 1] - first[number]
        ends = np.cumsum(counts)
        nth = np.arange(ends[-1]) - np.repeat(ends - counts, counts)
        earlier = best[np.repeat(first[number], counts) + nth] < np.repeat(mine, counts)
        out.append(np.add.reduceat(earlier.astype(np.uint32) << nth.astype(np.uint32), ends - counts).astype("<u4"))
    return out


def _answers(rows: pd.DataFrame, dtype) -> np.ndarray:
    """Answers to a block in the order of buckets."""
    return np.concatenate([np.frombuffer(a, dtype=dtype) for a in rows.sort_values("bucket")["answer"]] or [np.empty(0, dtype)])


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the bytes that remain).

    Null and empty texts have no bytes. Rows without an id keep everything and stand for no document. Rows with one id
    are none before the other; repeated rows give equal results. Other columns are not returned. An empty table gives
    no rows. `doc_id` must be an integer.
    """
    spark = docs.sparkSession
    blocks = max(1, -(-text_bytes(docs, text) // BLOCK_BYTES))
    buckets = max(1, -(-blocks // BLOCKS_A_BUCKET))
    small_batches(spark)
    rows = docs.select(
        F.pmod(F.xxhash64(doc_id, text), F.lit(blocks)).cast("int").alias("block"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("k"),
        F.col(doc_id).isNotNull().alias("named"),
        F.col(text).alias("t"),
    )
    by_block = rows.groupBy("block")

    def ask(key: tuple, mine: pd.DataFrame) -> pd.DataFrame:
        out = [(b, int(key[0]), blob) for b, blob in Block(mine, buckets).questions()]
        return pd.DataFrame(out, columns=["bucket", "block", "hashes"])

    def answer(key: tuple, mine: pd.DataFrame) -> pd.DataFrame:
        codes = answer_anchors([np.frombuffer(h, dtype=U64) for h in mine["hashes"]])
        return mine.assign(answer=[c.tobytes() for c in codes]).drop(columns="hashes")

    def send(key: tuple, mine: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(mine):
            block, me = Block(mine, buckets), int(key[0])
            places = block.stretches(_answers(answers, np.uint8))
            out = [(b, me, *parts) for b, *parts in block.messages()]
            if len(places.doc):
                out.append((-1 - me, me, b"", b"", places.packed()))
        return pd.DataFrame(out, columns=["bucket", "block", "least", "sizes", "stretches"])

    def compare(key: tuple, mine: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:  # what a block has to know in the last round
            return mine[["block", "bucket"]].assign(answer=mine["stretches"])
        messages = []
        for least, sizes, body in zip(mine["least"], mine["sizes"], mine["stretches"], strict=True):
            ends = np.cumsum(np.frombuffer(sizes, dtype=np.uint8), dtype=np.int64).tolist()
            messages.append((np.frombuffer(least, dtype=np.int64), [body[a:b] for a, b in zip([0, *ends], ends)]))
        found = [a.tobytes() for a in answer_stretches(messages)]
        return mine[["block", "bucket"]].assign(answer=found)

    def finish(key: tuple, mine: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame(columns=["k", "named", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        rows, texts = in_order(mine)
        known, runs_of = answers["bucket"] < 0, {}
        if known.any():
            places = Places.unpacked(answers.loc[known, "answer"].iloc[0])
            runs_of = places.covered(_answers(answers[~known], "<u4"))
        out = []
        for doc, data in enumerate(texts):
            runs = runs_of.get(doc, [])
            edges = [0, *[x for run in runs for x in run], len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        return pd.concat([rows[["k", "named"]], pd.DataFrame(out, columns=names)], axis=1)

    reply = "block int, bucket int, answer binary"
    asked = by_block.applyInPandas(ask, "bucket int, block int, hashes binary")
    codes = asked.groupBy("bucket").applyInPandas(answer, reply)
    sent = by_block.cogroup(codes.groupBy("block")).applyInPandas(
        send, "bucket int, block int, least binary, sizes binary, stretches binary"
    )
    bits = sent.groupBy("bucket").applyInPandas(compare, reply)
    out = by_block.cogroup(bits.groupBy("block")).applyInPandas(
        finish, "k long, named boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    return out.select(F.when(F.col("named"), F.col("k")).alias(doc_id), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).drop("kept")
