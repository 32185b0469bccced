"""Benchmark decontamination (operator 10): q-gram lemma filter in diagonal bands, then banded alignment.

Texts are compared as lower-case letters and digits with single spaces between words.
A passage of m characters found with at most e edits shares at least
m + 1 - q - q * e of its q-grams with the place, on diagonals (place in the document
less place in the passage) within a stretch of e + 1. For each passage, shared
q-grams are counted in cells of e + 1 diagonals; two neighbouring cells form a band,
so that bands overlap and one of them holds the whole stretch. Bands that meet the
bound are aligned, those of a run of neighbours (repetitive passages) as one, and
reported if the edits are within the budget.

Passages of fewer than LEAST_CHARS characters are searched without edits and between word
borders (both texts are given a space at either end); those too short for a q-gram by
a plain search.

Defined results: null and empty texts, and passages without a letter or digit, match
nothing; of places of a passage that overlap, or that lie on one run of neighbouring
diagonals, the one with the fewest edits is reported, the first on ties, and of others
each; repeated rows are searched each; keys are of any type, items are integers; other
columns stay, whatever their names. Passages are searched in blocks, so that the index
a worker holds is bounded; documents are read once for each block.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, durable, free_names

Q = 6
#: Edits allowed, as a share of a passage's characters.
EDIT_SHARE = 0.12
#: Shorter passages are searched without edits, as whole words.
LEAST_CHARS = 30
#: Share of the bound by which frequent q-grams are left out of the count.
LEFT_OUT = 0.5
#: Characters of passages in one block's index.
BLOCK_CHARS = 4_000_000
#: Positions of a document in a piece; pieces overlap by more than the longest passage.
PIECE = 1 << 18
RESULT = "array<struct<item_id:long,start:long,end:long,edits:int>>"


@lru_cache(maxsize=1)
def _alphabet() -> np.ndarray:
    """Code point -> lower-case code point of a letter or digit, else a space."""
    made = np.full(1 << 16, 32, dtype=np.uint32)
    for c in range(1 << 16):
        if chr(c).isalnum():
            low = chr(c).lower()
            made[c] = ord(low) if len(low) == 1 else c
    return made


def normalise(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Compared code points and the place of each in the text."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = np.where(codes < 1 << 16, _alphabet()[np.minimum(codes, 0xFFFF)], codes)
    keep = np.ones(len(low), dtype=bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    at = np.flatnonzero(keep)
    low = low[at]
    if len(low) and low[0] == 32:
        low, at = low[1:], at[1:]
    if len(low) and low[-1] == 32:
        low, at = low[:-1], at[:-1]
    return low, at


def grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the q-gram at each position."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    c, h = codes.astype(np.uint64), np.zeros(n, dtype=np.uint64)
    for i in range(Q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[i : i + n]
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


class Index:
    """Q-grams of a block of passages: hash -> passages and places."""

    BITS, NONE, MANY = 21, -1, -2

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.codes, self.tiny = [], [], []
        whole = []
        for item, text in sorted(items):
            codes = normalise(text)[0]
            short = len(codes) < LEAST_CHARS
            codes = np.pad(codes, 1, constant_values=32) if short and len(codes) else codes
            if len(codes) >= Q:
                self.ids.append(item)
                self.codes.append(codes)
                whole.append(short)
            elif len(codes):
                self.tiny.append((item, codes.tobytes(), len(codes)))
        self.whole = np.array(whole, dtype=bool)
        m = np.array([len(c) for c in self.codes], dtype=np.int64)
        self.edits = np.where(self.whole, 0, np.minimum((m * EDIT_SHARE).astype(np.int64), np.maximum(0, (m - Q) // Q)))
        self.least = m + 1 - Q - Q * self.edits
        self.size = m
        hashes = [grams(c) for c in self.codes]
        h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        item = np.repeat(np.arange(len(m)), [len(x) for x in hashes])
        place = np.concatenate([np.arange(len(x)) for x in hashes]) if hashes else np.zeros(0, dtype=np.int64)
        # Of each passage, the q-grams most frequent among passages are left out; a match may lose
        # each of them once, so that the bound falls by as many and no match is missed.
        times = np.unique(h, return_inverse=True, return_counts=True)
        common = times[2][times[1]] if len(h) else np.zeros(0, dtype=np.int64)
        out = (self.least * LEFT_OUT).astype(np.int64)
        by = np.lexsort((place, -common, item))
        nth = np.arange(len(by)) - np.repeat(np.concatenate(([0], np.cumsum([len(x) for x in hashes])))[:-1], [len(x) for x in hashes]) if len(by) else by
        by = by[nth >= out[item[by]]]
        h, item, place = h[by], item[by], place[by]
        self.least = self.least - out
        order = np.argsort(h, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        # slot of a hash's upper bits -> its key; MANY where several keys share a slot
        slot, at, times = np.unique((self.keys >> np.uint64(64 - self.BITS)).astype(np.int64), return_index=True, return_counts=True)
        self.slots = np.full(1 << self.BITS, self.NONE, dtype=np.int32)
        self.slots[slot] = np.where(times == 1, at, self.MANY)
        self.item, self.place, self.count, self.first = (x.astype(np.int32) for x in (self.item, self.place, self.count, self.first))

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of each place of a passage, in the text's code points."""
        codes, at = normalise(text)
        n = len(codes)
        if not n:
            return []
        codes = np.pad(codes, 1, constant_values=32)  # position p here is p - 1 among the compared characters
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        if len(self.keys) and len(codes) >= Q:
            over = int((self.size + 2 * self.edits).max()) + Q
            for begin in range(0, max(1, len(codes) - over), PIECE):
                for i, start, end, edits in self._piece(codes[begin : begin + PIECE + over]):
                    trim = int(self.whole[i])
                    found.setdefault((self.ids[i], i), []).append((edits, begin + start + trim, begin + end - trim))
        raw = codes.tobytes() if self.tiny else b""
        for k, (item, own, size) in enumerate(self.tiny):
            p = _find(raw, own, 0)
            while p >= 0:
                found.setdefault((item, len(self.ids) + k), []).append((0, p + 1, p + size - 1))
                p = _find(raw, own, p + 1)
        made = []
        for (item, _), places in sorted(found.items()):
            kept: list[tuple[int, int, int]] = []  # in order; fewest edits first, then those that overlap none
            for edits, start, end in sorted(places):
                k = bisect_left(kept, (start,))
                if (k == len(kept) or kept[k][0] >= end) and (not k or kept[k - 1][1] <= start):
                    kept.insert(k, (start, end, edits))
            made += [(item, int(at[max(0, s - 1)]), int(at[min(n, e - 1) - 1]) + 1, d) for s, e, d in kept]
        return made

    def _piece(self, codes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        h = grams(codes)
        key = self.slots[(h >> np.uint64(64 - self.BITS)).astype(np.int64)]
        where = np.flatnonzero(key != self.NONE).astype(np.int32)
        key, own = key[where], h[where]
        many = np.flatnonzero(key == self.MANY)
        key[many] = np.minimum(np.searchsorted(self.keys, own[many]), len(self.keys) - 1)
        hit = self.keys[key] == own
        where, key = where[hit], key[hit]
        if not len(where):
            return
        n = self.count[key]
        at = np.repeat(self.first[key] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, diagonal = self.item[at], np.repeat(where, n) - self.place[at]
        # passages that share enough q-grams with the piece at all
        enough = np.bincount(item, minlength=len(self.ids)) >= self.least
        own = enough[item]
        item, diagonal = item[own], diagonal[own]
        if not len(item):
            return
        item, diagonal = item.astype(np.int64), diagonal.astype(np.int64)
        width = self.edits[item] + 1
        cell = (diagonal + self.size[item]) // width
        cells = int(cell.max()) + 3
        keys, counts = np.unique(item * cells + cell, return_counts=True)
        follow = np.searchsorted(keys, keys + 1)
        beside = np.where((follow < len(keys)) & (keys[np.minimum(follow, len(keys) - 1)] == keys + 1), counts[np.minimum(follow, len(keys) - 1)], 0)
        before = np.searchsorted(keys, keys - 1)
        prior = np.where((before < len(keys)) & (keys[np.minimum(before, len(keys) - 1)] == keys - 1), counts[np.minimum(before, len(keys) - 1)], 0)
        meets = np.maximum(counts + beside, counts + prior) >= self.least[keys // cells]
        met = keys[meets]
        # runs of neighbouring cells are aligned as one band, with the cell beside each end
        starts = np.flatnonzero(np.concatenate(([True], np.diff(met) != 1))) if len(met) else met
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(met)).tolist()):
            i, first = divmod(int(met[a]), cells)
            w, m = int(self.edits[i]) + 1, int(self.size[i])
            low = (first - 1) * w - m
            found = align(self.codes[i], codes, low, low + (b - a + 2) * w - 1, int(self.edits[i]))
            if found:
                yield (i, *found)


def _find(raw: bytes, own: bytes, start: int) -> int:
    """The first place from ``start`` of 32-bit codes in others, or -1."""
    at = raw.find(own, 4 * start)
    while at > 0 and at % 4:
        at = raw.find(own, at + 1)
    return at // 4 if at >= 0 else -1


def align(passage: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """Best (start, end, edits) of the whole passage in the text on diagonals low to high, or none within the budget.

    Rows are the passage's characters, columns the diagonals; beginnings and ends in the
    text are free. The start is found by aligning backwards from the best end.
    """
    begin = max(0, low)
    at = _find(text[begin : high + len(passage)].tobytes(), passage.tobytes(), 0)
    if at >= 0:  # unchanged
        return begin + at, begin + at + len(passage), 0
    if not budget:
        return None
    end, edits = _ends(passage, text, low, high, budget)
    if edits > budget:
        return None
    back, edits = _ends(passage[::-1], text[:end][::-1], -edits, edits, edits, fixed=True)  # so many edits leave no other diagonals
    return end - back, end, edits


def _ends(passage: np.ndarray, text: np.ndarray, low: int, high: int, budget: int, fixed: bool = False) -> tuple[int, int]:
    """The diagonal's end of the best alignment and its edits; more than the budget as soon as no row can meet it."""
    m, n, far = len(passage), len(text), 1 << 20
    diagonals = np.arange(low, high + 1)
    steps = np.arange(len(diagonals))
    row = np.where((diagonals >= 0) & (diagonals <= n), 0, far)
    if fixed:  # must begin at the text's first character
        row = np.where(diagonals >= 0, diagonals, far)
    for i in range(1, m + 1):
        at = diagonals + i - 1  # the text's character of a match
        inside = (at >= 0) & (at < n)
        differs = np.ones(len(at), dtype=np.int64)
        differs[inside] = text[at[inside]] != passage[i - 1]
        new = np.where(inside, row + differs, far)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)  # a character of the passage left out
        new = np.where((at + 1 >= 0) & (at + 1 <= n), new, far)
        row = np.minimum(new, np.minimum.accumulate(new - steps) + steps)  # characters of the text put in
        if i % 8 == 0 and row.min() > budget:
            return 0, budget + 1
    k = int(row.argmin())
    return int(diagonals[k]) + m, int(row[k])


def find_passages(df: DataFrame, passages: list[tuple[int, str]], text: str = "text", out: str = "passages") -> DataFrame:
    """``df`` with an array column ``out`` (RESULT) of the passages found in each whole text."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(passages)

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(shared.value)
        names = ("item_id", "start", "end", "edits")
        for texts in batches:
            yield pd.Series([[dict(zip(names, found)) for found in index.search(t)] for t in texts])

    return df.withColumn(out, run(F.col(text)))


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The passages, in blocks of about BLOCK_CHARS characters; each is fetched when it is used."""
    rows = benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(text).alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    total = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    for i in range(n):
        own = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield [(r["item_id"], r["text"]) for r in own.collect()]


def leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, start, end, edits) of each place of a passage in a document."""
    rows, made = df.select(F.col(key).alias("key"), F.col(text).alias("text")), None
    for block in blocks(benchmark):
        found = find_passages(rows, block, "text", "found")
        # of an inner explode Catalyst would infer a filter that searches a second time
        found = found.select("key", F.explode_outer("found").alias("p")).filter(F.col("p").isNotNull()).select(F.col("key").alias(key), "p.*")
        made = found if made is None else made.unionByName(found)
    if made is None:
        return find_passages(rows, [], "text", "found").select(F.col("key").alias(key), F.explode("found").alias("p")).filter(F.lit(False)).select(key, "p.*")
    return made


def drop_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without the documents that hold a passage."""
    kept, (found,) = df, free_names(df, 1)
    for i, block in enumerate(blocks(benchmark)):
        kept = durable(kept) if i else kept
        kept = find_passages(kept, block, text, found).filter(F.size(found) == 0).drop(found)
    return kept
