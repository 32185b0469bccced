"""BPE encoding and decoding (operator 6) with reuse of content-defined chunks.

A rolling (gear) hash over the UTF-8 bytes cuts each text where its top bits are
zero, so equal passages give equal chunks wherever they stand. A worker encodes and
decodes a distinct chunk once until its bounded memory is full and all is forgotten. At a joint of two chunks
the text is encoded again: the stretch is widened to both sides until it reaches
sync points, places where both sides' tokens must agree (a visible ASCII character
followed by a space: the byte-level pattern always splits there, and no token or
special token holds both). What a chunk's interior keeps is what the whole text's
encoding has there. Chunks without a sync point become part of a longer stretch.

Defined results: null and empty texts have no tokens (digests of nothing); repeated
rows are encoded each; a column named like ``out`` is replaced, other columns stay.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches

#: Bytes the rolling hash sees; a power of two.
WINDOW = 16
#: A chunk has so many bytes in the mean, as a power of two.
CHUNK_BITS = 9
#: Bytes a worker remembers, with 8 for each byte of chunk text and 200 a chunk; beyond, all is forgotten.
CACHE_BYTES = 24 << 20


def gear_table(seed: int = 1) -> np.ndarray:
    """256 random 64-bit values by the splitmix rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


GEAR = gear_table()

#: The byte-level pattern, for the faster of the two libraries.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters on whose class all regex libraries agree; "<|" may begin a special token.
UNSURE = re.compile("[^\\x20-\\x7E\\n\\t\u00c0-\u024f]|<\\|")


def byte_ranks(path: str) -> dict[bytes, int]:
    """Merge ranks (bytes -> id) of a byte-level vocabulary; visible bytes stand for themselves, the rest for U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    of = {chr(b): b for b in seen} | {chr(0x100 + i): b for i, b in enumerate(sorted({*range(256)} - {*seen}))}
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    special = {t["content"] for t in made["added_tokens"]}
    return {bytes(of[c] for c in piece): i for piece, i in made["model"]["vocab"].items() if piece not in special}


def cuts(data: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash ends a chunk."""
    h = GEAR[data]
    m = 1
    while m < WINDOW:
        h[m:] += h[:-m] << np.uint64(m)
        m *= 2
    return np.flatnonzero((h >> np.uint64(64 - CHUNK_BITS)) == 0) + 1


def stretches(raw: bytes) -> list[bytes]:
    """Interiors of chunks and repaired joints, in order; joined they are ``raw``."""
    n = len(raw)
    if n < 1 << CHUNK_BITS:
        return [raw] if n else []
    data = np.frombuffer(raw, dtype=np.uint8)
    at = cuts(data)
    sync = np.flatnonzero((data[1:] == 0x20) & (data[:-1] > 0x20) & (data[:-1] < 0x7F)) + 1
    if not len(at) or not len(sync):
        return [raw]
    sync = np.concatenate(([0], sync, [n]))
    left = sync[np.searchsorted(sync, at, "right") - 1]
    right = sync[np.searchsorted(sync, at, "left")]
    edges = np.unique(np.concatenate(([0], left, right, [n]))).tolist()
    return [raw[a:b] for a, b in zip(edges, edges[1:])]


class Encoder:
    """The tokenizer of ``path`` with remembered stretches: bytes -> (ids, ids as text, decoded bytes).

    Stretches whose characters all regex libraries class alike are merged by tiktoken
    from the same vocabulary, which is six times as fast; all others, and those that
    may hold a special token, by the tokenizers library. The latter decodes all.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=byte_ranks(path), special_tokens={})
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, tuple[int, bytes, bytes]] = {}
        self.size = self.encoded = self.asked = 0

    def learn(self, wanted: set[bytes]) -> None:
        if self.size > CACHE_BYTES:
            self.known, self.size = {}, 0
        new = [w for w in wanted if w not in self.known]
        texts = [w.decode("utf-8", "replace") for w in new]
        unsure = [bool(UNSURE.search(t)) for t in texts]
        slow = iter(self.tokenizer.encode_batch_fast([t for t, u in zip(texts, unsure) if u], add_special_tokens=False))
        ids = [next(slow).ids if u else self.plain.encode_ordinary(t) for t, u in zip(texts, unsure)]
        back = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        for w, t, i, b in zip(new, texts, ids, back):
            self.known[w] = (len(i), ",".join(map(str, i)).encode(), w if b == t else b.encode())
            self.size += 8 * len(w) + 200
        self.encoded += len(new)

    def encode(self, texts: list[str | None], with_ids: bool) -> Iterator[tuple]:
        parts = [stretches((t or "").encode("utf-8", "surrogatepass")) for t in texts]
        self.asked += sum(map(len, parts))
        self.learn({p for ps in parts for p in ps})
        for ps in parts:
            found = [self.known[p] for p in ps]
            ids = b",".join([f[1] for f in found if f[0]])
            decoded = hashlib.sha256()
            for f in found:
                decoded.update(f[2])
            row = (sum(f[0] for f in found), hashlib.sha256(ids).hexdigest(), decoded.hexdigest())
            yield (*row, np.array(ids.split(b",") if ids else [], dtype=np.int32)) if with_ids else row


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_bpe(df: DataFrame, path: str, text: str = "text", out: str = "bpe", with_ids: bool = True) -> DataFrame:
    """``df`` with a struct column ``out``: n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    ``path``: the tokenizer's JSON file on each executor's machine; byte-level BPE
    without prefix space, whose pattern splits before a space that follows a visible
    character.
    """
    bounded_batches(df.sparkSession)
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(path)
        for texts in batches:
            yield pd.DataFrame(list(own.encode(list(texts), with_ids)), columns=names)

    return df.withColumn(out, run(F.col(text)))
