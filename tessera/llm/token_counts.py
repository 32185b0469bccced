"""Token counts (operator 3): count-only Viterbi over a unigram vocabulary.

Counts are those of a unigram tokenizer with Metaspace pre-tokenisation and byte
fallback: spaces become U+2581, a text that does not begin with one gets one, and
the text is cut before each. An Aho-Corasick automaton lists the vocabulary entries
that end at each character; dynamic programming carries the best score, the number
of pieces and whether the last piece was unknown. Ties fall as in the tokenizers
library: a later candidate must be strictly better, candidates come by ascending
start, and an unknown character comes after the entries that begin where it does.

Defined results: null and empty texts have 0 tokens and score 0; repeated rows are
counted each; a column named like ``out`` is replaced, other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches

SPACE = "▁"
#: What an unknown character scores below the worst entry.
UNKNOWN_PENALTY = 10.0
#: A worker remembers so many words, of so many characters at most.
CACHE_WORDS, CACHE_CHARS = 500_000, 64


class Counter(dict):
    """Word -> (pieces, score); computes and remembers missing words."""

    def __init__(self, pieces: list[tuple[str, float]], unknown_id: int = 0):
        super().__init__()
        import ahocorasick

        self.entries = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(pieces):
            if piece:
                self.entries.add_word(piece, (len(piece), score, i == unknown_id))
        self.entries.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.known = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in self.known for b in range(256))

    def _run(self, text: str) -> int:
        """Tokens of consecutive unknown pieces, which the tokenizer takes as one text."""
        return len(text.encode("utf-8", "surrogatepass")) if self.bytes and text not in self.known else 1

    def count(self, word: str) -> tuple[int, float]:
        n = len(word)
        best: list[float | None] = [0.0] + [None] * n
        pieces, run = [0] * (n + 1), [-1] * (n + 1)  # pieces before the last run of unknowns; its start
        single, end = -1, 0  # single: the last position with an entry of one character

        def total(e: int) -> int:
            return pieces[e] if run[e] < 0 else pieces[e] + self._run(word[run[e] : e])

        def unknown(s: int, e: int, score: float) -> None:
            best[e], pieces[e], run[e] = score, pieces[s], run[s] if run[s] >= 0 else s

        def close(e: int) -> None:
            """The unknown candidate of the character before e, which comes last."""
            score = best[e - 1] + self.unknown
            if single != e and (best[e] is None or score > best[e]):
                unknown(e - 1, e, score)

        for at, (size, add, is_unknown) in self.entries.iter(word):
            while end < at:
                end += 1
                close(end)
            e, s = at + 1, at + 1 - size
            if size == 1:
                single = e
            score = best[s] + add
            if best[e] is None or score > best[e]:
                if is_unknown:
                    unknown(s, e, score)
                else:
                    best[e], pieces[e], run[e] = score, total(s) + 1, -1
        while end < n:
            end += 1
            close(end)
        return total(n), best[n]

    def __missing__(self, word: str) -> tuple[int, float]:
        made = self.count(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = made
        return made


def words_of(text: str | None) -> list[str]:
    """The pre-tokens: each begins with the replaced space, and only there has one."""
    if not text:
        return []
    text = text.replace(" ", SPACE)
    first, *rest = text.split(SPACE)
    return ([SPACE + first] if first else []) + [SPACE + w for w in rest]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of each id of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def count_tokens(df: DataFrame, path: str, text: str = "text", out: str = "tokens") -> DataFrame:
    """``df`` with a struct column ``out`` (n_tokens long, score double) for each whole text.

    ``path``: the vocabulary file, on each executor's machine.
    """
    bounded_batches(df.sparkSession)

    @F.pandas_udf("n_tokens long, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counts = counter(path)
        for texts in batches:
            rows = []
            for t in texts:
                found = [counts[w] for w in words_of(t)]
                rows.append((sum(c for c, _ in found), float(sum(s for _, s in found))))
            yield pd.DataFrame(rows, columns=["n_tokens", "score"])

    return df.withColumn(out, run(F.col(text)))
