"""Token counts by dynamic programming over a shared trie.

A text is cut into pre-tokens (see pieces.py). The distinct pre-tokens of some hundred texts that a worker has not met
yet are inserted into a trie, level by level over arrays; a node holds the best unigram score of the prefix that it
stands for and the number of pieces in it, computed from the nodes above it, so a prefix that many pre-tokens share is
scored once. What a pre-token's last node holds is stored, and a text's count is the sum over its pre-tokens.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches
from .kernels import texts_of
from .pieces import _CHUNK, BYTE_SCORE, Lattice, Vocabulary, prepared, slices

#: Pre-tokens after which a worker's store starts anew, and characters of a pre-token that it keeps whole.
MOST_TOKENS, MOST_CHARS = 800_000, 60
RESULT = "n_pretokens long, n_tokens long, score double"


class Trie:
    """The tries of pre-tokens, and the final counts and scores of all that were inserted."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.lattice = vocabulary, Lattice(vocabulary)
        self.clear()

    def clear(self) -> None:
        self.final: dict[str, int] = {}
        self.count, self.score = array("q"), array("d")

    def __getitem__(self, token: str) -> tuple[int, float]:
        self.insert([token])
        at = self.final[token]
        return self.count[at], self.score[at]

    def insert(self, tokens: list[str]) -> None:
        """Final counts and scores of the tokens that have none yet. A long token is the sum of its independent parts."""
        new = set(tokens).difference(self.final)
        long = [t for t in new if len(t) > MOST_CHARS]
        parts = {t: self.vocabulary.split(t) for t in long}
        new.difference_update(long)
        new.update(p for p in chain.from_iterable(parts.values()) if p not in self.final and p not in parts)
        for own in _even(sorted(new, key=len)):
            self._add(own, *self._scored(own))
        for t, own in parts.items():
            at = [self.final[p] for p in own if p != t]
            if at:
                self._add([t], [sum(self.count[i] for i in at)], [math.fsum(self.score[i] for i in at)])
            else:  # a single part
                self._add([t], *self._scored([t]))

    def _add(self, tokens: list[str], counts: list[int], scores: list[float]) -> None:
        self.final.update(zip(tokens, range(len(self.count), len(self.count) + len(tokens)), strict=True))
        self.count.extend(counts)
        self.score.extend(scores)

    def _scored(self, tokens: list[str]) -> tuple[list[int], list[float]]:
        lattice, n = self.lattice, len(tokens)
        sizes = np.fromiter(map(len, tokens), np.int64, n)
        width = int(sizes.max(initial=0))
        codes = lattice.codes(tokens, width)
        # One level of nodes after the other: a node is a node above it and a character. The root is the only one of level 0.
        above, scores, counts = [np.zeros(1, np.int64)], [np.zeros(1)], [np.zeros(1, np.int64)]
        chars = [np.zeros(1, np.uint64)]
        at, final_count, final_score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
        for level in range(1, width + 1):
            going = np.flatnonzero(sizes >= level)
            made, place = np.unique(at[going].astype(np.uint64) << np.uint64(21) | codes[level - 1][going], return_inverse=True)
            at[going] = place
            above.append((made >> np.uint64(21)).astype(np.int64))
            chars.append(made & np.uint64((1 << 21) - 1))
            best, best_count = np.full(len(made), -np.inf), np.zeros(len(made), np.int64)
            back, h = np.arange(len(made)), np.zeros(len(made), np.uint64)
            for length in range(1, min(level, lattice.most) + 1):
                h += chars[level - length + 1][back] * lattice.power[length - 1]
                back = above[level - length + 1][back]
                rows, piece = lattice.found(h)
                if length == 1:
                    self._bytes(chars[level], rows, scores[level - 1][back], counts[level - 1][back], best, best_count)
                value, pieces = scores[level - length][back[rows]] + lattice.scores[piece], counts[level - length][back[rows]] + 1
                wins = (value > best[rows]) | ((value == best[rows]) & (pieces < best_count[rows]))
                best[rows[wins]], best_count[rows[wins]] = value[wins], pieces[wins]
            scores.append(best)
            counts.append(best_count)
            done = going[sizes[going] == level]
            final_count[done], final_score[done] = best_count[at[done]], best[at[done]]
        return final_count.tolist(), final_score.tolist()

    @staticmethod
    def _bytes(chars: np.ndarray, known: np.ndarray, scores: np.ndarray, counts: np.ndarray, best: np.ndarray, best_count: np.ndarray) -> None:
        """What a character without a piece is worth: the bytes of its UTF-8."""
        without = np.ones(len(chars), bool)
        without[known] = False
        code = chars[without] - np.uint64(1)
        size = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
        best[without], best_count[without] = scores[without] + BYTE_SCORE * size, counts[without] + size


def _even(tokens: list[str], most: int = 1 << 18) -> Iterator[list[str]]:
    """Tokens, sorted by length, in lists whose arrays have at most so many cells or one token."""
    own: list[str] = []
    for t in tokens:
        if own and len(t) * (len(own) + 1) > most:
            yield own
            own = []
        own.append(t)
    if own:
        yield own


_tries: list[Trie] = []


def _counted(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _tries or _tries[0].vocabulary.path != path:
            _tries[:] = [Trie(Vocabulary(path))]
        trie = _tries[0]
        for batch in batches:
            at = 0
            for texts in slices(texts_of(batch["text"])):
                if len(trie.final) > MOST_TOKENS:
                    trie.clear()
                cut = [_CHUNK.findall(prepared(t)) for t in texts]
                whole = list(chain.from_iterable(cut))
                trie.insert(whole)
                place = np.fromiter(map(trie.final.__getitem__, whole), np.int64, len(whole))
                ends = np.cumsum([0, *map(len, cut)])
                counts = np.concatenate([[0], np.cumsum(np.frombuffer(trie.count, np.int64)[place])])[ends]
                scores = np.frombuffer(trie.score, np.float64)[place].tolist()
                sums = [math.fsum(scores[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
                columns = [batch["doc_id"].slice(at, len(texts)), pa.array(np.diff(ends)), pa.array(np.diff(counts)), pa.array(sums, pa.float64())]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pretokens", "n_tokens", "score"])

    return run


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and RESULT for each row: the pieces of the best segmentation (of equal ones the shortest), and its score.

    A null or empty text has no tokens; a very long text or pre-token is counted whole; equal rows get equal results;
    an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_batches(rows, _counted(model), f"doc_id long, {RESULT}")
