"""Harmonic packing: lengths fall into reciprocal-capacity classes, and a class's bins hold a fixed number of documents.

Class k = 1, 2, 3 ... holds pieces of more than capacity / (k + 1) and at most capacity / k tokens, k to a bin. A
document longer than a bin is cut at the capacity; what is left of it belongs to a class. The gap that a bin's k pieces
leave is filled by the head of a document that comes later, whose rest goes to its own class: so a document is cut once
or twice beside its full bins, and a bin has at most k pieces and one head. No such cut makes a piece of less than
1 / LEAST of a bin; a piece that would leave a smaller gap goes to the next bin, or gives up its end.

A task fills its bins from its own rows, with no shuffle. It keeps one open bin a class and at most WAITING bins that
wait for a head; when there are more, and at its end, their pieces are put one behind the other and cut at the capacity.
What is left at the end, less than one bin, goes into sequences whose lengths are powers of two, which need no padding.
Only in these two steps may a cut make a shorter piece, and a closing id is cut off alone only where no other order of
the last pieces avoids it.
"""

from __future__ import annotations

import os
import zlib
from bisect import insort
from collections import deque
from collections.abc import Callable, Iterator
from typing import NamedTuple
from unicodedata import normalize

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches
from .kernels import texts_of

CAPACITY = 2048
#: No cut leaves a piece shorter than this part of a bin, that is 64 tokens of 2048.
LEAST = 32
#: Bins of a task that wait for a head.
WAITING = 64
END = 1
TOKENIZER = "word_bpe_49k.json"
#: White-space chunks after which a worker starts a new table of ids. It keeps the one before, and takes from it what
#: comes up again, so that it holds two such tables at most and frequent chunks are encoded once.
MOST_CHUNKS = 800_000
#: Marks that end a word; the tokenizer never joins them with the letters before.
_MARKS = ".,;:!?|"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


class Chunks(dict):
    """ids (little-endian unsigned 32-bit) of a chunk without white space, by the tokenizer at path.

    The tokenizer drops white space and nothing it does reaches across it, so a text's ids are those of its chunks.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path, self.tokenizer, self.before = path, Tokenizer.from_file(path), {}
        self.most = MOST_CHUNKS

    def __missing__(self, chunk: bytes) -> bytes:
        packed = self.before.get(chunk)
        if packed is None:
            packed = self._encoded(chunk)
        if len(chunk) <= 100:
            self[chunk] = packed
        return packed

    def _encoded(self, chunk: bytes) -> bytes:
        word = chunk.decode("utf-8", "replace")
        head = word.rstrip(_MARKS)
        if len(head) < len(word) and normalize("NFC", head).lower().isalpha():  # letters and marks behind them are tokens of their own
            return self[head.encode()] + self[word[len(head) :].encode()]
        if word.isascii() and word.isalpha() and not word.islower():  # the tokenizer lowers letters first
            return self[chunk.lower()]
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return b"".join([x.to_bytes(4, "little") for x in ids])

    def ids(self, text: bytes) -> bytes:
        if len(self) > self.most:
            self.before = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, text.split()))


_chunks: list[Chunks] = []


def chunks(path: str) -> Chunks:
    if not _chunks or _chunks[0].path != path:
        _chunks[:] = [Chunks(path)]
    return _chunks[0]


class Piece(NamedTuple):
    """Packed ids of a document from start on, n of them; total is the whole document's."""

    doc_id: int | None
    start: int
    ids: bytes
    n: int
    total: int

    def cut(self, at: int) -> tuple[Piece, Piece]:
        head = self._replace(ids=self.ids[: 4 * at], n=at)
        return head, self._replace(start=self.start + at, ids=self.ids[4 * at :], n=self.n - at)


class Bins:
    """The open bin of each class, the bins that wait for a head, and the next sequence number. capacity: a power of two."""

    def __init__(self, first: int, capacity: int = CAPACITY):
        self.next, self.capacity, self.least = first, capacity, max(1, capacity // LEAST)
        self.open: dict[int, tuple[list[Piece], int]] = {}  # pieces and room
        self.waiting: list[tuple[int, int, list[Piece]]] = []  # (gap, sequence to be, pieces), by gap
        self.rows: list[tuple] = []

    def _close(self, part: list[Piece]) -> None:
        at = 0
        for p in part:
            self.rows.append((p.doc_id, p.start, p.n, zlib.crc32(p.ids), p.total, self.next, at))
            at += p.n
        self.next += 1

    def _wait(self, part: list[Piece]) -> None:
        gap = self.capacity - sum(p.n for p in part)
        if not gap:
            return self._close(part)
        insort(self.waiting, (gap, id(part), part))
        if len(self.waiting) > WAITING:
            left = self._settled([p for *_, part in self.waiting for p in part])
            self.waiting = []
            if left:
                self._wait(left)

    def _head(self, n: int, room: int) -> int:
        """How much of a piece of n tokens may go into a room: no part and no room that is left is shorter than least."""
        if n == room or n <= room - self.least:
            return n
        if n >= room + self.least:
            return room
        short = min(n, room) - self.least
        return short if short >= self.least else 0

    def _put(self, piece: Piece) -> None:
        """A piece of one bin at most, into its class."""
        k = self.capacity // piece.n
        part, room = self.open.pop(k, ([], self.capacity))
        n = self._head(piece.n, room)
        if not n:  # the bin has fewer than k pieces, and a gap that a head can fill
            self._wait(part)
            part, room = [], self.capacity
            n = self._head(piece.n, room) or piece.n
        tail = None
        if n < piece.n:
            piece, tail = piece.cut(n)
        part.append(piece)
        if tail or len(part) == k:
            self._wait(part)
        else:
            self.open[k] = part, room - n
        if tail:
            self._put(tail)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """A document, into a bin that waits for its head, full bins and its class."""
        n = len(ids) // 4
        piece = Piece(doc_id, 0, ids, n, n)
        for i in range(len(self.waiting) - 1, -1, -1):
            gap, _, part = self.waiting[i]
            rest = n - gap
            if rest == 0 or (rest >= self.least and (rest % self.capacity == 0 or rest % self.capacity >= self.least)):
                del self.waiting[i]
                head, piece = piece.cut(gap)
                self._close([*part, head])
                break
        while piece.n > self.capacity:
            rest = piece.n - self.capacity
            # A rest that is too short takes along a bit of the bin before.
            head, piece = piece.cut(self.capacity if rest >= self.least else piece.n - 2 * self.least)
            self._put(head)
        if piece.n:
            self._put(piece)

    def _settled(self, pieces: list[Piece]) -> list[Piece]:
        """Closes as many full bins as the pieces give, cut where a bin ends; the pieces that are left."""
        todo, part, room = deque(sorted(pieces, key=lambda p: -p.n)), [], self.capacity
        while todo:
            fits = next((i for i, p in enumerate(todo) if self._head(p.n, room)), 0)
            piece = todo[fits]
            del todo[fits]
            n = self._head(piece.n, room) or min(piece.n, room)
            if n > 1 and n + 1 == piece.n:  # the closing id would be alone
                n -= 1
            if n < piece.n:
                piece, tail = piece.cut(n)
                todo.appendleft(tail)
            part.append(piece)
            room -= n
            if not room:
                self._close(part)
                part, room = [], self.capacity
        return part

    def finish(self) -> None:
        """Closes all bins: full ones, then sequences whose lengths are powers of two."""
        left = self._settled([p for part in [*(o[0] for o in self.open.values()), *(w[2] for w in self.waiting)] for p in part])
        self.open, self.waiting = {}, []
        total = sum(p.n for p in left)
        sizes = [1 << i for i in range(total.bit_length()) if total >> i & 1]
        for i in range(len(left)):  # an order of the pieces that leaves no closing id alone, if there is one
            sequences = _dealt(left[i:] + left[:i], sizes)
            if not any(p.n == 1 < p.total == p.start + 1 for s in sequences for p in s):
                break
        for part in sequences if left else []:
            self._close(part)

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _dealt(pieces: list[Piece], sizes: list[int]) -> list[list[Piece]]:
    """The pieces, cut into sequences of the sizes, which add up to theirs."""
    todo, out = deque(pieces), []
    for size in sizes:
        part = []
        while size:
            piece = todo.popleft()
            if piece.n > size:
                piece, tail = piece.cut(size)
                todo.appendleft(tail)
            part.append(piece)
            size -= piece.n
        out.append(part)
    return out


def _packed(path: str, capacity: int, most_chunks: int) -> Callable:
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, bins, end = chunks(path), Bins(TaskContext.get().partitionId() << 33, capacity), END.to_bytes(4, "little")
        ids_of.most = most_chunks
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), texts_of(batch["text"]), strict=True):
                bins.add(doc_id, ids_of.ids(text) + end)
                if len(bins.rows) >= 20_000:
                    yield batch_of(bins.taken())
        bins.finish()
        if bins.rows:
            yield batch_of(bins.taken())

    return run


def harmonic_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, most_chunks: int = MOST_CHUNKS) -> DataFrame:
    """One row per piece: SCHEMA. sequence_id is unique over the table; offsets in a sequence are gapless from 0.

    A null or empty text is one end token; a very long text is cut into as many pieces as it takes; a null doc_id stays
    null; equal rows are packed one by one; an empty table
    gives no rows; other columns are not read. tokenizer: the path of the vocabulary file, the same on all machines.
    most_chunks: the size of a worker's tables, which trades its memory for time and changes no result.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_batches(rows, _packed(tokenizer, capacity, most_chunks), SCHEMA)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)
