"""Functions over single texts that run in Arrow batches on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Entries after which a worker's table of words is emptied between two texts.
MOST_WORDS = 150_000
_MULTIPLIERS = np.random.default_rng(20).integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each text, one at a time; null as empty."""
    for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield x.as_py() or b""


def by_text(kernel: Callable[[bytes], tuple], schema: pa.Schema, keep: list[str]) -> Callable:
    """For mapInArrow: the columns of keep, then what kernel makes of each row's text."""
    names = schema.names[len(keep):]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                made = list(zip(*map(kernel, texts_of(part["text"])), strict=True))
                columns = [pa.array(v, schema.field(n).type) for n, v in zip(names, made, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part[c].cast(schema.field(c).type) for c in keep), *columns], schema=schema)
        freed()

    return run


class _Numbered(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


class _Hashed(dict):
    def __missing__(self, word):
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_numbers, _hashes = _Numbered(), _Hashed()


def freed() -> None:
    """At a task's end: gives back what the worker, which later steps use too, holds for this one only."""
    _numbers.clear()
    _hashes.clear()
    pa.default_memory_pool().release_unused()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _windows(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values) - width + 1
    out = values[:n] * _MULTIPLIERS[0]
    for i in range(1, width):
        out += values[i : i + n] * _MULTIPLIERS[i]
    return out


def repeated(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of width words which the text holds twice or more."""
    if len(words) <= width:
        return 0
    if len(_numbers) > MOST_WORDS:
        _numbers.clear()
    ids = np.fromiter(map(_numbers.__getitem__, words), np.int64, len(words))
    h = _windows(ids.astype(np.uint64), width)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    x, y = order[1:][same], order[:-1][same]
    if any((ids[x + i] != ids[y + i]).any() for i in range(width)):  # two windows share a hash: compare the words
        rows = np.lib.stride_tricks.sliding_window_view(ids, width)
        _, inverse, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(counts[inverse.ravel()] > 1)
    else:
        starts = np.union1d(x, y)
    step = np.zeros(len(ids) + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(step[:-1])))


def text_stats(b: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word)."""
    words = b.split()
    bare = b.translate(None, SPACE)
    lines = [x for x in b.split(b"\n") if x and not x.isspace()]
    return (len(words), len(bare.decode("utf-8", "replace")), len(b) - len(b.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated(words), len(lines))


def shingles(b: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text in lower case; a shorter text is one shingle."""
    words = b.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_hashes) > MOST_WORDS:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    short = min(width, len(words))
    return np.unique(_mixed(_windows(_mixed(h), short) + np.uint64(short)))



#: One-permutation hashing: the hash range is cut into BINS bins, and BAND bins make a band.
BINS, BAND = 512, 10
_EDGES = np.array([(i << 64) // BINS for i in range(BINS)], np.uint64)
_PROBES = np.random.default_rng(7).integers(0, BINS, (BINS, 2048))
_FOR_BANDS = np.random.default_rng(9).integers(1, 2**63, (BINS // BAND, BAND), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def one_permutation(hashes: np.ndarray) -> np.ndarray:
    """The least hash of each bin; an empty bin takes that of a bin it draws, again and again until one has a value.

    Each bin draws from its own fixed sequence, the same for all texts, which makes two texts agree on a bin with a
    chance equal to their similarity. hashes: sorted, not empty.
    """
    at = np.searchsorted(hashes, _EDGES)
    full = np.diff(np.append(at, len(hashes))) > 0
    values = np.zeros(BINS, np.uint64)
    values[full] = hashes[at[full]]
    left, tried, step = np.flatnonzero(~full), 0, 16
    while len(left) and tried < _PROBES.shape[1]:
        drawn = _PROBES[left, tried : tried + step]
        hit = full[drawn]
        found = hit.any(axis=1)
        values[left[found]] = values[drawn[found, hit[found].argmax(axis=1)]]
        left, tried, step = left[~found], tried + step, step * 4
    if len(left):  # 2048 draws without a hit: with one full bin for 2 in 100 empty ones, with two for 3 in 10,000; the next full bin
        there = np.flatnonzero(full)
        values[left] = values[there[np.searchsorted(there, left) % len(there)]]
    return values


def signature(b: bytes) -> tuple[int, int, int, list[int]]:
    """Size of the shingle set, two halves of its digest, and a bucket for each band (none for an empty set)."""
    h = shingles(b)
    if not len(h):
        return 0, 0, 0, []
    digest = xxhash.xxh3_128_intdigest(h.tobytes())
    halves = np.array([digest & (2**64 - 1), digest >> 64], np.uint64).view(np.int64)
    bins = one_permutation(h)[: len(_FOR_BANDS) * BAND].reshape(-1, BAND)
    bands = _mixed((_mixed(bins) * _FOR_BANDS).sum(axis=1, dtype=np.uint64) + np.arange(len(_FOR_BANDS), dtype=np.uint64)).view(np.int64)
    return len(h), int(halves[0]), int(halves[1]), bands.tolist()


def linked(percent: int) -> Callable:
    """For mapInArrow over (a, b, a_text, b_text): the pairs whose whole shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(batch["a"].to_pylist(), texts_of(batch["a_text"]), texts_of(batch["b_text"]), strict=True):
                if last != (a, x):
                    last, held = (a, x), shingles(x)
                other = shingles(y)
                common = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(common > 0 and 100 * common >= percent * (len(held) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        freed()

    return run


def strangers(percent: int) -> Callable:
    """For applyInArrow over a block (node, label, role, set) of a bucket: links (a, b) between its components.

    Rows with bit 2 of role are held against rows with bit 1: each row's set marks its hashes among all those of the
    block, and one sum over the marks gives its intersections with all others.
    """

    def run(block: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in block["set"].to_pylist()]
        node, label, role = (block[c].to_numpy() for c in ("node", "label", "role"))
        sizes = np.array([len(x) for x in sets])
        _, numbers = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        marks, a, b = np.zeros(len(numbers), np.int64), [], []
        for i in np.flatnonzero(role & 2):
            own = numbers[starts[i] : ends[i]]
            marks[own] = 1
            common = np.add.reduceat(marks[numbers], starts)
            marks[own] = 0
            near = (role & 1 > 0) & (label != label[i]) & (100 * common >= percent * (sizes + sizes[i] - common))
            b.extend(node[near].tolist())
            a.extend([int(node[i])] * int(near.sum()))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run
