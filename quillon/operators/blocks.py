"""Exact k nearest over blocks of references, in arrays.

References lie in blocks of nearby rows, and a block's rows in leaves of some hundred, each with its bounding box. A
query first searches the block that is nearest to it. What it finds there bounds the rest: it is sent to the blocks
whose box is not farther than its k-th distance, and there it meets the leaves of which that holds. A leaf and its
queries meet as a float32 matrix product, which rules out pairs with a margin above its rounding error; distances of
the pairs left are integers, and neighbours are ordered by (distance, idx).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

LEAF = 256
#: Cells with fewer members share a block with their neighbours.
SMALL_CELL = 2048
BLOCK = "block long, n long, idx binary, v binary, fraud binary, starts binary, lo binary, hi binary, first long"
ASKED = "block long, n long, qid binary, q binary, dist binary, idx binary"
FOUND = ASKED + ", fraud binary"
#: Most (query, box) pairs whose bounds are computed at once.
_AT_ONCE = 1 << 20
_FAR = np.iinfo(np.int64).max


def _cut(rows: np.ndarray, idx: np.ndarray) -> tuple[int, int]:
    """(dim, cut): rows with a value up to cut go left. The dimension that varies most, parted between two values near
    its median; idx, named -1, where the rows are equal; (-2, 0) where they can't be parted."""
    spread = rows.max(axis=0) - rows.min(axis=0)
    if spread.max() > 0:
        dim = int(np.where(spread > 0, rows.var(axis=0), -1.0).argmax())
        x = rows[:, dim]
    elif len(idx) > 1 and idx.min() < idx.max():
        dim, x = -1, idx
    else:
        return -2, 0
    middle = np.partition(x, len(x) // 2)[len(x) // 2]
    below = x[x < middle]
    upto = int((x <= middle).sum())
    if upto == len(x) or (len(below) and abs(2 * len(below) - len(x)) < abs(2 * upto - len(x))):
        return dim, int(below.max())
    return dim, int(middle)


class Planes:
    """A tree of cuts, made from a sample, that gives each row a cell. Any cuts give exact results."""

    def __init__(self, v: np.ndarray, idx: np.ndarray, n_cells: int):
        self.dim, self.cut, self.left, self.right = [0], [_FAR], [0], [0]
        most, todo = max(1, len(v) // n_cells), [(0, np.arange(len(v)))]
        while todo:
            at, rows = todo.pop()
            dim, cut = _cut(v[rows], idx[rows]) if len(rows) > most else (-2, 0)
            if dim == -2:
                continue
            here = (idx[rows] if dim < 0 else v[rows, dim]) <= cut
            for side, part in ((self.left, rows[here]), (self.right, rows[~here])):
                new = len(self.dim)
                for column, x in ((self.dim, 0), (self.cut, _FAR), (self.left, new), (self.right, new)):
                    column.append(x)
                side[at] = new
                todo.append((new, part))
            self.dim[at], self.cut[at] = dim, cut
        self.dim, self.cut, self.left, self.right = (np.array(x, np.int64) for x in (self.dim, self.cut, self.left, self.right))

    def cells(self, v: np.ndarray, idx: np.ndarray) -> np.ndarray:
        rows, all_rows = np.column_stack([v, idx]), np.arange(len(v))  # dim -1 is the last column
        at = np.zeros(len(v), np.int64)
        while True:
            then = np.where(rows[all_rows, self.dim[at]] <= self.cut[at], self.left[at], self.right[at])
            if (then == at).all():
                return at
            at = then


def vectors_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def celled(planes: Planes) -> Callable:
    """For mapInArrow: (idx, v, fraud) with its cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = planes.cells(vectors_of(batch), batch["idx"].to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(cell), batch["idx"], batch["v"], batch["fraud"]], names=["cell", "idx", "v", "fraud"])

    return run


def _leaves(v: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): rows ordered so that each leaf, of LEAF rows at most, is one run."""
    order, starts, todo = [], [], [np.arange(len(v))]
    while todo:
        rows = todo.pop()
        dim, cut = _cut(v[rows], idx[rows]) if len(rows) > LEAF else (-2, 0)
        if dim != -2:
            here = (idx[rows] if dim < 0 else v[rows, dim]) <= cut
            todo += [rows[~here], rows[here]]
            continue
        for at in range(0, len(rows), LEAF):
            order.append(rows[at : at + LEAF])
            starts.append(len(order[-1]))
    return np.concatenate(order), np.cumsum([0, *starts[:-1]])


def _record(values: list, schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split(" ") for c in schema.split(", ")), strict=True)
    arrays = [pa.array([x], pa.int64()) if kind == "long" else pa.array([None if x is None else x.tobytes()], pa.binary()) for x, kind in zip(values, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=list(names))


def _narrow(q: np.ndarray) -> np.ndarray:
    """q in 2 bytes a value where all of them fit: queries are sent to several blocks, and take most of what is shuffled."""
    short = np.iinfo(np.int16)
    return q.astype(np.int16) if len(q) and q.min() >= short.min and q.max() <= short.max else q


def _wide(q: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(q, np.int16 if len(q) == 2 * n * dims else np.int32).reshape(n, dims).astype(np.int32)


def packed(size: int) -> Callable:
    """For mapInArrow over (cell, idx, v, fraud): blocks of at most size rows. A task holds its rows as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b["cell"].to_numpy(), b["idx"].to_numpy(), vectors_of(b).astype(np.int32), b["fraud"].to_numpy().astype(np.int32)) for b in batches if b.num_rows]
        if not held:
            return
        cell, idx, v, fraud = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        order = np.lexsort((idx, cell))
        runs = np.flatnonzero(np.diff(cell[order], prepend=cell[order[0]] - 1))
        bounds = [0]
        for at, end in zip(runs, [*runs[1:], len(order)], strict=True):
            if at > bounds[-1] and (end - bounds[-1] > size or end - at >= min(size, SMALL_CELL) or at - bounds[-1] >= min(size, SMALL_CELL)):
                bounds.append(at)
            parts = -(-(end - bounds[-1]) // size)
            bounds += [bounds[-1] + (end - bounds[-1]) * i // parts for i in range(1, parts)]
        name = TaskContext.get().partitionId() << 32
        for i, (at, end) in enumerate(zip(bounds, [*bounds[1:], len(order)], strict=True)):
            rows = order[at:end]
            inner, starts = _leaves(v[rows], idx[rows])
            rows = rows[inner]
            lo, hi = v[rows].min(axis=0), v[rows].max(axis=0)
            yield _record([name + i, len(rows), idx[rows], v[rows], fraud[rows], starts, lo, hi, int(idx[rows].min())], BLOCK)

    return run


def _bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distances of queries to boxes, in float32 and made a little smaller than they are."""
    q, lo, hi = (x.astype(np.float32) for x in (q, lo, hi))
    total, gap, other = np.zeros((len(q), len(lo)), np.float32), np.empty((len(q), len(lo)), np.float32), np.empty((len(q), len(lo)), np.float32)
    for d in range(q.shape[1]):
        np.subtract(lo[None, :, d], q[:, d, None], out=gap)
        np.subtract(q[:, d, None], hi[None, :, d], out=other)
        np.maximum(gap, other, out=gap)
        np.maximum(gap, 0, out=gap)
        np.multiply(gap, gap, out=gap)
        total += gap
    return total * np.float32(1 - 2.0**-18)


class Boxes:
    """The boxes of all blocks, a row each: what tasks know of blocks that they don't hold."""

    def __init__(self, rows: list):
        self.block = np.array([r["block"] for r in rows], np.int64)
        self.lo, self.hi = (np.array([np.frombuffer(r[c], np.int32) for r in rows]) for c in ("lo", "hi"))
        self.first = np.array([r["first"] for r in rows], np.int64)

    def chunks(self, n: int) -> Iterator[slice]:
        step = max(1, _AT_ONCE // len(self.block))
        for at in range(0, n, step):
            yield slice(at, at + step)

    def home(self, q: np.ndarray) -> np.ndarray:
        """The nearest block of each query; of equal ones that with the nearest middle."""
        middle = ((self.lo.astype(np.float64) + self.hi) / 2).astype(np.float32)
        out = [np.empty(0, np.int64)]
        for s in self.chunks(len(q)):
            bound = _bounds(q[s], self.lo, self.hi)
            x = q[s].astype(np.float32)
            away = (x**2).sum(axis=1)[:, None] + (middle**2).sum(axis=1)[None, :] - 2 * (x @ middle.T)
            out.append(np.where(bound <= bound.min(axis=1)[:, None], away, np.inf).argmin(axis=1))
        return np.concatenate(out)


def grouped(block: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(block, kind="stable")
    starts = np.flatnonzero(np.diff(block[order], prepend=-1))
    for at, end in zip(starts, [*starts[1:], len(order)], strict=False):  # none of none
        yield int(block[order[at]]), order[at:end]


def sent_home(boxes: Boxes, size: int) -> Callable:
    """For mapInArrow over (qid, v): queries, packed by the block that they search first, size or so of them at once."""

    def dealt(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        qid, q = (np.concatenate(x) for x in zip(*held, strict=True))
        for i, rows in grouped(boxes.home(q)):
            none = np.full(len(rows), _FAR)
            yield _record([int(boxes.block[i]), len(rows), qid[rows], _narrow(q[rows]), none, none], ASKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append((batch["qid"].to_numpy(), vectors_of(batch).astype(np.int32)))
                n += batch.num_rows
            if n >= size:
                yield from dealt(held)
                held, n = [], 0
        if held:
            yield from dealt(held)

    return run


class Search:
    """The k nearest so far for each of the queries, over leaves. limit, last: (distance, idx) from which on nothing
    is of use."""

    def __init__(self, q: np.ndarray, limit: np.ndarray, last: np.ndarray, k: int):
        self.q, self.k, self.limit, self.last = q, k, limit.copy(), last.copy()
        self.col, self.dist, self.idx, self.fraud = (np.empty(0, np.int64) for _ in range(4))
        self.held, self.n_held = [], 0

    def meet(self, rows: np.ndarray, v: np.ndarray, idx: np.ndarray, fraud: np.ndarray) -> None:
        """Queries rows and the references of a leaf."""
        middle = v[len(v) // 2].astype(np.int64)
        x, y = ((a - middle).astype(np.float32) for a in (self.q[rows], v))
        xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
        # rounding: the terms' sizes add up to at most 2 (xx + yy), and 16 of them are added
        margin = (xx + yy.max()) * np.float32(2.0**-17) + 1
        d = x @ (-2 * y).T
        d += yy
        most = self.limit[rows].astype(np.float32) - xx + margin
        new = self.limit[rows] == _FAR
        if new.any() and len(v) >= self.k:
            most[new] = np.partition(d[new], self.k - 1, axis=1)[:, self.k - 1] + 2 * margin[new]
        row, ref = np.nonzero(d <= most[:, None])
        col = rows[row]
        away = self.q[col].astype(np.int64) - v[ref]
        dist = (away * away).sum(axis=1)
        kept = (dist < self.limit[col]) | ((dist == self.limit[col]) & (idx[ref] <= self.last[col]))
        self.held.append((col[kept], dist[kept], idx[ref[kept]], fraud[ref[kept]].astype(np.int64)))
        self.n_held += int(kept.sum())
        if self.n_held > max(1 << 14, 2 * len(self.q)):
            self.settle()

    def settle(self) -> None:
        if not self.held:
            return
        col, dist, idx, fraud = (np.concatenate(x) for x in zip((self.col, self.dist, self.idx, self.fraud), *self.held, strict=True))
        self.held, self.n_held = [], 0
        order = np.lexsort((idx, dist, col))
        at = np.arange(len(order)) - np.searchsorted(col[order], col[order])
        order, at = order[at < self.k], at[at < self.k]
        self.col, self.dist, self.idx, self.fraud = col[order], dist[order], idx[order], fraud[order]
        full = at == self.k - 1
        self.limit[self.col[full]], self.last[self.col[full]] = self.dist[full], self.idx[full]


class Block:
    """A block's references and the boxes of its leaves."""

    def __init__(self, idx: bytes, v: bytes, fraud: bytes, starts: bytes):
        self.idx, self.fraud, self.starts = np.frombuffer(idx, np.int64), np.frombuffer(fraud, np.int32), np.frombuffer(starts, np.int64)
        self.v = np.frombuffer(v, np.int32).reshape(len(self.idx), -1)
        self.lo, self.hi = np.minimum.reduceat(self.v, self.starts), np.maximum.reduceat(self.v, self.starts)
        self.first = np.minimum.reduceat(self.idx, self.starts)
        self.ends = np.append(self.starts[1:], len(self.idx))

    def search(self, found: Search) -> None:
        step = max(1, _AT_ONCE // len(self.starts))
        for at in range(0, len(found.q), step):
            rows = np.arange(at, min(at + step, len(found.q)))
            bound = _bounds(found.q[rows], self.lo, self.hi)
            nearest = bound.argmin(axis=1)
            for first in (True, False):  # the nearest leaf bounds the rest
                for i in range(len(self.starts)):
                    here = nearest == i
                    limit, last = found.limit[rows], found.last[rows]
                    use = here if first else ~here
                    use = use & ((bound[:, i] < limit) | ((bound[:, i] == limit) & (self.first[i] <= last)))
                    if use.any():
                        s = slice(self.starts[i], self.ends[i])
                        found.meet(rows[use], self.v[s], self.idx[s], self.fraud[s])
                found.settle()


def searched(k: int, size: int, boxes: Boxes | None) -> Callable:
    """For mapInArrow over rows (block, part, kind, n, a, b, c, d) in this order, a block (kind 0) before its queries: FOUND.

    A row without a block is what was found. With boxes, the others ask for the blocks that may hold nearer rows.
    At most size queries are held at once.
    """

    def met(block: Block, name: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        qid, q, limit, last = (np.concatenate([r[i] for r in rows]) for i in range(4))
        for at in range(0, len(qid), size):
            s = slice(at, at + size)
            found = Search(q[s], limit[s], last[s], k)
            block.search(found)
            if len(found.col):
                yield _record([None, len(found.col), qid[s][found.col], None, found.dist, found.idx, found.fraud], FOUND)
            if boxes is not None:
                yield from others(name, qid[s], found)

    def others(name: int, qid: np.ndarray, found: Search) -> Iterator[pa.RecordBatch]:
        asked = []
        for s in boxes.chunks(len(qid)):
            bound = _bounds(found.q[s], boxes.lo, boxes.hi)
            limit, last = found.limit[s, None], found.last[s, None]
            use = ((bound < limit) | ((bound == limit) & (boxes.first[None, :] <= last))) & (boxes.block != name)[None, :]
            row, at = np.nonzero(use)
            asked.append((row + s.start, at))
        row, at = (np.concatenate(x) for x in zip(*asked, strict=True))
        for i, where in grouped(at):
            rows = row[where]
            yield _record([int(boxes.block[i]), len(rows), qid[rows], _narrow(found.q[rows]), found.limit[rows], found.last[rows], None], FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, rows, n = None, None, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                raw = {c: batch[c][i].as_py() for c in batch.schema.names}
                if raw["kind"] == 0:
                    if rows:
                        yield from met(block, key, rows)
                    key, block, rows, n = raw["block"], Block(raw["a"], raw["b"], raw["c"], raw["d"]), [], 0
                    continue
                qid = np.frombuffer(raw["a"], np.int64)
                rows.append((qid, _wide(raw["b"], len(qid), block.v.shape[1]), np.frombuffer(raw["c"], np.int64), np.frombuffer(raw["d"], np.int64)))
                n += len(qid)
                if n >= size:
                    yield from met(block, key, rows)
                    rows, n = [], 0
        if rows:
            yield from met(block, key, rows)

    return run


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over FOUND: (qid, idx, dist, fraud)."""
    for batch in batches:
        for i in range(batch.num_rows):
            columns = [pa.array(np.frombuffer(batch[c][i].as_py(), np.int64)) for c in ("qid", "idx", "dist")]
            fraud = np.frombuffer(batch["fraud"][i].as_py(), np.int64).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fraud)], names=["qid", "idx", "dist", "fraud"])
