"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns POINTS points of the ring; a key goes clockwise to the next point. A shard takes keys up to its bound;
keys beyond it continue clockwise to the next shard with room. The bounds add up to the number of rows and differ by
at most one, so the shards end with equal counts whatever the keys are (law "rows"), while most keys keep the shard
that the bare ring gives them.

Rows are counted by arc (between two points) and slice of the ring. The driver gets these counts alone, at most one
for each point and slice, and works out which ranks of each arc go to which shard and slot. A row's rank is its cell's
first rank plus its place in the cell; cells are small, and one that a repeated key fills is split by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scoped, written

SHARDS, POINTS = 40, 64
#: Rows in a slice of the ring; cells are cut finer by the points.
SLICE_ROWS = 200_000
#: Rows of a part of a cell that one repeated key fills; a cell with more than twice as many is cut by row.
PART_ROWS = 20_000


class Ring:
    """Points of the ring, and for each the shard that owns it."""

    def __init__(self, shards: int, points: int = POINTS):
        at = sorted((xxhash.xxh64_intdigest(f"{s}/{p}") >> 1, s) for s in range(shards) for p in range(points))
        self.shards, self.at, self.owner = shards, np.array([x for x, _ in at], np.int64), np.array([s for _, s in at])

    def arcs(self, h: np.ndarray) -> np.ndarray:
        """The point that each hash (0 to 2**63 - 1) comes to, clockwise."""
        return np.searchsorted(self.at, h) % len(self.at)

    def spans(self, counts: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
        """(arc, first rank, end rank, shard, first slot), given the rows of each arc."""
        total = sum(counts.values())
        room = [total // self.shards + (s < total % self.shards) for s in range(self.shards)]
        filled, out = [0] * self.shards, []
        waiting = [(arc, 0, n, arc) for arc, n in sorted(counts.items()) if n]
        while waiting:
            onward = []
            for arc, lo, hi, at in waiting:
                s = int(self.owner[at])
                if take := min(hi - lo, room[s]):
                    out.append((arc, lo, lo + take, s, filled[s]))
                    room[s], filled[s] = room[s] - take, filled[s] + take
                if lo + take < hi:
                    onward.append((arc, lo + take, hi, (at + 1) % len(self.owner)))
            waiting = onward
        return sorted(out)


def _cells(ring: Ring, slices: int, parts: dict[tuple[int, int], int]) -> Callable:
    """Adds arc, slice and part to rows with key (a hash) and uid."""
    width = min((1 << 63) // slices + 1, (1 << 63) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch["key"].to_numpy(zero_copy_only=False)
            arc, piece, part = ring.arcs(h), h // width, np.zeros(len(h), np.int64)
            for (a, s), n in parts.items():
                here = (arc == a) & (piece == s)
                part[here] = batch["uid"].to_numpy(zero_copy_only=False)[here] % n
            made = [pa.array(x, pa.int64()) for x in (arc, piece, part)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "arc", "slice", "part"])

    return run


def _settled(first: dict[tuple[int, int, int], int], spans: list[tuple]) -> Callable:
    """Turns the place in a cell into shard and slot."""
    starts = np.array([[s[0], s[1]] for s in spans], np.int64).reshape(-1, 2)
    shard, slot = np.array([s[3] for s in spans], np.int64), np.array([s[4] for s in spans], np.int64)
    arcs = np.unique(starts[:, 0])
    of_arc = {int(a): np.flatnonzero(starts[:, 0] == a) for a in arcs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = zip(*(batch[c].to_pylist() for c in ("arc", "slice", "part")), strict=True)
            rank = np.fromiter((first[c] for c in cells), np.int64, batch.num_rows) + batch["place"].to_numpy(zero_copy_only=False) - 1
            at = np.empty(batch.num_rows, np.int64)
            arc = batch["arc"].to_numpy(zero_copy_only=False)
            order = np.argsort(arc, kind="stable")
            for run_of in np.split(order, np.flatnonzero(np.diff(arc[order])) + 1) if len(order) else []:
                own = of_arc[int(arc[run_of[0]])]
                at[run_of] = own[np.searchsorted(starts[own, 1], rank[run_of], side="right") - 1]
            made = [pa.array(shard[at], pa.int32()), pa.array(slot[at] + rank - starts[at, 1], pa.int64())]
            kept = ["doc_id", "size", "text_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *made], names=[*kept, "shard", "slot"])

    return run


@scoped
def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row.

    The key is doc_id; rows that share one, or have none, follow each other round the ring like any others. A null
    and an empty text have no bytes; a very long text counts whole; of equal hashes the row that was read first has the
    lower rank; an empty table gives no rows; other columns are not read. law is "rows", so grown_shard is null.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    key = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    rows = written(rows.withColumns({"key": key, "uid": F.monotonically_increasing_id()}), "keys")
    n, ring = rows.count(), Ring(shards)
    slices = max(1, -(-n // SLICE_ROWS))
    kind = "doc_id long, size long, text_crc32 long, key long, uid long, arc long, slice long, part long"

    def counted(parts: dict) -> tuple[DataFrame, dict]:
        cut = rows.mapInArrow(_cells(ring, slices, parts), kind)
        return cut, {(r["arc"], r["slice"], r["part"]): r["n"] for r in cut.groupBy("arc", "slice", "part").agg(F.count("*").alias("n")).collect()}

    cut, counts = counted({})
    if hot := {(a, s): -(-c // PART_ROWS) for (a, s, _), c in counts.items() if c > 2 * PART_ROWS}:
        cut, counts = counted(hot)
    first, of_arc = {}, {}
    for cell, c in sorted(counts.items()):
        first[cell] = of_arc.get(cell[0], 0)
        of_arc[cell[0]] = first[cell] + c
    place = F.row_number().over(Window.partitionBy("arc", "slice", "part").orderBy("key", "uid")).cast("long")
    placed = cut.select("doc_id", "size", "text_crc32", "arc", "slice", "part", place.alias("place"))
    out = placed.mapInArrow(_settled(first, ring.spans(of_arc)), "doc_id long, size long, text_crc32 long, shard int, slot long")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
