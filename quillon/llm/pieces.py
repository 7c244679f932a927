"""SentencePiece encoding and decoding: the N best segmentations of a text over its piece lattice.

Pieces come from a model file; a piece's score is a Zipf log-probability of its rank there, since the file's own
scores are merge ranks, which do not add up to anything. A character without a piece is spelled as its UTF-8 bytes.

No piece has a space after another character, nor a line break beside one, so the lattice of a text is a chain of
small lattices, one per chunk: a chunk's forward Viterbi scores are the exact heuristic of a backward A* search, which
hence meets complete segmentations from the best to the worst and expands nothing else. The N best of the text are
the N least sums of losses over its chunks, of which only the N - 1 chunks with the smallest second-best loss can
differ from their best. The forward scores of all new chunks of some hundred texts are computed at once, over arrays;
with them comes the loss of the second best, so the search itself runs for these few chunks.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches
from .kernels import texts_of

MODEL = "piece_bpe_32k.model"
N_BEST = 4
#: Zipf-Mandelbrot offset, and the log-probability of a byte.
OFFSET, BYTE_SCORE = 2.7, -14.0
#: Units after which a worker's tables start anew, and characters of a unit that they keep.
MOST_UNITS, MOST_CHARS = 800_000, 60
_CHUNK = re.compile(r"\n| +[^ \n]*|[^ \n]+")
RESULT = "n_pieces long, score double, scores array<double>, ids_crc32 array<long>, round_trip boolean"


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.path = path
        self.bytes = {i: int(model.id_to_piece(i)[3:5], 16) for i in range(model.get_piece_size()) if model.is_byte(i)}
        self.byte_id = {b: i for i, b in self.bytes.items()}
        own = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.text = {i: model.id_to_piece(i).replace("▁", " ") for i in own}
        norm = math.log(sum(1 / (rank + OFFSET) for rank in range(len(own))))
        self.piece = {self.text[i]: (i, -math.log(rank + OFFSET) - norm) for rank, i in enumerate(own)}
        sizes: dict[str, set[int]] = {}
        for t in self.piece:
            if len(t) > 2:
                sizes.setdefault(t[-3:], set()).add(len(t))
        #: Lengths of the pieces that end with these three characters.
        self.sizes = {k: sorted(v) for k, v in sizes.items()}
        #: Neighbours that some piece holds; a text falls apart between any other two.
        self.tied = {t[i : i + 2] for t in self.piece for i in range(len(t) - 1)}
        if any(" " in t.lstrip(" ") or "\n" in t and t != "\n" for t in self.piece):
            raise ValueError("a piece with an inner space: chunks would not be independent")

    def split(self, chunk: str) -> list[str]:
        """chunk, cut between neighbours that no piece holds: the parts' lattices are independent."""
        cuts = [0, *(i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in self.tied), len(chunk)]
        return [chunk[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def ending(self, chunk: str, end: int) -> list[tuple[int, tuple[int, ...], float]]:
        """(start, ids, score) of what may stand in chunk just before end."""
        piece, last, out = self.piece, chunk[end - 1], []
        if found := piece.get(last):
            out.append((end - 1, (found[0],), found[1]))
        else:
            raw = last.encode()
            out.append((end - 1, tuple(self.byte_id[b] for b in raw), BYTE_SCORE * len(raw)))
        if end > 1 and (found := piece.get(chunk[end - 2 : end])):
            out.append((end - 2, (found[0],), found[1]))
        if end > 2:
            for size in self.sizes.get(chunk[end - 3 : end], ()):
                if size <= end and (found := piece.get(chunk[end - size : end])):
                    out.append((end - size, (found[0],), found[1]))
        return out

    def forward(self, chunk: str) -> tuple[list, list[float]]:
        """The lattice (what ends at each place), and the best score of each prefix."""
        arcs, best = [[]], [0.0]
        for end in range(1, len(chunk) + 1):
            arcs.append(self.ending(chunk, end))
            best.append(max([best[start] + score for start, _, score in arcs[end]]))
        return arcs, best

    def best_two(self, chunk: str) -> tuple[float, float, tuple[int, ...]]:
        """Best score, loss of the second best, ids of the best: what the search below pops first, without an agenda.

        The heuristic is exact, so the second best leaves the best path once, where that costs least.
        """
        arcs, best = self.forward(chunk)
        at, loss, tail = len(chunk), math.inf, ()
        while at:
            ways = [(-best[start] - score, ids[::-1], start) for start, ids, score in arcs[at]]
            if len(ways) > 1:
                ways.sort()
                loss = min(loss, ways[1][0] - ways[0][0])
            _, ids, at = ways[0]
            tail += ids
        return best[-1], loss, tail[::-1]

    def n_best(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """(score, ids) of the n best segmentations, the best first; equal ones by their ids from the end."""
        arcs, best = self.forward(chunk)
        agenda, out = [(-best[-1], (), len(chunk), 0.0)], []
        while agenda and len(out) < n:
            _, tail, at, done = heapq.heappop(agenda)
            if not at:
                out.append((done, tuple(reversed(tail))))
                continue
            for start, own, score in arcs[at]:
                heapq.heappush(agenda, (-(best[start] + score + done), tail + own[::-1], start, score + done))
        return out

    def spelled(self, ids: Iterable[int]) -> str:
        try:
            return "".join([self.text[i] for i in ids])
        except KeyError:
            pass
        out, raw = [], bytearray()
        for i in ids:
            if i in self.bytes:
                raw.append(self.bytes[i])
            else:
                if raw:
                    out.append(raw.decode("utf-8", "replace"))
                    raw.clear()
                out.append(self.text[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        return self.spelled(ids).removeprefix(" ")


class Lattice:
    """The lattices of many units at once: arcs that end at one place of all units are found and weighed together.

    A piece is found by a hash of its characters, which grows to the left. What the hash says is checked once the best
    segmentation is known: a unit that its pieces don't spell is done again without it.
    """

    BITS = 20

    def __init__(self, vocabulary: Vocabulary):
        pieces = list(vocabulary.piece.items())
        self.most = max(len(t) for t, _ in pieces)
        rng = np.random.default_rng(11)
        self.power = rng.integers(1, 2**63, self.most, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        hashes = np.array([self.hash(t) for t, _ in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.ids = np.array([x[0] for _, x in pieces], np.int32)[order]
        self.scores = np.array([x[1] for _, x in pieces])[order]
        # By the first bits of a hash: whether there is a piece, and where those pieces begin in the list.
        slots = self.hashes >> np.uint64(64 - self.BITS)
        self.there = np.zeros(1 << self.BITS, bool)
        self.there[slots] = True
        self.first = np.searchsorted(slots, np.arange(1 << self.BITS, dtype=np.uint64)).astype(np.int32)
        self.deepest = int(np.unique(slots, return_counts=True)[1].max())

    def hash(self, piece: str) -> int:
        return sum((ord(c) + 1) * int(self.power[i]) for i, c in enumerate(reversed(piece))) % 2**64

    def codes(self, units: list[str], width: int) -> np.ndarray:
        """Character codes by place and unit, 0 beyond the end."""
        out = np.zeros((len(units), width), np.uint64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        out[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32) + np.uint64(1)
        return np.ascontiguousarray(out.T)

    def found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, places in the list of pieces) where h is the hash of a piece."""
        slot = h >> np.uint64(64 - self.BITS)
        at = np.flatnonzero(self.there[slot])
        h, place = h[at], self.first[slot[at]]
        for _ in range(1, self.deepest):  # a slot has few pieces; the next ones follow
            place += (self.hashes[place] < h) & (place + 1 < len(self.hashes))
        hit = self.hashes[place] == h
        return at[hit], place[hit]

    def best_two(self, units: list[str]) -> Iterator[tuple[list, list, list, list]]:
        """Blocks of units, best scores, losses of the second best, packed ids of the best. A unit with a character
        that has no piece is left out."""
        units = sorted(units, key=len)
        for lo in range(0, len(units), 8192):
            yield self._best_two(units[lo : lo + 8192])

    def _best_two(self, units: list[str]) -> tuple[list, list, list, list]:
        sizes, n = np.array([len(u) for u in units], np.int64), len(units)
        width = int(sizes.max())
        codes = self.codes(units, width)
        best, last = np.full((width + 1, n), -np.inf), np.full((width + 1, n), -1, np.int32)
        loss, step = np.full((width + 1, n), np.inf), np.zeros((width + 1, n), np.int64)
        best[0] = 0
        for end in range(1, width + 1):
            top, second, own, size = best[end], np.full(n, -np.inf), last[end], step[end]
            h = np.zeros(n, np.uint64)
            for length in range(1, min(end, self.most) + 1):
                h += codes[end - length] * self.power[length - 1]
                rows, place = self.found(h)
                value, ids = best[end - length][rows] + self.scores[place], self.ids[place]
                old = top[rows]
                wins = (value > old) | ((value == old) & (ids < own[rows]))
                second[rows] = np.maximum(second[rows], np.where(wins, old, value))
                won = rows[wins]
                top[won], own[won], size[won] = value[wins], ids[wins], length
            with np.errstate(invalid="ignore"):
                loss[end] = np.where(np.isneginf(second), np.inf, top - second)
        whole = np.arange(n)
        at, least, path, count = sizes.copy(), np.full(n, np.inf), np.zeros((n, width), np.int32), np.zeros(n, np.int64)
        failed = np.zeros(n, bool)
        while (going := np.flatnonzero((at > 0) & ~failed)).size:
            here = at[going]
            failed[going] = step[here, going] == 0
            least[going] = np.minimum(least[going], loss[here, going])
            path[going, width - 1 - count[going]] = last[here, going]
            count[going] += 1
            at[going] = here - step[here, going]
        raw, row, good = path.tobytes(), 4 * width, np.flatnonzero(~failed)
        packed = [raw[row * (i + 1) - 4 * c : row * (i + 1)] for i, c in zip(good.tolist(), count[good].tolist(), strict=True)]
        return [units[i] for i in good.tolist()], best[sizes, whole][good].tolist(), least[good].tolist(), packed


def prepared(text: str) -> str:
    """A space in front, as the model was made for; its space symbol is a space. Nothing for an empty text."""
    return " " + text.replace("▁", " ") if text else ""


class Units(dict):
    """The place of each unit met (a chunk, or a part of a long one) in lists of what is known about its best segmentation."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.lattice = vocabulary, Lattice(vocabulary)
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.score, self.loss, self.packed = array("d"), array("d"), []
        self.spelled = bytearray()

    def add(self, units: list[str], scores: list[float], losses: list[float], packed: list[bytes]) -> None:
        self.update(zip(units, range(len(self.packed), len(self.packed) + len(units)), strict=True))
        self.score.extend(scores)
        self.loss.extend(losses)
        self.packed += packed
        ids, spelled = array("i", b"".join(packed)), self.vocabulary.spelled
        if spelled(ids) == "".join(units):
            self.spelled += bytes([1]) * len(units)
        else:
            self.spelled += bytes(spelled(array("i", x)) == u for u, x in zip(units, packed, strict=True))

    def of(self, text: str) -> list[str]:
        """The units of a text. Their lattices are independent."""
        out = _CHUNK.findall(prepared(text))
        if len(max(out, key=len, default="")) > MOST_CHARS:
            out = [u for c in out for u in ([c] if len(c) <= MOST_CHARS else self.vocabulary.split(c))]
        return out

    def learn(self, units: list[str]) -> None:
        new = list(set(units).difference(self))
        for block in self.lattice.best_two([u for u in new if len(u) <= MOST_CHARS]):
            self.add(*block)
        for unit in new:
            if unit not in self:  # long, or with a character that takes bytes
                score, loss, ids = self.vocabulary.best_two(unit)
                self.add([unit], [score], [loss], [array("i", ids).tobytes()])


class Encoder:
    def __init__(self, path: str, n: int):
        self.vocabulary, self.n = Vocabulary(path), n
        self.units, self.lists = Units(self.vocabulary), {}

    def options(self, unit: str) -> list[tuple[float, bytes]]:
        """(score, packed ids) of a unit's n best segmentations."""
        found = self.lists.get(unit)
        if found is None:
            found = [(score, array("i", ids).tobytes()) for score, ids in self.vocabulary.n_best(unit, self.n)]
            if len(unit) <= MOST_CHARS:
                self.lists[unit] = found
        return found

    def encode(self, text: str) -> list[tuple[float, bytes]]:
        """(score, packed ids) of the n best."""
        return self.encoded([text])[0][1]

    def encoded(self, texts: list[str]) -> list[tuple[bool, list[tuple[float, bytes]]]]:
        """For each text: whether its best segmentation spells it, and (score, packed ids) of the n best."""
        if len(self.units) + len(self.lists) > MOST_UNITS:
            self.units.clear(), self.lists.clear()
        cut = [self.units.of(t) for t in texts]
        whole = list(chain.from_iterable(cut))
        self.units.learn(whole)
        at = np.fromiter(map(self.units.__getitem__, whole), np.int64, len(whole))
        scores, losses, spelled = (np.frombuffer(x, k)[at] for x, k in ((self.units.score, np.float64), (self.units.loss, np.float64), (self.units.spelled, bool)))
        out, end = [], 0
        for own in cut:
            start, end = end, end + len(own)
            out.append((bool(spelled[start:end].all()), self._combined(own, at[start:end], scores[start:end], losses[start:end])))
        return out

    def _combined(self, own: list[str], at: np.ndarray, scores: np.ndarray, losses: np.ndarray) -> list[tuple[float, bytes]]:
        best, total = list(map(self.units.packed.__getitem__, at.tolist())), math.fsum(scores.tolist())
        combos: list[tuple[float, dict[int, bytes]]] = [(0.0, {})]
        most = self.n - 1
        able = np.flatnonzero(losses <= np.partition(losses, most - 1)[most - 1]) if len(losses) > most > 0 else np.arange(len(losses) if most else 0)
        for i in able[np.argsort(losses[able], kind="stable")][:most].tolist():  # the least losses, of equal ones the first
            if losses[i] == math.inf:
                continue
            options = self.options(own[i])
            merged = [(loss + options[0][0] - score, {**other, i: ids} if j else other) for loss, other in combos for j, (score, ids) in enumerate(options)]
            combos = heapq.nsmallest(self.n, merged, key=lambda x: x[0])
        out = []
        for loss, changes in combos:
            path = list(best) if changes else best
            for i, ids in changes.items():
                path[i] = ids
            out.append((total - loss, b"".join(path)))
        return out


_encoders: list[tuple[str, int, Encoder]] = []


def _encoder(path: str, n: int) -> Encoder:
    if not _encoders or _encoders[0][:2] != (path, n):
        _encoders[:] = [(path, n, Encoder(path, n))]
    return _encoders[0][2]


def slices(texts: Iterator[bytes], rows: int = 200, size: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in lists of so many rows, or of about size bytes."""
    own, held = [], 0
    for b in texts:
        own.append(b.decode("utf-8", "replace"))
        held += len(b)
        if len(own) == rows or held >= size:
            yield own
            own, held = [], 0
    if own:
        yield own


def _lists(rows: list[list], kind: pa.DataType) -> pa.Array:
    """Lists of numbers (bytes of little-endian ints for int32) as one Arrow array."""
    if kind != pa.int32():
        return pa.array(rows, pa.list_(kind))
    ends = np.cumsum([0, *(len(x) // 4 for x in rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def _encoded(path: str, n: int, keep: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, n)
        for batch in batches:
            at = 0
            for texts in slices(texts_of(batch["text"])):
                made = encoder.encoded(texts)
                found = [x for _, x in made]
                columns = [
                    batch["doc_id"].slice(at, len(texts)),
                    pa.array([len(x[0][1]) // 4 for x in found], pa.int64()),
                    pa.array([x[0][0] for x in found], pa.float64()),
                    _lists([[s for s, _ in x] for x in found], pa.float64()),
                    _lists([[zlib.crc32(ids) for _, ids in x] for x in found], pa.int64()),
                    pa.array([x for x, _ in made], pa.bool_()),
                ]
                if keep:
                    kept = [x[:keep] for x in found]
                    ends = np.cumsum([0, *map(len, kept)], dtype=np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), _lists([ids for x in kept for _, ids in x], pa.int32())))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(x.split()[0] for x in RESULT.split(", ")), *(["ids"] if keep else [])])

    return run


def n_best_encoding(docs: DataFrame, model: str, n: int = N_BEST, keep: int | None = None) -> DataFrame:
    """doc_id and RESULT for each row, and ids: those of each of the first keep (by default all) of the n best segmentations.

    n_pieces and score are the best's; ids_crc32 is over little-endian 32-bit ids; round_trip says whether the pieces
    of the best spell the text again (the model's own space symbol comes back as a space). Of segmentations with equal
    scores the one with the smaller ids from the end comes first within a unit, and over units the one that changes the
    first. A null or empty text has one empty segmentation with score 0. A very long text is encoded whole. Equal rows
    get equal results; an empty table gives no rows; other columns are not read.
    """
    keep = n if keep is None else keep
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_batches(rows, _encoded(model, n, keep), f"doc_id long, {RESULT}" + (", ids array<array<int>>" if keep else ""))


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids array<int>); null ids give a null text, no ids an empty one.

    Equal rows get equal texts; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _encoder(model, N_BEST).vocabulary
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [None if x is None else vocabulary.decode(x) for x in part["ids"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return in_batches(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), run, "doc_id long, text string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)
