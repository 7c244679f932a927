"""License scans: fuzzy search of short notices, by exact seeds and bounded-error matching.

Texts become words in lower case with one space between. A notice that may have k edits is cut into k + 1 seeds: by
the pigeonhole principle one of them is intact wherever the notice stands with at most k edits. An Aho-Corasick
automaton finds the seeds of all notices in one pass; around each, the regex library looks for the notice with at
most k edits, from the start of a word to the end of one, and reports where it stands. Words that tell one license
from another, names, numbers and the like, must stand unedited. Texts without a seed, nearly all, cost that one pass.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches
from .kernels import texts_of

#: Phrases of the contract, found exactly, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: The method's own short notices, in words, and their labels.
NOTICES = {
    "apache license version 2 0": "apache-2.0",
    "apache license version 1 1": "apache-1.1",
    "apache license version 1 0": "apache-1.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "licensed under cc by": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by nd": "cc-by-nd",
    "licensed under cc by nc sa": "cc-by-nc-sa",
    "licensed under cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
}
#: Words that tell licenses apart, with all numbers: no edit is taken in them.
TELLING = {"apache", "mit", "gnu", "lesser", "cc", "by", "nc", "sa", "nd", "mozilla", "commons"}
#: Characters of a notice for each edit that it may have.
PER_EDIT = 10
_UPPER = {c: c + 32 for c in range(65, 91)}
_TABLE = bytes(_UPPER.get(c, c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32) for c in range(256))
RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,end_word:long,edits:int>>"


def words_of(b: bytes) -> list[bytes]:
    return b.translate(_TABLE).split()


def _told(word: str) -> bool:
    return word in TELLING or word.isdigit()


class Notices:
    def __init__(self, notices: dict[str, str], per_edit: int = PER_EDIT):
        import ahocorasick
        import regex

        self.seeds, self.find = ahocorasick.Automaton(), []
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (text, label) in enumerate(notices.items()):
            k = len(text) // per_edit
            cuts = [len(text) * j // (k + 1) for j in range(k + 2)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                at[text[lo:hi]].append((i, lo))
            parts = [(told, " ".join(words)) for told, words in groupby(text.split(), _told)]
            own = [regex.escape(x, literal_spaces=True) if told else f"(?:{regex.escape(x, literal_spaces=True)}){{e<={k}}}" for told, x in parts]
            needed = [f" {x} " for told, x in parts if told]
            self.find.append((regex.compile("(?b) " + " ".join(own) + " "), needed, len(text), k, label))
        for seed, uses in at.items():
            self.seeds.add_word(seed, (len(seed), uses))
        self.seeds.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, str, int, float]]:
        """(start, end, label, edits, similarity) of the notices in text, which has a space between words and at both ends.

        Each seed has a window of its own, in which the notice may begin up to k characters beside where it would
        without edits: too short for two of them, so the best match of a window is all that there is.
        """
        seen, out = set(), set()
        for end, (size, uses) in self.seeds.iter(text):
            for i, offset in uses:
                start = end + 1 - size - offset
                if (i, start) in seen:
                    continue
                seen.add((i, start))
                pattern, needed, length, k, label = self.find[i]
                lo, hi = max(0, start - k - 1), start + length + k + 1
                window = text[lo:hi]
                if all(x in window for x in needed) and (m := pattern.search(window)):
                    edits = sum(m.fuzzy_counts)
                    if edits <= k:
                        out.add((lo + m.start() + 1, lo + m.end() - 1, label, edits, 1 - edits / length))
        return _apart(list(out))


def _apart(spans: list[tuple]) -> list[tuple]:
    """Of spans that overlap, the one with the fewest edits (then the longest) stays."""
    out, cluster, end = [], [], -1
    for span in [*sorted(spans), None]:
        if span is None or span[0] >= end:
            taken = []
            for x in sorted(cluster, key=lambda x: (x[3], x[0] - x[1], x)):
                if all(x[1] <= y[0] or y[1] <= x[0] for y in taken):
                    taken.append(x)
            out += sorted(taken)
            cluster = []
        if span:
            cluster.append(span)
            end = max(end, span[1])
    return out


_held: list = []


def scan(b: bytes, phrases: dict[str, str], notices: dict[str, str]) -> tuple:
    """The columns of RESULT for one text."""
    if not _held or _held[0] != notices:
        _held[:] = [notices, Notices(notices)]
    words = words_of(b)
    joined = b" " + b" ".join(words) + b" "
    starts, base = [], set()
    for phrase, label in phrases.items():
        target = f" {phrase} ".encode()
        at, before, n = joined.find(target), 0, 0
        while at >= 0:
            n += joined.count(b" ", before, at)
            before = at
            starts.append(n)
            base.add(label)
            at = joined.find(target, at + 1)
    text = joined.decode("utf-8", "replace")
    spans, labels, score = [], set(base), float(bool(base))
    at = n = 0
    for lo, hi, label, edits, similarity in _held[1].spans(text):
        lo, hi = lo + (text[lo] == " "), hi - (text[hi - 1] == " ")  # a space at an end is no part of the notice
        n += text.count(" ", at, lo + 1)
        at = lo + 1
        spans.append({"label": label, "first_word": n - 1, "end_word": n + text.count(" ", lo + 1, hi), "edits": edits})
        labels.add(label)
        score = max(score, similarity)
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans)


def _scanned(phrases: dict[str, str], notices: dict[str, str]) -> Callable:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(f"doc_id long, {RESULT}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if made := [scan(b, phrases, notices) for b in texts_of(batch["text"])]:
                columns = [pa.array(v, f.type) for v, f in zip(zip(*made, strict=True), list(schema)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], schema=schema)

    return run


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """doc_id and RESULT for each row. spans: where the fuzzy notices stand, in words from 0, with their edits.

    A null or empty text has no words, no labels and score 0; a document without labels has empty strings; score is 1
    where a phrase stands exactly, else the best notice's share of characters without an edit. Of notices that overlap
    the one with the fewest edits stays, then the longest, then the first. A very long text is searched whole. Equal
    rows get equal results; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_batches(rows, _scanned(phrases or PHRASES, notices or NOTICES), f"doc_id long, {RESULT}")
