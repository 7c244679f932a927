"""N-best pieces and token counts of a whole table against plain dynamic programming over whole texts."""

import heapq
import math
import zlib
from array import array

import numpy as np
import pytest

from quillon.llm import pieces, queries, tokencount
from quillon.llm.common import table

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(pieces.default_model())


def spelt(vocabulary, char):
    found = vocabulary.piece.get(char)
    return ((found[0],), found[1]) if found else (tuple(vocabulary.byte_id[b] for b in char.encode()), pieces.BYTE_SCORE * len(char.encode()))


def plain(vocabulary, text, n=4):
    """The n best scores of a text, and the fewest pieces with the best one, over the lattice of the whole text."""
    text, longest = (" " + text.replace("▁", " ") if text else ""), max(map(len, vocabulary.piece))
    best, fewest = [[0.0]], [(0.0, 0)]
    for end in range(1, len(text) + 1):
        ids, score = spelt(vocabulary, text[end - 1])
        arcs = [(end - 1, len(ids), score)]
        for start in range(end - 2, max(-1, end - longest - 1), -1):
            if text[start + 1] in " \n" and text[start] != " ":
                break  # no piece has a space after another character, nor a line break beside one
            if found := vocabulary.piece.get(text[start:end]):
                arcs.append((start, 1, found[1]))
        best.append(heapq.nlargest(n, [s + score for start, _, score in arcs for s in best[start]]))
        fewest.append(max((round(fewest[start][0] + score, 9), fewest[start][1] - k) for start, k, score in arcs))
    return best[-1], -fewest[-1][1]


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, TINY, "documents").collect()}


@pytest.fixture(scope="module")
def wanted(texts, vocabulary):
    return {i: plain(vocabulary, t) for i, t in texts.items()}


def test_n_best_of_a_table(spark, vocabulary, texts, wanted):
    for r in queries.op6_n_best_pieces(spark, TINY).collect():
        want, _ = wanted[r["doc_id"]]
        assert np.allclose(r["scores"], want, rtol=1e-12) and math.isclose(r["score"], want[0], rel_tol=1e-12)
        assert r["round_trip"] and len(r["ids_crc32"]) == len(want) == len(set(r["ids_crc32"]))
        assert vocabulary.decode(r["ids"][0]) == texts[r["doc_id"]] and r["n_pieces"] == len(r["ids"][0])
        assert zlib.crc32(array("i", r["ids"][0]).tobytes()) == r["ids_crc32"][0]
        assert math.isclose(sum(spelt(vocabulary, vocabulary.text[i])[1] if i in vocabulary.text else pieces.BYTE_SCORE for i in r["ids"][0]), want[0], rel_tol=1e-9)


def test_all_segmentations_are_different_and_score_as_said(spark, vocabulary):
    docs = table(spark, TINY, "documents").limit(40)
    for r in pieces.n_best_encoding(docs, pieces.default_model()).collect():
        assert len({tuple(x) for x in r["ids"]}) == len(r["ids"]) == len(r["scores"])
        for ids, score, crc in zip(r["ids"], r["scores"], r["ids_crc32"], strict=True):
            own = sum(vocabulary.piece[vocabulary.text[i]][1] if i in vocabulary.text else pieces.BYTE_SCORE for i in ids)
            assert math.isclose(own, score, rel_tol=1e-9) and zlib.crc32(array("i", ids).tobytes()) == crc
            assert vocabulary.decode(ids) == vocabulary.decode(r["ids"][0])


def test_token_counts_of_a_table(spark, wanted):
    for r in queries.op8_token_counts(spark, TINY).collect():
        want, fewest = wanted[r["doc_id"]]
        assert math.isclose(r["score"], want[0], rel_tol=1e-9, abs_tol=1e-9) and r["n_tokens"] == fewest


ODD = ["", "é日本語𝕏x\x00y", "▁a▁▁b", "x" * 400, "日本" * 90 + " end", "\n\n  \n", "a\nb", " lead", "ﬁ\t\x0b", "😀" * 70, "ab" * 40 + "𝕏"]


def test_odd_texts_equal_the_plain_version(vocabulary):
    encoder, trie = pieces.Encoder(pieces.default_model(), 4), tokencount.Trie(vocabulary)
    for text, (spells, found) in zip(ODD, encoder.encoded(ODD), strict=True):
        want, fewest = plain(vocabulary, text)
        assert np.allclose([s for s, _ in found], want) and spells and vocabulary.decode(array("i", found[0][1])) == text.replace("▁", " ")
        tokens = pieces._CHUNK.findall(pieces.prepared(text))
        assert sum(trie[t][0] for t in tokens) == fewest and math.isclose(sum(trie[t][1] for t in tokens), want[0], abs_tol=1e-9)


def test_units_at_once_equal_units_one_by_one(spark, vocabulary):
    """Scores, losses and ids of the array version are those of the plain search."""
    units = pieces.Units(vocabulary)
    for r in table(spark, TINY, "documents").limit(60).collect():
        units.learn(units.of(r["text"] or ""))
    assert len(units) > 1000
    for unit, at in units.items():
        score, loss, ids = vocabulary.best_two(unit)
        assert units.score[at] == score and units.loss[at] == loss and tuple(array("i", units.packed[at])) == ids


def test_equal_rows_and_other_columns(spark):
    rows = spark.createDataFrame([(1, "to be or not", "x"), (1, "to be or not", "y"), (None, None, "z"), (2, "", None)], "doc_id long, text string, score string")
    found = pieces.n_best_encoding(rows, pieces.default_model()).collect()
    assert found[0] == found[1] and [(r["n_pieces"], r["score"], r["ids"]) for r in found[2:]] == [(0, 0.0, [[]])] * 2
    counted = tokencount.token_counts(rows, pieces.default_model()).collect()
    assert counted[0] == counted[1] and [tuple(r)[1:] for r in counted[2:]] == [(0, 0, 0.0)] * 2
    back = spark.createDataFrame([(1, found[0]["ids"][0], "x"), (None, None, "y"), (3, [], "z"), (1, found[0]["ids"][0], "x")], "doc_id long, ids array<int>, text string")
    assert [tuple(r) for r in pieces.decoded(back, pieces.default_model()).collect()] == [(1, "to be or not"), (None, None), (3, ""), (1, "to be or not")]
    assert pieces.decoded(back.limit(0), pieces.default_model()).collect() == []
